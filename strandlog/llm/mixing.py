"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``rate = target / source size`` times in the mix. The expected copies are
prefix-summed along a fixed order within the source, one random offset in [0, 1) is added per source, and a document
is emitted once for each integer boundary its interval crosses: floor(offset + rate * k) - floor(offset + rate * (k - 1))
for the k-th document. The order goes by size class first, so that the copies are spread evenly over short and long
documents and the words taken stay within a few documents of the target.

The prefix sum needs no task that sees a whole source: documents are counted by (source, size class, slice), the counts
are summed ahead of each slice, and only the rows of one slice are numbered together. 256 slices by a hash of doc_id
split a source that holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import as_row, n_words_of, save, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, target. ``sizes`` has source, source_size.

    Sources by code point, null last, get the weights in turn and share ``share`` of all sizes by weight; a target
    stops at ``most`` times its source's size and what exceeds it is shared again by weight. The level that this ends
    at is where the capped sources' caps and the others' weights add up to the whole, which is the largest of the
    levels got by capping the 0, 1, 2, ... sources of least cap per weight. An empty source gets 0.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    least_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = least_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = least_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    return (
        sizes.withColumn("weight", given[((F.row_number().over(every) - 1) % len(weights)).cast("int")])
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("pot", F.sum("source_size").over(all_rows) * F.lit(share))
        .withColumn("level", (F.col("pot") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.max("level").over(all_rows))
        .select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))
    )


def _offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the source and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("")).cast("binary")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def copies_per_document(sized: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """Adds size's source_size, target and copies to ``sized`` (doc_id, source, size and any others).

    Null sources form one source. Rows with the same doc_id are told apart by their size only: equal rows are
    interchangeable, so which of them is taken has no effect. An empty table gives an empty table.
    """
    binary = F.bin("size")
    keyed = sized.withColumn("_class", F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 1, 4)))
    keyed = keyed.withColumn("_slice", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2))
    keyed = save(keyed, "mix-sized")
    slices = keyed.groupBy("source", "_class", "_slice").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    slices = save(slices, "mix-slices")
    classes = slices.groupBy("source", "_class").agg(F.sum("n").alias("class_n"))
    ahead = Window.partitionBy("source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("class_at", F.coalesce(F.sum("class_n").over(ahead), F.lit(0)))
    within = Window.partitionBy("source", "_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("slice_at", F.coalesce(F.sum("n").over(within), F.lit(0)))
    starts = starts.alias("s").join(classes.alias("c"), F.expr("s.source <=> c.source and s._class = c._class"))
    goal = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), **targets).alias("g")
    starts = starts.join(goal, F.expr("s.source <=> g.source")).select(
        "s.source", "s._class", "s._slice", "g.source_size", "g.target", (F.col("slice_at") + F.col("class_at")).alias("_at")
    )
    order = Window.partitionBy("source", "_class", "_slice").orderBy("size", "doc_id")
    numbered = keyed.withColumn("_k", F.row_number().over(order))
    numbered = numbered.alias("d").join(starts.alias("p"), F.expr("d.source <=> p.source and d._class = p._class and d._slice = p._slice"))
    rate = F.when(F.col("p.source_size") > 0, F.col("p.target") / F.col("p.source_size")).otherwise(0.0)
    k = F.col("_at") + F.col("_k")
    u = _offset(F.col("d.source"), seed)
    copies = F.floor(u + rate * k) - F.floor(u + rate * (k - 1))
    kept = [F.col(f"d.`{c}`") for c in sized.columns]
    return numbered.select(*kept, F.col("p.source_size"), F.col("p.target"), F.least(F.lit(MAX_COPIES), copies).cast("long").alias("copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every document."""
    sized = docs.select("doc_id", "source", n_words_of(text_of()).alias("size"))
    out = copies_per_document(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, repeated as often as they are taken, with the columns they came with, whatever these are
    called. Documents without a source are one source, those without words or of an empty source are not taken; a null
    doc_id is an id like others. Rows that share doc_id, source and size are taken as often as one of them, chosen by a hash of the text.
    """
    sized = docs.select("doc_id", "source", n_words_of(text_of()).alias("size"))
    n = copies_per_document(sized).groupBy("doc_id", "source", "size").agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
    rows = docs.select(as_row(docs), "doc_id", "source", n_words_of(text_of()).alias("size"), F.xxhash64("text").alias("text_hash")).alias("d")
    rows = rows.join(n.alias("n"), F.expr("d.doc_id <=> n.doc_id and d.source <=> n.source and d.size = n.size"))
    taken = F.expr("_copies[pmod(text_hash, size(_copies))]").cast("int")
    return rows.select("row", taken.alias("taken")).filter("taken > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("taken")))).select("row.*")


SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
         (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end)::double as weight
  from sized group by source
), leveled as (
  select *, cast(source_size * 2 as double) as cap,
    ((sum(source_size) over ())::double * 1.5::double - coalesce(sum((source_size * 2)::double) over (
       order by (source_size * 2)::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by (source_size * 2)::double / weight, source nulls last rows between current row and unbounded following) as level
  from sources
), goals as (
  select source, source_size, least(cap, max(level) over () * weight) as target from leveled
), placed as (
  select doc_id, source, size, row_number() over (partition by source order by
    lpad(length(bin(size))::varchar, 2, '0') || substr(bin(size), 1, 4), substr(md5(doc_id::varchar), 1, 2), size, doc_id) as k
  from sized
), rated as (
  select p.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0.0::double end as rate,
    ('0x' || substr(md5('mix' || coalesce('=' || p.source, '')), 1, 8))::bigint::double / 4294967296.0::double as u
  from placed p join goals g on p.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  cast(size * least(2, floor(u + rate * k) - floor(u + rate * (k - 1))) as bigint) as taken
from rated
"""
