"""Line dedup: later copies of repeated line runs are deleted, found by a suffix array over line ids.

Texts are sequences of line ids (lines without a word are skipped; ids come from 128 bits of the line's hashes). Only
lines that occur twice or more can be part of a repeated run, so the suffixes of the others are left out at once. The
array is built by prefix doubling: the rank of a suffix by its first 2h lines is that of the pair of ranks (by its first
h, by the h lines after). Each round sorts the distinct pairs that occur twice, numbers them in order and joins the
numbers back; suffixes whose pair is unique leave.

A run counts if it has at least ``min_words`` words. A line belongs to such a run, repeated from an earlier place, just
if it lies in a shortest stretch of at least that many words that starts or ends at some line of the run, itself
repeated from an earlier place. A stretch of T lines spans the array's interval of suffixes whose common prefix is at
least T lines, and that interval is named by two ranks that overlap: by the first h lines and by the last h of the T, h
the greatest power of two within T. Its earliest suffix stays, the others' lines are deleted; stretches that touch merge
into the maximal runs. As every line has a word, T is at most ``min_words``, so there are log2(min_words) rounds however
long the runs are. The first copy of every line stays somewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import as_row, save, text_of, words_of

MIN_WORDS = 50
_DOC = ["doc_id", "text_hash"]
_BLANKS = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, seq (among the lines with a word), line (from 0), n_words, h1, h2; equal rows count once."""
    d = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    d = d.withColumn("lines", F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(_BLANKS)).alias("said"))))
    d = d.select(*_DOC, F.posexplode(F.filter("lines", lambda x: x["said"] != "")).alias("seq", "at"))
    odd = reduce(lambda a, b: a | b, [F.contains("said", F.lit(c)) for c in "\t\x0b\x0c\r"])
    d = d.select(*_DOC, "seq", "at.line", F.col("at.said").alias("said"))
    plain = F.array_remove(F.split("said", " "), "")
    return d.select(
        *_DOC, "seq", "line", F.when(odd, F.size(words_of(F.col("said")))).otherwise(F.size(plain)).alias("n_words"),
        F.xxhash64("said").alias("h1"), F.xxhash64(F.lit(1), "said").alias("h2"),
    )


def _numbered(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds rank, increasing along ``by``. Saved at once, as the numbers depend on how rows were partitioned."""
    return save(keys.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def _same_doc(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """The join of a and b by document and ``by``, whose columns stay once; null ids equal each other."""
    b = b.select(*[F.col(c).alias(f"__{c}") if c in (*_DOC, *by) else F.col(c) for c in b.columns])
    on = [F.col("doc_id").eqNullSafe(F.col("__doc_id")), *(F.col(c) == F.col(f"__{c}") for c in ("text_hash", *by))]
    return a.join(b, on).drop("__doc_id", "__text_hash", *(f"__{c}" for c in by))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, first, last: the runs of lines (numbered from 0) to delete; maximal and apart."""
    lines = save(_lines(docs), "lines")
    distinct = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    ids = _numbered(distinct.select("h1", "h2"), ["h1", "h2"], "line-ids")
    # rows that are equal altogether are one document
    once = lines.join(ids, ["h1", "h2"]).select(*_DOC, "seq", "line", "n_words", "rank").dropDuplicates([*_DOC, "seq"])
    suffixes = save(once, "line-suffixes")
    along = Window.partitionBy(*_DOC).orderBy("seq")

    # ranks by the first 1, 2, 4, ... lines
    ranks, level, width = [], suffixes.select(*_DOC, "seq", "rank"), 1
    while True:
        ranks.append(level.withColumn("width", F.lit(width)))
        if 2 * width > min_words:
            break
        # a text's suffixes that are left need not follow one another, so the later one is looked up by place
        later = F.last(F.struct("seq", "rank")).over(along.rangeBetween(width, width))
        pairs = level.withColumn("later", later).filter("later is not null").select(*_DOC, "seq", F.col("rank").alias("r1"), F.col("later.rank").alias("r2"))
        twice = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2")
        numbered = _numbered(twice, ["r1", "r2"], "line-ranks")
        level = save(pairs.join(numbered, ["r1", "r2"]).select(*_DOC, "seq", "rank"), "line-level")
        width *= 2
        if level.isEmpty():
            break
    ranks = reduce(DataFrame.unionByName, ranks)

    # the shortest stretches of enough words from and to each line, over lines that follow one another
    def reach(order, step: int):
        ahead = F.collect_list(F.struct("seq", "n_words")).over(Window.partitionBy(*_DOC).orderBy(order).rowsBetween(0, min_words - 1))
        grow = (
            f"aggregate(ahead, named_struct('n', 0, 'words', 0L), (a, x) -> case when a.words < {min_words} and x.seq = seq + {step} * a.n "
            "then named_struct('n', a.n + 1, 'words', a.words + x.n_words) else a end)"
        )
        return suffixes.withColumn("ahead", ahead).select(*_DOC, "seq", F.expr(grow).alias("got")).filter(F.col("got.words") >= min_words)

    forward = reach(F.col("seq"), 1).select(*_DOC, "seq", F.col("got.n").alias("n"))
    backward = reach(F.col("seq").desc(), -1).select(*_DOC, (F.col("seq") - F.col("got.n") + 1).alias("seq"), F.col("got.n").alias("n"))
    stretches = forward.union(backward).distinct().withColumn("width", F.expr("cast(shiftleft(1, cast(floor(log2(n + 0.5D)) as int)) as int)"))
    begins = ranks.withColumnRenamed("rank", "begin")
    ends = ranks.select(*_DOC, F.col("seq").alias("end_seq"), "width", F.col("rank").alias("end"))
    named = _same_doc(stretches, begins, "seq", "width").withColumn("end_seq", F.col("seq") + F.col("n") - F.col("width"))
    named = save(_same_doc(named, ends, "end_seq", "width").select(*_DOC, "seq", "n", "begin", "end"), "line-stretches")
    place = F.struct(*_DOC, "seq")
    earliest = named.groupBy("n", "begin", "end").agg(F.min(place).alias("earliest"))
    later = named.join(earliest, ["n", "begin", "end"]).filter(place > F.col("earliest"))
    gone = later.select(*_DOC, F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("seq")).distinct()

    # neighbours merge
    gone = _same_doc(gone, suffixes.select(*_DOC, "seq", "line"), "seq")
    islands = gone.withColumn("island", F.col("seq") - F.row_number().over(along))
    return islands.groupBy(*_DOC, "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("island")


def _cut(docs: DataFrame, min_words: int) -> DataFrame:
    """row (a struct of the columns of docs), runs (array of the first and last lines cut) and left (the text less these)."""
    runs = repeated_runs(docs, min_words)
    runs = runs.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    d = docs.select(as_row(docs), "doc_id", F.xxhash64(text_of()).alias("text_hash")).alias("d")
    d = d.join(runs.alias("r"), F.expr("d.doc_id <=> r.doc_id and d.text_hash = r.text_hash"), "left")
    cut = F.array_join(F.expr(r"filter(split(row.text, '\n'), (x, i) -> not exists(r.runs, y -> i between y.first and y.last))"), "\n")
    none = F.expr("cast(array() as array<struct<first: int, last: int>>)")
    return d.select("row", F.coalesce("r.runs", none).alias("runs"), F.when(F.col("r.runs").isNull(), F.col("row.text")).otherwise(cut).alias("left"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, runs_as: str = "runs") -> DataFrame:
    """docs with the later copies of repeated runs cut out of text, and an array of the (first, last) lines cut as ``runs_as``.

    Lines are split at \\n and compared without the white space around them; a line without a word goes only if it lies
    within a run. Earlier means smaller doc_id (null first), then smaller text hash, then line. Rows with equal doc_id
    and text count as one document and get equal results. A null text stays null.
    """
    d = _cut(docs, min_words)
    return d.select(*[F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], F.col("runs").alias(runs_as))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted lines, the runs deleted (first-last of each), and the text that is left."""
    d = dedup_lines(docs.select("doc_id", "text", F.size(F.split(text_of(), "\n")).cast("long").alias("n_lines")))
    deleted = F.expr("aggregate(runs, 0L, (a, r) -> a + r.last - r.first + 1)")
    runs = F.array_join(F.expr("transform(runs, r -> concat(r.first, '-', r.last))"), ",")
    return d.select("doc_id", "n_lines", deleted.alias("n_deleted"), runs.alias("runs"), "text")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with the copies cut out, n_chars anew, less the rows that nothing is left of; same columns, whatever these are
    called. Rows that nothing was cut from stay as they are, null and empty texts too."""
    d = _cut(docs, MIN_WORDS).filter((F.size("runs") == 0) | (F.btrim("left", F.lit(_BLANKS)) != ""))
    anew = {"text": F.col("left"), "n_chars": F.when(F.size("runs") == 0, F.col("row.n_chars")).otherwise(F.length("left"))} if "n_chars" in docs.columns else {"text": F.col("left")}
    return d.select(*[anew[c].alias(c) if c in anew else F.col(f"row.`{c}`") for c in docs.columns])
