"""Quality rules by the divergence of a document's distributions from those of its language.

Two histograms of every document are held against the same histograms of all documents in its language: character
classes, and the language's most common words with one bin for all others. The Jensen-Shannon distance (the root of the
divergence in bits, 0 to 1) of each must stay within a limit. Short texts are too noisy for that: below ``min_words``
words a document is judged by the base rules alone.

Every language has a reference of its own, however few documents it has, and documents without one share one; so a
verdict depends on the documents of the same language alone. References have ``top_words`` rows for each language and
are joined by key; Spark broadcasts them only where their size, known as they are saved, allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import as_row, save, text_of, words_of

MIN_WORDS = 60
TOP_WORDS = 32
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.45
CLASSES = ("n_upper", "n_digits", "n_symbols", "n_points", "n_spaces", "n_extra_bytes", "n_rest")


_ODD = "\t\x0b\x0c\r"


def _split_words(text: str) -> Column:
    """The words of a text column. Where blanks and line ends are its only white space, as nearly always, no pattern is
    needed to split it."""
    odd = reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in _ODD])
    plain = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")
    return F.when(odd, words_of(F.col(text))).otherwise(plain)


def _ref(lang: str = "lang") -> Column:
    """The key of a language's reference; that of no language differs from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ref, a hash of the text, the base counts and the character classes of every row."""
    less = lambda pattern: F.length("special") - F.length(F.regexp_replace("special", pattern, ""))
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text")).withColumn("ref", _ref())
    d = d.withColumn("words", _split_words("text")).withColumn("special", F.regexp_replace("text", r"""[^A-Z0-9#*$%&|<>.,;:!?'"()-]+""", ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    d = d.select(
        "doc_id", "lang", "ref", "words", F.xxhash64("text").alias("text_hash"),
        F.length("text").cast("long").alias("n_chars"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        less(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        less("[A-Z]+").cast("long").alias("n_upper"),
        less("[0-9]+").cast("long").alias("n_digits"),
        less(r"""[.,;:!?'"()-]+""").cast("long").alias("n_points"),
        (F.octet_length("text") - F.length("text")).cast("long").alias("n_extra_bytes"),
        F.expr(
            "case when size(words) < 3 then array() else slice(zip_with(zip_with(words, slice(words, 2, size(words)), (a, b) -> xxhash64(a, b)), "
            "slice(words, 3, size(words)), (a, b) -> xxhash64(a, b)), 1, size(words) - 2) end"
        ).alias("windows"),
    )
    # windows that differ in their hashes differ; only those with an equal hash in the text are looked at word by word
    same = lambda what, by: f"filter(sequence(0, size({what}) - 1), k -> {what}[k].{by} = get({what}, k - 1).{by} or {what}[k].{by} = get({what}, k + 1).{by})"
    d = d.withColumn("hashed", F.expr("case when size(array_distinct(windows)) < size(windows) then sort_array(transform(windows, (h, i) -> struct(h as h, i as i))) end"))
    d = d.withColumn("placed", F.expr(f"sort_array(transform(transform({same('hashed', 'h')}, k -> hashed[k].i), i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) as w, i as i)))"))
    repeated = f"size(array_distinct(flatten(transform({same('placed', 'w')}, k -> sequence(placed[k].i, placed[k].i + 2)))))"
    d = d.withColumn("n_repeat_words", F.expr(f"case when size(placed) > 0 then {repeated} else 0 end").cast("long"))
    d = d.withColumn("n_spaces", F.col("n_chars") - F.col("word_chars"))
    d = d.withColumn("n_rest", F.col("word_chars") - F.col("n_upper") - F.col("n_digits") - F.col("n_symbols") - F.col("n_points"))
    return d.drop("words", "windows", "hashed", "placed")


def _half(p: str, q: str) -> str:
    """What a bin adds to the divergence, in bits."""
    part = lambda a: f"case when {a} > 0 then 0.5 * {a} * log2(2 * {a} / ({p} + {q})) else 0D end"
    return f"({part(p)} + {part(q)})"


def _distance(divergence: str) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.expr(divergence)))


def quality(docs: DataFrame, min_words: int = MIN_WORDS, top_words: int = TOP_WORDS, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, and the two distances (null below min_words).

    A null or empty text has no words and fails the base rules. Documents without a lang are held against one another.
    Equal rows get equal verdicts. Columns other than doc_id, text and lang are ignored.
    """
    base = save(base_counts(docs), "quality-base")
    said = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text")).withColumn("ref", _ref())
    said = said.select("doc_id", "ref", F.xxhash64("text").alias("text_hash"), F.explode(_split_words("text")).alias("word"))
    counts = said.groupBy("ref", "word").agg(F.count("*").alias("n"))
    first = lambda by: Window.partitionBy(*by).orderBy(F.desc("n"), "word")
    common = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))
    common = common.withColumn("rank", F.row_number().over(first(["ref", "part"]))).filter(F.col("rank") <= top_words)
    common = common.withColumn("rank", F.row_number().over(first(["ref"]))).filter(F.col("rank") <= top_words)
    classes = base.groupBy("ref").agg(F.sum("n_words").alias("ref_words"), *[F.sum(c).alias(f"ref_{c}") for c in CLASSES])
    classes = save(classes, "quality-classes")
    common = common.join(classes.select("ref", "ref_words"), "ref")
    common = save(common.select("ref", "word", "rank", (F.col("n") / F.col("ref_words")).alias("q")), "quality-common")

    # reference words are found by a 64-bit hash of language and word, which is one long to look up
    ids = common.select(F.xxhash64("ref", "word").alias("word_hash"), F.col("ref").alias("word_ref"), "rank")
    seen = said.withColumn("word_hash", F.xxhash64("ref", "word")).join(ids, "word_hash")
    seen = seen.groupBy("doc_id", "text_hash", "word_ref", "rank").agg(F.count("*").alias("n"))
    seen = seen.groupBy("doc_id", "text_hash", F.col("word_ref").alias("ref")).agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("seen"), F.sum("n").alias("hits"))
    # equal rows were counted together
    copies = base.groupBy("doc_id", "text_hash", "ref").agg(F.count("*").alias("copies"))
    seen = copies.alias("c").join(seen.alias("s"), F.expr("c.doc_id <=> s.doc_id and c.text_hash = s.text_hash and c.ref = s.ref"))
    seen = seen.select("c.*", "s.seen", "s.hits")
    refs = classes.join(common.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("rank", "q"))).alias("common")), "ref", "left")
    refs = save(refs.withColumn("q", F.expr("transform(coalesce(common, array()), x -> x.q)")).withColumn("q_sum", F.expr("aggregate(q, 0D, (a, x) -> a + x)")).drop("common"), "quality-refs")

    d = base.alias("b").join(seen.alias("s"), F.expr("b.doc_id <=> s.doc_id and b.text_hash = s.text_hash and b.ref = s.ref"), "left")
    d = d.select("b.*", F.expr("coalesce(s.seen, array())").alias("seen"), F.expr("b.n_words * coalesce(s.copies, 1)").alias("seen_words"), F.expr("coalesce(s.hits, 0L)").alias("hits")).join(refs, "ref")
    bytes_of = " + ".join(CLASSES)
    of_ref = " + ".join(f"ref_{c}" for c in CLASSES)
    d = d.withColumn("all_bytes", F.expr(f"nullif(cast({bytes_of} as double), 0D)")).withColumn("ref_bytes", F.expr(f"nullif(cast({of_ref} as double), 0D)"))
    d = d.withColumn("class_distance", _distance(" + ".join(_half(f"({c} / all_bytes)", f"(ref_{c} / ref_bytes)") for c in CLASSES)))
    d = d.withColumn("p_other", F.expr("(seen_words - hits) / nullif(seen_words, 0)"))
    terms = f"aggregate(seen, 0D, (a, x) -> a + {_half('(x.n / nullif(seen_words, 0))', 'q[x.rank - 1]')} - 0.5 * q[x.rank - 1])"
    d = d.withColumn("word_distance", _distance(f"{terms} + 0.5 * q_sum + {_half('p_other', '(1 - q_sum)')}"))
    d = d.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    judged = F.col("n_words") >= min_words
    far = (F.col("class_distance") > max_class) | (F.col("word_distance") > max_word)
    return d.select(
        "doc_id", "text_hash", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~(judged & far)).alias("kept"),
        F.when(judged, F.col("class_distance")).alias("class_distance"), F.when(judged, F.col("word_distance")).alias("word_distance"),
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    return quality(docs).drop("text_hash", "lang", "class_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns they came with, whatever these are called; equal rows all stay or all go."""
    kept = quality(docs).filter("kept").select("doc_id", "text_hash", "lang").distinct()
    given = docs.select(as_row(docs), "doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64(text_of()).alias("text_hash"))
    on = F.expr("d.doc_id <=> k.doc_id and d.text_hash = k.text_hash and d.lang <=> k.lang")
    return given.alias("d").join(kept.alias("k"), on, "left_semi").select("row.*")


def _sql_bin(p: str, q: str) -> str:
    return f"(case when {p} > 0 then 0.5 * {p} * log2(2 * {p} / ({p} + {q})) else 0 end + case when {q} > 0 then 0.5 * {q} * log2(2 * {q} / ({p} + {q})) else 0 end)"


SQL = rf"""
with d as (
  select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), positions as (
  select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i, len(ws) as n from d
), windows as (
  select doc_id, i, n, w, lead(w, 1) over o as w1, lead(w, 2) over o as w2 from positions window o as (partition by doc_id order by i)
), repeated as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, w, w1, w2) as c from windows where i + 2 < n) where c > 1
), repeats as (
  select doc_id, count(distinct i + k) as n_repeat_words from repeated, (values (0), (1), (2)) t(k) group by doc_id
), lines as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), base as (
  select doc_id, lang, length(text) as n_chars, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) as n_upper,
    length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) as n_digits,
    length(text) - length(regexp_replace(text, '[.,;:!?''"()-]+', '', 'g')) as n_points,
    strlen(text) - length(text) as n_extra_bytes,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join repeats using (doc_id) left join lines using (doc_id)
), counted as (
  select *, n_chars - word_chars as n_spaces, word_chars - n_upper - n_digits - n_symbols - n_points as n_rest, coalesce('=' || lang, '') as ref from base
), refs as (
  select ref, sum(n_words) as ref_words, {', '.join(f'sum({c}) as ref_{c}' for c in CLASSES)} from counted group by ref
), words as (
  select ref, w, count(*) as n from positions join counted using (doc_id) group by ref, w
), common as (
  select ref, w, n / ref_words as q from (select *, row_number() over (partition by ref order by n desc, w) as r from words)
  join refs using (ref) where r <= {TOP_WORDS}
), said as (
  select doc_id, ref, w, count(*) as c from positions join counted using (doc_id) group by doc_id, ref, w
), hits as (
  select doc_id, sum(c) as hits, sum({_sql_bin('(c / n_words)', 'q')} - 0.5 * q) as part
  from said join common using (ref, w) join counted using (doc_id, ref) group by doc_id
), sums as (
  select ref, sum(q) as q_sum from common group by ref
), judged as (
  select c.*, sqrt(greatest(0, {' + '.join(_sql_bin(f'({c} / ({" + ".join(CLASSES)}))', f'(ref_{c} / ({" + ".join("ref_" + x for x in CLASSES)}))') for c in CLASSES)})) as class_distance,
    sqrt(greatest(0, coalesce(part, 0) + 0.5 * coalesce(q_sum, 0) + {_sql_bin('((n_words - coalesce(hits, 0)) / n_words)', '(1 - coalesce(q_sum, 0))')})) as word_distance
  from counted c join refs using (ref) left join sums using (ref) left join hits using (doc_id) where n_words >= {MIN_WORDS}
)
select c.doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words,
  (c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words) as base_failed,
  not (c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words)
    and not coalesce(j.class_distance > {MAX_CLASS_DISTANCE} or j.word_distance > {MAX_WORD_DISTANCE}, false) as kept
from counted c left join judged j using (doc_id)
"""
