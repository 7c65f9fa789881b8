"""Secret scans: patterns, and a battery of randomness tests with length-aware false-discovery control.

The base spans are those of three patterns. Besides, every run of 20 or more characters of the encodings' alphabets is
a candidate, unless it overlaps a base span. Its encoding is inferred (hex, base32, base64 with either pair of marks)
and its symbols are tested for what random bytes would look like: chi-squared uniformity over the kinds of characters
and over the alphabet, the runs test on high and low symbols, and lag-1 serial correlation. The score is the least of the
four p-values times four: spread over (0, 1] for random strings, near 0 for words and names.

How often ordinary language reaches a score is measured, not assumed. Every different document yields a decoy for each
encoding: a piece of its own text, at a place and of a length that follow from its hash, written the way identifiers and
paths are (run together, with marks, or capitalised). A candidate's p-value is the share of decoys of its encoding and
length band that score as high, plus one over their number plus one; short decoys score higher by chance, so short
candidates get a stricter threshold. The Benjamini-Hochberg procedure over a stratum's different candidates then keeps
the expected share of false ones among the secrets within ``Q``. A stratum with too few decoys, or too few candidates
that stand out, has no secrets. Only a histogram of STEPS bins per stratum is gathered, 3 * len(BANDS) * STEPS rows at
most for any corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import save, text_of

# fixed values: the patterns of the base kinds, in the order in which kinds are listed
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=\ue001-]{20,}"  # or a mark over a base span
KINDS = ("assign", "access", "hex", "random")

Q = 0.05
STEPS = 50
BANDS = (20, 24, 32, 48, 80, 160)  # the lengths at which strata begin, and the end of decoys
CHUNK = 64  # matches
_MARK, _OVER = "\ue000", "\ue001"
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _pieces(pattern: str) -> Column:
    """The column said cut at a pattern's matches, in chunks: what is before a match, the match, and so on to an end that
    is empty. What follows the last match is left out.

    Matches are set off by a mark that the text has not. Chunks of CHUNK matches keep running sums short, so that the
    work grows with the text and not with its square; each begins where the one before ends."""
    marked = F.regexp_replace("said", pattern, f"{_MARK}$0{_MARK}")
    chunks = F.regexp_extract_all(marked, F.lit(f"\\G(?:[^{_MARK}]*+{_MARK}[^{_MARK}]*+{_MARK}){{1,{CHUNK}}}+"), F.lit(0))
    return F.transform(chunks, lambda c: F.split(c, _MARK))


def _running(lengths: Column) -> Column:
    """0 and the sums of the first one, two, ... of a short array of numbers."""
    return F.aggregate(lengths, F.expr("array(0)"), lambda a, x: F.array_append(a, F.get(a, F.size(a) - 1) + x))


def _spans(pieces: str, kind: int) -> Column:
    """start, kind, end and what was said of every match, leftmost first."""
    parts = F.transform(pieces, lambda p: F.struct(p.alias("p"), _running(F.transform(p, F.length)).alias("at")))
    chunks = F.arrays_zip(parts.alias("part"), _running(F.transform(pieces, lambda p: F.length(F.array_join(p, "")))).alias("from"))
    span = lambda start, x: F.struct((start + x["at"]).alias("start"), F.lit(kind).alias("kind"), (start + x["at"] + F.length(x["p"])).alias("end"), x["p"].alias("said"))
    of = lambda c: F.transform(F.filter(F.arrays_zip(c["part"]["p"].alias("p"), c["part"]["at"].alias("at")), lambda x, i: i % 2 == 1), lambda x: span(c["from"], x))
    # the running sums are one more than the chunks, and those of a chunk one more than its pieces, of which the last is no match
    full = F.filter(chunks, lambda c: c["part"].isNotNull())
    return F.filter(F.flatten(F.transform(full, of)), lambda x: x["said"].isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (array of spans), candidates (array of spans) of every row of docs.

    A candidate that overlaps a base span is none. Those of access and hex are made of a candidate's characters, so they
    lie within it. Those of assign are written over by a mark first; no candidate starts where one ends, and one that ends
    where it starts would go on into it, so a run that holds a mark is what overlaps."""
    d = docs.select("doc_id", text_of().alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.replace(F.replace("text", F.lit(_MARK), F.lit("\ufffd")), F.lit(_OVER), F.lit("\ufffd")).alias("said"))
    d = d.select("*", _pieces(ASSIGN).alias("a"), _pieces(ACCESS).alias("c"), _pieces(HEX).alias("h"))
    long = lambda p: F.length(F.regexp_extract(p, ASSIGN, 2)) >= 6
    d = d.select("doc_id", "text_hash", "said", "a", F.filter(_spans("a", 0), lambda x: long(x["said"])).alias("assign"), _spans("c", 1).alias("access"), _spans("h", 2).alias("hex"))
    over = F.array_join(F.flatten(F.transform("a", lambda c: F.transform(c, lambda p, i: F.when((i % 2 == 1) & long(p), F.repeat(F.lit(_OVER), F.length(p))).otherwise(p)))), "")
    d = d.withColumn("over", F.when(F.size("assign") > 0, over))
    rest = F.expr("substring(said, length(over) + 1)")
    d = d.select("doc_id", "text_hash", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.when(F.col("over").isNull(), F.col("said")).otherwise(F.concat("over", rest)).alias("said"))
    d = d.select("doc_id", "text_hash", "base", _pieces(CANDIDATE).alias("pieces"))
    return d.select("doc_id", "text_hash", "base", F.filter(_spans("pieces", 3), lambda x: ~x["said"].rlike(f"{_OVER}|{ACCESS}|{HEX}")).alias("candidates"))


def _upper(z: str) -> str:
    """The normal distribution's tail above z, by the usual rational approximation of the error function."""
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1 / (1 + 0.3275911D * {x}))"
    half = f"(0.5D * {t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))) * exp(-{x} * {x}))"
    return f"case when {z} >= 0 then {half} else 1 - {half} end"


def _chi_tail(chi: str, freedom: str) -> str:
    """The tail of the chi-squared distribution, by the cube-root normal approximation."""
    return _upper(f"((power({chi} / {freedom}, 1D / 3) - (1 - 2D / (9 * {freedom}))) / sqrt(2D / (9 * {freedom})))")


def randomness(candidates: DataFrame) -> DataFrame:
    """Adds encoding, n and p to candidates (said)."""
    c = candidates.withColumn("code", F.regexp_replace("said", "=+$", ""))
    c = c.withColumn("encoding", F.expr("case when code rlike '^([0-9a-f]+|[0-9A-F]+)$' then 'hex' when code rlike '^[A-Z2-7]+$' then 'base32' else 'base64' end"))
    c = c.withColumn("code", F.expr("case when encoding = 'hex' then lower(code) when encoding = 'base64' then translate(code, '-_=', '+/+') else code end"))
    letters = F.create_map(*[F.lit(x) for pair in _ALPHABETS.items() for x in pair])
    c = c.withColumn("alphabet", letters[F.col("encoding")]).withColumn("size", F.length("alphabet").cast("double")).withColumn("n", F.length("code"))
    c = c.filter("n >= 16")
    c = c.withColumn("v", F.expr("transform(filter(split(code, ''), x -> x <> ''), x -> instr(alphabet, x) - 1)"))
    # chi-squared over kinds of characters: expected shares follow from the alphabet
    count = lambda col, pattern: f"cast(length(regexp_replace({col}, '[^{pattern}]+', '')) as double)"
    kinds = [("A-Z", "upper"), ("a-z", "lower"), ("0-9", "digit"), ("+/", "mark")]
    for pattern, name in kinds:
        c = c.withColumn(f"n_{name}", F.expr(count("code", pattern))).withColumn(f"e_{name}", F.expr(f"n * {count('alphabet', pattern)} / size"))
    c = c.withColumn("chi_kinds", F.expr(" + ".join(f"case when e_{x} > 0 then power(n_{x} - e_{x}, 2) / e_{x} else 0D end" for _, x in kinds)))
    c = c.withColumn("free_kinds", F.expr("case when encoding = 'base64' then 3D else 1D end"))
    c = c.withColumn("sorted", F.array_sort("v"))
    squares = "aggregate(sorted, named_struct('last', -1, 'k', 0L, 'sum', 0L), (a, x) -> case when x = a.last then named_struct('last', x, 'k', a.k + 1, 'sum', a.sum + 2 * a.k + 1) else named_struct('last', x, 'k', 1L, 'sum', a.sum + 1) end).sum"
    c = c.withColumn("chi", F.expr(f"size / n * {squares} - n")).withColumn("free", F.expr("(size - 1) * n / (n - 1)"))
    c = c.withColumn("chi", F.expr("greatest(0D, chi * n / (n - 1))"))
    c = c.withColumn("high", F.expr("transform(v, x -> int(2 * x >= size))"))
    c = c.withColumn("n1", F.expr("cast(aggregate(high, 0, (a, x) -> a + x) as double)")).withColumn("n0", F.expr("n - n1"))
    c = c.withColumn("runs", F.expr("1D + size(filter(sequence(1, n - 1), i -> high[i] <> high[i - 1]))"))
    c = c.withColumn("mu", F.expr("2 * n1 * n0 / n + 1"))
    c = c.withColumn("z_runs", F.expr("(runs - mu) / sqrt(nullif((mu - 1) * (mu - 2) / (n - 1), 0D))"))
    c = c.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x) / n"))
    c = c.withColumn("spread", F.expr("aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean))"))
    c = c.withColumn("lagged", F.expr("aggregate(sequence(1, n - 1), 0D, (a, i) -> a + (v[i] - mean) * (v[i - 1] - mean))"))
    c = c.withColumn("z_serial", F.expr("(lagged / nullif(spread, 0D) + 1D / n) * sqrt(n)"))
    two_sided = lambda z: f"2 * ({_upper(f'abs({z})')})"
    tests = [_chi_tail("chi_kinds", "free_kinds"), _chi_tail("chi", "free"), f"coalesce({two_sided('z_runs')}, 0D)", f"coalesce({two_sided('z_serial')}, 0D)"]
    for k, test in enumerate(tests):
        c = c.withColumn(f"p{k}", F.expr(test))
    return c.withColumn("p", F.least(F.lit(1.0), 4 * F.least("p0", "p1", "p2", "p3"))).select(*candidates.columns, "encoding", "n", "p")


def decoys(docs: DataFrame) -> DataFrame:
    """said: pieces of the documents' own text in the manner of identifiers, one per different text and encoding."""
    d = docs.select(F.xxhash64("text").alias("h"), F.col("text").alias("t")).filter("t is not null")
    h = lambda k: F.expr(f"xxhash64(h, {k})")
    band = F.pmod(h(1), F.lit(len(BANDS) - 1)).cast("int")
    edges = F.array(*[F.lit(x) for x in BANDS])
    d = d.withColumn("least", edges[band]).withColumn("length", (F.col("least") + F.pmod(h(2), edges[band + 1] - F.col("least"))).cast("int"))
    d = d.withColumn("piece", F.expr("substring(t, cast(1 + pmod(xxhash64(h, 3), greatest(1, length(t) - 6 * length)) as int), 6 * length)"))
    # words that the window cuts, and what could be a secret itself, are left out
    d = d.withColumn("piece", F.regexp_replace(F.regexp_replace("piece", r"^\S+|\S+$", ""), CANDIDATE, " "))
    d = d.select("h", "length", "piece").dropDuplicates(["h"])
    marks = F.array(*[F.lit(x) for x in ("", "_", "/", "-")])[F.pmod(h(4), F.lit(4)).cast("int")]
    words = F.when(F.pmod(h(5), F.lit(2)) == 0, F.initcap("piece")).otherwise(F.col("piece"))
    forms = F.array(
        F.regexp_replace(words, F.lit("[^A-Za-z0-9]+"), marks), F.regexp_replace(F.upper("piece"), "[^A-Z2-7]+", ""), F.regexp_replace(F.lower("piece"), "[^0-9a-f]+", ""),
    )
    return d.select("length", F.explode(forms).alias("form")).select(F.expr("substring(form, 1, length)").alias("said")).filter(f"length(said) >= {BANDS[0]}")


def _stratified(tested: DataFrame) -> DataFrame:
    """Adds band (by length without padding) and bin (by score) to tested strings."""
    band = " ".join(f"when n < {edge} then {k}" for k, edge in enumerate(BANDS[1:-1]))
    return tested.withColumn("band", F.expr(f"case {band} else {len(BANDS) - 2} end")).withColumn("bin", F.expr(f"cast(least({STEPS - 1}, floor(p * {STEPS})) as int)"))


def thresholds(tested: DataFrame, q: float = Q) -> DataFrame:
    """encoding, band, threshold: the bin from which on a stratum's candidates are secrets, if there is one. tested has a
    row for each different candidate and each decoy (decoy true)."""
    bins = tested.groupBy("encoding", "band", "bin").agg(F.count_if(~F.col("decoy")).alias("k"), F.count_if("decoy").alias("d"))
    held = bins.groupBy("encoding", "band").agg(F.collect_list(F.struct("bin", "k", "d")).alias("bins"), F.sum("k").alias("candidates"), F.sum("d").alias("decoys"))
    over = lambda col: f"aggregate(filter(bins, b -> b.bin >= t), 0L, (a, b) -> a + b.{col})"
    good = f"filter(sequence(1, {STEPS - 1}), t -> {over('k')} > 0 and (1D + {over('d')}) / (1D + decoys) * candidates <= {q} * {over('k')})"
    return held.select("encoding", "band", F.expr(f"get({good}, 0)").alias("threshold")).filter("threshold is not null")


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, base and found (arrays of spans by start, then kind) of every row of docs.

    Spans count code points, ends are exclusive. A null text is empty. Rows with equal doc_id and text get equal results.
    Other columns are ignored; an empty table gives an empty one.
    """
    scanned = save(scan(docs), "secret-spans")
    c = scanned.select("doc_id", "text_hash", F.explode("candidates").alias("c")).distinct().select("doc_id", "text_hash", "c.*")
    strings = c.select("said").distinct().withColumn("decoy", F.lit(False)).unionByName(decoys(docs).withColumn("decoy", F.lit(True)))
    tested = save(_stratified(randomness(strings)).select(F.when(~F.col("decoy"), F.col("said")).alias("said"), "decoy", "encoding", "band", "bin"), "secret-tests")
    limits = F.broadcast(thresholds(tested, q))  # at most a row per encoding and band
    passed = tested.filter("not decoy").join(limits, ["encoding", "band"]).filter("bin >= threshold").select("said")
    passed = c.join(passed, "said").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    s = scanned.alias("s").join(passed.alias("p"), F.expr("s.doc_id <=> p.doc_id and s.text_hash = p.text_hash"), "left")
    base = F.expr("transform(s.base, x -> struct(x.start as start, x.kind as kind, x.end as end))")
    return s.select("s.doc_id", base.alias("base"), F.array_sort(F.concat(base, F.coalesce("p.more", F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")))).alias("found"))


def _said(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    d = find_secrets(docs)
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return d.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_said("base"), 256).alias("base_sha256"), _said("found").alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_random"),
    )
