"""Documents into chunks, and whether fragments are found in their sources word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.written import cut

FLOOR = 25
WINDOW = 12
_PIECE = 4_000


# fixed values: notes as <sup>n</sup>, and the 1 to 3 digits that one leaves after a full stop or quotation mark
NOTE = r"<sup>\d+</sup>"
NOTE_DIGITS = r"(?<=[.\"”])\d{1,3}$"


def clean_footnotes(text: Column) -> Column:
    """The text without its notes' numbers."""
    return F.regexp_replace(F.regexp_replace(text, NOTE, ""), NOTE_DIGITS, "")


#: A document's spine: headings that match ``parts`` open a part, under which sections nest; ``furniture`` (running page
#: headers) is passed over as if it weren't there; ``exclude`` opens matter that is left out up to the next part or section;
#: where ``only`` has patterns, nothing but the sections that match one contributes. ``marker`` (bullet or numbered) tells which list
#: items count. All patterns are searched for within a heading's text.
PROFILE = "profile string, label string, parts array<string>, furniture array<string>, exclude array<string>, only array<string>, marker string"

BULLET = r"(?s)^\s*[-*]\s+(.*)$"
NUMBER = r"(?s)^\s*\d+\.\s+(.*)$"
BOUNDARIES = ("part", "section", "excluded")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _any_of(patterns: str, text: Column) -> Column:
    return F.coalesce(F.exists(patterns, lambda p: F.regexp(text, p)), F.lit(False))


def line_kinds(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """lines (doc, profile, n, line) with their profile's columns, kind (part, section, excluded, blank, item, para) and body: a heading's or an item's
    text. Furniture is gone."""
    said, heading = stripped(F.col("line")), stripped(F.regexp_replace(stripped(F.col("line")), "^[# ]+", ""))
    marker = F.when(F.col("marker") == "numbered", F.regexp_extract("line", NUMBER, 1)).otherwise(F.regexp_extract("line", BULLET, 1))
    is_item = F.when(F.col("marker") == "numbered", F.col("line").rlike(NUMBER)).otherwise(F.col("line").rlike(BULLET))
    kind = (
        F.when(said.startswith("#"), F.when(_any_of("furniture", heading), "furniture").when(_any_of("parts", heading), "part").when(_any_of("exclude", heading), "excluded").otherwise("section"))
        .when(said == "", "blank").when(is_item, "item").otherwise("para")
    )
    d = lines.join(profiles, "profile").withColumn("kind", kind).filter("kind <> 'furniture'")
    clean = stripped(clean_footnotes(stripped(F.regexp_replace(marker, NOTE, ""))))
    return d.withColumn("body", F.when(F.col("kind") == "item", clean).when(F.col("kind").isin(*BOUNDARIES), heading))


def chunk_lines(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """doc, label, part, section, run, group, n, body of the list items that make up chunks.

    A run is a list that no blank or other line interrupts. An item that starts in lower case is a clause of the one
    above it in its run. Of a numbered document only the first run after each part, section or excluded heading counts: detached numbers below it
    are notes and references. State that a reader would keep from line to line is window functions along the document."""
    along = Window.partitionBy("doc").orderBy("n")
    d = line_kinds(lines, profiles)
    boundary = F.col("kind").isin(*BOUNDARIES)
    d = d.withColumn("region", F.sum(boundary.cast("int")).over(along)).withColumn("run", F.sum((F.col("kind") != "item").cast("int")).over(along))
    d = d.withColumn("part", F.last(F.when(F.col("kind") == "part", F.col("body")), ignorenulls=True).over(along))
    d = d.withColumn("under", F.last(F.when(boundary, F.struct("kind", "body")), ignorenulls=True).over(along))
    d = d.withColumn("section", F.when(F.col("under.kind") == "section", F.col("under.body")))
    items = d.filter("kind = 'item'").withColumn("first_run", F.min("run").over(Window.partitionBy("doc", "region")))
    items = items.filter((F.col("marker") != "numbered") | (F.col("run") == F.col("first_run")))
    items = items.filter((F.col("under.kind") != "excluded") & F.coalesce("section", "part").isNotNull())
    items = items.filter((F.coalesce(F.size("only"), F.lit(0)) <= 0) | _any_of("only", F.coalesce("section", F.lit(""))) & F.col("section").isNotNull())
    within = Window.partitionBy("doc", "run").orderBy("n")
    new = (F.row_number().over(within) == 1) | ~F.col("body").rlike(r"^\P{L}*\p{Ll}")
    return items.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(within)).select("doc", "label", "part", "section", "run", "group", "n", "body")


def chunk_documents(lines: DataFrame, profiles: DataFrame, floor: int = FLOOR) -> DataFrame:
    """doc, label, part, section, lead_in, ordinal (from 0 within the document), body, source_lines.

    A chunk is an item with its clauses. One that ends in a colon is no chunk, it leads in the later ones of its run. An item
    that stands alone, without clauses and lead-in, has at least ``floor`` characters."""
    d = chunk_lines(lines, profiles).groupBy("doc", "run", "group").agg(F.first("label").alias("label"), F.first("part").alias("part"), F.first("section").alias("section"), F.array_sort(F.collect_list(F.struct("n", "body"))).alias("lines"))
    d = d.withColumn("source_lines", F.transform("lines", lambda x: x["body"])).withColumn("body", stripped(F.array_join("source_lines", " ")))
    leads = F.when(F.col("body").endswith(":"), stripped(F.regexp_replace("body", ":+$", "")))
    before = Window.partitionBy("doc", "run").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("lead_in", F.last(leads, ignorenulls=True).over(before)).filter(~F.col("body").endswith(":"))
    d = d.filter(F.col("lead_in").isNotNull() | (F.size("lines") > 1) | (F.length("body") >= floor))
    ordinal = F.row_number().over(Window.partitionBy("doc").orderBy("run", "group")) - 1
    return d.select("doc", "label", "part", "section", "lead_in", ordinal.alias("ordinal"), "body", "source_lines")


def normalized(text: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _windows(rows: DataFrame, key: str) -> DataFrame:
    """key, w: the windows' hashes, repeats within a text included. A look-ahead finds the windows at all places in one
    pass; long texts are cut into pieces that overlap, so that few windows are held at a time."""
    pieces = F.explode(F.expr(f"transform(sequence(0, greatest(0, length(said) - {WINDOW}), {_PIECE}), p -> substr(said, p + 1, {_PIECE + WINDOW - 1}))"))
    d = rows.filter(F.length("said") >= WINDOW).select(key, pieces.alias("piece"))
    d = d.select(key, F.explode(F.expr(f"regexp_extract_all(piece, '(?=(.{{{WINDOW}}}))', 1)")).alias("said"))
    return d.select(key, F.xxhash64("said").alias("w"))


def verbatim_coverage(fragments: DataFrame, sources: DataFrame, floor: float = 0.9) -> DataFrame:
    """fragment, coverage, suspect: the greatest share of a fragment's windows of 12 characters found in one source.

    Windows are told by a 64-bit hash. Those of the sources meet the wanted ones (written, so that Spark knows whether
    they are few enough to broadcast) where they are read, and only what is left is moved."""
    f = cut(_windows(fragments.select("fragment", normalized("text").alias("said")), "fragment").distinct(), "fragments")
    total = f.groupBy("fragment").agg(F.count("*").alias("total"))
    wanted = cut(f.select("w").distinct(), "wanted")
    s = _windows(sources.select("source", normalized("text").alias("said")), "source").join(wanted, "w", "left_semi").distinct()
    hits = s.join(f, "w").groupBy("fragment", "source").agg(F.count("*").alias("k")).groupBy("fragment").agg(F.max("k").alias("k"))
    d = total.join(hits, "fragment", "left").withColumn("coverage", F.coalesce("k", F.lit(0)) / F.col("total"))
    return d.select("fragment", "coverage", (F.col("coverage") < floor).alias("suspect"))


def embed_input(label: str = "label", part: str = "part", section: str = "section", lead_in: str = "lead_in", body: str = "body") -> Column:
    """The text that stands for a chunk where it is embedded: the path to it, as far as there is one, and its body."""
    return F.concat(F.concat_ws(" > ", *[F.when(F.col(c) != "", F.col(c)) for c in (label, part, section, lead_in)]), F.lit(": "), F.col(body))
