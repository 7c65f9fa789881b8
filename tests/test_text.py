"""Documents into chunks, against a reading line by line."""

import re

from pyspark.sql import functions as F

from strandlog.operators import text as X
from strandlog.plans import evidence
from strandlog.plans.views import Views

MANUAL = """# Contents
- An entry of a contents list that is no flag at all
# Part One
- A flag right below a part, long enough to stand.
## Transfers
- Funds are sent to many accounts that have no apparent link.12
- too short, but a clause of the one above it
- Short one
# Page 7 of the manual
- Funds go on after the page's header, in the same list.<sup>3</sup>

- Where accounts are new, any of these:
- Cash
- Wires
A line of prose ends the list and its lead-in.
- Gold
# Annex A
- A list below an excluded heading, which nobody reads.
## Cards
1. A number where bullets count, therefore no flag at all.
* A star is a bullet as good as any dash, of course it is."""

NUMBERED = """# Flags
Some prose.
1. The first flag of the list, which is long enough.
2. the second is a clause of it
# Page 2
3. The third flag of the very same list of flags.

4. A note below the list, detached, so it's no flag.
# Flags again
5. Another section has a first list of its own here.
# Notes
6. Not one of the sections that may contribute to it."""


def plain_chunks(doc, profile):
    """(part, section, lead_in, body) in order, by the state that a reader keeps from line to line."""
    item = re.compile(r"^\s*\d+\.\s+(.*)$" if profile["marker"] == "numbered" else r"^\s*[-*]\s+(.*)$")
    some = lambda kind, head: any(re.search(p, head) for p in profile[kind])
    out, runs, state, fresh, current = [], [], (None, None, False), True, None
    for line in doc.split("\n"):
        said = line.strip()
        if said.startswith("#"):
            head = said.lstrip("# ").strip()
            if some("furniture", head):
                continue
            current, fresh = None, True
            state = (head, None, False) if some("parts", head) else (state[0], None, True) if some("exclude", head) else (state[0], head, False)
        elif found := item.match(line):
            if current is None and (fresh or profile["marker"] != "numbered"):
                current, fresh = [], False
                runs.append((state, current))
            if current is not None:
                current.append(re.sub(r"(?<=[.\"”])\d{1,3}$", "", re.sub(r"<sup>\d+</sup>", "", found[1]).strip()).strip())
        else:
            current = None
    for (part, section, left_out), run in runs:
        if left_out or (part is None and section is None) or profile["only"] and not (section and some("only", section)):
            continue
        groups, lead = [], None
        for body in run:
            first = next((c for c in body if c.isalpha()), "")
            groups[-1].append(body) if first.islower() and groups else groups.append([body])
        for group in groups:
            body = " ".join(group).strip()
            if body.endswith(":"):
                lead = body.rstrip(":").strip()
            elif lead is not None or len(group) > 1 or len(body) >= 25:
                out.append((part, section, lead, body))
    return out


def profile(**changes):
    return {"profile": "p", "label": "Manual", "parts": ["^Part "], "furniture": ["^Page "], "exclude": ["^Annex ", "^Contents$"], "only": [], "marker": "bullet"} | changes


def chunked(spark, doc, p):
    rows = spark.createDataFrame([(1, "p", n, line) for n, line in enumerate(doc.split("\n"))], "doc long, profile string, n int, line string")
    found = X.chunk_documents(rows, spark.createDataFrame([p], X.PROFILE)).orderBy("ordinal").collect()
    assert [r.ordinal for r in found] == list(range(len(found))) and all(r.body == " ".join(r.source_lines).strip() for r in found)
    return [(r.part, r.section, r.lead_in, r.body) for r in found]


def test_a_manual_with_bullets(spark):
    found = chunked(spark, MANUAL, profile())
    assert found == plain_chunks(MANUAL, profile())
    assert [x[:3] for x in found] == [
        ("Part One", None, None), ("Part One", "Transfers", None), ("Part One", "Transfers", None),
        ("Part One", "Transfers", "Where accounts are new, any of these"), ("Part One", "Transfers", "Where accounts are new, any of these"), ("Part One", "Cards", None),
    ]
    assert found[1][3] == "Funds are sent to many accounts that have no apparent link. too short, but a clause of the one above it"


def test_a_numbered_advisory(spark):
    p = profile(marker="numbered", only=["^Flags"])
    found = chunked(spark, NUMBERED, p)
    assert found == plain_chunks(NUMBERED, p) and [x[1] for x in found] == ["Flags", "Flags", "Flags again"]


def test_all_documents_equal_the_plain_reading(spark, data):
    v = Views(spark, data)
    whole = v.table("documents").count()
    docs = evidence.lines(v).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l")).collect()
    expected = {(d.doc, k): x for d in docs for k, x in enumerate(plain_chunks("\n".join(y.line for y in d.l), dict(zip([c.split()[0] for c in X.PROFILE.split(", ")], evidence.PROFILES[d.doc % 3]))))}
    found = {(r.doc, r.ordinal): (r.part, r.section, r.lead_in, r.body) for r in evidence.chunks(v).collect()}
    assert found == expected and len(docs) == whole and len(found) > 100


def test_the_path_to_a_chunk_comes_before_it(spark):
    d = spark.createDataFrame([("Manual", "One", None, "", "Body")], "label string, part string, section string, lead_in string, body string")
    assert d.select(X.embed_input().alias("said")).first().said == "Manual > One: Body"
