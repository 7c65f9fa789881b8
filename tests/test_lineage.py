"""Deep and branching lineages, certification as of an instant, instants out of range."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandlog.operators import certify as Z
from strandlog.operators import closure as C
from strandlog.operators import temporal as T

DAY = datetime(2020, 1, 1)


def _lineage(spark, edges, origins):
    b = spark.createDataFrame(origins, "belief_id long, originating_agent_id long")
    i = spark.createDataFrame([(b_, f, t, DAY, None) for b_, f, t in edges], "belief_id long, from_agent_id long, to_agent_id long, inherited_at timestamp, invalidated_at timestamp")
    return b, i


def test_a_deep_lineage_takes_few_rounds(spark, monkeypatch):
    """A chain of 10,000 heirs beside a bush, a loop that no originator feeds and an heir of nobody."""
    n, rounds = 10_000, []
    cut = C.cut
    monkeypatch.setattr(C, "cut", lambda df, name="cut": rounds.append(name) or cut(df, name))
    edges = [(1, k, k + 1) for k in range(n)] + [(2, k // 3, k) for k in range(1, 60)] + [(2, 101, 102), (2, 102, 101), (2, 900, 901)]
    found = C.inheritance_closure(*_lineage(spark, edges, [(1, 0), (2, 0), (3, 5)]))
    depth = {(r.belief_id, r.agent_id): r.depth for r in found.collect()}
    assert depth[1, n] == n and len(depth) == n + 1 + 60 + 1 and depth[3, 5] == 0 and (2, 101) not in depth and (2, 901) not in depth
    assert depth[2, 59] == 4 and not found.filter("truncated").count()
    assert rounds.count("lineage") <= 16


def test_chains_and_both_ways_agree_with_a_plain_walk(spark):
    """Random trees (by doubling) and graphs with two ways in and loops (by depth), against a walk along all paths."""
    rnd, edges = random.Random(2), []
    for b in range(6):
        for k in range(1, 14):
            edges.append((b, rnd.randrange(k), k))
        if b % 2:
            edges += [(b, rnd.randrange(14), rnd.randrange(1, 14)) for _ in range(2)] + [(b, 13, 0)] * (b == 3)
    expected = set()

    def walk(b, path):
        expected.add((b, path[-1], tuple(reversed(path))))
        if path[-1] not in path[:-1]:
            for x, f, t in edges:
                if x == b and f == path[-1]:
                    walk(b, [*path, t])

    for b in range(6):
        walk(b, [0])
    got = C.ancestor_chains(*_lineage(spark, edges, [(b, 0) for b in range(6)])).collect()
    assert {(r.belief_id, r.agent_id, tuple(r.chain)) for r in got} == expected


def test_certification_sees_the_state_of_its_instant(spark):
    """One belief, audited before an heir came, after, and after a revocation; a stored hash of today's world."""
    day = lambda k: DAY + timedelta(days=k)
    beliefs = spark.createDataFrame([(1, 10, day(0), "invalidated", day(9))], "belief_id long, originating_agent_id long, formed_at timestamp, status string, invalidated_at timestamp")
    edges = spark.createDataFrame([(1, 10, 11, day(1), None), (1, 11, 12, day(5), day(7))], "belief_id long, from_agent_id long, to_agent_id long, inherited_at timestamp, invalidated_at timestamp")
    agents = spark.createDataFrame([(10, 0), (11, 1), (12, 2)], "agent_id long, generation int")
    stored = Z.world_hash(C.inheritance_closure(beliefs, edges), agents).select("belief_id", "world_hash")
    audits = spark.createDataFrame([(1, day(k)) for k in (-1, 0, 3, 6, 8, 10)], "belief_id long, at timestamp")
    got = [(r.total, r.open, r.verified, r.agreement) for r in Z.certify_independently(audits, stored, beliefs, edges, agents).orderBy("at").collect()]
    assert got == [(0, 0, False, "disagreed"), (0, 0, False, "disagreed"), (1, 1, True, "disagreed"), (2, 2, True, "agreed"), (2, 1, False, "agreed"), (2, 1, False, "agreed")]


def test_an_instant_out_of_range_is_refused(spark):
    versions = spark.createDataFrame([("k", DAY, 1, False, 5)], "key string, commit_ts timestamp, seq long, deleted boolean, value int")
    old, new = F.lit(DAY - timedelta(days=9)), F.lit(DAY + timedelta(days=9))
    assert T.as_of_text(versions, f"{DAY:%Y-%m-%dT%H:%M:%S}", old, new).first().value == 5
    for text in ("1999-13-01T00:00:00", "now", "", "2001-01-01T00:00:00", "2090-01-01T00:00:00Z", "0.5"):
        with pytest.raises(ValueError):
            T.as_of_text(versions, text, old, new)
    with pytest.raises(Exception, match="OUT_OF_RANGE"):
        spark.createDataFrame([("2001-01-01T00:00:00",)], "t string").select(T.required_instant("t", old, new)).collect()
