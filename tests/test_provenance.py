"""Audits of planted violations, tampered certificates, streams that go on, sinks that repeat."""

from datetime import datetime, timedelta

import pytest

from strandlog.functions.ids import uuid5
from strandlog.functions.statistics import fisher_exact
from strandlog.operators import certify, closure, temporal
from strandlog.sources import sinks
from strandlog.streaming import streams

T0 = datetime(2020, 1, 1)
EDGE = "edge_id long, belief_id long, from_agent_id long, to_agent_id long, inherited_at timestamp, invalidated_at timestamp"


def test_audit_of_one_attack_per_invariant(spark):
    hour = lambda n: T0 + timedelta(hours=n)
    agents = spark.createDataFrame([(i, (i - 1) // 2 if i else None, hour(i)) for i in range(8)], "agent_id long, parent_id long, spawned_at timestamp")
    beliefs = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "belief_id long, originating_agent_id long")
    edges = [
        (1, 1, 0, 1, hour(1), None), (2, 1, 0, 3, hour(3), None), (3, 1, 0, 2, hour(9), None), (4, 1, 3, 7, hour(7), None), (5, 2, 2, 5, hour(5), None),
        (6, 2, 0, 1, hour(1), hour(2)), (7, 2, 1, 4, hour(4), None), (8, 3, 0, 99, hour(1), None),
    ]
    audit = closure.provenance_audit(beliefs, spark.createDataFrame(edges, EDGE), agents)
    assert {r.edge_id: (r.codes, r.verdict) for r in audit.collect()} == {
        1: ([], "ok"), 2: (["A1"], "anomalous"), 3: (["A2"], "anomalous"), 4: ([], "ok"), 5: (["A3"], "anomalous"), 6: ([], "ok"), 7: (["A4"], "anomalous"), 8: ([], "inconclusive"),
    }
    verdicts = {r.belief_id: r.verdict for r in closure.belief_verdicts(audit, beliefs).collect()}
    assert verdicts == {1: "ANOMALOUS", 2: "ANOMALOUS", 3: "INCONCLUSIVE"}


def test_any_changed_field_spoils_a_certificate(spark):
    row = {"belief_id": 1, "revoked_at": "2020-01-01T00:00:00Z", "affected_edges": 2, "affected_agents": 3, "open_before": 2, "pre_state_source": "recorded", "world_hash": None, "agreement": "agreed"}
    schema = "belief_id long, revoked_at string, affected_edges long, affected_agents long, open_before long, pre_state_source string, world_hash string, agreement string"
    signed = spark.createDataFrame([row], schema).withColumn("content_hash", certify.canonical_hash(*certify.FIELDS))
    assert certify.verify_certificates(signed).first().valid
    for field, value in (("affected_edges", 9), ("world_hash", "sha256:1"), ("agreement", "disagreed")):
        from pyspark.sql import functions as F

        assert not certify.verify_certificates(signed.withColumn(field, F.lit(value))).first().valid


def test_fisher_known_values(spark):
    cases = {(231, 19, 249, 1): None, (3, 1, 1, 3): 0.4857142857, (10, 0, 0, 10): 1.0825e-05, (5, 5, 0, 0): 1.0}
    d = spark.createDataFrame(list(cases), "a long, b long, c long, d long")
    got = {(r.a, r.b, r.c, r.d): r.p for r in d.withColumn("p", fisher_exact("a", "b", "c", "d")).collect()}
    for k, p in cases.items():
        assert p is None or got[k] == pytest.approx(p, rel=1e-4)
    assert 0 < got[231, 19, 249, 1] < 0.001


def test_uuid5_equals_the_library(spark):
    import uuid

    names = ["", "a\x1fb", "ü🙂", "x" * 100]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.u for r in d.select(uuid5(d.n).alias("u")).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_as_of_and_its_tombstones(spark):
    v = [("k", T0, 1, "a", False), ("k", T0 + timedelta(1), 2, "b", False), ("k", T0 + timedelta(2), 3, "c", True), ("l", T0 + timedelta(1), 1, "d", False)]
    d = spark.createDataFrame(v, "key string, commit_ts timestamp, seq long, value string, deleted boolean")
    from pyspark.sql import functions as F

    at = lambda days: {r.key: r.value for r in temporal.as_of(d, F.lit(T0 + timedelta(days))).collect()}
    assert at(-1) == {} and at(0) == {"k": "a"} and at(1) == {"k": "b", "l": "d"} and at(3) == {"l": "d"}


def test_insert_if_absent_repeats_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    path = f"file://{tmp_path}/t"
    assert sinks.insert_if_absent(d, path, ["id"]) == 2 and sinks.insert_if_absent(d, path, ["id"]) == 0
    assert sinks.insert_if_absent(spark.createDataFrame([(3, "x")], d.schema), path, ["id"]) == 1 and spark.read.parquet(path).count() == 3


def test_pattern_blocks(spark):
    text = "noise\nBEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 3-degree\na,b\nc,d\nEND LAUNDERING ATTEMPT - FAN-OUT\n\nBEGIN LAUNDERING ATTEMPT - CYCLE\ne\nEND LAUNDERING ATTEMPT - CYCLE\n"
    got = sorted((r.instance_index, r.typology, r.param, r.hop_index, r.row) for r in sinks.pattern_blocks(spark.createDataFrame([("f", text)], "file string, text string")).collect())
    assert got == [(0, "FAN-OUT", "Max 3-degree", 0, "a,b"), (0, "FAN-OUT", "Max 3-degree", 1, "c,d"), (1, "CYCLE", "", 0, "e")]


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("id", f"timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id as int)) as ts")
    folder, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows(0, 10).write.parquet(folder)
    for lo, hi, n in ((5, 15, 15), (0, 3, 15)):
        stream = spark.readStream.schema("id long, ts timestamp").parquet(folder)
        streams.run_to_end(streams.dedup_raw_key(stream, "id", "ts", "1 day"), out, state)
        rows(lo, hi).write.mode("append").parquet(folder)
    streams.run_to_end(streams.dedup_raw_key(spark.readStream.schema("id long, ts timestamp").parquet(folder), "id", "ts", "1 day"), out, state)
    assert spark.read.parquet(out).count() == n
