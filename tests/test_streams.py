"""Streams: what a watermark drops as late, and that a stream goes on where it was."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from strandlog.operators import graph as G
from strandlog.streaming import arrivals as A
from strandlog.streaming import requests as R
from strandlog.streaming import streams as T

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, event_type string, ts timestamp"


def at(day, hour=0):
    return START + datetime.timedelta(days=day, hours=hour)


def arrive(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/batch{k}")


def test_a_late_row_is_dropped(spark, tmp_path):
    """In append mode a window is given out once the watermark has passed it; a row that comes after that is in none."""
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        [(1, 7, "error", at(0, 1)), (2, 7, "view", at(0, 2)), (3, 7, "view", at(3))],
        [(4, 7, "error", at(0, 3)), (5, 7, "view", at(3, 1)), (6, 7, "view", at(6))],  # the first is three days late
        [(7, 7, "view", at(9))],
        [(8, 7, "view", at(12))],
    ]
    for k, rows in enumerate(batches):
        arrive(spark, folder, k, rows)
        events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder)
        T.run_to_end(T.closure_samples(events), out, state)
    got = sorted((r.window_start, r.total, r.closed) for r in spark.read.parquet(out).collect())
    assert got[:3] == [(at(0), 2, 1), (at(3), 2, 0), (at(6), 1, 0)]


def test_late_and_repeated_keys_are_dropped(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, rows in enumerate([[(1, 7, "a", at(5)), (1, 7, "a", at(5, 1))], [(2, 7, "a", at(9))], [(3, 7, "a", at(1)), (4, 7, "a", at(9, 1)), (2, 7, "a", at(9, 1))]]):
        arrive(spark, folder, k, rows)
        events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder)
        T.run_to_end(T.dedup_raw_key(events, "event_id", "ts", late="2 days").select("event_id"), out, state)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_upserts_hold_the_newest_rows_and_let_state_go(spark, tmp_path):
    """Each batch writes what it changes; windows behind the watermark leave the state and change no more."""
    folder, log, state, small = (str(tmp_path / x) for x in ("in", "log", "state", "small"))
    batches = [[(1, 7, "error", at(0, 1)), (2, 8, "view", at(0, 2))], [(3, 7, "view", at(0, 3)), (4, 7, "view", at(9))], [(5, 7, "error", at(0, 4)), (6, 7, "view", at(9, 1))]]
    schema, key = "subject long, window_start timestamp, total long, closed long", ["subject", "window_start"]
    sizes = []
    for k, rows in enumerate(batches):
        arrive(spark, folder, k, rows)
        events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder)
        T.run_upserts(T.closure_samples(events), log, state)
        sizes.append(spark.read.schema(schema + ", batch bigint").option("basePath", log).parquet(log).count())
    newest = lambda at_: sorted(map(tuple, T.newest(spark, at_, schema, key).collect()))
    expected = [(7, at(0), 2, 1), (7, at(9), 2, 0), (8, at(0), 1, 0)]  # row 5 is nine days late
    assert newest(log) == expected and sizes == [2, 4, 5]
    T.compact(spark, log, small, schema, key)
    assert newest(small) == expected
    query = T.closure_samples(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder)).writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.format("noop").mode("overwrite").save())
    query = query.option("checkpointLocation", str(tmp_path / "again")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # of three windows


def plain_windows(requests, limit, seconds):
    """The rule, request by request in order of arrival."""
    buckets, out = {}, {}
    for client, path, n, ts in requests:
        key = client, re.sub(r"/[0-9]+", "/{id}", path)
        opened, count = buckets.get(key, (ts, 0))
        if (ts - opened).total_seconds() >= seconds:
            opened, count = ts, 0
        if count >= limit:
            out[n] = opened, False, max(1, int(seconds - (ts - opened).total_seconds()) + 1)
        else:
            out[n], count = (opened, True, 0), count + 1
        buckets[key] = opened, count
    return out


def test_request_windows_open_at_the_first_request(spark, tmp_path):
    """Bursts across hour edges, in batches between which the stream stops, against the rule request by request."""
    rnd, folder, out, state = random.Random(4), *(str(tmp_path / x) for x in ("in", "out", "state"))
    requests, now = [], {}
    for n in range(400):
        client = rnd.choice(("a", "b", "c"))
        now[client] = now.get(client, START + datetime.timedelta(minutes=50)) + datetime.timedelta(seconds=rnd.choice((1, 5, 700, 3599, 3600, 0.25)) if rnd.random() < 0.9 else 30_000)
        requests.append((client, f"/x/{n}" if rnd.random() < 0.7 else "/y", n, now[client]))
    requests.sort(key=lambda r: (r[3], r[2]))
    for k in range(4):
        spark.createDataFrame(requests[100 * k : 100 * k + 100], "client string, path string, request_id long, ts timestamp").coalesce(1).write.parquet(f"{folder}/batch{k}")
        stream = spark.readStream.schema("client string, path string, request_id long, ts timestamp").option("recursiveFileLookup", True).parquet(folder)
        with R.keyed_state(spark):
            T.run_to_end(R.request_rate(stream, limit=3), out, state)
    got = {r.request_id: (r.window_start, r.allowed, r.retry_after) for r in spark.read.parquet(out).collect()}
    assert got == plain_windows(requests, 3, 3600) and not all(x[1] for x in got.values())


def test_revocations_as_a_stream(spark, tmp_path):
    """A row before and one after a revocation, a revocation that comes after the decision it concerns, one that is too late, and restarts."""
    out, state, dec, rev = (str(tmp_path / x) for x in ("out", "state", "decisions", "revocations"))
    decision, revocation = "decision_id long, belief_id long, decided_at timestamp", "belief_id long, at timestamp"
    batches = [
        ([(1, 5, at(0)), (2, 5, at(3)), (3, 6, at(3))], [(5, at(1))]),
        ([(4, 5, at(4)), (5, 7, at(4, 1))], [(6, at(2, 12)), (9, at(4))]),  # belief 6: after its decision, before the watermark
        ([(6, 8, at(30)), (7, 5, at(29))], [(9, at(30))]),
        ([(8, 8, at(60))], [(7, at(3)), (9, at(60))]),  # belief 7: weeks too late, its decision has been given out
        ([(9, 8, at(90))], [(9, at(90))]),
    ]
    settled = spark.createDataFrame([(8, at(29))], revocation)
    for decisions, revocations in batches:
        for rows, schema, folder in ((decisions, decision, dec), (revocations, revocation, rev)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        streams = [spark.readStream.schema(schema).parquet(folder) for schema, folder in ((decision, dec), (revocation, rev))]
        T.run_to_end(T.meet_revocations(*streams, reach="20 days", settled=settled), out, state)
    got = {r.decision_id: r.live for r in spark.read.parquet(out).collect()}
    # decision 7 is beyond the reach of the stream's revocation; 8's is a settled one
    assert {k: v for k, v in got.items() if k < 8} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: True} and got.get(8) is False


def test_arrivals_are_decided_by_what_had_arrived(spark, tmp_path):
    """Batch by batch, with a restart between any two, against the whole search over the edges that had arrived."""
    folder, store, out, state = (str(tmp_path / x) for x in ("in", "store", "out", "state"))
    rnd, edges = random.Random(8), []
    for g in range(6):
        n = rnd.randint(4, 9)
        edges += [(f"{g}{a}", f"{g}{b}") for a, b in [(rnd.randrange(n), rnd.randrange(n)) for _ in range(2 * n)]]
    rnd.shuffle(edges)
    rows = [(f"t{i:03d}", a, b, None if i % 9 == 0 else i % 4, i % 5) for i, (a, b) in enumerate(edges)]
    gate = spark.createDataFrame([(b, a, "DECIDER_DEAD") for b in range(4) for a in (3,)], "belief_id long, agent_id long, refusal string")
    third = len(rows) // 3 + 1
    expected = {}
    for k in range(3):
        new = rows[third * k : third * k + third]
        spark.createDataFrame(new, A.EDGE).coalesce(1).write.mode("append").parquet(folder)
        A.decide_arrivals(spark.readStream.schema(A.EDGE).parquet(folder), gate, store, out, state)
        so_far = spark.createDataFrame(rows[: third * k + third], A.EDGE).withColumn("ts", F.lit(START))
        whole = {r.txn_id: r for r in G.cycle_witness(so_far).collect()}
        for t, _, _, belief, agent in new:
            if belief is not None:
                expected[t] = ("refused", None, None) if agent == 3 else ("blocked" if whole[t].outcome == "MATCH" else "approve", whole[t].outcome, whole[t].boundary)
    got = A.decided(spark, out)
    assert {r.txn_id: (r.ruled, r.outcome, r.boundary) for r in got.collect()} == expected and len({x[1] for x in expected.values()}) == 4
    labels = spark.createDataFrame([("t001", True)], "txn_id string, label boolean")
    assert A.with_labels(got, labels).filter("is_fraud").count() == 1 and "label" not in A.EDGE


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_twins_of_a_way_back_repeat_no_decision(spark, share):
    """An edge whose reverse has a twin, a pair that is paid twice: each edge has one outcome, whichever way is taken."""
    from strandlog.operators import graph as G

    pairs = [("A", "B"), ("B", "A"), ("B", "A"), ("B", "C"), ("C", "A"), ("C", "A"), ("D", "A"), ("D", "A"), ("E", "E")]
    e = spark.createDataFrame([(f"t{i}", a, b) for i, (a, b) in enumerate(pairs)], "txn_id string, src string, dst string").withColumn("ts", F.lit(START))
    want = sorted((r.txn_id, r.outcome, r.length, r.boundary) for r in G.cycle_witness(e).collect())
    got = sorted((r.txn_id, r.outcome, r.length, r.boundary) for r in G.cycle_witness_of(e.select("txn_id", "src", "dst"), e, share).collect())
    assert got == want and len(got) == len(pairs)
