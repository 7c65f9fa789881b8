"""Queries that run as streams to their end; the SQL is their batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.written import cut, shared_dir
from strandlog.operators import holdings as H
from strandlog.plans.graphs import BFS
from strandlog.plans.registry import query
from strandlog.plans.views import Views
from strandlog.sources import sinks as K
from strandlog.streaming import arrivals as A
from strandlog.streaming import requests as R
from strandlog.streaming import streams as T


class StreamViews(Views):
    """The same views over growing folders: some tables come as streams, whatever view asks for them."""

    def __init__(self, spark, sf_dir: str, names: tuple[str, ...] = ("orders", "events")):
        super().__init__(spark, sf_dir)
        self.names = names

    def table(self, name: str) -> DataFrame:
        return T.source(self.spark, self.sf_dir, name) if name in self.names else super().table(name)


def fresh(v: Views, *names: str) -> list[str]:
    return [K.fresh(shared_dir(v.spark), name) for name in names]


def ended(v: Views, stream: DataFrame) -> DataFrame:
    """What a stream has written when all that is there has been processed."""
    out, state = fresh(v, "stream", "state")
    T.run_to_end(stream, out, state)
    return v.spark.read.schema(stream.schema).parquet(out)


def upserted(v: Views, stream: DataFrame, key: list[str]) -> DataFrame:
    """The newest rows of a stream of updated aggregates."""
    log, state = fresh(v, "log", "state")
    T.run_upserts(stream, log, state)
    return T.newest(v.spark, log, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema), key)


def live(v: Views, *names: str) -> StreamViews:
    return StreamViews(v.spark, v.sf_dir, names or ("orders", "events"))


@query("stream_closure_samples", "select user_id as subject, date_trunc('day', ts) as window_start, count(*) as total, count(*) filter (event_type = 'error') as closed from events group by 1, 2")
def _(v: Views) -> DataFrame:
    events = live(v).table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return upserted(v, T.closure_samples(events), ["subject", "window_start"])


@query("stream_rule_performance", """select belief_id, timestamp '1970-01-01' + to_days(((epoch(decided_at)::bigint // 86400) // 365 * 365)::int) as window_start, count(*) as n, count(*) filter ((verdict = 'approve') <> is_fraud) as correct,
  count(*) filter (is_fraud and verdict = 'approve') as frauds_approved from v_decisions where belief_id is not null group by 1, 2""")  # fmt: skip
def _(v: Views) -> DataFrame:
    d = live(v).decisions.withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    return upserted(v, T.rule_performance(d), ["belief_id", "window_start"])


@query("stream_dedup_raw_key", "select count(*) as n from (select distinct user_id, event_type, date_trunc('hour', ts) as h from events)")
def _(v: Views) -> DataFrame:
    d = live(v).table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withColumn("raw_key", F.concat_ws("|", "user_id", "event_type", F.date_trunc("hour", "ts").cast("string")))
    return ended(v, T.dedup_raw_key(d, "raw_key", "ts", late="60 days").select("raw_key")).agg(F.count("*").alias("n"))


@query("stream_request_rate", """, req as (select event_id, 'c' || user_id % 20 as client, '/' || event_type || '/{id}' as route, ts from events
), opened as (select client, route, min(ts) as began from req group by 1, 2 union all select o.client, o.route, min(r.ts) from opened o join req r on r.client = o.client and r.route = o.route and r.ts >= o.began + interval 1 hour group by o.client, o.route, o.began
), ranked as (select r.*, o.began, row_number() over (partition by r.client, r.route, o.began order by r.ts, r.event_id) as k from req r asof join opened o on o.client = r.client and o.route = r.route and o.began <= r.ts)
select event_id as request_id, client, route, began as window_start, k <= 2 as allowed, cast(case when k > 2 then greatest(1, (3600000000 - (epoch_us(ts) - epoch_us(began))) // 1000000 + 1) else 0 end as int) as retry_after from ranked""")  # fmt: skip
def _(v: Views) -> DataFrame:
    d = live(v).table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.select("ts", F.concat(F.lit("c"), F.col("user_id") % 20).alias("client"), F.concat(F.lit("/"), "event_type", F.lit("/"), "event_id").alias("path"), F.col("event_id").alias("request_id"))
    with R.keyed_state(v.spark):
        return ended(v, R.request_rate(d, limit=2))


@query("stream_revocations", "select decision_id, not coalesce(belief_id % 3 = 0 and decided_at >= timestamp '1998-01-01', false) as live from v_decisions where belief_id is not null")
def _(v: Views) -> DataFrame:
    spark, (beats, out, state) = v.spark, fresh(v, "beats", "stream", "state")
    beat = "decision_id long, belief_id long, decided_at timestamp"

    def run(day: str) -> None:
        """Both streams, each followed by a heartbeat of a day, which pushes its watermark on; a restart goes on from the last."""
        spark.sql(f"select -1L as decision_id, -1L as belief_id, timestamp'{day}' as decided_at").write.mode("append").parquet(beats)
        arriving = live(v, "orders").decisions.filter("belief_id is not null").selectExpr("decision_id", "cast(belief_id as bigint) as belief_id", "cast(decided_at as timestamp) as decided_at")
        revoked = live(v, "nation").beliefs.filter("belief_id % 3 = 0").selectExpr("belief_id", "timestamp'1998-01-01' as at")
        more = [spark.readStream.schema(beat).parquet(beats) for _ in range(2)]
        arriving, revoked = arriving.unionByName(more[0]), revoked.unionByName(more[1].selectExpr("-2L as belief_id", "decided_at as at"))
        T.run_to_end(T.meet_revocations(arriving, revoked, reach="1500 days").select("decision_id", "live"), out, state)

    run("1990-01-01")
    run("2100-01-01")  # all that is open is given out: no revocation before it can still come
    run("2200-01-01")
    return spark.read.schema("decision_id long, live boolean").parquet(out).filter("decision_id >= 0")


@query("stream_decide", BFS + """, open_edges as (select belief_id, to_agent_id as agent_id, count(*) as live from v_inheritance where invalidated_at is null group by 1, 2)
select c.txn_id, case when b.status <> 'active' or a.status <> 'alive' or (coalesce(e.live, 0) = 0 and d.agent_id <> b.originating_agent_id) then 'refused' when outcome = 'MATCH' then 'blocked' else 'approve' end as ruled, label as is_fraud
from cyc c join v_decisions d on d.decision_id = left(c.txn_id, 9)::bigint join v_beliefs b using (belief_id) join v_agents a on a.agent_id = d.agent_id left join open_edges e on e.belief_id = d.belief_id and e.agent_id = d.agent_id join v_labels l on l.txn_id = c.txn_id""")  # fmt: skip
def _(v: Views) -> DataFrame:
    asked = v.decisions.filter("belief_id is not null").select("belief_id", "agent_id").distinct()
    gate = H.governance_gate(asked, v.beliefs, v.agents, v.inheritance).select("belief_id", "agent_id", "refusal")
    gate = cut(gate.filter("refusal is not null"), "gate")
    of_order = v.decisions.select("decision_id", F.col("belief_id").cast("long").alias("belief_id"), F.col("agent_id").cast("long").alias("agent_id"))
    arriving = live(v, "lineitem").edges.withColumn("decision_id", F.expr("cast(substr(txn_id, 1, 9) as bigint)")).join(of_order, "decision_id")
    store, out, state = fresh(v, "arrived", "ruled", "state")
    A.decide_arrivals(arriving, gate, store, out, state)
    return A.with_labels(A.decided(v.spark, out), v.labels).select("txn_id", "ruled", "is_fraud")
