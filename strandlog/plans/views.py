"""The evidence model's tables, derived from the given star schema, as DataFrames and as SQL.

Ids, hashes and keys are made of integers, dates and strings only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.written import cut, kept
from strandlog.operators import graph as G


_TXN = "concat_ws('-', lpad(l_orderkey, 9, '0'), lpad(l_partkey, 7, '0'), lpad(l_suppkey, 6, '0'), l_linenumber, date_format(l_shipdate, 'yyyyMMdd'))"


class Views:
    """The tables under a folder and the views over them, each planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def edges(self) -> DataFrame:
        """Money-flow edges (txn_id, src, dst, ts, amount_cents, format), one for each line, without a label.

        An account is a customer's at one of 31 banks. Lines go from the customer of the order to one of the 16 of the same
        neighbourhood, so the accounts' degrees stay some 1.3 and structures grow in number with the table."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
            f"{_TXN} as txn_id",
            "concat(lpad(o_custkey, 8, '0'), '-', lpad((l_orderkey + 7 * l_linenumber) % 31, 2, '0')) as src",
            "concat(lpad(o_custkey div 16 * 16 + l_partkey % 16, 8, '0'), '-', lpad((l_partkey div 16 + l_suppkey) % 31, 2, '0')) as dst", "l_shipdate as ts",
            "cast(round(l_extendedprice * 100) as bigint) as amount_cents", "concat(l_returnflag, l_linestatus) as format",
        )

    @cached_property
    def asked_edges(self) -> DataFrame:
        """txn_id of the edges that searches about single edges ask for: those of every fiftieth order."""
        return self.edges.filter("cast(substr(txn_id, 1, 9) as bigint) % 50 = 0").select("txn_id")

    def _kept(self, name: str, build) -> DataFrame:
        return kept(self.spark, name, [f"{self.sf_dir}/{t}.parquet" for t in ("lineitem", "orders")], build)

    @property
    def judged(self) -> DataFrame:
        """What the search finds for every pair of accounts; searched for once, as many questions start from it."""
        return self._kept("judged", lambda: G.judged(cut(G.adjacency(self.edges), "pairs")))

    @property
    def cycles(self) -> DataFrame:
        """The cycle witness of every edge."""
        return G.cycle_witness(self.edges, self.judged)

    @property
    def witnessed(self) -> DataFrame:
        """What all four structures tell of every pair of accounts; searched for once, too."""
        return self._kept("witnessed", lambda: G.witnessed(self.edges))

    @property
    def matches(self) -> DataFrame:
        """Which of the four witnesses match each edge."""
        return G.matches(self.edges, self.witnessed)

    @property
    def witnesses(self) -> DataFrame:
        """All four witnesses of every edge."""
        return G.interrogate(self.edges, self.witnessed)

    @property
    def facts(self) -> DataFrame:
        return self._kept("facts", lambda: G.structure_facts(self.edges, self.judged))

    @cached_property
    def labels(self) -> DataFrame:
        """txn_id, label, typology and instance of each edge; only scoring reads it."""
        orders = self.table("orders").select("o_orderkey")
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").selectExpr(
            f"{_TXN} as txn_id", "l_returnflag = 'R' as label",
            "case l_orderkey % 3 when 0 then 'CYCLE' when 1 then 'SCATTER-GATHER' else 'STACK' end as typology", "cast(l_orderkey div 4 as bigint) as instance",
        )

    @cached_property
    def agents(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey as agent_id", "cast(length(bin(c_custkey + 1)) - 1 as int) as generation", "c_mktsegment as bloodline",
            "case when c_acctbal >= 0 then 'alive' else 'dead' end as status",
            "timestamp'1990-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey as int), 0, 0) as spawned_at",
            "case when c_custkey > 0 then (c_custkey - 1) div 2 end as parent_id",
        )

    @cached_property
    def beliefs(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "cast(n_nationkey as bigint) as belief_id", "n_name as rule_text", "cast(n_nationkey as bigint) as originating_agent_id",
            "timestamp'1990-01-01 00:00:00' + make_dt_interval(0, n_nationkey, 0, 0) as formed_at",
            "case when n_nationkey % 6 = 5 then 'invalidated' else 'active' end as status",
            "case when n_nationkey % 6 = 5 then timestamp'2000-01-01 00:00:00' end as invalidated_at",
        )

    @cached_property
    def inheritance(self) -> DataFrame:
        """One edge for each belief and tree edge below its originator, with gaps and planted violations.

        A tree node's ancestors are the prefixes of its number in binary, so each node meets the beliefs of its own few
        ancestors by an equi-join."""
        child = self.agents.filter("parent_id is not null").withColumn("up", F.explode(F.expr("sequence(1, generation)")))
        child = child.withColumn("ancestor", F.expr("cast(shiftright(agent_id + 1, up) - 1 as bigint)"))
        d = child.alias("c").join(self.beliefs.alias("b"), F.expr("c.ancestor = b.originating_agent_id"))
        d = d.filter("(c.agent_id + b.belief_id) % 5 <> 0")
        return d.selectExpr(
            "b.belief_id * 1000000000 + c.agent_id as edge_id", "b.belief_id",
            "case when (c.agent_id + b.belief_id) % 13 = 0 then b.originating_agent_id else c.parent_id end as from_agent_id", "c.agent_id as to_agent_id",
            "case when (c.agent_id + b.belief_id) % 17 = 0 then c.spawned_at + interval 1 hour else c.spawned_at end as inherited_at",
            "case when (c.agent_id * 7 + b.belief_id) % 11 = 0 then timestamp'1995-06-01 00:00:00' else b.invalidated_at end as invalidated_at",
        )

    @cached_property
    def decisions(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as decision_id", "o_custkey as agent_id", "case when o_orderkey % 7 <> 0 then o_custkey % 25 end as belief_id", "o_orderdate as decided_at",
            "case o_orderstatus when 'F' then 'approve' when 'O' then 'decline' else 'blocked' end as verdict", "o_orderpriority = '1-URGENT' as is_fraud",
            "cast(round(o_totalprice * 100) as bigint) as amount_cents",
            "case when o_orderkey % 4 = 0 then lpad(o_orderkey, 9, '0') end as transaction_id",
            "case o_orderkey % 5 when 0 then 'aml:MATCH' when 1 then 'aml:INCONCLUSIVE' when 2 then 'aml:CONCLUSIVE_NO' when 3 then concat('card-', o_orderkey) else 'aml:OTHER' end as txn_ref",
            "case when o_orderkey % 4 <> 0 or o_orderkey % 28 = 0 then concat('m', o_custkey % 50) end as merchant",
        )

    @cached_property
    def windows(self) -> DataFrame:
        years = self.spark.range(1995, 2002).selectExpr("make_timestamp(cast(id as int), 1, 1, 0, 0, 0) as window_start", "make_timestamp(cast(id as int) + 1, 1, 1, 0, 0, 0) as window_end")
        return self.beliefs.select("belief_id").crossJoin(years)  # seven rows a belief

    @cached_property
    def versions(self) -> DataFrame:
        """A change log: key, the instant (commit_ts, seq) of each version, its value, whether it deletes the key."""
        return self.table("events").selectExpr("user_id as key", "ts as commit_ts", "event_id as seq", "cast(round(value * 100) as bigint) as value_cents", "event_type as state", "event_type = 'error' as deleted")

    @cached_property
    def samples(self) -> DataFrame:
        """Samples of each user's closure in order: total holders and those still open."""
        d = self.table("events").filter("event_type in ('error', 'purchase', 'view')").selectExpr("user_id as subject", "ts", "event_id", "int(event_type = 'error') as closed")
        return d.selectExpr(
            "subject", "ts", "cast(row_number() over (partition by subject order by ts, event_id) as bigint) as seq",
            "count(*) over (partition by subject) div 2 as total",
            "greatest(0, count(*) over (partition by subject) div 2 - sum(closed) over (partition by subject order by ts, event_id)) as open",
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id", "label as source", "embedding")


PRELUDE = """with recursive v_edges as (
  select concat_ws('-', lpad(l_orderkey::varchar, 9, '0'), lpad(l_partkey::varchar, 7, '0'), lpad(l_suppkey::varchar, 6, '0'), l_linenumber, strftime(l_shipdate, '%Y%m%d')) as txn_id,
    lpad(o_custkey::varchar, 8, '0') || '-' || lpad(((l_orderkey + 7 * l_linenumber) % 31)::varchar, 2, '0') as src,
    lpad((o_custkey // 16 * 16 + l_partkey % 16)::varchar, 8, '0') || '-' || lpad(((l_partkey // 16 + l_suppkey) % 31)::varchar, 2, '0') as dst, l_shipdate as ts,
    cast(round(l_extendedprice * 100) as bigint) as amount_cents, l_returnflag || l_linestatus as format
  from lineitem join orders on l_orderkey = o_orderkey
), v_labels as (
  select concat_ws('-', lpad(l_orderkey::varchar, 9, '0'), lpad(l_partkey::varchar, 7, '0'), lpad(l_suppkey::varchar, 6, '0'), l_linenumber, strftime(l_shipdate, '%Y%m%d')) as txn_id,
    l_returnflag = 'R' as label, case l_orderkey % 3 when 0 then 'CYCLE' when 1 then 'SCATTER-GATHER' else 'STACK' end as typology, cast(l_orderkey // 4 as bigint) as instance
  from lineitem join orders on l_orderkey = o_orderkey
), v_agents as (
  select c_custkey as agent_id, cast(length(bin(c_custkey + 1)) - 1 as int) as generation, c_mktsegment as bloodline,
    case when c_acctbal >= 0 then 'alive' else 'dead' end as status, timestamp '1990-01-01' + to_hours(c_custkey) as spawned_at,
    case when c_custkey > 0 then (c_custkey - 1) // 2 end as parent_id from customer
), v_beliefs as (
  select n_nationkey::bigint as belief_id, n_name as rule_text, n_nationkey::bigint as originating_agent_id, timestamp '1990-01-01' + to_hours(n_nationkey) as formed_at,
    case when n_nationkey % 6 = 5 then 'invalidated' else 'active' end as status, case when n_nationkey % 6 = 5 then timestamp '2000-01-01' end as invalidated_at from nation
), v_inheritance as (
  select b.belief_id * 1000000000 + c.agent_id as edge_id, b.belief_id,
    case when (c.agent_id + b.belief_id) % 13 = 0 then b.originating_agent_id else c.parent_id end as from_agent_id, c.agent_id as to_agent_id,
    case when (c.agent_id + b.belief_id) % 17 = 0 then c.spawned_at + to_hours(1) else c.spawned_at end as inherited_at,
    case when (c.agent_id * 7 + b.belief_id) % 11 = 0 then timestamp '1995-06-01' else b.invalidated_at end as invalidated_at
  from (select *, unnest(range(1, generation + 1)) as up from v_agents where parent_id is not null) c
  join v_beliefs b on ((c.agent_id + 1) >> c.up::int) - 1 = b.originating_agent_id where (c.agent_id + b.belief_id) % 5 <> 0
), v_decisions as (
  select o_orderkey as decision_id, o_custkey as agent_id, case when o_orderkey % 7 <> 0 then o_custkey % 25 end as belief_id, o_orderdate as decided_at,
    case o_orderstatus when 'F' then 'approve' when 'O' then 'decline' else 'blocked' end as verdict, o_orderpriority = '1-URGENT' as is_fraud,
    cast(round(o_totalprice * 100) as bigint) as amount_cents, case when o_orderkey % 4 = 0 then lpad(o_orderkey::varchar, 9, '0') end as transaction_id,
    case o_orderkey % 5 when 0 then 'aml:MATCH' when 1 then 'aml:INCONCLUSIVE' when 2 then 'aml:CONCLUSIVE_NO' when 3 then 'card-' || o_orderkey else 'aml:OTHER' end as txn_ref,
    case when o_orderkey % 4 <> 0 or o_orderkey % 28 = 0 then 'm' || (o_custkey % 50) end as merchant from orders
), v_windows as (
  select belief_id, make_timestamp(y, 1, 1, 0, 0, 0) as window_start, make_timestamp(y + 1, 1, 1, 0, 0, 0) as window_end from v_beliefs, range(1995, 2002) t(y)
), v_versions as (
  select user_id as key, ts as commit_ts, event_id as seq, cast(round(value * 100) as bigint) as value_cents, event_type as state, event_type = 'error' as deleted from events
), v_samples as (
  select subject, ts, row_number() over (partition by subject order by ts, event_id) as seq, cast(count(*) over (partition by subject) // 2 as bigint) as total,
    cast(greatest(0, count(*) over (partition by subject) // 2 - sum(closed) over (partition by subject order by ts, event_id)) as bigint) as open
  from (select user_id as subject, ts, event_id, (event_type = 'error')::int as closed from events where event_type in ('error', 'purchase', 'view'))
), v_vectors as (
  select vec_id, label as source, embedding from embeddings
)
"""
