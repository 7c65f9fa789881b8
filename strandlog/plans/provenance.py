"""Queries on closures, audits, time travel and certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.written import shared_dir
from strandlog.operators import certify as Z
from strandlog.operators import closure as C
from strandlog.operators import decisions as D
from strandlog.operators import stats as S
from strandlog.operators import temporal as T
from strandlog.plans.registry import query
from strandlog.plans.relational import HELD
from strandlog.plans.views import Views
from strandlog.sources import sinks as K

CLO = """, clo as (
  select belief_id, 0 as depth, originating_agent_id as agent_id, cast(null as bigint) as from_agent_id, cast(null as timestamp) as inherited_at, cast(null as timestamp) as invalidated_at, [originating_agent_id] as path from v_beliefs
  union all select c.belief_id, c.depth + 1, i.to_agent_id, c.agent_id, i.inherited_at, i.invalidated_at, list_append(c.path, i.to_agent_id) from clo c join v_inheritance i on i.belief_id = c.belief_id and i.from_agent_id = c.agent_id
), world as (
  select belief_id, count(*) as n_agents, 'sha256:' || sha256(string_agg(depth || ':' || coalesce(generation, -1) || ':' || agent_id, '|' order by depth, coalesce(generation, -1), agent_id)) as world_hash
  from clo left join v_agents using (agent_id) group by 1
)
"""
REQ = ", req as (select belief_id, timestamp '1999-01-01' as at from v_beliefs where belief_id % 2 = 1 union all select 1000 + belief_id, timestamp '1999-01-01' from v_beliefs where belief_id < 2)\n"
EV = REQ + """, est as (select belief_id, count(*) as edges, count(*) filter (invalidated_at is null) as open, count(distinct to_agent_id) filter (invalidated_at is null) as agents from v_inheritance group by 1
), ev as (select belief_id, r.at, case when status is null then 'UNKNOWN' when status <> 'active' then 'ALREADY_INVALIDATED' end as refusal, case when status = 'active' then coalesce(open, 0) else 0 end as affected_edges,
  case when status = 'active' then coalesce(agents, 0) + 1 else 0 end as affected_agents, coalesce(open, 0) as open_before, coalesce(edges, 0) as edges_before from req r left join v_beliefs using (belief_id) left join est using (belief_id))
"""


def requests(v: Views) -> DataFrame:
    at = F.expr("timestamp'1999-01-01'").alias("at")
    return v.beliefs.filter("belief_id % 2 = 1").select("belief_id", at).union(v.beliefs.filter("belief_id < 2").select(F.col("belief_id") + 1000, at))


def events(v: Views) -> DataFrame:
    return T.invalidate(requests(v), v.beliefs, v.inheritance)


def closure(v: Views) -> DataFrame:
    return C.inheritance_closure(v.beliefs, v.inheritance)


@query("inheritance_closure", CLO + "select belief_id, depth, agent_id, from_agent_id, inherited_at from clo")
def _(v: Views) -> DataFrame:
    return closure(v).select("belief_id", "depth", "agent_id", "from_agent_id", "inherited_at")


@query("replay_closure", CLO + "select belief_id, n_agents, world_hash, k as revoked from world join (select belief_id, count(invalidated_at) as k from clo group by 1) using (belief_id)")
def _(v: Views) -> DataFrame:
    c = closure(v)
    return Z.world_hash(c, v.agents).join(c.groupBy("belief_id").agg(F.count("invalidated_at").alias("revoked")), "belief_id")


@query("ancestor_chain", CLO + "select belief_id, agent_id, array_to_string(list_reverse(path), '>') as chain from clo")
def _(v: Views) -> DataFrame:
    return C.ancestor_chains(v.beliefs, v.inheritance).select("belief_id", "agent_id", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))


@query("closure_world_hash", CLO + "select belief_id, world_hash from world")
def _(v: Views) -> DataFrame:
    return Z.world_hash(closure(v), v.agents).select("belief_id", "world_hash")


AUD = """, held0 as (select belief_id, to_agent_id as from_agent_id, min(inherited_at) as held_from, min(invalidated_at) as revoked_at from v_inheritance group by 1, 2
), aud as (select i.edge_id, i.belief_id, t.agent_id is null or s.agent_id is null as unknown, list_filter([case when t.agent_id is not null and t.parent_id is distinct from i.from_agent_id then 'A1' end, case when i.inherited_at <> t.spawned_at then 'A2' end,
  case when i.from_agent_id <> b.originating_agent_id and coalesce(h.held_from > i.inherited_at, true) then 'A3' end, case when i.inherited_at > h.revoked_at then 'A4' end], lambda x: x is not null) as codes
  from v_inheritance i join v_beliefs b using (belief_id) left join v_agents t on t.agent_id = i.to_agent_id left join v_agents s on s.agent_id = i.from_agent_id left join held0 h on h.belief_id = i.belief_id and h.from_agent_id = i.from_agent_id
), audit as (select edge_id, belief_id, array_to_string(codes, ',') as codes, case when len(codes) > 0 then 'anomalous' when unknown then 'inconclusive' else 'ok' end as verdict from aud)
"""


@query("provenance_audit", AUD + "select * from audit")
def _(v: Views) -> DataFrame:
    return C.provenance_audit(v.beliefs, v.inheritance, v.agents).withColumn("codes", F.array_join("codes", ","))


@query("provenance_verdict", AUD + """select belief_id, coalesce(a, 0) as anomalous, coalesce(i, 0) as inconclusive, case when a > 0 then 'ANOMALOUS' when i > 0 then 'INCONCLUSIVE' else 'CLEAN' end as verdict
  from v_beliefs left join (select belief_id, count(*) filter (verdict = 'anomalous') as a, count(*) filter (verdict = 'inconclusive') as i from audit group by 1) using (belief_id)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return C.belief_verdicts(C.provenance_audit(v.beliefs, v.inheritance, v.agents), v.beliefs)


@query("spawn_inheritance", HELD + """, rq as (select 10000000 + agent_id as child_id, agent_id as parent_id from v_agents where agent_id % 3 = 0 union all select 20000000 + belief_id, -belief_id - 1 from v_beliefs
), ok as (select child_id, rq.parent_id from rq join v_agents va on va.agent_id = rq.parent_id where status = 'alive'
), ed as (select child_id, count(*) as edges from ok join held h on h.agent_id = parent_id join v_beliefs b using (belief_id) where b.status = 'active' group by 1)
select child_id, rq.parent_id, generation + 1 as generation, case when a.status is null then 'UNKNOWN_PARENT' when a.status <> 'alive' then 'DEAD_PARENT' end as refusal, coalesce(edges, 0) as edges
from rq left join v_agents a on a.agent_id = rq.parent_id left join ed using (child_id)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    at = F.expr("timestamp'2002-01-01'").alias("at")
    asked = v.agents.filter("agent_id % 3 = 0").select((F.col("agent_id") + 10_000_000).alias("child_id"), F.col("agent_id").alias("parent_id"), at)
    asked = asked.union(v.beliefs.select(F.col("belief_id") + 20_000_000, -F.col("belief_id") - 1, at))
    children, edges, _retired = C.spawn(asked, v.agents, v.beliefs, v.inheritance)
    n = edges.groupBy(F.col("to_agent_id").alias("child_id")).agg(F.count("*").alias("edges"))
    return children.join(n, "child_id", "left").select("child_id", "parent_id", "generation", "refusal", F.coalesce("edges", F.lit(0)).alias("edges"))


NOW = "select key, commit_ts, seq, value_cents, state from (select *, row_number() over (partition by key order by commit_ts desc, seq desc) as r from v_versions where commit_ts <= timestamp '2024-01-15') where r = 1 and not deleted"


@query("as_of", NOW)
def _(v: Views) -> DataFrame:
    return T.as_of(v.versions, F.expr("timestamp'2024-01-15'")).select("key", "commit_ts", "seq", "value_cents", "state")


@query("latest_per_key", "select key, seq, state from (select *, row_number() over (partition by key order by commit_ts desc, seq desc) as r from v_versions) where r = 1")
def _(v: Views) -> DataFrame:
    return T.latest_per_key(v.versions, "key", ["commit_ts", "seq"]).select("key", "seq", "state")


@query("normalize_as_of", """select event_id, case when event_id % 3 <> 2 and ts >= timestamp '2024-01-05' then date_trunc('second', ts) end as instant,
  case when event_id % 3 = 2 then 'MALFORMED' when date_trunc('second', ts) < timestamp '2024-01-05' then 'OUT_OF_RANGE' end as problem from events""")  # fmt: skip
def _(v: Views) -> DataFrame:
    said = F.expr("case event_id % 3 when 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") when 1 then concat(unix_seconds(cast(ts as timestamp)), '000000000.0000000001') else concat('on ', ts) end")
    instant = T.checked_instant("said", F.expr("timestamp'2024-01-05'"), F.expr("timestamp'2024-03-01'"))
    return v.table("events").withColumn("said", said).select("event_id", instant.alias("c")).select("event_id", "c.instant", "c.problem")


@query("invalidate", EV + "select belief_id, ev.at, refusal, affected_edges, affected_agents, open_before, edges_before from ev")
def _(v: Views) -> DataFrame:
    return events(v)


@query("eventual_invalidate_trace", REQ + """, live as (select i.*, row_number() over (partition by belief_id order by to_agent_id) as step, count(*) over (partition by belief_id) as total from v_inheritance i where invalidated_at is null and belief_id in (select belief_id from req))
select belief_id, step, total - step as open, case when step = 0 then 'ALL_ACTIVE' when step = total then 'ALL_INVALIDATED' else 'SPLIT' end as state from (select belief_id, step, total from live union all select distinct belief_id, 0, total from live)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    d = T.eventual_trace(requests(v), v.inheritance)
    return d.select("belief_id", "step", "open", T.closure_state().alias("state"))


@query("closure_state", EV + """, after as (select i.belief_id, count(*) as total, count(*) filter (coalesce(i.invalidated_at, e.at) is null) as open from v_inheritance i left join ev e on e.belief_id = i.belief_id and e.refusal is null group by 1)
select belief_id, total, open, case when open = total then 'ALL_ACTIVE' when open = 0 then 'ALL_INVALIDATED' else 'SPLIT' end as state from after""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return S.closure_open_counts(T.edges_after(events(v), v.inheritance)).withColumn("state", T.closure_state())


@query("holder_live", "select decision_id from v_decisions d where exists (select 1 from v_inheritance i where i.belief_id = d.belief_id and i.to_agent_id = d.agent_id and i.invalidated_at is null)")
def _(v: Views) -> DataFrame:
    return T.holder_live(v.decisions, v.inheritance).select("decision_id")


@query("deterministic_verdict", """select decision_id, case when amount_cents < 9000000 and verdict = 'approve' then 'approve' else 'decline' end as ruled from v_decisions d
  where exists (select 1 from v_inheritance i where i.belief_id = d.belief_id and i.to_agent_id = d.agent_id and i.invalidated_at is null)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    live = T.holder_live(v.decisions, v.inheritance).withColumn("age", F.lit(7))
    return live.select("decision_id", F.when(D.rule_predicate("verdict", "approve", "amount_cents", 9_000_000, "age", 6), "approve").otherwise("decline").alias("ruled"))


@query("closure_change_points", """, st as (select *, case when open = total then 'ALL_ACTIVE' when open = 0 then 'ALL_INVALIDATED' else 'SPLIT' end as state from v_samples),
lg as (select *, lag(seq) over w as ps, lag(state) over w as pst, lag(open) over w as po from st window w as (partition by subject order by seq)) select subject, seq, open, state from lg where ps is null or pst <> state or po <> open""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return T.change_points(v.samples).select("subject", "seq", "open", "state")


@query("holder_close_seq", "select s.subject, h.holder, min(s.seq) as seq from v_samples s, lateral (select unnest(range(s.total - s.open)) as holder) h group by 1, 2")
def _(v: Views) -> DataFrame:
    return T.holder_close_seq(v.samples)


@query("first_split", "select subject, min(seq) filter (open <> total and open <> 0) as first_split, count(*) filter (open <> total and open <> 0) as splits from v_samples group by 1")
def _(v: Views) -> DataFrame:
    return T.first_split(v.samples)


@query("hop_order_chronological", """, hops as (select instance, ts, lag(ts) over (partition by instance order by txn_id) as before from v_edges join v_labels using (txn_id) where label)
select instance, bool_and(coalesce(before <= ts, true)) as ascending from hops group by 1""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return T.hop_order(v.edges.join(v.labels.filter("label"), "txn_id").withColumn("hop_index", F.col("txn_id")))


@query("canonical_hash", "select decision_id, 'sha256:' || sha256(to_json({'agent_id': agent_id, 'belief_id': belief_id, 'decision_id': decision_id, 'verdict': verdict})) as hash from v_decisions")
def _(v: Views) -> DataFrame:
    return v.decisions.select("decision_id", Z.canonical_hash("decision_id", "agent_id", "belief_id", "verdict").alias("hash"))


CERT = CLO + EV + """, cert0 as (select belief_id, strftime(e.at, '%Y-%m-%dT%H:%M:%SZ') as revoked_at, affected_edges, affected_agents, open_before, case when edges_before > 0 then 'recorded' else 'derived' end as pre_state_source, world_hash, 'agreed' as agreement
  from ev e left join world using (belief_id) where refusal is null
), cert as (select *, 'sha256:' || sha256(to_json({'affected_agents': affected_agents, 'affected_edges': affected_edges, 'agreement': agreement, 'belief_id': belief_id, 'open_before': open_before, 'pre_state_source': pre_state_source, 'revoked_at': revoked_at, 'world_hash': world_hash})) as content_hash from cert0)
"""


def certificates(v: Views) -> DataFrame:
    performance = S.belief_performance(v.decisions, v.windows)
    return Z.build_certificates(events(v), Z.world_hash(closure(v), v.agents), S.staleness_evidence(performance, performance))


@query("build_certificates", CERT + "select * from cert")
def _(v: Views) -> DataFrame:
    return certificates(v)


@query("verify_certificates", CERT + "select belief_id, content_hash, belief_id % 3 <> 0 as valid from cert")
def _(v: Views) -> DataFrame:
    tampered = F.when(F.col("belief_id") % 3 == 0, F.col("affected_edges") + 1).otherwise(F.col("affected_edges"))
    return Z.verify_certificates(certificates(v).withColumn("affected_edges", tampered))


@query("sink_certificates_json", CERT + "select belief_id, content_hash from cert")
def _(v: Views) -> DataFrame:
    at = K.fresh(shared_dir(v.spark), "certificates")
    K.write_certificates(certificates(v), at)
    return K.read_certificates(v.spark, at).select("belief_id", "content_hash")


@query("scan_certificates_verify", CERT + "select belief_id, content_hash, true as valid from cert")
def _(v: Views) -> DataFrame:
    at = K.fresh(shared_dir(v.spark), "certificates")
    K.write_certificates(certificates(v), at)
    return Z.verify_certificates(K.read_certificates(v.spark, at))


AUDITED = ", audited as (select belief_id, case belief_id % 4 when 0 then timestamp '1990-01-20' when 1 then timestamp '1994-01-01' when 2 then timestamp '1999-01-01' else timestamp '2001-01-01' end as at from v_beliefs)\n"
THEN = CLO + AUDITED + """, edges as (select a.belief_id, i.from_agent_id, i.to_agent_id, i.invalidated_at is not null and i.invalidated_at <= a.at as gone from audited a join v_inheritance i using (belief_id) where i.inherited_at <= a.at
), past as (select b.belief_id, 0 as depth, originating_agent_id as agent_id from v_beliefs b join audited a using (belief_id) where formed_at <= a.at
  union all select p.belief_id, p.depth + 1, e.to_agent_id from past p join edges e on e.belief_id = p.belief_id and e.from_agent_id = p.agent_id
), then_world as (select belief_id, 'sha256:' || sha256(string_agg(depth || ':' || coalesce(generation, -1) || ':' || agent_id, '|' order by depth, coalesce(generation, -1), agent_id)) as world_hash from past left join v_agents using (agent_id) group by 1
), stt as (select belief_id, count(*) as total, count(*) filter (not gone) as open from edges group by 1)
"""


@query("certify_independently", THEN + """select a.belief_id, a.at, coalesce(t.total, 0) as total, coalesce(t.open, 0) as open, coalesce(b.formed_at <= a.at and (b.invalidated_at is null or b.invalidated_at > a.at) and t.open = t.total and t.total > 0, false) as verified,
  case when a.belief_id % 7 = 0 then 'unavailable' when w.world_hash = x.world_hash then 'agreed' else 'disagreed' end as agreement
  from audited a join v_beliefs b using (belief_id) left join stt t using (belief_id) left join then_world w using (belief_id) left join world x using (belief_id)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    at = F.expr("case belief_id % 4 when 0 then timestamp'1990-01-20' when 1 then timestamp'1994-01-01' when 2 then timestamp'1999-01-01' else timestamp'2001-01-01' end")
    audits = v.beliefs.select("belief_id", at.alias("at"))
    # certificates that state the whole closure; of some there is none. Where heirs came after the audit, they must disagree
    stored = Z.world_hash(closure(v), v.agents).filter("belief_id % 7 <> 0").select("belief_id", "world_hash")
    return Z.certify_independently(audits, stored, v.beliefs, v.inheritance, v.agents)


@query("stamp_audit_outcome", EV + "select belief_id, case when belief_id % 3 = 0 then 'failed' else 'written' end as outcome from ev where refusal is null")
def _(v: Views) -> DataFrame:
    audit = events(v).filter("refusal is null").select("belief_id")
    first = audit.select("belief_id", F.lit(1).alias("seq"), F.lit("failed").alias("outcome"))
    return K.stamped(audit, first.union(audit.filter("belief_id % 3 <> 0").select("belief_id", F.lit(2), F.lit("written")))).select("belief_id", "outcome")
