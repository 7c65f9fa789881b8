"""Queries over decisions, agents and beliefs: filters, checks, joins and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.operators import decisions as D
from strandlog.operators import holdings as H
from strandlog.plans.registry import query
from strandlog.plans.views import Views

OUT = "case when txn_ref like 'aml:%' and substr(txn_ref, 5) in ('MATCH', 'INCONCLUSIVE', 'CONCLUSIVE_NO') then substr(txn_ref, 5) end"


@query("decision_feed_filter", f"select decision_id, agent_id, verdict from v_decisions where belief_id = 3 and {OUT} = 'MATCH' and not is_fraud and transaction_id is null")
def _(v: Views) -> DataFrame:
    return D.filter_decisions(v.decisions, belief_id=3, kind="card", outcome="MATCH", is_fraud=False).select("decision_id", "agent_id", "verdict")


@query("decision_kind", "select case when transaction_id is null then 'card' else 'aml' end as kind, count(*) as n from v_decisions group by 1")
def _(v: Views) -> DataFrame:
    return v.decisions.groupBy(D.kind().alias("kind")).agg(F.count("*").alias("n"))


@query("rule_predicate", "select decision_id from v_decisions join v_agents using (agent_id) where amount_cents < 9000000 and generation > 6 and verdict = 'approve'")
def _(v: Views) -> DataFrame:
    rows = v.decisions.join(v.agents, "agent_id")
    return rows.filter(D.rule_predicate("verdict", "approve", "amount_cents", 9_000_000, "generation", 6)).select("decision_id")


@query("witness_outcome_of", f"select {OUT} as outcome, count(*) as n from v_decisions group by 1")
def _(v: Views) -> DataFrame:
    return v.decisions.groupBy(D.outcome_of("txn_ref").alias("outcome")).agg(F.count("*").alias("n"))


@query("verdict_for_outcome", f"select decision_id, case when {OUT} = 'MATCH' then 'blocked' when {OUT} is not null then 'approve' end as ruled, 'aml:' || {OUT} as tag from v_decisions")
def _(v: Views) -> DataFrame:
    outcome = D.outcome_of("txn_ref")
    return v.decisions.select("decision_id", D.verdict_for(outcome).alias("ruled"), D.tag_for(outcome).alias("tag"))


@query("agent_catalog", "select agent_id, bloodline, generation from v_agents where bloodline = 'BUILDING' and status = 'alive'")
def _(v: Views) -> DataFrame:
    return D.agent_catalog(v.agents, bloodline="BUILDING", status="alive").select("agent_id", "bloodline", "generation")


@query("belief_catalog", "select belief_id, rule_text, formed_at from v_beliefs where status = 'active'")
def _(v: Views) -> DataFrame:
    return D.belief_catalog(v.beliefs, status="active").select("belief_id", "rule_text", "formed_at")


@query("check_decision_kinds", """select decision_id from v_decisions where not (case when transaction_id is null then merchant is not null
  else merchant is null and txn_ref in ('aml:MATCH', 'aml:INCONCLUSIVE', 'aml:CONCLUSIVE_NO') end)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return D.kind_violations(v.decisions).select("decision_id")


@query("check_dangling_refs", "select decision_id, transaction_id from v_decisions where transaction_id is not null and transaction_id not in (select substr(txn_id, 1, 9) from v_edges)")
def _(v: Views) -> DataFrame:
    known = v.edges.select(F.substring("txn_id", 1, 9).alias("transaction_id"))
    return D.dangling(v.decisions, known, "transaction_id").select("decision_id", "transaction_id")


@query("check_ingest_census", """select typology, count(*) as members, count(distinct instance) as instances, count(*) filter (label) as fraud, count(*) filter (not label) as benign
  from v_labels group by typology""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return D.ingest_census(v.labels)


@query("check_benign_anchored", """, fraud_accounts as (
  select src as account from v_edges join v_labels using (txn_id) where label union select dst from v_edges join v_labels using (txn_id) where label
) select count(*) as benign, count(*) filter (src in (select account from fraud_accounts) or dst in (select account from fraud_accounts)) as anchored,
  (select count(*) from v_labels where label) as fraud, count(*) <= 4 * (select count(*) from v_labels where label) as within_ratio
from v_edges join v_labels using (txn_id) where not label""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return D.benign_anchored(v.edges.join(v.labels, "txn_id"), ratio=4)


@query("check_corpus_join_key", "select distinct 'label-' || source as key from v_vectors where 'label-' || source not in (select 'label-' || source from v_vectors where vec_id % 7 = 0 and source < 8)")
def _(v: Views) -> DataFrame:
    keys = v.vectors.select("vec_id", F.concat(F.lit("label-"), "source").alias("key"), "source")
    return D.missing_keys(keys, keys.filter("vec_id % 7 = 0 and source < 8"), "key")


@query("check_vector_dims", "select len(embedding) as dims, count(*) as n, len(embedding) = 64 as ok from v_vectors group by 1")
def _(v: Views) -> DataFrame:
    return D.vector_dims(v.vectors, "embedding", 64)


@query("txn_with_accounts", """select txn_id, a.c_name as src_name, b.c_name as dst_name, amount_cents from v_edges
  join customer a on lpad(a.c_custkey::varchar, 8, '0') = left(src, 8) join customer b on lpad(b.c_custkey::varchar, 8, '0') = left(dst, 8)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    accounts = v.table("customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("account"), F.col("c_name").alias("name"))
    return D.with_accounts(v.edges.withColumns({c: F.substring(c, 1, 8) for c in ("src", "dst")}), accounts).select("txn_id", "src_name", "dst_name", "amount_cents")


HELD = """, held as (
  select originating_agent_id as agent_id, belief_id from v_beliefs union select to_agent_id, belief_id from v_inheritance
)"""


@query("beliefs_held", HELD + " select agent_id, belief_id, rule_text, formed_at from held join v_beliefs using (belief_id)")
def _(v: Views) -> DataFrame:
    return H.beliefs_held(v.beliefs, v.inheritance).select("agent_id", "belief_id", "rule_text", "formed_at")


@query("beliefs_held_active", HELD + " select agent_id, belief_id, rule_text, formed_at from held join v_beliefs using (belief_id) where status = 'active'")
def _(v: Views) -> DataFrame:
    return H.beliefs_held(v.beliefs, v.inheritance, active_only=True).select("agent_id", "belief_id", "rule_text", "formed_at")


@query("closure_agents", HELD + " select a.agent_id, a.generation, belief_id from held join v_agents a using (agent_id) where belief_id = 2")
def _(v: Views) -> DataFrame:
    return H.closure_agents(v.agents, v.beliefs.filter("belief_id = 2"), v.inheritance).select("agent_id", "generation", "belief_id")


@query("governance_gate", """, open_edges as (
  select belief_id, to_agent_id as agent_id, count(*) as live, 0 as x from v_inheritance where invalidated_at is null group by 1, 2
) select d.decision_id, case when d.belief_id is null then 'NO_BELIEF' when b.status <> 'active' then 'BELIEF_INACTIVE' when a.status <> 'alive' then 'DECIDER_DEAD'
  when coalesce(e.live, 0) = 0 and d.agent_id <> b.originating_agent_id then 'NO_LIVE_EDGE' end as refusal
from v_decisions d left join v_beliefs b using (belief_id) left join v_agents a on a.agent_id = d.agent_id
left join open_edges e on e.belief_id = d.belief_id and e.agent_id = d.agent_id""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return H.governance_gate(v.decisions, v.beliefs, v.agents, v.inheritance).select("decision_id", "refusal")


@query("resolve_ids", """, asked as (select unnest([txn_id, 'missing-' || src]) as id from v_edges where left(txn_id, 9)::bigint % 50 = 0)
select distinct e.txn_id, e.src, e.dst from v_edges e join asked on id = txn_id""")  # fmt: skip
def _(v: Views) -> DataFrame:
    asked = v.edges.filter("cast(substr(txn_id, 1, 9) as bigint) % 50 = 0").select(F.array("txn_id", F.concat(F.lit("missing-"), "src")).alias("ids"))
    return D.resolve_ids(v.edges, asked, "txn_id").select("txn_id", "src", "dst")


@query("exact_tuple_integrity", """, keys as (select l_orderkey, l_linenumber, count(*) as hits from lineitem group by 1, 2),
asked as (select distinct l_orderkey, l_linenumber from lineitem where l_linenumber <= 2 union all select distinct -l_orderkey - 1, l_linenumber from lineitem where l_linenumber = 7)
select count(*) filter (hits = 1) as matched, count(*) filter (hits is null) as zero, count(*) filter (hits > 1) as collisions from asked left join keys using (l_orderkey, l_linenumber)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber")
    asked = rows.filter("l_linenumber <= 2").distinct().union(rows.filter("l_linenumber = 7").select(-F.col("l_orderkey") - 1, "l_linenumber").distinct())
    return D.tuple_integrity(asked, rows, ["l_orderkey", "l_linenumber"])


@query("pairwise_overlap", """, touched as (
  select distinct instance, account from (select instance, src as account from v_edges join v_labels using (txn_id) where label union all select instance, dst from v_edges join v_labels using (txn_id) where label)
) select a.instance as a, b.instance as b, count(*) as shared from touched a join touched b on a.account = b.account and a.instance < b.instance group by 1, 2""")  # fmt: skip
def _(v: Views) -> DataFrame:
    d = v.edges.join(v.labels.filter("label"), "txn_id")
    return D.pairwise_overlap(d.select("instance", F.col("src").alias("account")).union(d.select("instance", "dst")))


@query("decision_reverse_lookup", """select transaction_id, decision_id, decided_at, row_number() over (partition by transaction_id order by decided_at desc, decision_id desc) as nth
from v_decisions where transaction_id in (select substr(txn_id, 1, 9) from v_edges)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    asked = v.edges.select(F.substring("txn_id", 1, 9).alias("transaction_id"))
    return D.reverse_lookup(v.decisions, asked).select("transaction_id", "decision_id", "decided_at", "nth")


PRIOR = """, now as (select decision_id, agent_id, verdict, decided_at from v_decisions where decided_at >= timestamp '2000-01-01'),
prior as (select n.decision_id, p.verdict, row_number() over (partition by n.decision_id order by p.decided_at desc, p.decision_id desc) as r
  from now n join v_decisions p on p.agent_id = n.agent_id and p.decided_at < timestamp '2000-01-01')
select n.decision_id, p.verdict as prior_verdict, n.verdict = p.verdict as agrees from now n left join prior p on p.decision_id = n.decision_id and r = 1"""


@query("prior_agreement", PRIOR)
def _(v: Views) -> DataFrame:
    cut = F.expr("timestamp'2000-01-01'")
    return D.prior_agreement(v.decisions.filter(F.col("decided_at") >= cut), v.decisions.filter(F.col("decided_at") < cut), "agent_id")


@query("bridge_retrieval_to_instances", """, retrieved as (select vec_id, case source % 3 when 0 then 'CYCLE' when 1 then 'SCATTER-GATHER' else 'FAN' end as typology from v_vectors),
inst as (select typology, count(distinct instance) as instances from v_labels group by 1) select vec_id, typology, instances from retrieved join inst using (typology)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    typology = F.expr("case source % 3 when 0 then 'CYCLE' when 1 then 'SCATTER-GATHER' else 'FAN' end")
    return D.bridge(v.vectors.select("vec_id", typology.alias("typology")), v.labels)


@query("investigate_decision", """select d.decision_id, a.status as decider_status, case when d.belief_id is null then 'none' when b.belief_id is null then 'missing' else 'resolved' end as driving,
  b.originating_agent_id, o.bloodline as origin_bloodline, d.agent_id <> b.originating_agent_id as inherited
from v_decisions d left join v_agents a on a.agent_id = d.agent_id left join v_beliefs b on b.belief_id = d.belief_id and b.belief_id < 20 left join v_agents o on o.agent_id = b.originating_agent_id""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return D.investigate(v.decisions, v.agents, v.beliefs.filter("belief_id < 20"))


@query("decision_feed_page", "select decision_id, decided_at, (select count(*) from v_decisions where verdict = 'blocked') as total from v_decisions where verdict = 'blocked' order by decided_at desc, decision_id desc limit 50 offset 20")
def _(v: Views) -> DataFrame:
    return D.feed_page(v.decisions.filter("verdict = 'blocked'"), limit=50, offset=20).select("decision_id", "decided_at", "total")


@query("topk_categories", "select format, count(*) as n from v_edges group by 1 order by n desc, format limit 5")
def _(v: Views) -> DataFrame:
    return D.top_categories(v.edges, "format", 5)


@query("scan_edges_label_free", "select count(*) as edges, count(distinct src) as sources, sum(amount_cents)::bigint as cents from v_edges")
def _(v: Views) -> DataFrame:
    return v.edges.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.sum("amount_cents").alias("cents"))
