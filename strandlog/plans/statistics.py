"""Queries on performance, counterfactuals and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.statistics import fisher_exact, wilson, wilson_by_roots
from strandlog.operators import graph as G
from strandlog.operators import stats as S
from strandlog.plans.graphs import ALL, BFS
from strandlog.plans.registry import query
from strandlog.plans.views import Views

OK = "((verdict = 'approve') <> is_fraud)"
INW = ", inw as (select d.*, window_start, window_end from v_decisions d join v_windows w on d.belief_id = w.belief_id and decided_at >= window_start and decided_at < window_end)\n"
PERF = INW + f""", perf as (select belief_id, window_start, count(*) as n, count(*) filter ({OK}) as correct, count(*) filter ({OK}) / count(*) as confidence,
  case when count(*) filter (not is_fraud) > 0 then count(*) filter (not is_fraud and verdict <> 'approve') / count(*) filter (not is_fraud) else 0.0 end as false_positive_rate,
  count(*) filter (is_fraud and verdict = 'approve') as frauds_approved from inw group by 1, 2)
"""
CUTS = ", cuts as (select belief_id, t as at from v_beliefs, (values (timestamp '1997-06-01'), (timestamp '2000-01-01'), (timestamp '2030-01-01')) x(t))\n"
WHAT = """count(*) as affected, count(*) filter (verdict = 'approve') as withdrawn_approvals, count(*) filter (verdict <> 'approve') as withdrawn_blocks,
  count(*) filter (verdict = 'approve' and is_fraud) as frauds_auto_approved, count(*) filter (verdict <> 'approve' and is_fraud) as frauds_caught_by_block"""


def cuts(v: Views) -> DataFrame:
    instants = F.explode(F.expr("array(timestamp'1997-06-01', timestamp'2000-01-01', timestamp'2030-01-01')"))
    return v.beliefs.select("belief_id", instants.alias("at"))


@query("staleness_range_join", INW + "select belief_id, window_start, count(*) as n from inw group by 1, 2")
def _(v: Views) -> DataFrame:
    return S.in_windows(v.decisions, v.windows).groupBy("belief_id", "window_start").agg(F.count("*").alias("n"))


@query("belief_performance", PERF + "select * from perf")
def _(v: Views) -> DataFrame:
    return S.belief_performance(v.decisions, v.windows)


@query("offpattern_baseline", "select window_start, count(*) as n, count(*) filter (is_fraud) as frauds from v_decisions join (select distinct window_start, window_end from v_windows) on decided_at >= window_start and decided_at < window_end where belief_id is null group by 1")
def _(v: Views) -> DataFrame:
    return S.offpattern_baseline(v.decisions, v.windows)


@query("counterfactual_summary", CUTS + f"select belief_id, c.at, {WHAT}, count(distinct agent_id) as holders from v_decisions join cuts c using (belief_id) where decided_at > c.at group by 1, 2")
def _(v: Views) -> DataFrame:
    return S.counterfactual_summary(v.decisions, cuts(v))


@query("counterfactual_windows", INW + CUTS + f"select belief_id, c.at, window_start, {WHAT} from inw join cuts c using (belief_id) where decided_at > c.at group by 1, 2, 3")
def _(v: Views) -> DataFrame:
    return S.counterfactual_windows(v.decisions, cuts(v), v.windows)


@query("counterfactual_holders", CUTS + "select distinct belief_id, c.at, agent_id from v_decisions join cuts c using (belief_id) where decided_at > c.at")
def _(v: Views) -> DataFrame:
    return S.counterfactual_holders(v.decisions, cuts(v))


@query("what_if_invalidated_at", CUTS + """select belief_id, c.at, count(d.decision_id) as total_driven, count(*) filter (decided_at > c.at) as affected, count(*) filter (decided_at > c.at and verdict = 'approve') as withdrawn_approvals,
  count(distinct agent_id) filter (decided_at > c.at) as holders from cuts c left join v_decisions d using (belief_id) group by 1, 2""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return S.what_if(v.decisions, cuts(v))


@query("closure_open_counts", "select belief_id, count(*) as total, count(*) - count(invalidated_at) as open from v_inheritance group by 1")
def _(v: Views) -> DataFrame:
    return S.closure_open_counts(v.inheritance)


WILSON = "select belief_id, window_start, round(greatest(0.0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 9) as low, round(least(1.0, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 9) as high from (select *, correct / n as p from perf)"


@query("wilson_interval", PERF + WILSON)
def _(v: Views) -> DataFrame:
    low, high = wilson(F.col("correct"), F.col("n"))
    return S.belief_performance(v.decisions, v.windows).select("belief_id", "window_start", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("wilson_by_roots", PERF + WILSON)
def _(v: Views) -> DataFrame:
    low, high = wilson_by_roots(F.col("correct"), F.col("n"))
    return S.belief_performance(v.decisions, v.windows).select("belief_id", "window_start", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


ENDS = """, ends as (select belief_id, arg_min(window_start, window_start) as first_window_start, arg_min(n, window_start) as first_n, arg_min(correct, window_start) as first_correct,
  max(window_start) as last_window_start, arg_max(n, window_start) as last_n, arg_max(correct, window_start) as last_correct from perf group by 1)
"""
FISHER = """, tab as (select belief_id, first_correct as a, first_n - first_correct as b, last_correct as c, last_n - last_correct as d from ends
), terms as (
  select t.*, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) as base, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as k from tab t
), chances as (
  select *, exp(base - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) as pk, exp(base - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) as p0 from terms
), fisher as (
  select belief_id, round(case when any_value(a + b) = 0 or any_value(c + d) = 0 or any_value(a + c) = 0 or any_value(b + d) = 0 then 1.0 else least(1.0, sum(pk) filter (pk <= p0 * (1 + 1e-7))) end, 9) as p_value from chances group by 1
)
"""


@query("first_last_window", PERF + ENDS + "select * from ends")
def _(v: Views) -> DataFrame:
    return S.first_last(S.belief_performance(v.decisions, v.windows))


@query("fisher_exact_two_sided", PERF + ENDS + FISHER + "select belief_id, p_value from fisher")
def _(v: Views) -> DataFrame:
    d = S.first_last(S.belief_performance(v.decisions, v.windows))
    p = fisher_exact("first_correct", "(first_n - first_correct)", "last_correct", "(last_n - last_correct)")
    return d.select("belief_id", F.round(p, 9).alias("p_value"))


@query("staleness_evidence", PERF + """, stored as (select belief_id, case when belief_id % 7 = 3 and year(window_start) = 1996 then timestamp '2002-01-01' else window_start end as window_start,
  case when belief_id % 5 = 0 and year(window_start) = 1997 then confidence + 0.01 else confidence end as confidence from perf
), cmp as (select s.belief_id, s.window_start, p.n, p.correct, case when p.n is null then 'unavailable' when abs(p.confidence - s.confidence) > 1e-9 then 'disagreed' end as state from stored s left join perf p using (belief_id, window_start)
), ends as (select belief_id, min(window_start) as first_window_start, arg_min(n, window_start) as first_n, arg_min(correct, window_start) as first_correct, max(window_start) as last_window_start, arg_max(n, window_start) as last_n, arg_max(correct, window_start) as last_correct
  from cmp where n is not null group by 1)
""" + FISHER + """select v.belief_id, v.agreement, first_n, first_correct, last_n, last_correct, p_value, p_value < 0.05 and last_correct / last_n < first_correct / first_n as decay_supported
from (select belief_id, coalesce(arg_min(state, window_start) filter (state is not null), 'agreed') as agreement from cmp group by 1) v left join ends using (belief_id) left join fisher using (belief_id)""")
def _(v: Views) -> DataFrame:
    measured = S.belief_performance(v.decisions, v.windows)
    stored = measured.selectExpr(
        "belief_id", "case when belief_id % 7 = 3 and year(window_start) = 1996 then timestamp'2002-01-01' else window_start end as window_start",
        "case when belief_id % 5 = 0 and year(window_start) = 1997 then confidence + 0.01D else confidence end as confidence",
    )
    d = S.staleness_evidence(stored, measured)
    return d.select("belief_id", "agreement", "first_n", "first_correct", "last_n", "last_correct", F.round("p_value", 9).alias("p_value"), "decay_supported")


@query("witness_scorecard", ALL + """, c as (select w.typology as witness, outcome = 'MATCH' as fires, case when not label then 'benign' when l.typology = w.typology then 'own' else 'cross' end as part from wit w join v_labels l using (txn_id))
select witness, count(*) filter (part = 'own' and fires) as own, count(*) filter (part = 'own') as own_total, count(*) filter (part = 'cross' and fires) as "cross", count(*) filter (part = 'cross') as cross_total,
  count(*) filter (part = 'benign' and fires) as benign, count(*) filter (part = 'benign') as benign_total, count(*) filter (part = 'cross' and fires) = 0 as sound from c group by 1""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return S.witness_scorecard(v.matches, v.labels)


DET = ALL + ", det as (select l.*, f.flagged from v_labels l join (select txn_id, bool_or(outcome = 'MATCH' and typology in ('CYCLE', 'SCATTER-GATHER')) as flagged from wit group by 1) f using (txn_id))\n"
PRF = """select tp, fp, fn, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as "precision", case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall, case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) else 0.0 end as f1
from (select count(*) filter (flagged and label) as tp, count(*) filter (flagged and not label) as fp, count(*) filter (not flagged and label) as fn from det"""


def _detections(v: Views) -> DataFrame:
    return S.detection_rows(v.matches, v.labels)


@query("precision_recall_f1", DET + PRF + ")")
def _(v: Views) -> DataFrame:
    return S.precision_recall_f1(_detections(v))


@query("head_to_head", DET + PRF + " where not label or typology in ('CYCLE', 'SCATTER-GATHER'))")
def _(v: Views) -> DataFrame:
    return S.head_to_head(_detections(v), ("CYCLE", "SCATTER-GATHER"))


@query("per_instance_detection", DET + "select typology, instance, count(*) as edges, count(*) filter (flagged) as fires, bool_or(flagged) as any_hit, bool_and(flagged) as all_hit from det where label group by 1, 2")
def _(v: Views) -> DataFrame:
    return S.per_instance_detection(_detections(v))


@query("reconcile_totals", "select unnest(['labelled+benign=edges', 'tp+fn=labelled', 'instances=labelled', 'instance fires=tp']) as \"check\", true as ok")
def _(v: Views) -> DataFrame:
    return S.reconcile_totals(_detections(v))


LAB = ", rows as (select e.*, label, typology, instance from v_edges e join v_labels using (txn_id))\n"


def rows(v: Views) -> DataFrame:
    return v.edges.join(v.labels, "txn_id")


@query("format_label_crosstab", LAB + "select format, count(*) filter (label) as pos, count(*) filter (not label) as neg, count(*) filter (label) / count(*) as pos_rate from rows group by 1")
def _(v: Views) -> DataFrame:
    return S.crosstab(rows(v), "format")


@query("target_encode", LAB + "select txn_id, format_rate from rows join (select format, count(*) filter (label) / count(*) as format_rate from rows group by 1) using (format)")
def _(v: Views) -> DataFrame:
    return S.target_encode(rows(v), "format").select("txn_id", "format_rate")


F1SQL = """, per as (select feature, score, count(*) filter (label) as p, count(*) as k from long group by 1, 2
), run as (select *, sum(p) over (partition by feature order by score desc) as tp, sum(k) over (partition by feature order by score desc) as taken, sum(p) over (partition by feature) as pos from per
), fs as (select feature, score, coalesce(2 * tp / nullif(taken + pos, 0), 0) as f1 from run), best as (select feature, score as threshold, f1, row_number() over (partition by feature order by f1 desc, score desc) as r from fs)
"""


@query("best_f1_threshold", LAB + ", long as (select 'amount' as feature, cast(amount_cents as double) as score, label from rows)" + F1SQL + "select threshold, f1 from best where r = 1")
def _(v: Views) -> DataFrame:
    return S.best_f1_threshold(rows(v).withColumn("score", F.col("amount_cents").cast("double")), [], "score")


FEATURES = {"amount": "amount_cents", "negative_amount": "-amount_cents", "month": "month(ts)", "weekday": "weekday(ts)", "returned": "int(format like 'R%')", "filled": "int(format like '%F')", "hub": "int(src = dst)"}


@query("best_single_feature_rule", LAB + """, long as (select label, unnest(['amount', 'negative_amount', 'month', 'weekday', 'returned', 'filled', 'hub']) as feature,
  unnest([amount_cents::double, -amount_cents::double, month(ts)::double, (isodow(ts) - 1)::double, (format like 'R%')::int::double, (format like '%F')::int::double, (src = dst)::int::double]) as score from rows)""" + F1SQL + "select feature, threshold, f1 from best where r = 1")
def _(v: Views) -> DataFrame:
    return S.best_single_feature(rows(v), FEATURES)


@query("logistic_baseline")
def _(v: Views) -> DataFrame:
    d = rows(v).withColumn("day_part", F.concat(F.lit("m"), F.month("ts").cast("string")))
    return S.logistic_baseline(d, {"log_amount": "log1p(amount_cents)"}, "day_part")


@query("split_overlap", LAB + """, dev as (select * from rows where instance % 2 = 0), hold as (select * from rows where instance % 2 = 1 or format = 'RF'), da as (select src as x from dev union select dst from dev), ha as (select src as x from hold union select dst from hold)
select 'accounts' as part, (select count(*) from (select x from da intersect select x from ha)) as overlap union all select 'edges', (select count(*) from (select txn_id from dev intersect select txn_id from hold))
union all select 'benign', (select count(*) from (select txn_id from dev where not label intersect select txn_id from hold where not label))""")  # fmt: skip
def _(v: Views) -> DataFrame:
    d = rows(v)
    return S.split_overlap(d.filter("instance % 2 = 0"), d.filter("instance % 2 = 1 or format = 'RF'"))


@query("block_profile", """select typology, count(*) as n, min(k) as least, cast(quantile_cont(k, 0.5) as double) as median, max(k) as most, count(*) filter (k = 1) / count(*) as single_share
from (select typology, instance, count(*) as k from v_labels group by 1, 2) group by 1""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return S.block_profile(v.labels)


@query("label_profile", LAB + "select format, count(*) as n, sum(amount_cents)::bigint as cents from rows where label group by 1 order by n desc, format limit 5")
def _(v: Views) -> DataFrame:
    d = rows(v).filter("label").groupBy("format").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))
    return d.orderBy(F.desc("n"), "format").limit(5)


@query("judge_summary", "select event_type as category, count(*) as n, count(*) filter (event_id % 11 = 0) as failed, round(avg(case when event_id % 11 <> 0 then (event_id % 100) / 100.0 end), 3) as mean_score from events group by 1")
def _(v: Views) -> DataFrame:
    scores = v.table("events").selectExpr("event_type as category", "case when event_id % 11 <> 0 then (event_id % 100) / 100D end as score")
    return S.judge_summary(scores)


@query("artifact_diff", PERF + """, a as (select belief_id || '/' || year(window_start) as path, confidence as value from perf where belief_id < 20), b as (select belief_id || '/' || year(window_start) as path, case when belief_id % 3 = 0 then confidence + 0.5 else confidence end as value from perf where belief_id > 2)
select path, a.value as a, b.value as b, case when a.value is null then 'missing in a' when b.value is null then 'missing in b' else 'differs' end as problem from a full join b using (path) where a.value is null or b.value is null or abs(a.value - b.value) > 1e-9""")  # fmt: skip
def _(v: Views) -> DataFrame:
    p = S.belief_performance(v.decisions, v.windows).withColumn("path", F.concat_ws("/", "belief_id", F.year("window_start")))
    a = p.filter("belief_id < 20").select("path", F.col("confidence").alias("value"))
    b = p.filter("belief_id > 2").selectExpr("path", "case when belief_id % 3 = 0 then confidence + 0.5D else confidence end as value")
    return S.artifact_diff(a, b)
