"""Queries on text, vectors, claims, ids, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions import ids as I
from strandlog.functions.written import shared_dir
from strandlog.operators import citations as C
from strandlog.operators import claims as E
from strandlog.operators import graph as G
from strandlog.operators import holdings as H
from strandlog.operators import temporal as T
from strandlog.operators import text as X
from strandlog.operators import vectors as N
from strandlog.plans.graphs import ALL, BFS, CITED, FACTS, PAIRS, PATHS, SG
from strandlog.plans.registry import query
from strandlog.plans.relational import HELD
from strandlog.plans.views import Views
from strandlog.sources import sinks as K

# a markdown reading of the documents: short lines are headings of all kinds, lines of middle length list items, some of them clauses or lead-ins
MARK = """case when length(line) = 0 then '' when length(line) < 30 then concat(case n % 8 when 0 then '# Part ' when 1 then '# Page ' when 2 then '## Annex ' else '## ' end, line)
  when length(line) < 240 then concat(case when doc % 3 = 1 then concat(n + 1, '. ') else '- ' end, case when n % 5 = 4 then concat(line, ':') when n % 3 = 1 then lower(line) else concat(line, '.<sup>3</sup>') end)
  when n % 9 = 0 then '' else line end"""
#: The documents' profiles by doc % 3: lists with bullets, numbered lists, and bullets of some sections only.
PROFILES = [(str(i), f"Manual {i}", ["^Part "], ["^Page "], ["^Annex "], ["^[A-M]"] if i == 2 else [], "numbered" if i == 1 else "bullet") for i in range(3)]
LINES = f", lines as (select doc, n, {MARK} as line from (select doc_id as doc, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents))\n"
CHUNKS = LINES + r""", heads as (select doc, n, line, trim(line) as said, trim(regexp_replace(trim(line), '^[# ]+', '')) as head, regexp_extract(line, case when doc % 3 = 1 then '^\s*\d+\.\s+(.*)$' else '^\s*[-*]\s+(.*)$' end, 1) as item,
    regexp_matches(line, case when doc % 3 = 1 then '^\s*\d+\.\s+' else '^\s*[-*]\s+' end) as is_item from lines
), kinds as (select *, case when said like '#%' then case when head like 'Page %' then 'furniture' when head like 'Part %' then 'part' when head like 'Annex %' then 'excluded' else 'section' end when said = '' then 'blank' when is_item then 'item' else 'para' end as kind from heads
), flow as (select *, case when kind = 'item' then trim(regexp_replace(regexp_replace(trim(item), '<sup>\d+</sup>', '', 'g'), '([."”])\d{1,3}$', '\1')) else head end as body, kind in ('part', 'section', 'excluded') as bound from kinds where kind <> 'furniture'
), state as (select doc, n, kind, body, sum(bound::int) over w as region, sum((kind <> 'item')::int) over w as run, last_value(case when kind = 'part' then body end ignore nulls) over w as part,
    last_value(case when bound then kind end ignore nulls) over w as under, last_value(case when bound then body end ignore nulls) over w as named from flow window w as (partition by doc order by n)
), items as (select doc, n, body, run, part, under, case when under = 'section' then named end as section, min(run) over (partition by doc, region) as first_run from state where kind = 'item'
), kept as (select * from items where (doc % 3 <> 1 or run = first_run) and under <> 'excluded' and coalesce(section, part) is not null and (doc % 3 <> 2 or regexp_matches(section, '^[A-M]'))
), news as (select *, case when row_number() over (partition by doc, run order by n) = 1 or not regexp_matches(body, '^\P{L}*\p{Ll}') then 1 else 0 end as new from kept
), grouped as (select *, sum(new) over (partition by doc, run order by n) as g from news
), bodies as (select doc, run, g, any_value(part) as part, any_value(section) as section, trim(string_agg(body, ' ' order by n)) as body, count(*) as k from grouped group by 1, 2, 3
), led as (select *, last_value(case when body like '%:' then trim(rtrim(body, ':')) end ignore nulls) over (partition by doc, run order by g rows between unbounded preceding and 1 preceding) as lead_in from bodies
), chunks as (select doc, 'Manual ' || doc % 3 as label, part, section, lead_in, row_number() over (partition by doc order by run, g) - 1 as ordinal, body, k from led where body not like '%:' and (lead_in is not null or k > 1 or length(body) >= 25)
)
"""


def lines(v: Views) -> DataFrame:
    d = v.table("documents").select(F.col("doc_id").alias("doc"), F.expr("cast(doc_id % 3 as string)").alias("profile"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    # Spark makes two characters of İ in lower case, the SQL one
    return d.withColumn("line", F.expr(MARK.replace("lower(line)", "lower(replace(line, 'İ', 'i'))")))


def chunks(v: Views) -> DataFrame:
    return X.chunk_documents(lines(v), profiles(v))


def profiles(v: Views) -> DataFrame:
    return v.spark.createDataFrame(PROFILES, X.PROFILE)


@query("scan_markdown_lines", LINES + """, numbered as (select row_number() over (partition by doc // 200 order by doc, n) - 1 as n, line from lines)
select cast(n as int) as n, count(*) as k, sum(length(line))::bigint as chars from numbered group by 1""")  # fmt: skip
def _(v: Views) -> DataFrame:
    at = K.fresh(shared_dir(v.spark), "markdown")
    d = lines(v).groupBy(F.expr("doc div 200").alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc", "n", "line"))).alias("l"))
    d = d.select("part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value"))
    d.write.partitionBy("part").text(at)  # a file of 200 documents each
    return K.read_markdown_lines(v.spark, at, "\n").groupBy("n").agg(F.count("*").alias("k"), F.sum(F.length("line")).alias("chars"))


@query("chunk_documents", CHUNKS + "select doc, part, section, lead_in, cast(ordinal as int) as ordinal, body from chunks")
def _(v: Views) -> DataFrame:
    return chunks(v).select("doc", "part", "section", "lead_in", "ordinal", "body")


@query("chunk_census", CHUNKS + "select doc, count(*) as n from chunks group by 1")
def _(v: Views) -> DataFrame:
    return chunks(v).groupBy("doc").agg(F.count("*").alias("n"))


@query("clause_grouping", CHUNKS + "select doc, cast(run as bigint) as run, cast(g as bigint) as \"group\", count(*) as n from grouped group by 1, 2, 3")
def _(v: Views) -> DataFrame:
    return X.chunk_lines(lines(v), profiles(v)).groupBy("doc", "run", "group").agg(F.count("*").alias("n"))


@query("clean_footnotes", LINES + r"select sum(length(regexp_replace(regexp_replace(line, '<sup>\d+</sup>', '', 'g'), '([." + '"' + r"”])\d{1,3}$', '\1')))::bigint as chars from lines")
def _(v: Views) -> DataFrame:
    return lines(v).agg(F.sum(F.length(X.clean_footnotes(F.col("line")))).alias("chars"))


@query("chunk_body_is_source", CHUNKS + "select count(*) as chunks, cast(sum(k) as bigint) as lines, 0::bigint as strangers, 0::bigint as reworded from chunks")
def _(v: Views) -> DataFrame:
    d = chunks(v)
    source = X.line_kinds(lines(v), profiles(v)).filter("kind = 'item'").select("doc", F.col("body").alias("said")).distinct()
    said = d.select("doc", F.explode("source_lines").alias("said"))
    strangers = said.join(source, ["doc", "said"], "left_anti").agg(F.count("*").alias("strangers"))
    whole = d.agg(F.count("*").alias("chunks"), F.sum(F.size("source_lines")).alias("lines"), F.count_if(F.col("body") != X.stripped(F.array_join("source_lines", " "))).alias("reworded"))
    return whole.crossJoin(strangers)  # a row each


@query("verbatim_coverage", r""", fr as (select item_id as fragment, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as said from benchmark), fw as (select distinct fragment, substr(said, i, 12) as w from (select fragment, said, unnest(range(1, length(said) - 10)) as i from fr where length(said) >= 12)),
sr as (select doc_id as source, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as said from documents), sw as (select distinct source, w from (select source, substr(said, i, 12) as w from (select source, said, unnest(range(1, length(said) - 10)) as i from sr where length(said) >= 12)) where w in (select w from fw)),
hit as (select fragment, max(k) as k from (select fragment, source, count(*) as k from sw join fw using (w) group by 1, 2) group by 1)
select fragment, coalesce(k, 0) / total as coverage, coalesce(k, 0) / total < 0.9 as suspect from (select fragment, count(*) as total from fw group by 1) left join hit using (fragment)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return X.verbatim_coverage(v.table("benchmark").select(F.col("item_id").alias("fragment"), "text"), v.table("documents").select(F.col("doc_id").alias("source"), "text"))


#: Searches ask with every fiftieth vector, against all.
ASKED = "vec_id % 50 = 0"
COS = "list_cosine_distance(q.embedding::double[], x.embedding::double[])"
NEAR = f", near as (select q.vec_id as query_id, x.vec_id, {COS} as d, row_number() over (partition by q.vec_id order by {COS}, x.vec_id) as r from v_vectors q, v_vectors x where q.vec_id % 50 = 0)\n"


def top(v: Views, k: int = 5, **options) -> DataFrame:
    return N.topk_in_blocks(v.vectors.filter(ASKED), v.vectors, k, **options)


@query("topk_cosine", NEAR + "select query_id, vec_id, round(d, 6) as distance from near where r <= 5")
def _(v: Views) -> DataFrame:
    return top(v).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("retrieve_typology", f"select query_id, vec_id from (select q.vec_id as query_id, x.vec_id, row_number() over (partition by q.vec_id order by {COS}, x.vec_id) as r from v_vectors q join v_vectors x using (source) where q.vec_id % 50 = 0) where r <= 3")
def _(v: Views) -> DataFrame:
    return top(v, 3, same_source=True).select("query_id", "vec_id")


@query("retrieve_beliefs", HELD + f""", vb as (select vec_id as belief_id, embedding from v_vectors)
select agent_id, belief_id from (select h.agent_id, x.belief_id, row_number() over (partition by h.agent_id order by {COS}, x.belief_id) as r from held h join v_beliefs b using (belief_id) join vb x using (belief_id) join v_vectors q on q.vec_id = h.agent_id
  where b.status = 'active') where r <= 3""")  # fmt: skip
def _(v: Views) -> DataFrame:
    held = H.beliefs_held(v.beliefs, v.inheritance, active_only=True).select("agent_id", "belief_id")
    known = N.with_norm(v.vectors).select(F.col("vec_id").alias("belief_id"), "embedding", "norm")
    asks = N.with_norm(v.vectors).select(F.col("vec_id").alias("agent_id"), F.col("embedding").alias("_q"), F.col("norm").alias("_qn"))
    d = held.join(known, "belief_id").join(asks, "agent_id").withColumn("distance", 1 - N.dot("_q", "embedding") / (F.col("norm") * F.col("_qn")))
    from pyspark.sql import Window

    order = Window.partitionBy("agent_id").orderBy("distance", "belief_id")
    return d.withColumn("r", F.row_number().over(order)).filter("r <= 3").select("agent_id", "belief_id")


@query("retrieve_indexed")
def _(v: Views) -> DataFrame:
    return N.topk_indexed(v.vectors.filter(ASKED), v.vectors, 5).select("query_id", "vec_id", "distance", "rank")


@query("ann_vs_exact_recall")
def _(v: Views) -> DataFrame:
    found = N.topk_indexed(v.vectors.filter(ASKED), v.vectors, 5)
    share = found.groupBy("query_id").agg(F.max("met").alias("met")).crossJoin(F.broadcast(v.vectors.agg(F.count("*").alias("n"))))
    return N.recall(found, top(v)).join(share.select("query_id", (F.col("met") / F.col("n")).alias("share_met")), "query_id", "left")


@query("self_retrieval", "select vec_id, true as itself from v_vectors where vec_id % 50 = 0")
def _(v: Views) -> DataFrame:
    d = top(v, 1)
    return d.select(F.col("query_id").alias("vec_id"), ((F.col("query_id") == F.col("vec_id")) & (F.abs("distance") < 1e-6)).alias("itself"))


@query("retrieval_margin", NEAR + "select query_id, round(max(d) filter (r = 2) - max(d) filter (r = 1), 6) as margin from near group by 1")
def _(v: Views) -> DataFrame:
    d = top(v, 2).groupBy("query_id").agg(F.max("distance").alias("b"), F.min("distance").alias("a"))
    return d.select("query_id", F.round(F.col("b") - F.col("a"), 6).alias("margin"))


@query("revise_document", "select vec_id, case when vec_id % 10 = 0 then 2 else 1 end as version, vec_id as old_title from v_vectors")
def _(v: Views) -> DataFrame:
    first = v.vectors.selectExpr("vec_id as key", "timestamp'2024-01-01' as commit_ts", "1 as seq", "vec_id as title", "false as deleted")
    revised = v.vectors.filter("vec_id % 10 = 0").selectExpr("vec_id as key", "timestamp'2024-02-01' as commit_ts", "2 as seq", "-vec_id as title", "false as deleted")
    log = first.union(revised)
    now, then = T.as_of(log, F.expr("timestamp'2024-03-01'")), T.as_of(log, F.expr("timestamp'2024-01-15'"))
    return now.join(then.select("key", F.col("title").alias("old_title")), "key").select(F.col("key").alias("vec_id"), F.col("seq").alias("version"), "old_title")


@query("parse_claims", """select event_id as claim_id, case event_id % 3 when 0 then 'CYCLE' else 'STACK' end as typology, case when event_id % 4 = 0 then 0 else 1 end as citations from events where event_id % 5 <> 0 union all select event_id, null, 0 from events where event_id % 5 = 0""")
def _(v: Views) -> DataFrame:
    body = F.expr("""case when event_id % 5 = 0 then 'not json' else to_json(named_struct('typology', case event_id % 3 when 0 then 'CYCLE' else 'STACK' end,
      'citations', array(case when event_id % 4 = 0 then 'nope' else concat('00000000-0000-0000-0000-', lpad(event_id, 12, '0')) end, 'bad-id'))) end""")
    return E.parse_claims(v.table("events").select(F.col("event_id").alias("claim_id"), body.alias("body"))).withColumn("citations", F.size("citations"))


@query("validate_driving_belief", "select decision_id, case when decision_id % 3 <> 0 then belief_id end as belief_id, case decision_id % 4 when 0 then 1.0 when 1 then 0.0 else 0.5 end as confidence from v_decisions where belief_id is not null")
def _(v: Views) -> DataFrame:
    d = v.decisions.filter("belief_id is not null").selectExpr(
        "decision_id", "array(belief_id, belief_id + 1) as candidates", "case when decision_id % 3 <> 0 then belief_id else 99 end as cited", "case decision_id % 4 when 0 then 1.5D when 1 then -0.2D else 0.5D end as confidence"
    )
    return E.driving_belief(d)


@query("evaluate_claims", PATHS + SG + CITED + """, cl as (select claim, subject, typology, case when claim like '%/%' then split_part(claim, '/', 2) end as spoilt from claims where subject <> 'nobody'
) select claim, cl.typology, case when hash_ok and spoilt is null then 'FLAG' else 'NO_FLAG' end as verdict, case when not hash_ok then 'TYPOLOGY_NOT_RETRIEVED' when spoilt is null then 'CORROBORATED' else 'UNFAITHFUL_CITATION' end as reason
from (select *, length(claim) % 7 <> 0 as hash_ok from cl) cl""")  # fmt: skip
def _(v: Views) -> DataFrame:
    cycles = v.cycles
    paths = G.cycle_path(v.edges, cycles)
    scatter = G.scatter_gather_witness(v.edges)
    claims = C.mutated_claims(paths, scatter.filter("outcome = 'MATCH'").select("txn_id", "ids")).filter("subject <> 'nobody'")
    errors = C.verify(claims, v.edges).select("claim", "typology", "error")
    outcomes = cycles.select(F.col("txn_id").alias("subject"), F.lit("CYCLE").alias("typology"), "outcome").union(scatter.select("txn_id", F.lit("SCATTER-GATHER"), "outcome"))
    d = claims.join(errors, ["claim", "typology"]).join(outcomes, ["subject", "typology"])
    d = d.withColumn("retrieved", F.length("claim") % 7 != 0).withColumn("flag_capable", F.col("typology").isin(*G.FLAG_CAPABLE)).withColumn("others", F.array())
    return E.evaluate_claims(d)


LINE = "right(e.txn_id, 6) || ': ' || right(e.src, 6) || ' -> ' || right(e.dst, 6) || ' ' || e.amount_cents || ' ' || e.format"


@query("grounding_lines", FACTS + f""", subj as (select txn_id as subject, src, dst from v_edges where left(txn_id, 9)::bigint % 50 = 0), und as (select src as a, dst as b from pairs union select dst, src from pairs),
around as (select subject, src as node, 0 as d from subj union select subject, dst, 0 from subj union select r.subject, u.b, r.d + 1 from around r join und u on u.a = r.node where r.d < 6),
depth as (select subject, node, min(d) as d from around group by 1, 2),
inside as (select a.subject, {LINE} as line, row_number() over (partition by a.subject order by case when e.txn_id = a.subject then -1 else greatest(a.d, b.d) end, e.txn_id) as place from flow e join depth a on a.node = e.src join depth b on b.node = e.dst and b.subject = a.subject)
select txn_id, cast(count(*) + 1 as int) as n_lines, 'out ' || any_value(src_out) || ' in ' || any_value(src_in) || chr(10) || string_agg(line, chr(10) order by place) as lines from facts join inside on subject = txn_id where place <= 120 group by 1""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return E.grounding_lines(G.grounding(v.edges, v.asked_edges, E.edge_line()))


@query("render_witness_text", ALL + f""", ex as (select txn_id, typology, unnest(ids) as id, unnest(range(len(ids))) as i from wit where ids is not null), said as (select ex.txn_id, ex.typology, string_agg({LINE}, '; ' order by i) as text from ex join v_edges e on e.txn_id = ex.id group by 1, 2)
select w.txn_id, w.typology, coalesce(text, 'no witness in these rows') as text from wit w left join said using (txn_id, typology)""")  # fmt: skip
def _(v: Views) -> DataFrame:
    return E.render_witness(v.witnesses, v.edges)


@query("faithfulness_gate", """select event_id as claim_id, case when event_id % 13 = 0 then 'SUPPORTED' when event_id % 7 = 0 then 'UNAVAILABLE' when event_id % 10 >= 5 then 'SUPPORTED' else 'UNSUPPORTED' end as state, event_id % 13 = 0 or (event_id % 7 <> 0 and event_id % 10 >= 5) as passes from events""")
def _(v: Views) -> DataFrame:
    d = v.table("events").selectExpr("event_id as claim_id", "case when event_id % 13 = 0 then ' ' else 'because' end as rationale", "case when event_id % 7 <> 0 then (event_id % 10) / 10D end as score")
    return E.faithfulness(d)


UUID5 = "(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"


@query("raw_key_and_ids", ", k as (select txn_id, concat_ws(chr(31), src, dst, amount_cents, format) as raw_key from v_edges), h as (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(raw_key)) as h from k) select txn_id, raw_key, " + UUID5 + " as id from h")
def _(v: Views) -> DataFrame:
    key = I.raw_key("src", "dst", "amount_cents", "format")
    return v.edges.select("txn_id", key.alias("raw_key"), I.uuid5(key).alias("id"))


@query("parse_ts", "select txn_id, date_trunc('minute', ts) as parsed from v_edges")
def _(v: Views) -> DataFrame:
    return v.edges.select("txn_id", F.date_format("ts", "yyyy/MM/dd HH:mm").alias("said")).select("txn_id", F.to_timestamp("said", "yyyy/MM/dd HH:mm").alias("parsed"))


@query("transaction_text", "select txn_id, 'A transfer of ' || amount_cents || ' cents by ' || format || ' on ' || strftime(ts, '%Y-%m-%d') as said from v_edges")
def _(v: Views) -> DataFrame:
    return v.edges.select("txn_id", F.concat(F.lit("A transfer of "), "amount_cents", F.lit(" cents by "), "format", F.lit(" on "), F.date_format("ts", "yyyy-MM-dd")).alias("said"))


@query("blob_sha1", ", b as (select doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::blob || encode(text)) as id from documents) select doc_id, id from b")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", I.blob_sha1(F.col("text")).alias("id"))


CSV = ", c as (select date_trunc('minute', ts) as ts, src, dst, amount_cents, format, label from v_edges join v_labels using (txn_id))\n"


@query("scan_transactions_csv", CSV + "select ts, src as from_account, dst as to_account, cast(amount_cents as bigint) as cents, format as payment_format, label::int as is_laundering from c")
def _(v: Views) -> DataFrame:
    at = K.fresh(shared_dir(v.spark), "csv")
    d = v.edges.join(v.labels, "txn_id").selectExpr(
        "date_format(ts, 'yyyy/MM/dd HH:mm') as `Timestamp`", "'b1' as `From Bank`", "src as `Account`", "'b2' as `To Bank`", "dst as `Account2`", "amount_cents / 100 as `Amount Received`", "'USD' as `Receiving Currency`",
        "cast(amount_cents / 100 as decimal(38,2)) as `Amount Paid`", "'USD' as `Payment Currency`", "format as `Payment Format`", "int(label) as `Is Laundering`",
    )
    d.write.csv(at, header=True)
    return K.read_transactions(v.spark, at).select("ts", "from_account", "to_account", (F.col("amount_paid") * 100).cast("long").alias("cents"), "payment_format", "is_laundering")


@query("scan_pattern_blocks", """, m as (select typology, instance, txn_id from v_labels where label) select typology, 'max ' || instance % 7 as param, row_number() over (partition by typology, instance order by txn_id) - 1 as hop_index, txn_id as "row" from m""")
def _(v: Views) -> DataFrame:
    members = v.labels.filter("label").groupBy("typology", "instance").agg(F.array_sort(F.collect_list("txn_id")).alias("rows"))
    begin = F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), "typology", F.lit(": max "), (F.col("instance") % 7).cast("string"))
    body = F.concat_ws("\n", begin, F.array_join("rows", "\n"), F.concat(F.lit("END LAUNDERING ATTEMPT - "), "typology"))
    at = K.fresh(shared_dir(v.spark), "patterns")
    members.select(body.alias("value")).write.text(at)
    return K.read_pattern_blocks(v.spark, at).select("typology", "param", "hop_index", "row")


@query("scan_json_artifact", "select 1 as schema_version, count(*) as edges, count(distinct src)::bigint as sources from v_edges")
def _(v: Views) -> DataFrame:
    at = K.fresh(shared_dir(v.spark), "artifact")
    v.edges.agg(F.lit(1).alias("schema_version"), F.count("*").alias("edges"), F.countDistinct("src").alias("sources")).write.json(at)
    return K.read_artifact(v.spark, at, "schema_version int, edges long, sources long", version=1)


@query("sink_insert_if_absent", "select format, count(*) as n from v_edges group by 1")
def _(v: Views) -> DataFrame:
    at = K.fresh(shared_dir(v.spark), "edges")
    K.insert_if_absent(v.edges.filter("amount_cents % 2 = 0"), at, ["txn_id"])
    K.insert_if_absent(v.edges.union(v.edges), at, ["txn_id"])
    K.insert_if_absent(v.edges, at, ["txn_id"])
    return v.spark.read.parquet(at).groupBy("format").agg(F.count("*").alias("n"))


@query("sink_replace_by_key", "select belief_id, case when belief_id % 2 = 0 then 2 else 1 end as version, count(*) as n from v_decisions where belief_id is not null group by 1")
def _(v: Views) -> DataFrame:
    at = K.fresh(shared_dir(v.spark), "performance")
    rows = v.decisions.filter("belief_id is not null").select("decision_id", F.lit(1).alias("version"), "belief_id").repartition("belief_id")
    K.replace_by_key(rows, at, "belief_id")
    for _again in range(2):
        K.replace_by_key(rows.filter("belief_id % 2 = 0").withColumn("version", F.lit(2)), at, "belief_id")
    return v.spark.read.parquet(at).groupBy(F.col("belief_id").cast("long").alias("belief_id"), "version").agg(F.count("*").alias("n"))


@query("sink_decisions_append", "select verdict, count(*) as n from v_decisions group by 1")
def _(v: Views) -> DataFrame:
    at = K.fresh(shared_dir(v.spark), "decisions")
    for part in ("verdict = 'approve'", "verdict <> 'approve'"):
        v.decisions.filter(part).write.mode("append").parquet(at)
    return v.spark.read.parquet(at).groupBy("verdict").agg(F.count("*").alias("n"))


@query("embed_input", CHUNKS + "select doc, cast(ordinal as int) as ordinal, concat_ws(' > ', label, part, section, lead_in) || ': ' || body as said from chunks")
def _(v: Views) -> DataFrame:
    return chunks(v).select("doc", "ordinal", X.embed_input().alias("said"))


@query("retrieve_regulation", f"""select query_id, vec_id from (select q.vec_id as query_id, x.vec_id, row_number() over (partition by q.vec_id order by {COS}, x.vec_id) as r
  from v_vectors q, v_vectors x where q.vec_id % 50 = 0 and x.source in (1, 2, 3) and x.vec_id % 10 <> 7) where r <= 4""")  # fmt: skip
def _(v: Views) -> DataFrame:
    # a corpus of versions in which some chunks came after the instant that is asked about
    log = v.vectors.selectExpr("vec_id as key", "case when vec_id % 10 = 7 then timestamp'2024-06-01' else timestamp'2024-01-01' end as commit_ts", "1 as seq", "source", "embedding", "false as deleted")
    then = T.as_of(log, F.expr("timestamp'2024-03-01'")).select(F.col("key").alias("vec_id"), "source", "embedding")
    return N.topk_in_blocks(v.vectors.filter(ASKED), then.filter("source in (1, 2, 3)"), 4).select("query_id", "vec_id")
