"""Content-hashed certificates of revocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.written import cut
from strandlog.operators.closure import inheritance_closure


def canonical_hash(*columns: str) -> Column:
    """sha256 of compact JSON with sorted keys, nulls written out. Use strings, integers and booleans only."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def world_hash(closure: DataFrame, agents: DataFrame) -> DataFrame:
    """belief_id, n_agents, world_hash: the hash of a belief's closure in a total order (depth, generation, agent)."""
    d = closure.join(agents.select("agent_id", "generation"), "agent_id", "left")
    d = d.groupBy("belief_id").agg(F.count("*").alias("n_agents"), F.array_sort(F.collect_list(F.struct("depth", F.coalesce("generation", F.lit(-1)).alias("g"), "agent_id"))).alias("world"))
    said = F.array_join(F.transform("world", lambda x: F.concat_ws(":", x["depth"], x["g"], x["agent_id"])), "|")
    return d.select("belief_id", "n_agents", F.concat(F.lit("sha256:"), F.sha2(said, 256)).alias("world_hash"))


FIELDS = ["belief_id", "revoked_at", "affected_edges", "affected_agents", "open_before", "pre_state_source", "world_hash", "agreement"]


def build_certificates(events: DataFrame, worlds: DataFrame, staleness: DataFrame) -> DataFrame:
    """One certificate for each accepted event, with the hash over all its other fields."""
    d = events.filter("refusal is null").join(worlds.select("belief_id", "world_hash"), "belief_id", "left").join(staleness.select("belief_id", "agreement"), "belief_id", "left")
    d = d.withColumn("revoked_at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    d = d.withColumn("pre_state_source", F.when(F.col("edges_before") > 0, "recorded").otherwise("derived"))
    d = d.select(*FIELDS)
    return d.withColumn("content_hash", canonical_hash(*FIELDS))


def verify_certificates(certificates: DataFrame) -> DataFrame:
    return certificates.select("belief_id", "content_hash", (canonical_hash(*FIELDS) == F.col("content_hash")).alias("valid"))


def state_at(audits: DataFrame, beliefs: DataFrame, inheritance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The beliefs and edges that each audit (audit_id, belief_id, at) saw, under the audit's id: those that were there by its
    instant, with what had been revoked by then."""
    by_then = lambda c: F.when(F.col(c) <= F.col("at"), F.col(c)).alias(c)
    b = audits.join(beliefs, "belief_id").filter("formed_at <= at").select("audit_id", "originating_agent_id", by_then("invalidated_at"))
    e = audits.join(inheritance, "belief_id").filter("inherited_at <= at").select("audit_id", "from_agent_id", "to_agent_id", "inherited_at", by_then("invalidated_at"))
    return b, e


def certify_independently(audits: DataFrame, stored: DataFrame, beliefs: DataFrame, inheritance: DataFrame, agents: DataFrame) -> DataFrame:
    """belief_id, at, total, open, verified, agreement of audits (belief_id, at), from the tables alone.

    The state is derived again as of each audit's instant, not today's: verified if the belief was active and had edges, all
    of them open; its closure's hash is held against the stored certificate's: agreed, disagreed or unavailable."""
    audits = cut(audits.withColumn("audit_id", F.monotonically_increasing_id()), "audits")
    b, e = state_at(audits, beliefs, inheritance)
    as_belief = lambda d: d.withColumnRenamed("audit_id", "belief_id")  # noqa: E731  each audit has a world of its own
    now = world_hash(inheritance_closure(as_belief(b), as_belief(e)), agents).select(F.col("belief_id").alias("audit_id"), F.col("world_hash").alias("now"))
    edges = e.groupBy("audit_id").agg(F.count("*").alias("total"), F.count_if(F.col("invalidated_at").isNull()).alias("open"))
    active = b.filter("invalidated_at is null").select("audit_id", F.lit(True).alias("active"))
    d = audits.join(active, "audit_id", "left").join(edges, "audit_id", "left").join(now, "audit_id", "left").join(stored.select("belief_id", F.col("world_hash").alias("then")), "belief_id", "left")
    none = F.lit(0).cast("long")
    verified = F.coalesce(F.col("active") & (F.col("open") == F.col("total")) & (F.col("total") > 0), F.lit(False))
    agreement = F.when(F.col("then").isNull(), "unavailable").when(F.col("then") == F.col("now"), "agreed").otherwise("disagreed")
    return d.select("belief_id", "at", F.coalesce("total", none).alias("total"), F.coalesce("open", none).alias("open"), verified.alias("verified"), agreement.alias("agreement"))
