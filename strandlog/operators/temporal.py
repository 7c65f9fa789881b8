"""State at an instant, revocation as one event, and what samples of a change look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The newest version of each key at an instant, less deleted keys. ``versions`` has key, commit_ts, seq, deleted.

    Pre-aggregated before the shuffle, so a key with very many versions costs one row a task."""
    rest = [c for c in versions.columns if c not in ("key", "commit_ts", "seq")]
    newest = versions.filter(F.col("commit_ts") <= at).groupBy("key").agg(F.max_by(F.struct("commit_ts", "seq", *rest), F.struct("commit_ts", "seq")).alias("v"))
    return newest.select("key", "v.*").filter("not deleted")


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def normalized_instant(text: str) -> Column:
    """The instant that a column's text names: ISO-8601 (without zone: UTC) or decimal nanoseconds with a logical part.
    Null if it is neither."""
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    nanos = F.timestamp_micros((F.regexp_extract(text, r"^([0-9]+)(\.[0-9]+)?$", 1).cast("decimal(38,0)") / 1000).cast("long"))
    return F.when(F.col(text).rlike(r"^[0-9]+(\.[0-9]+)?$"), nanos).when(F.col(text).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ?$"), iso)


def checked_instant(text: str, oldest: Column, newest: Column) -> Column:
    """struct(instant, problem): the instant that a column's text names and null, or null and MALFORMED or OUT_OF_RANGE:
    before what is still kept, or in the future."""
    instant = normalized_instant(text)
    problem = F.when(instant.isNull(), "MALFORMED").when((instant < oldest) | (instant > newest), "OUT_OF_RANGE")
    return F.struct(F.when(problem.isNull(), instant).alias("instant"), problem.alias("problem"))


def required_instant(text: str, oldest: Column, newest: Column) -> Column:
    """The instant of a column's text; a text that names none within range fails the query."""
    c = checked_instant(text, oldest, newest)
    return F.when(c["problem"].isNotNull(), F.raise_error(F.concat(c["problem"], F.lit(": "), F.coalesce(text, F.lit("null"))))).otherwise(c["instant"])


def as_of_text(versions: DataFrame, text: str, oldest: Column, newest: Column) -> DataFrame:
    """``as_of`` the instant that a text names; raises ValueError if there is no such instant or it is out of range."""
    c = versions.sparkSession.createDataFrame([(text,)], "t string").select(checked_instant("t", oldest, newest).alias("c")).first().c
    if c.problem:
        raise ValueError(f"{c.problem}: {text}")
    return as_of(versions, F.lit(c.instant))


def invalidate(requests: DataFrame, beliefs: DataFrame, inheritance: DataFrame) -> DataFrame:
    """One revocation event for each request (belief_id, at): accepted or refused, what it affects, the state before.

    A belief that is unknown or revoked already is refused. Edges and beliefs are closed by joining the events, so all
    holders change at once."""
    edges = inheritance.groupBy("belief_id").agg(F.count("*").alias("edges"), F.expr("count_if(invalidated_at is null)").alias("open"), F.expr("count(distinct case when invalidated_at is null then to_agent_id end)").alias("agents"))
    d = requests.join(beliefs.select("belief_id", "status"), "belief_id", "left").join(edges, "belief_id", "left")
    refusal = F.when(F.col("status").isNull(), "UNKNOWN").when(F.col("status") != "active", "ALREADY_INVALIDATED")
    taken = refusal.isNull()
    none = F.lit(0).cast("long")
    return d.select(
        "belief_id", "at", refusal.alias("refusal"), F.when(taken, F.coalesce("open", none)).otherwise(none).alias("affected_edges"),
        F.when(taken, F.coalesce("agents", none) + 1).otherwise(none).alias("affected_agents"), F.coalesce("open", none).alias("open_before"), F.coalesce("edges", none).alias("edges_before"),
    )


def edges_after(events: DataFrame, inheritance: DataFrame) -> DataFrame:
    """Edges with invalidated_at as accepted events leave it."""
    at = events.filter("refusal is null").select("belief_id", F.col("at").alias("_at"))
    return inheritance.join(at, "belief_id", "left").withColumn("invalidated_at", F.coalesce("invalidated_at", "_at")).drop("_at")


def eventual_trace(requests: DataFrame, inheritance: DataFrame) -> DataFrame:
    """belief_id, step, open: what readers see if holders are closed one after another, in N + 1 commits."""
    live = inheritance.filter("invalidated_at is null").join(requests.select("belief_id"), "belief_id", "left_semi")
    order = Window.partitionBy("belief_id").orderBy("to_agent_id")
    n = Window.partitionBy("belief_id")
    steps = live.select("belief_id", F.row_number().over(order).alias("step"), F.count("*").over(n).alias("total"))
    start = live.groupBy("belief_id").agg(F.count("*").alias("total")).select("belief_id", F.lit(0).alias("step"), "total")
    return start.union(steps).select("belief_id", "step", (F.col("total") - F.col("step")).alias("open"), "total")


def closure_state(total: str = "total", open_: str = "open") -> Column:
    """ALL_ACTIVE (also of an empty closure), ALL_INVALIDATED or SPLIT."""
    return F.when(F.col(open_) == F.col(total), "ALL_ACTIVE").when(F.col(open_) == 0, "ALL_INVALIDATED").otherwise("SPLIT")


def holder_live(decisions: DataFrame, inheritance: DataFrame) -> DataFrame:
    """Decisions whose decider's own edge for the driving belief is open."""
    live = inheritance.filter("invalidated_at is null").select("belief_id", F.col("to_agent_id").alias("agent_id")).distinct()
    return decisions.join(live, ["belief_id", "agent_id"], "left_semi")


def change_points(samples: DataFrame) -> DataFrame:
    """Samples that differ from the one before in state or open; the first always counts."""
    order = Window.partitionBy("subject").orderBy("seq")
    d = samples.withColumn("state", closure_state())
    changed = F.lag("seq").over(order).isNull() | (F.lag("state").over(order) != F.col("state")) | (F.lag("open").over(order) != F.col("open"))
    return d.withColumn("_c", changed).filter("_c").drop("_c")


def holder_close_seq(samples: DataFrame) -> DataFrame:
    """subject, holder (from 0), seq: the first sample by which each holder is closed.

    Open counts only fall along a subject's samples, so each sample closes the holders between its count and the least
    before: the rows made are one per holder."""
    before = Window.partitionBy("subject").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    d = samples.withColumn("was", F.coalesce(F.min("open").over(before), F.col("total")))
    fell = d.filter("open < was")
    return fell.select("subject", F.explode(F.expr("sequence(total - was, total - open - 1)")).alias("holder"), "seq")


def first_split(samples: DataFrame) -> DataFrame:
    d = samples.withColumn("split", closure_state() == "SPLIT")
    return d.groupBy("subject").agg(F.min(F.when(F.col("split"), F.col("seq"))).alias("first_split"), F.count_if("split").alias("splits"))


def hop_order(members: DataFrame) -> DataFrame:
    """instance, ascending: do times rise along hop_index."""
    order = Window.partitionBy("instance").orderBy("hop_index")
    d = members.withColumn("ok", F.coalesce(F.lag("ts").over(order) <= F.col("ts"), F.lit(True)))
    return d.groupBy("instance").agg(F.bool_and("ok").alias("ascending"))
