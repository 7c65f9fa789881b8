"""Structured Streaming forms of the evidence queries. Each reads a folder as it grows, and its batch twin gives the
same rows over all of it, but for what a watermark drops as late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators.stats import CORRECT


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of the files that come to match its name."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there and stops; started again it goes on where it was."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_upserts(stream: DataFrame, log: str, checkpoint: str) -> None:
    """Writes the rows that each batch changes (update mode) to that batch's folder of a log, from which ``newest`` reads.

    A batch costs what it changes, state that the watermark has passed is let go, and a batch that is run again after
    a failure replaces its own folder."""
    run_batches(stream, lambda batch, k: batch.write.mode("overwrite").parquet(f"{log}/batch={k}"), checkpoint, "update")


def newest(spark: SparkSession, log: str, schema, key: list[str]) -> DataFrame:
    """The last row of each key in a log of batches."""
    d = spark.read.schema(f"{schema}, batch bigint").option("basePath", log).parquet(log)
    row = [c for c in d.columns if c not in key]
    return d.groupBy(*key).agg(F.max_by(F.struct(*row), "batch").alias("row")).select(*key, *[F.col(f"row.{c}").alias(c) for c in row if c != "batch"])


def compact(spark: SparkSession, log: str, to: str, schema, key: list[str]) -> None:
    """The newest rows as a log of one batch that counts as older than any that follows."""
    newest(spark, log, schema, key).write.mode("overwrite").parquet(f"{to}/batch=-1")


def closure_samples(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """subject, window_start, total, closed of the edge events of each subject and tumbling window."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    d = d.groupBy("user_id", F.window("ts", window)).agg(F.count("*").alias("total"), F.expr("count_if(event_type = 'error')").alias("closed"))
    return d.select(F.col("user_id").alias("subject"), F.col("window.start").alias("window_start"), "total", "closed")


def rule_performance(decisions: DataFrame, window: str = "365 days", late: str = "30 days") -> DataFrame:
    """belief_id, window_start, n, correct, frauds_approved of decisions by tumbling window."""
    d = decisions.withWatermark("decided_at", late) if decisions.isStreaming else decisions
    d = d.filter("belief_id is not null").groupBy("belief_id", F.window("decided_at", window))
    d = d.agg(F.count("*").alias("n"), F.expr(f"count_if({CORRECT})").alias("correct"), F.expr("count_if(is_fraud and verdict = 'approve')").alias("frauds_approved"))
    return d.select("belief_id", F.col("window.start").alias("window_start"), "n", "correct", "frauds_approved")


def dedup_raw_key(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; a stream forgets keys that are older than the watermark."""
    if rows.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def route_template(path: str):
    """A path with its ids collapsed."""
    return F.regexp_replace(path, r"/([0-9a-f]{8}-[0-9a-f-]{27}|[0-9]+)(?=/|$)", "/{id}")


def apply_revocations(decisions: DataFrame, revocations: DataFrame) -> DataFrame:
    """Decisions (a stream or a table) with live: whether the driving belief's revocation lies later, or there is none."""
    at = revocations.groupBy("belief_id").agg(F.min("at").alias("revoked_at"))
    return decisions.join(at, "belief_id", "left").withColumn("live", F.coalesce(F.col("decided_at") < F.col("revoked_at"), F.lit(True)))


def meet_revocations(decisions: DataFrame, revocations: DataFrame, reach: str, late: str = "1 day", settled: DataFrame | None = None) -> DataFrame:
    """The same with revocations as a stream, too: decision_id, belief_id, decided_at, live.

    A decision meets the revocations (one a belief) of at most ``reach`` before it; with that bound and both watermarks
    either side is let go when nothing can meet it any more. Older ones come from ``settled``, a table of belief_id and
    at that is read anew at each batch. A decision is given out when it is met, or when the watermark says that no
    revocation before it can still come; what comes later than ``late`` is dropped."""
    d = decisions.withWatermark("decided_at", late).select("decision_id", "belief_id", "decided_at")
    r = revocations.withWatermark("at", late).select(F.col("belief_id").alias("revoked"), "at")
    met = d.join(r, F.expr(f"belief_id = revoked and at <= decided_at and at > decided_at - interval {reach}"), "leftOuter")
    met = met.select("decision_id", "belief_id", "decided_at", F.col("at").isNull().alias("live"))
    if settled is None:
        return met
    before = settled.groupBy("belief_id").agg(F.min("at").alias("settled_at"))
    return met.join(before, "belief_id", "left").select("decision_id", "belief_id", "decided_at", (F.col("live") & F.coalesce(F.col("settled_at") > F.col("decided_at"), F.lit(True))).alias("live"))
