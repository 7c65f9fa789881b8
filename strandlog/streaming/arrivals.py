"""Transactions decided as they arrive, by the evidence of what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import decisions as D
from strandlog.operators import graph as G
from strandlog.streaming.streams import run_batches

EDGE = "txn_id string, src string, dst string, belief_id long, agent_id long"
RULED = "txn_id string, outcome string, boundary string, tag string, ruled string"


def arrived(spark: SparkSession, store: str, upto: int) -> DataFrame:
    """All edges that had arrived by a batch; a batch that is run again sees what it saw before."""
    return spark.read.schema(f"{EDGE}, batch long").option("basePath", store).parquet(store).filter(F.col("batch") <= upto).drop("batch")


def decide_arrivals(stream: DataFrame, gate: DataFrame, store: str, out: str, checkpoint: str) -> None:
    """Rules on each edge (EDGE) of a stream in the batch in which it arrives; rows RULED go to the batch's folder of ``out``.

    Phase one sees no label, the stream has none. A batch is added to the kept edges, and only from its own accounts a
    search goes out over them (a batch of a large share of all edges has them all judged at once). Where ``gate`` (belief_id, agent_id, refusal) refuses, nothing is searched for and the edge
    only joins the graph. Edges without a belief are nobody's decision: they join the graph too. Both folders of a batch
    are written over if it is run again, so a restart repeats no row."""

    def rule(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        batch.select(*[c.split()[0] for c in EDGE.split(", ")]).write.mode("overwrite").parquet(f"{store}/batch={k}")
        mine = spark.read.schema(EDGE).parquet(f"{store}/batch={k}").filter("belief_id is not null")
        mine = mine.join(gate.select("belief_id", "agent_id", "refusal"), ["belief_id", "agent_id"], "left")
        asked = mine.filter("refusal is null").select("txn_id", "src", "dst")
        found = G.cycle_witness_of(asked, arrived(spark, store, k)).select("txn_id", "outcome", "boundary")
        ruled = mine.select("txn_id", "refusal").join(found, "txn_id", "left").withColumn("verdict", D.verdict_for(F.col("outcome")))
        ruled = ruled.select("txn_id", "outcome", "boundary", D.tag_for(F.col("outcome")).alias("tag"), F.when(F.col("refusal").isNotNull(), "refused").otherwise(F.col("verdict")).alias("ruled"))
        ruled.write.mode("overwrite").parquet(f"{out}/batch={k}")

    run_batches(stream, rule, checkpoint)


def decided(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{RULED}, batch long").option("basePath", out).parquet(out)


def with_labels(ruled: DataFrame, labels: DataFrame) -> DataFrame:
    """Phase two: the label, which the witness never saw, is attached to what has been decided."""
    return ruled.join(labels.select("txn_id", F.col("label").alias("is_fraud")), "txn_id", "left")
