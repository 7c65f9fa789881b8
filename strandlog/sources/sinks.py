"""Files as sources and sinks; one writer at a time, each commit a whole folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def fresh(under: str, name: str) -> str:
    """A path under a shared folder that isn't there yet."""
    return f"{under}/{name}-{uuid.uuid4().hex}"


def insert_if_absent(rows: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key is neither in the table nor earlier among them (by key); the number of rows added, which
    is counted as they are written."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(key)
    try:
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(*key).distinct(), key, "left_anti")
    except Exception as error:  # the table's first rows
        if "PATH_NOT_FOUND" not in str(error):
            raise
    added = Observation()
    new.observe(added, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return added.get["n"]


def replace_by_key(rows: DataFrame, path: str, key: str) -> None:
    """Replaces whole keys: each key's rows are one partition folder, overwritten if it comes again."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_certificates(certificates: DataFrame, path: str) -> None:
    """One JSON object per certificate, in the belief's folder."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(certificates.columns)]), {"ignoreNullFields": "false"})
    certificates.select(F.col("belief_id").alias("belief"), body.alias("value")).repartition("belief").write.partitionBy("belief").text(path)


CERTIFICATE = "affected_agents long, affected_edges long, agreement string, belief_id long, content_hash string, open_before long, pre_state_source string, revoked_at string, world_hash string"


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CERTIFICATE).json(f"{path}/belief=*")


def stamped(audit: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Audit rows with their latest outcome (by seq), null if none was appended yet."""
    newest = outcomes.groupBy("belief_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    return audit.join(newest, "belief_id", "left")


TRANSACTIONS = (
    "ts string, from_bank string, from_account string, to_bank string, to_account string, amount_received decimal(38,2), receiving_currency string, "
    "amount_paid decimal(38,2), payment_currency string, payment_format string, is_laundering int"
)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions from an 11-column CSV; columns go by place, as the header names two of them alike."""
    d = spark.read.schema(TRANSACTIONS).csv(path, header=True, enforceSchema=True)
    return d.withColumn("ts", F.to_timestamp("ts", "yyyy/MM/dd HH:mm"))


def read_pattern_blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, instance_index, typology, param, hop_index, row of BEGIN ... END blocks in text files."""
    d = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return pattern_blocks(d.select("file", F.col("value").alias("text")))


def pattern_blocks(files: DataFrame) -> DataFrame:
    """The blocks of texts (file, text): "BEGIN LAUNDERING ATTEMPT - TYPE: param", rows, "END LAUNDERING ATTEMPT"."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    along = Window.partitionBy("file").orderBy("n")
    begins, ends = F.col("line").startswith("BEGIN LAUNDERING ATTEMPT"), F.col("line").startswith("END LAUNDERING ATTEMPT")
    d = lines.withColumn("begun", F.sum(begins.cast("int")).over(along)).withColumn("ended", F.sum(ends.cast("int")).over(along))
    d = d.withColumn("head", F.last(F.when(begins, F.col("line")), ignorenulls=True).over(along))
    d = d.filter((F.col("begun") > F.col("ended")) & ~begins & (F.trim("line") != ""))
    hop = Window.partitionBy("file", "begun").orderBy("n")
    pattern = r"ATTEMPT - ([^:]*)(?::\s*(.*))?$"
    return d.select(
        "file", (F.col("begun") - 1).alias("instance_index"), F.trim(F.regexp_extract("head", pattern, 1)).alias("typology"), F.trim(F.regexp_extract("head", pattern, 2)).alias("param"),
        (F.row_number().over(hop) - 1).alias("hop_index"), F.col("line").alias("row"),
    )


def read_markdown_lines(spark: SparkSession, path: str, line_end: str = r"\r?\n") -> DataFrame:
    """file, n (from 0), line of the text files under path; the end of the last line begins no other. Empty lines count, at
    the end too: only ``\\z`` is the very end, ``$`` also stands before a last line end."""
    d = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("file", F.input_file_name())
    return d.select("file", F.posexplode(F.split(F.regexp_replace("value", rf"(?:{line_end})\z", ""), line_end)).alias("n", "line"))


def read_artifact(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """A JSON document per file, checked: version as asked and no field of the wrong type."""
    d = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
    wrong = d.filter(F.col("_bad").isNotNull() | ~F.col("schema_version").eqNullSafe(F.lit(version)))
    if not wrong.isEmpty():
        raise ValueError(f"{path} has another version or wrong types")
    return d.drop("_bad")
