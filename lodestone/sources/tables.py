"""The driver's tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of texts, and the size of one that may be a single row group, which one task would read and work on.
TEXTS, ONE_GROUP = ("documents", "pages"), 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts of less than a row group's size are dealt out to all cores; larger tables have row groups enough, and aren't shuffled."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_GROUP:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """Rows that are made of little, whose number alone tells what they come to: dealt out to all cores, some `most` a task."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text, n_chars) of documents."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "n_chars")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, kind, ts) of events."""
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Deleted").otherwise("Modified")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery operations of events: errors have failed, purchases are done, signups are in flight, others wait."""
    t = F.col("event_type")
    status = F.when(t == "error", 3).when(t == "purchase", 2).when(t == "signup", 1).otherwise(0)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("file_path"), F.when(t == "view", 1).otherwise(0).alias("op_type"), status.alias("status"),
        (F.col("event_id") % 12).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("created_utc"), F.col("ts").cast("timestamp").alias("next_attempt_utc"), F.when(t == "error", F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("error"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), F.col("role").alias("agent_name"), "text")
