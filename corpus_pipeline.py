"""The corpus pipeline: toxic documents out, one of each near-duplicate group, personal data masked, sources mixed, text encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of the table that they were given, whatever else those are. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, pii, simhash, toxicity
from lodestone.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go; labels teach as in the query, held-out folds don't.

    Null and empty texts score as a text without toxic words, and stay. Rows that repeat an id are
    judged by their own texts; null ids teach nothing.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.toxicity(spark, F.col("text"), model) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id stays, of rows that repeat it that with the smallest text hash.

    Null and empty texts are one class, of which one row stays. A null id stays only where its class has no other.
    """
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind, those that overlap as one; `n_chars` follows the text. Null and empty texts stay as they are, and every row stays."""
    masked = docs.withColumn("text", pii.mask_pii(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; `n_chars` follows a text cut at its source's budget.

    Documents without words, null texts among them, are taken no times. Null sources are one source, the last.
    """
    mixed = mixing.take(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids, decoded_ok): the ids, and whether they decode to the text. Null and empty texts have no ids and decode to nothing."""
    encoded = docs.select("doc_id", "source", "lang", "text", bpe.bpe(F.col("text")).alias("b"))
    same = F.col("b.decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return encoded.select("doc_id", "source", "lang", "b.n_tokens", "b.ids", same.alias("decoded_ok"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL expresses the classifier, the fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again."""
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
