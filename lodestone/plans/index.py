"""Queries over a whole index that they build from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_token
from ..operators import indexing
from ..operators.chunking import file_hash
from ..operators.service import HistogramEmbedder
from ..sources.store import Store
from ..sources.tables import files, read
from .base import CHUNKS, FILES, new_folder, query

COUNTS = ["scanned", "indexed", "unchanged", "deferred", "chunks", "vectors", "changes"]


def new_store(spark: SparkSession) -> Store:
    """An empty store in a new shared folder."""
    return Store(spark, new_folder(spark), buckets=8)


def as_files(rows: DataFrame) -> DataFrame:
    """(path, text) with what a folder's listing adds; blank texts are no files."""
    return rows.where(has_token(F.col("text"))).select("path", F.octet_length("text").cast("long").alias("length"), F.lit("2024-01-01").cast("timestamp").alias("modified_utc"), file_hash(F.col("text")).alias("hash"), "text")


@query(
    "index_passes",
    rf"""WITH {FILES}, {CHUNKS}, n AS (SELECT path, count(*) AS c FROM ck GROUP BY path),
d AS (SELECT n.path, c, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS other FROM n JOIN f USING (path)),
s AS (SELECT count(*) AS files, count(*) FILTER (gone) AS gone, count(*) FILTER (other AND NOT gone) AS other, CAST(sum(c) AS BIGINT) AS c, CAST(coalesce(sum(c) FILTER (other AND NOT gone), 0) AS BIGINT) AS oc FROM d)
SELECT 1 AS pass, files AS scanned, files AS indexed, 0 AS unchanged, 0 AS deferred, c AS chunks, c AS vectors, files AS changes FROM s
UNION ALL SELECT 2, files - gone, other, files - gone - other, 0, oc, oc, other + gone FROM s""",
)
def index_passes(spark, sf):
    """A first pass over all documents; a second one after the toxic ones are gone and those of quality 0 have another end."""
    store, embedder, labels = new_store(spark), HistogramEmbedder(), read(spark, sf, "labels")
    first = files(spark, sf)
    left = first.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    other = labels.where("quality = 0").select("doc_id", F.lit(" ").alias("end")).distinct()
    second = left.join(other, "doc_id", "left").withColumn("text", F.concat("text", F.coalesce("end", F.lit(""))))
    rows = [indexing.index_pass(store, as_files(x), embedder) for x in (first, second)]
    return spark.createDataFrame([(i + 1, *[r[c] for c in COUNTS]) for i, r in enumerate(rows)], ", ".join(f"{c} long" for c in ["pass", *COUNTS]))


@query("index_search")
def index_search(spark, sf):
    """The benchmark's passages looked up in an index of all documents: (query_id, place, path, relevance)."""
    store, embedder = new_store(spark), HistogramEmbedder()
    now = as_files(files(spark, sf))
    indexing.index_pass(store, now, embedder)
    asked = read(spark, sf, "benchmark").selectExpr("item_id query_id", "text query")
    return indexing.search(store, now, asked, embedder).select("query_id", "place", "path", "relevance")
