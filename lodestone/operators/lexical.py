"""Top matches by shared terms without forming all pairs that share any.

A query's terms are taken in ascending document frequency. Its rarest terms give candidates, and the k-th best of those a
count that the answer reaches at least. Of n terms, a document with `least` of them has one of the n - least + 1 rarest, so
the frequent terms never make candidates: they only complete the counts of those there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Postings that a query's first candidates come from, as a multiple of k.
FIRST = 4


def best_covering(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, shared, n, rank): each query's k documents with most of its terms, ties by doc; documents without any have no row.

    `docs` is (doc, terms) and `queries` (query_id, terms), terms distinct.
    """
    asked = cut(queries.select("query_id", "terms", F.size("terms").alias("n")))
    words = asked.select(F.explode("terms").alias("term")).distinct()
    # Written once, as frequencies and both rounds of pairs are made of them, and texts would be cut each time.
    postings = cut(docs.select("doc", F.explode("terms").alias("term")).join(words, "term"))
    frequency = cut(postings.groupBy("term").agg(F.count("*").alias("df")))
    order = Window.partitionBy("query_id").orderBy("df", "term")
    # A query's terms are one text's, so these windows are short. Terms that no document has come in no posting.
    ranked = asked.select("query_id", "n", F.explode("terms").alias("term")).join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = cut(ranked.withColumn("place", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    first = _counted(_pairs(postings, ranked.where(F.col("before") < FIRST * k)), docs, asked)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "doc"))
    least = first.withColumn("r", place).where(F.col("r") == k).select("query_id", F.col("shared").alias("least"))
    # Queries whose first candidates are fewer than k take all their terms.
    needed = ranked.join(least, "query_id", "left").where(F.col("place") <= F.col("n") - F.coalesce("least", F.lit(1)) + 1)
    found = _counted(_pairs(postings, needed), docs, asked)
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _pairs(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc) that meet under one of the terms, written once."""
    return cut(postings.join(terms.select("query_id", "term"), "term").select("query_id", "doc").distinct())


def _counted(pairs: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    both = pairs.join(docs.select("doc", F.col("terms").alias("has")), "doc").join(asked, "query_id")
    return both.select("query_id", "doc", F.size(F.array_intersect("terms", "has")).alias("shared"), "n")
