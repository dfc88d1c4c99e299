"""Exact nearest neighbours, screening, reranking under a budget, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import terms

#: Vectors and queries that are scored by one matrix product, and blocks of queries that a scan of the vectors scores.
ROW_BLOCK, QUERY_BLOCK, QUERY_BLOCKS = 2048, 2048, 8


def knn(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT.top_k, min_score: float = DEFAULT.min_score, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): each query's k best of (id, vector) by cosine, ties by id, below `min_score` none.

    Queries (query_id, vector) go out in groups of QUERY_BLOCK * QUERY_BLOCKS at most, which are scored
    block by block in one scan of the vectors. A task keeps its k best for a query, so only those are shuffled.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    groups = max(1, -(-queries.count() // (QUERY_BLOCK * QUERY_BLOCKS)))
    part = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    found = [_scan(vectors, queries.where(part == i) if groups > 1 else queries, k, min_score, digits) for i in range(groups)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(score: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of [rows, queries] scores: each query's k best rows and the ids of those, ties by id, a row of the result each."""
    if len(score) > 4 * k:
        # All rows that reach the k-th best score, ties included, are sorted only.
        least = np.partition(score, len(score) - k, axis=0)[len(score) - k]
        keep = np.flatnonzero((score >= least).any(1))
        score, key = score[keep], key[keep]
    by_id = np.argsort(key, kind="stable")
    score, key = score[by_id], key[by_id]
    top = np.argsort(-score, axis=0, kind="stable")[:k]
    return np.take_along_axis(score, top, 0), key[top]


def _scan(vectors: DataFrame, queries: DataFrame, k: int, min_score: float, digits: int) -> DataFrame:
    rows = queries.select("query_id", "vector").collect()
    ids = [r.query_id for r in rows]
    q = np.array([r.vector for r in rows], np.float64).reshape(len(rows), len(rows[0].vector) if rows else 0)
    length = np.sqrt((q * q).sum(1, keepdims=True))
    q = np.divide(q, length, out=np.zeros_like(q), where=length > 0)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))
    id_type = vectors.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            v = batch.column("vector")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(x) != len(v) * q.shape[1]:
                raise ValueError("vectors of different dimension: the index must be rebuilt")
            x = x.reshape(len(v), -1)
            size = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            key = batch.column("id").to_numpy(zero_copy_only=False)
            for first, i in product(range(0, len(x), ROW_BLOCK), range(0, len(q), QUERY_BLOCK)):
                got, top = _best(np.round(x[first : first + ROW_BLOCK] @ q[i : i + QUERY_BLOCK].T, digits) + 0.0, key[first : first + ROW_BLOCK], k)
                if i in best:  # k rows a query of those before
                    got, top = np.concatenate([best[i][0], got]), np.concatenate([best[i][1], top])
                    for order in (np.argsort(top, axis=0, kind="stable"), None):
                        order = np.argsort(-got, axis=0, kind="stable")[:k] if order is None else order
                        got, top = np.take_along_axis(got, order, 0), np.take_along_axis(top, order, 0)
                best[i] = got, top
        for first, (got, top) in best.items():
            i, j = np.nonzero(got >= min_score)
            yield pa.record_batch([pa.array([ids[first + c] for c in j]), pa.array(top[i, j]), pa.array(got[i, j])], names=["query_id", "id", "score"])

    return vectors.select("id", "vector").mapInArrow(run, f"query_id {query_type}, id {id_type}, score double")


def locate(hits: DataFrame, chunk_manifest: DataFrame) -> DataFrame:
    """Late materialisation: the few hits meet the manifest by id; hits whose chunk is gone drop out."""
    return hits.join(chunk_manifest.withColumnRenamed("chunk_id", "id"), "id")


def screen(hits: DataFrame, floor: float = DEFAULT.floor, gap: float = DEFAULT.gap) -> DataFrame:
    """All of a query's hits or none, by whether its best reaches the floor; then those of at least `gap` times the best."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("best", best).where((F.col("best") >= floor) & (F.col("score") >= gap * F.col("best")))


def notes(rebuilt: DataFrame, floor: float = DEFAULT.floor, gap: float = DEFAULT.gap) -> DataFrame:
    """(query_id, ranked, stale, unavailable, best, below_floor, dropped, kept) of rebuilt passages (query_id, score, state).

    `best` is that of the verified ones, null without any; below the floor none is kept and none
    counts as dropped, which are those under `gap` times the best. A query's passages are its top k, so lists are short.
    """
    verified = F.when(F.col("state") == "verified", F.col("score"))
    count = lambda state: F.count_if(F.col("state") == state)
    per = rebuilt.groupBy("query_id").agg(F.count("*").alias("ranked"), count("stale").alias("stale"), count("unavailable").alias("unavailable"), F.max(verified).alias("best"), F.collect_list(verified).alias("scores"))
    below, above = F.coalesce(F.col("best") < floor, F.lit(False)), F.size(F.filter("scores", lambda s: s >= gap * F.col("best")))
    kept = F.when(below, 0).otherwise(above).cast("long")
    dropped = F.when(below, 0).otherwise(F.size("scores") - above).cast("long")
    return per.select("query_id", "ranked", "stale", "unavailable", "best", below.alias("below_floor"), dropped.alias("dropped"), kept.alias("kept"))


def coverage(query_terms: Column, passage_terms: Column) -> Column:
    """The share of the query's terms that the passage has; 0 without any."""
    n = F.size(query_terms)
    return F.when(n > 0, F.size(F.array_intersect(query_terms, passage_terms)) / n).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def blended(score: Column, cover: Column, weight: float = DEFAULT.lexical_weight) -> Column:
    w = min(1.0, max(0.0, weight))
    return (1 - w) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) + w * cover


def rerank(candidates: DataFrame, max_passages: int, max_tokens: int = DEFAULT.budget_tokens, config: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """From (query_id, query, id, score, text, token_count): (query_id, id, relevance, place) and columns to keep, chosen greedily.

    Each round takes the candidate of the largest diversity-weighted relevance less its likeness to
    those chosen, the first in order of ties; one over the budget is passed over and the search goes
    on, but the first is always taken. A query's candidates are its top k, so groups are small.
    """
    kept = [F.col(c).alias(f"kept_{c}") for c in keep]
    prepared = candidates.select("query_id", "id", "score", "token_count", *kept, terms(F.col("text")).alias("terms"), terms(F.col("query")).alias("query_terms"))
    prepared = prepared.select("query_id", "id", "score", "token_count", "terms", *(f"kept_{c}" for c in keep), blended(F.col("score"), coverage(F.col("query_terms"), F.col("terms")), config.lexical_weight).alias("relevance"))
    lam = min(1.0, max(0.0, config.diversity))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sets, relevance, tokens = [set(t) for t in pdf.terms], pdf.relevance.tolist(), pdf.token_count.tolist()
        like, left, chosen, used = [0.0] * len(pdf), list(range(len(pdf))), [], 0
        while left and len(chosen) < max_passages:
            i = max(left, key=lambda j: (lam * relevance[j] - (1 - lam) * like[j], -j))
            left.remove(i)
            if chosen and used + tokens[i] > max_tokens:
                continue
            chosen.append(i)
            used += tokens[i]
            for j in left:
                both = len(sets[i] | sets[j])
                like[j] = max(like[j], len(sets[i] & sets[j]) / both if both else 0.0)
        out = pdf.loc[chosen, ["query_id", "id", "relevance"]].assign(place=np.arange(1, len(chosen) + 1))
        return out.assign(**{c: pdf.loc[chosen, f"kept_{c}"] for c in keep})

    kind = lambda c: prepared.schema[c].dataType.simpleString()
    result = [f"query_id {kind('query_id')}", f"id {kind('id')}", "relevance double", "place long", *(f"{c} {kind(f'kept_{c}')}" for c in keep)]
    return prepared.groupBy("query_id").applyInPandas(choose, ", ".join(result))


def files_about(hits: DataFrame, max_files: int) -> DataFrame:
    """(query_id, path, score, passages, rank): hits by file, best score first, ties by path."""
    files = hits.groupBy("query_id", "path").agg(F.max("score").alias("score"), F.count("*").alias("passages"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_files)


def quality(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query of (query_id, id, rank) and the number of its relevant items: hit@1, reciprocal rank, average precision, nDCG@k, recall@k.

    `ranked` has `is_relevant`; `relevant` is (query_id, n_relevant).
    """
    hit = F.col("is_relevant").cast("int")
    seen = F.sum(hit).over(Window.partitionBy("query_id").orderBy("rank"))
    rows = ranked.where(F.col("rank") <= k).withColumn("precision", F.when(F.col("is_relevant"), seen / F.col("rank")).otherwise(F.lit(0.0)))
    per = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, hit).otherwise(0)).alias("hit_1"), F.max(F.when(F.col("is_relevant"), 1 / F.col("rank")).otherwise(F.lit(0.0))).alias("rr"),
        F.sum("precision").alias("precisions"), F.count("*").alias("n_ranked"), F.sum(hit).alias("n_found"), F.sum(F.when(F.col("is_relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.join(relevant.where("n_relevant > 0"), "query_id").select(
        "query_id", "hit_1", "rr", (F.col("precisions") / F.least("n_relevant", "n_ranked")).alias("ap"), (F.col("dcg") / ideal).alias("ndcg"), (F.col("n_found") / F.least("n_relevant", F.lit(k))).alias("recall")
    )
