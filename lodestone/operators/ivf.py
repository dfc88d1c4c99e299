"""Nearest neighbours by an inverted file: cells around k-means centres, stored as partitions, of which a search reads those that can matter.

The angle between two vectors obeys the triangle inequality. A cell keeps the least and greatest angle of its members to its
centre, so the angle between query and centre bounds the cosine that any member can reach. An exact search first reads
each query's nearest cells; the k-th best score found there bounds the answer from below, and only cells whose
bound reaches it are read after that. An approximate one stops after a given number of cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from .retrieval import ROW_BLOCK, _best

#: Cells at most, whatever the number of vectors: the centres are sent to every task (at 1,024 dimensions 32 MB).
MOST_CELLS = 4_096
#: Vectors that the centres are fitted on, those with the smallest hashes of their ids; all vectors are assigned and stored.
FIT_ROWS = 1 << 18
ROUNDS = 6
#: Queries that are asked at once: their bounds to all cells are held by the driver (128 MB at most).
QUERIES = 4_096
#: Zero vectors have no angle to any other; they score 0 and have a cell of their own.
ZERO = -1
#: Scores are rounded to so many digits: bounds closer than that are read.
DIGITS = 6


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch, of length 1, in double precision."""
    v = batch.column("vector")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(x) != len(v) * dim:
        raise ValueError("vectors of different dimension: the index must be rebuilt")
    return _unit(x.reshape(len(v), dim))


def _assign(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, angle to its centre) of unit vectors, block by block."""
    cell, angle = np.full(len(x), ZERO), np.full(len(x), np.pi / 2)
    for i in range(0, len(x), ROW_BLOCK):
        cos = x[i : i + ROW_BLOCK] @ centers.T
        best = cos.argmax(1)
        some = x[i : i + ROW_BLOCK].any(1)
        cell[i : i + ROW_BLOCK] = np.where(some, best, ZERO)
        angle[i : i + ROW_BLOCK] = np.arccos(np.clip(np.take_along_axis(cos, best[:, None], 1)[:, 0], -1, 1))
    return cell, angle


def fit_centers(vectors: DataFrame, cells: int, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """`cells` unit vectors: k-means by cosine over the `fit_rows` vectors with the smallest hashes of their ids, begun at the first of those.

    Each round is one scan, in which a task adds up its vectors by cell; sums meet by cell, and the driver sees the centres only.
    """
    hashed = vectors.where("vector is not null").select("vector", F.xxhash64("id").alias("h"), "id")
    first = hashed.orderBy("h", "id").limit(2 * cells).select("vector").collect()
    if not first:
        return np.zeros((0, 0))
    seeds = _unit(np.array([r.vector for r in first], np.float64))
    _, distinct = np.unique(seeds, axis=0, return_index=True)
    centers = seeds[np.sort(distinct)]
    centers = centers[centers.any(1)][:cells]
    if not len(centers):
        return np.eye(1, seeds.shape[1])
    few = hashed.orderBy("h", "id").limit(fit_rows).select("vector").repartition(max(1, vectors.sparkSession.sparkContext.defaultParallelism)).persist()
    dim = centers.shape[1]

    def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(now)
        for batch in batches:
            x = _matrix(batch, dim)
            cell, _ = _assign(x, now)
            np.add.at(total, cell[cell >= 0], x[cell >= 0])
        used = np.flatnonzero(total.any(1))
        yield pa.record_batch([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cell", "total"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.array(t) for t in table.column("total").to_pylist()], axis=0)
        return pa.table({"cell": table.column("cell").slice(0, 1), "total": pa.array([total], pa.list_(pa.float64()))})

    try:
        for _ in range(rounds):
            parts = few.mapInArrow(lambda b, now=centers: sums(b, now), "cell long, total array<double>")
            moved = parts.groupBy("cell").applyInArrow(added, "cell long, total array<double>").collect()
            new = centers.copy()
            for r in moved:
                new[r.cell] = r.total
            new = _unit(new)
            new[~new.any(1)] = centers[~new.any(1)]
            if np.allclose(new, centers, atol=1e-6):
                break
            centers = new
    finally:
        few.unpersist()
    return centers


@dataclass
class VectorIndex:
    """Vectors (id, vector) in a folder that every executor reaches: `rows` by cell, `stats` of the cells, and their centres.

    `last` tells of the last search how many cells, of how many, and what share of the rows and of the
    pairs of query and row it read. Rows are added at any time; the centres stay, so rebuild an index that has grown many times over.
    """

    spark: SparkSession
    root: str
    last: dict = field(default_factory=dict)

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int | None = None, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> VectorIndex:
        """An index of all vectors: about the square root of their number as cells, where none is given."""
        spark = vectors.sparkSession
        centers = fit_centers(vectors, min(MOST_CELLS, cells or max(1, round(vectors.count() ** 0.5))), rounds, fit_rows)
        meta = [(i, c.tolist()) for i, c in enumerate(centers)]
        spark.createDataFrame(meta, "cell int, center array<double>").coalesce(1).write.parquet(f"{root}/centers")
        index = cls(spark, root)
        index.add(vectors)
        return index

    def centers(self) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(f"{self.root}/centers").collect())
        return np.array([r.center for r in rows], np.float64).reshape(len(rows), -1)

    def add(self, vectors: DataFrame) -> None:
        """Puts vectors into their cells. Cells that hold many rows are written as several files, by several tasks."""
        centers = self.centers()
        kind = vectors.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, angle = _assign(_matrix(batch, centers.shape[1]), centers)
                    yield pa.record_batch([batch.column("id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "vector", "cell", "angle"])

        vector = vectors.schema["vector"].dataType.simpleString()
        rows = vectors.where("vector is not null").select("id", "vector").mapInArrow(run, f"id {kind}, vector {vector}, cell int, angle double")
        rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.root}/rows")

    def rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.root}/rows").schema
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows")

    def stats(self) -> dict[int, tuple[int, float, float]]:
        """Of each cell its number of rows and their least and greatest angle to its centre; MOST_CELLS rows at most, from the column of angles."""
        return {r.cell: (r.n, r.low, r.high) for r in self.rows().groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}

    def search(self, queries: DataFrame, k: int = DEFAULT.top_k, min_score: float = DEFAULT.min_score, probes: int | None = None, digits: int = DIGITS) -> DataFrame:
        """(query_id, id, score, rank), as of `knn`: exact, or with `probes` the best of each query's so many nearest cells.

        An exact search is one of the nearest cells and one of the cells that may hold better or equal ones.
        Queries (query_id, vector) are asked in groups of QUERIES; only a group's k best each come to the driver.
        """
        if k <= 0 or (probes is not None and probes <= 0):
            raise ValueError("k and probes must be positive")
        stats, centers = self.stats(), self.centers()
        groups = max(1, -(-queries.count() // QUERIES))
        part = F.pmod(F.xxhash64("query_id"), F.lit(groups))
        found, read, pairs, asked = None, set(), 0, 0
        for g in range(groups):
            rows = (queries.where(part == g) if groups > 1 else queries).select("query_id", "vector").collect()
            if not rows:
                continue
            q = _unit(np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1))
            ids, names, asked = [r.query_id for r in rows], sorted(stats), asked + len(rows)
            angle, bound, sizes = self._bounds(q, centers, names, stats)
            want = probes or self._enough(angle, sizes, k)
            first = np.zeros(angle.shape, bool)
            np.put_along_axis(first, np.argsort(angle, axis=1, kind="stable")[:, :want], True, axis=1)
            # A bounded answer: k rows of each of QUERIES queries.
            near = self._scan(first, names, ids, q, k, min_score, digits, queries)
            done, more = near, None
            if probes is None:
                # Once, as both the bound and the answer come from it.
                done = near = self.spark.createDataFrame(near.toArrow(), near.schema)
                least = {r.query_id: r.least for r in near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")).collect()}
                floor = np.array([least.get(i, min_score) for i in ids])
                rest = (bound >= floor[:, None] - 10.0**-digits) & ~first
                more = self._scan(rest, names, ids, q, k, min_score, digits, queries) if rest.any() else None
                first |= rest
            if more is not None:
                done = _ranked(done.drop("rank").unionByName(more.drop("rank")), k)
            found = done if found is None else found.unionByName(done)
            read |= {names[c] for c in np.flatnonzero(first.any(0))}
            pairs += int((first * sizes).sum())
        total = sum(n for n, *_ in stats.values())
        self.last = {"cells": len(read), "of_cells": len(stats), "rows_share": sum(stats[c][0] for c in read) / max(1, total), "pairs_share": pairs / max(1, asked * total)}
        id_type, query_type = self.rows().schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
        return found if found is not None else self.spark.createDataFrame([], f"query_id {query_type}, id {id_type}, score double, rank int")

    @staticmethod
    def _enough(angle: np.ndarray, sizes: np.ndarray, k: int) -> int:
        """Cells that the first step reads of each query: those that hold k rows at least on average, two at least."""
        return min(angle.shape[1], max(2, -(-k * angle.shape[1] // max(1, int(sizes.sum())))))

    @staticmethod
    def _bounds(q: np.ndarray, centers: np.ndarray, names: list[int], stats: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(angle, bound, rows): of [query, cell] the angle to the centre and the cosine that no member exceeds; the rows of each cell."""
        sizes = np.array([stats[c][0] for c in names])
        low, high = (np.array([stats[c][i] for c in names]) for i in (1, 2))
        angle = np.full((len(q), len(names)), np.pi / 2)
        real = [i for i, c in enumerate(names) if c != ZERO]
        angle[:, real] = np.arccos(np.clip(q @ centers[[names[i] for i in real]].T, -1, 1))
        # A little wider than the angles that were stored, which were rounded.
        bound = np.cos(np.maximum(0, np.maximum(angle - high, low - angle) - 1e-7))
        for i, c in enumerate(names):
            if c == ZERO:
                bound[:, i] = 0
        bound[~q.any(1)] = 0
        return angle, bound, sizes

    def _scan(self, wanted: np.ndarray, names: list[int], ids: list, q: np.ndarray, k: int, min_score: float, digits: int, queries: DataFrame) -> DataFrame:
        """The k best of each query in the cells that `wanted` [query, cell] names; other cells' files are not opened, and in a cell only its queries are scored."""
        asks = {names[c]: np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(0))}
        rows = self.rows().where(F.col("cell").isin(list(asks)))
        shared = self.spark.sparkContext.broadcast((ids, q, asks))
        id_type, query_type = rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, asks = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                edges = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    for i in range(a, b, ROW_BLOCK):
                        piece = batch.slice(i, min(ROW_BLOCK, b - i))
                        x, key, mine = _matrix(piece, q.shape[1]), piece.column("id").to_numpy(zero_copy_only=False), asks[int(cells[a])]
                        got, top = _best(np.round(x @ q[mine].T, digits) + 0.0, key, k)
                        for j, at in enumerate(mine.tolist()):
                            old = best.get(at)
                            s, t = (got[:, j], top[:, j]) if old is None else (np.concatenate([old[0], got[:, j]]), np.concatenate([old[1], top[:, j]]))
                            if old is not None:
                                order = np.argsort(t, kind="stable")
                                order = order[np.argsort(-s[order], kind="stable")][:k]
                                s, t = s[order], t[order]
                            best[at] = s, t
            for at, (s, t) in best.items():
                ok = s >= min_score
                if not ok.any():
                    continue
                yield pa.record_batch([pa.array([ids[at]] * int(ok.sum())), pa.array(t[ok]), pa.array(s[ok])], names=["query_id", "id", "score"])

        return _ranked(rows.select("id", "vector", "cell").mapInArrow(run, f"query_id {query_type}, id {id_type}, score double"), k)

    def describe(self) -> str:
        return json.dumps(self.last)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
