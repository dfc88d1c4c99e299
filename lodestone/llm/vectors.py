"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A vector is rotated (signs, Hadamard transform, three times over), and the signed axis nearest to
it is its hash; several hashes make a table's bucket. A vector is stored in one bucket of each
table and also probes the buckets that its next nearest axes lead to. Vectors that meet are
compared in blocks by cosine in double precision, and each pair counts in the first bucket in
which it meets only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, local_roots, map_arrow, table, whole_runs

TABLES = 12
#: Hashes that make a bucket.
HASHES = 3
#: Buckets besides its own that a vector probes in each table.
PROBES = 4
#: Vectors of a bucket that are compared with each other in one task, at least and at most; larger buckets are split. A vector is
#: copied once for each block of its bucket, so blocks grow with the bucket: to a sixteenth of it, until the most is reached.
BLOCK, MOST_BLOCK, SPLIT = 1024, 8192, 16
THRESHOLD = 0.93
#: A cosine this near to the threshold is computed again, exactly.
MARGIN = 1e-9


@lru_cache
def signs(dim: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).integers(0, 2, (tables, hashes, 3, dim)).astype(np.float64) * 2 - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of the last axis, a power of two long."""
    n = x.shape[-1]
    h = 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 3) -> np.ndarray:
    """[n, tables, 1 + probes] bucket numbers of unit vectors: the own one, then those to probe. Large numbers are folded, which only joins buckets.

    A probe replaces one hash by its second nearest axis, or two where the least loss is so.
    """
    n, d = x.shape
    dim = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - d)))
    out = np.empty((n, tables, 1 + probes), np.int32)
    flips = [[(c >> i) & 1 for i in range(hashes)] for c in range(1, 1 << hashes)]
    for t in range(tables):
        axes, loss = np.empty((n, hashes, 2), np.int64), np.empty((n, hashes))
        for k in range(hashes):
            y = x
            for s in signs(dim, tables, hashes, seed)[t, k]:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            rank = np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable")
            top = np.take_along_axis(top, rank, 1)
            axes[:, k] = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            two = np.take_along_axis(size, top, 1)
            loss[:, k] = two[:, 0] - two[:, 1]
        number = lambda pick: sum(np.take_along_axis(axes[:, k], pick[:, k : k + 1], 1)[:, 0] * (2 * dim) ** k for k in range(hashes)) % ((1 << 31) - 1)  # noqa: B023, E731
        out[:, t, 0] = number(np.zeros((n, hashes), np.int64))
        cost = np.stack([sum(loss[:, k] * f[k] for k in range(hashes)) for f in flips], 1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            out[:, t, 1 + p] = number(np.array(flips)[order[:, p]])
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one bucket's block pair: the links of each vector that count here, and the root that it reaches by them."""
    for rows, edges in whole_runs(batches, ["label", "dim", "t", "bucket", "bi", "bj"]):
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo > 1 and (found := _block(rows.slice(lo, hi - lo))):
                yield found


def _units(vectors: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """[n, dim] doubles, scaled by their largest component, and of length 1."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x, x / np.sqrt((x * x).sum(1, keepdims=True))


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine with sums rounded once, so that neither their order nor the machine matters."""
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _block(run: pa.Table) -> pa.RecordBatch | None:
    t, bi, bj, bucket = (run.column(c)[0].as_py() for c in ("t", "bi", "bj", "bucket"))
    col = lambda c: run.column(c).to_numpy()
    entry, mult, side, stored = col("entry"), col("mult"), col("side"), col("stored")
    raw, x = _units(run.column("embedding").combine_chunks(), len(entry))
    b = run.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(entry), t + 1, 1 + PROBES)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if bi != bj else (np.arange(len(entry)),) * 2
    us, vs = [], []
    for i in range(0, len(left), 256):
        u = left[i : i + 256]
        cosine = x[u] @ x[right].T
        near = cosine >= THRESHOLD
        for p, q in np.argwhere(np.abs(cosine - THRESHOLD) < MARGIN):
            near[p, q] = _exact(raw[u[p]], raw[right[q]]) >= THRESHOLD
        near &= stored[u][:, None] | stored[right][None, :]
        p, q = np.nonzero(near & (u[:, None] < right[None, :])) if bi == bj else np.nonzero(near)
        p, q = u[p], right[q]
        ok = np.ones(len(p), bool)
        for s in range(t + 1):  # has the pair met before?
            for j in range(0, len(p), 65536):
                k = slice(j, j + 65536)
                own_p, own_q = b[p[k], s, 0], b[q[k], s, 0]
                in_p, in_q = (b[q[k], s] == own_p[:, None]).any(1), (b[p[k], s] == own_q[:, None]).any(1)
                if s < t:
                    ok[k] &= ~(in_p | in_q)
                else:
                    ok[k] &= np.where(in_p & in_q, np.minimum(own_p, own_q), np.where(in_p, own_p, own_q)) == bucket
        us.append(p[ok])
        vs.append(q[ok])
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return None
    n = np.bincount(u, mult[v], len(entry)) + np.bincount(v, mult[u], len(entry))
    root = local_roots(len(entry), u, v)
    linked = np.flatnonzero(n > 0)
    return pa.record_batch([pa.array(entry[linked]), pa.array(n[linked].astype(np.int64)), pa.array(entry[root[linked]])], names=["entry", "n", "root"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of `vectors`.

    Vectors link only where their labels are equal and not null and their lengths are equal. Null,
    zero and non-finite vectors, vectors with a null component and rows of null label or id link
    with nothing: they have no links and are their own class. Equal vectors of a label are one entry
    with its multiplicity. Rows that repeat an id are vectors of their own, which their id doesn't link.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    good = rows.where("valid")
    # Entries are numbered before they are checkpointed, and never again.
    distinct = cut(good.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("mult")).withColumns({"dim": F.size("embedding"), "entry": F.monotonically_increasing_id()}))
    signed = _signatures(distinct)
    width = 1 + PROBES
    keyed = signed.select("entry", "label", "dim", F.posexplode("buckets").alias("at", "bucket")).selectExpr("entry", "label", "dim", f"cast(at div {width} as int) t", f"at % {width} = 0 stored", "bucket")
    key = ["label", "dim", "t", "bucket"]
    # Buckets where a stored vector meets another.
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("rows"), F.max("stored").alias("any")).where("rows > 1 and any").withColumn("blocks", F.ceil(F.col("rows") / F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.col("rows") / SPLIT))).cast("int")).drop("rows", "any")
    met = keyed.join(sizes, key)
    block = F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("bi"), F.greatest(F.col("block"), j).alias("bj"), (F.col("block") > j).cast("int").alias("side")))
    # Vectors meet their buckets once, and are spread to pairs of blocks after that, on the way to the exchange; of their
    # buckets they take those up to this table, by which it is told whether a pair has met before.
    whole = met.withColumn("block", block).join(signed.select("entry", "embedding", "buckets", "mult"), "entry")
    order = [*key, "bi", "bj"]
    spread = whole.withColumn("p", F.explode(pairs)).select("entry", "mult", *key, "p.*", "stored", "embedding", F.slice("buckets", F.lit(1), (F.col("t") + 1) * width).alias("buckets"))
    counted = cut(map_arrow(spread.repartition(*order).sortWithinPartitions(*order), _compare, "entry long, n long, root long"))
    n_links = counted.groupBy("entry").agg(F.sum("n").alias("n"))
    roots = components(counted, "entry", "root")
    joined = distinct.join(n_links, "entry", "left").join(roots.withColumnRenamed("node", "entry"), "entry", "left").withColumn("root", F.coalesce("component", "entry"))
    least = joined.where("root <> entry").groupBy("root").agg(F.min("rep").alias("least"))
    # Classes of one entry, nearly all, need no shuffle of their own.
    named = joined.where("root = entry").select("root", "rep").join(least, "root", "left").select("root", F.least("rep", "least").alias("component_id"))
    info = joined.join(named, "root").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = good.join(info, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _signatures(distinct: DataFrame) -> DataFrame:
    """The distinct vectors with their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):  # vectors of one length make a matrix
                same = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for i in range(0, same.num_rows, 512):
                    part = same.slice(i, 512)
                    b = buckets(_units(part.column("embedding"), part.num_rows)[1]).reshape(part.num_rows, -1)
                    ends = np.arange(len(b) + 1, dtype=np.int32) * b.shape[1]
                    yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(ends, pa.array(b.ravel()))], names=[*part.schema.names, "buckets"])

    kind = "long" if dict(distinct.dtypes)["label"] == "bigint" else dict(distinct.dtypes)["label"]
    vector = dict(distinct.dtypes)["embedding"]
    return cut(map_arrow(distinct.select("label", "embedding", "entry", "mult", "dim"), run, f"label {kind}, embedding {vector}, entry long, mult long, dim int, buckets array<int>"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (SELECT * FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.n AS a, b.n AS b, a.vec_id AS a_id, b.vec_id AS b_id FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(n, root) AS (SELECT n, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.n WHERE r.root < l.b_id),
c AS (SELECT n, min(root) AS component_id FROM r GROUP BY n), k AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(component_id, e.vec_id), true) AS kept FROM e LEFT JOIN c USING (n) LEFT JOIN k USING (n)
"""
