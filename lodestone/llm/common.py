"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names as shared by driver and executors; one of this machine where all run in it (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        set_dir = sc._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return base


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    # With its scheme, so that Spark and the workers' own file systems mean the same place.
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_base(spark))
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    return f"{path.toString().rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def sums_before(sums: DataFrame, part: str, weight: str, fan: int = 10, levels: int = 3) -> DataFrame:
    """(part, before): for numbered parts the sum of `weight` of all lower ones, by a tree of 2^fan children a node: no task sees more rows of a window than a node has children."""
    level, tree = sums.select(F.col(part), F.col(weight).alias("w")), []
    for _ in range(levels):
        up = F.shiftright(part, fan)
        lower = Window.partitionBy(up).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        tree.append(level.select(part, F.coalesce(F.sum("w").over(lower), F.lit(0)).alias("before")))
        level = level.groupBy(up.alias(part)).agg(F.sum("w").alias("w"))
    out = tree[0]
    for i, node in enumerate(tree[1:], 1):
        above = node.select(F.col(part).alias("__up"), F.col("before").alias("__above"))
        out = out.join(above.hint("merge"), F.shiftright(part, i * fan) == F.col("__up")).select(part, (F.col("before") + F.col("__above")).alias("before"))
    return out


def running_totals(df: DataFrame, order: list[str], weight: str) -> DataFrame:
    """`df` with `before`: the sum of `weight` over the rows that come before by `order`, nulls first.

    Rows are dealt to ranges of the order, which only rows equal in all of it can't be split by; sums of
    the ranges are added up by a tree. Neither `__part` nor `before` may be a column of `df`.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    starts = sums_before(dealt.groupBy("__part").agg(F.sum(weight).alias("w")), "__part", "w")
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__in", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    # Never broadcast, however few: there are more ranges the more rows there are.
    return placed.join(starts.hint("merge"), "__part").select(*df.columns, (F.col("__in") + F.col("before")).alias("before"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; a worker, which outlives the task, gives its free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that this process holds but does not use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every C library
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def small_pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings in a column add up to about `limit` bytes; a longer single text stays whole."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start, n = 0, batch.num_rows
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by `keys`: tables that hold whole runs of equal keys, with the runs' starts and the end."""
    rest: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        s = starts(t)
        if s[-1]:
            yield t.slice(0, s[-1]).combine_chunks(), s
        rest = t.slice(s[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links u-v."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Alternates large-star and small-star steps; every round is one grouped minimum and one join
    per step and is checkpointed, so neither links nor components ever meet in one place.
    """
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
