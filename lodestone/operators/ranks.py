"""Exact order statistics of large groups: by histograms of leading bits, until what is left of a group is few rows.

No task gathers a group's values. A pass counts them by 16 more bits of an order-preserving number, at most 65,536 counts a
group; the bucket that holds a rank is refined in the next pass, which reads that bucket's rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..sources.shared import cut

BITS = 16
#: Rows of a bucket that are told apart by their values in one place.
FEW = 100_000


def ordered_bits(value: Column) -> Column:
    """A long in the order of a double: -0 as 0, NaN the largest; null for null."""

    @arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            bits = (v.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
            # Of negative numbers the larger bits are the smaller value.
            yield pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits), mask=v.is_null().to_numpy(zero_copy_only=False))

    return run(value.cast("double"))


def select(points: DataFrame, tags: list[str], value: str, ranks: dict[str, Column], few: int = FEW) -> DataFrame:
    """(tags, name, value) for each name of `ranks`: of each group the value at the 1-based rank, a column over the group's number of values `n`.

    Null values don't count; null tags are a group. Groups without values are absent.
    """
    integral = dict(points.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    key = F.col(value).cast("long") if integral else ordered_bits(F.col(value))
    rows = points.where(F.col(value).isNotNull()).select(*tags, F.col(value).alias("__v"), key.alias("__key"))
    per = rows.groupBy(*tags).agg(F.count("*").alias("n"))
    wanted = per.select(*tags, "n", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), r).cast("long").alias("rank")) for n, r in ranks.items()])).alias("x"))
    wanted = wanted.select(*tags, "x.name", "x.rank", F.lit(0).cast("long").alias("part"), F.col("n").alias("rows"))
    shift, taken = 64 - BITS, 64  # bits that are left to refine, and those that parts are told apart by
    while True:
        last = shift == 0 or (taken < 64 and (wanted.agg(F.max("rows")).first()[0] or 0) <= few)
        shift = 0 if last else shift
        part = F.shiftright("__key", taken) if taken < 64 else F.lit(0).cast("long")
        parts = wanted.select(*[F.col(t).alias(f"__{i}") for i, t in enumerate(tags)], "part").distinct()
        same = _same(tags) & (F.col("__part") == F.col("part"))
        kept = rows.withColumn("__part", part)
        kept = kept if taken == 64 else kept.join(parts, same, "left_semi")
        counts = kept.groupBy(*tags, "__part", F.shiftright("__key", shift).alias("__b")).agg(F.count("*").alias("c"), F.min("__v").alias("__v"))
        upto = Window.partitionBy(*tags, "__part").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("c").over(upto))
        asked = wanted.select(*[F.col(t).alias(f"__{i}") for i, t in enumerate(tags)], "name", "rank", "part")
        met = counts.join(asked, same & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
        found = met.select(*tags, "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("__b").alias("part"), F.col("c").alias("rows"), "__v")
        if last:
            return found.select(*tags, "name", F.col("__v").alias(value))
        wanted, taken, shift = cut(found.drop("__v")), shift, max(0, shift - BITS)


def _same(tags: list[str]) -> Column:
    out = F.lit(True)
    for i, t in enumerate(tags):
        out = out & F.col(t).eqNullSafe(F.col(f"__{i}"))
    return out


def nearest_rank(thousandths: int) -> Column:
    """The rank of the smallest value that so many thousandths of a group's values don't exceed."""
    return F.expr(f"(n * {thousandths} + 999) div 1000")
