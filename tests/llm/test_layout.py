"""The clustered layout against plain ranks and loops over files."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import layout
from lodestone.llm.common import running_totals, sums_before

from .conftest import DOCS, SCHEMA


def plain(rows, file_rows):
    """(id, z, position's file, touched, matching, bounds) of every row, by sorting and by comparing every query with every file."""
    least = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v.encode() if v is not None else b"")
    values = [[text(s), text(g), least(len(t.encode()) if t is not None else -1), least(None if i is None else zlib.crc32(str(i).encode()) % 365)] for i, t, g, s, *_ in rows]
    n, co = len(rows), [[0] * 4 for _ in rows]
    for d in range(4):
        ordered = sorted(v[d] for v in values)
        first = {}
        for k, v in enumerate(ordered):
            first.setdefault(v, k)
        for k, v in enumerate(values):
            co[k][d] = 8 * first[v[d]] // n
    z = [int("".join(str(c[d] >> b & 1) for b in (2, 1, 0) for d in range(4)), 2) for c in co]
    order = sorted(range(n), key=lambda k: (z[k], least(rows[k][0])))
    files = [order[k : k + file_rows] for k in range(0, n, file_rows)]
    bounds = [[(min(co[k][d] for k in f), max(co[k][d] for k in f)) for d in range(4)] for f in files]
    out = []
    for at, k in enumerate(order):
        s, g, length, t = co[k]
        box = [(s, s), (g, g), (length - 1, length + 1), (t - 1, t + 1)]
        meets = sum(all(lo <= b and hi >= a for (a, b), (lo, hi) in zip(box, bd, strict=True)) for bd in bounds)
        holds = sum(any(all(a <= co[j][d] <= b for d, (a, b) in enumerate(box)) for j in f) for f in files)
        out.append((rows[k][0], z[k], at, at // file_rows, meets, holds, ",".join(f"{a},{b}" for a, b in bounds[at // file_rows])))
    return out


def laid_out(df, file_rows):
    placed = layout.place(df, file_rows=file_rows)
    files = layout.bounds(placed)
    cells = layout.queries_of_cells(placed, files)
    text = F.concat_ws(",", *(f"{n}_{i}" for i in range(4) for n in ("min", "max")))
    return placed.join(cells, "z").join(files.select("file", text.alias("b")), "file").select("id", "z", "position", "file", "files_touched", "files_matching", "b")


@pytest.mark.parametrize("file_rows", [3, 25])
def test_counts_equal_loops_over_files(spark, file_rows):
    rng = random.Random(file_rows)
    rows = [*DOCS] + [(rng.choice([None, rng.randrange(900)]), rng.choice([None, "", "é" * rng.randrange(9), "x" * rng.randrange(400)]), rng.choice(["de", "en", "en", "en", None]), rng.choice(["hot"] * 4 + ["a", "b", "c", None]), "x", 0.5) for _ in range(300)]
    got = laid_out(spark.createDataFrame(rows, SCHEMA).repartition(3), file_rows)
    # Rows of one id and z may change places: their positions are the same together.
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, file_rows))


def test_rows_equal_in_all_are_dealt_apart(spark):
    """Null ids and one text: one z and one id, yet ranges of about equal size."""
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    placed = layout.place(same)
    assert sorted(r.position for r in placed.collect()) == list(range(20_000))
    assert laid_out(same, 1000).agg(F.max("files_touched"), F.min("files_matching"), F.max("z")).first() == (20, 20, 0)
    sizes = [r["count"] for r in same.withColumn("salt", F.rand(1)).repartitionByRange(4, "doc_id", "salt").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 8_000


def test_an_empty_table(spark, none):
    assert laid_out(none, 10).count() == 0


def test_sums_before_by_a_tree(spark):
    parts = spark.range(3000).select((F.col("id") * 7).alias("part"), (F.col("id") % 5).alias("w"))
    got = {r.part: r.before for r in sums_before(parts, "part", "w", fan=3, levels=5).collect()}
    total, want = 0, {}
    for i in range(3000):
        want[i * 7] = total
        total += i % 5
    assert got == want


def test_running_totals(spark):
    rows = [(random.Random(i).choice([None, "a", "b", "c"]), i % 7, i) for i in range(500)]
    got = {r.i: r.before for r in running_totals(spark.createDataFrame(rows, "k string, v int, i int"), ["k", "v", "i"], "v").collect()}
    total = 0
    for k, v, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        assert got[i] == total, (k, v, i)
        total += v
