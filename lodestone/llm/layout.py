"""A clustered layout in four dimensions: files along a space-filling curve, and how many files a query opens, by counts alone.

Each value has a coordinate of 0 to 7 by its rank, the coordinates' digits interleave to z, and every `file_rows` rows in the
order of z and id are one file. For a query, which asks for one source and lang coordinate and for length and date
coordinates at most 1 away, the files whose bounds meet it are counted by complements: those that cover its
source and lang, less those that miss its length, less those that miss its date, plus those that miss
both. The four are read from cumulative histograms of the corners of the files' length and date ranges,
one set for each source and lang coordinate. The files that hold a row of it are counted from its cells' intervals of
files. So what is counted has 8^4 cells at most, whatever the table's size; files never meet queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fold, running_totals, table

DIMS = ("source", "lang", "length", "date")
BITS = 3
SIDE = 1 << BITS
CELLS = SIDE ** len(DIMS)
FILE_ROWS = 1_000
DAYS = 365
#: Length and date coordinates that a query accepts beside its own.
NEAR = 1


def interleave(coordinates: list[Column]) -> Column:
    """One number of the coordinates' binary digits, highest first, each round in their order."""
    out = F.lit(0).cast("long")
    for bit in reversed(range(BITS)):
        for c in coordinates:
            out = out * 2 + F.shiftright(c, bit).bitwiseAND(F.lit(1))
    return out


def coordinate(z: Column, dim: int) -> Column:
    """A dimension's coordinate, out of the interleaved number."""
    out = F.lit(0).cast("long")
    for bit in reversed(range(BITS)):
        out = out * 2 + F.shiftright(z, bit * len(DIMS) + len(DIMS) - 1 - dim).bitwiseAND(F.lit(1))
    return out


def thresholds(values: DataFrame, n: int) -> list[list]:
    """Per dimension the smallest values of coordinates 1 to 7, null where there are none; 28 values, whatever the table's size.

    Distinct values are counted, and a running total over all dimensions, each of n rows, gives the rows with a smaller value.
    """
    columns = [F.struct(F.lit(i).alias("dim"), *(F.col(d).cast(t).alias(t) if t == kind else F.lit(None).cast(t).alias(t) for t in ("string", "long"))) for i, (d, kind) in enumerate(zip(DIMS, ("string", "string", "long", "long"), strict=True))]
    counts = values.select(F.explode(F.array(*columns)).alias("v")).groupBy("v.dim", "v.string", "v.long").agg(F.count("*").alias("m"))
    ranked = running_totals(counts, ["dim", "string", "long"], "m").withColumn("smaller", F.col("before") - F.col("dim") * F.lit(n))
    least = [F.min(F.when(F.col("smaller") * SIDE >= F.lit(k * n), F.struct("string", "long"))).alias(f"t{k}") for k in range(1, SIDE)]
    rows = {r.dim: [t and (t.string if t.string is not None else t.long) for t in r[1:]] for r in ranked.groupBy("dim").agg(*least).collect()}
    return [rows.get(i, []) for i in range(len(DIMS))]


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", file_rows: int = FILE_ROWS) -> DataFrame:
    """(id, z, position, file), one row per row of `docs`.

    Null sources, langs and dates (those of null ids) are smaller than all others, a null text has length -1 and an empty
    one 0. Rows that repeat an id and a z take places beside each other, which of them which is all one. An empty table
    has no rows. Other columns of `docs`, whatever their names, play no part.
    """
    id_ = F.col(id_col)
    # Drawn once and written, so that rows equal in all else can be dealt apart.
    narrow = cut(
        docs.select(
            id_.alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
            F.coalesce(F.octet_length(text_col), F.lit(-1)).cast("long").alias("length"), fold(id_, DAYS).cast("long").alias("date"), F.rand(12).alias("salt"),
        )
    )
    marks = thresholds(narrow, narrow.count())
    least = [[t for t in ts if t is not None] for ts in marks]
    found = [sum((F.coalesce(F.col(d) >= F.lit(t), F.lit(False)).cast("long") for t in ts), F.lit(0).cast("long")) for d, ts in zip(DIMS, least, strict=True)]
    keyed = narrow.select("id", interleave(found).alias("z"), "salt", F.lit(1).cast("long").alias("one"))
    placed = running_totals(keyed, ["z", "id", "salt"], "one")
    return cut(placed.select("id", "z", F.col("before").alias("position"), F.expr(f"before div {file_rows}").alias("file")))


def bounds(placed: DataFrame) -> DataFrame:
    """(file, rows, min_0, max_0 ...): the range of each coordinate in each file."""
    return placed.groupBy("file").agg(F.count("*").alias("rows"), *(f(coordinate(F.col("z"), i)).alias(f"{n}_{i}") for i in range(4) for n, f in (("min", F.min), ("max", F.max))))


#: Corners of a file's ranges of length (2) and date (3).
CORNERS = (("max_2", "max_3"), ("max_2", "min_3"), ("min_2", "max_3"), ("min_2", "min_3"))


def corner_histograms(files: DataFrame) -> DataFrame:
    """(s, g, h): for each source and lang coordinate the files that cover both, counted by each of their four corners: h holds for corner k and each (a, b) the files whose corner is at most that in both, at k * 64 + a * 8 + b. 64 rows at most."""
    shapes = files.groupBy(*(f"{n}_{i}" for i in range(4) for n in ("min", "max"))).agg(F.count("*").alias("m"))
    covered = shapes.withColumn("s", F.explode(F.sequence("min_0", "max_0"))).withColumn("g", F.explode(F.sequence("min_1", "max_1")))
    corners = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(a).alias("a"), F.col(b).alias("b")) for k, (a, b) in enumerate(CORNERS)]))
    counted = covered.select("s", "g", "m", corners.alias("c")).groupBy("s", "g", "c.k", "c.a", "c.b").agg(F.sum("m").alias("m"))
    # Every place of every histogram, so that each has a cumulative count.
    grid = counted.select("s", "g").distinct().crossJoin(counted.sparkSession.range(len(CORNERS) * SIDE * SIDE).selectExpr("id", f"id div {SIDE * SIDE} as k", f"id div {SIDE} % {SIDE} as a", f"id % {SIDE} as b"))
    full = grid.join(counted, ["s", "g", "k", "a", "b"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    along_a = Window.partitionBy("s", "g", "k", "b").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    along_b = Window.partitionBy("s", "g", "k", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = full.withColumn("m", F.sum("m").over(along_a)).withColumn("m", F.sum("m").over(along_b))
    return cumulative.groupBy("s", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda x: x["m"]).alias("h"))


def touched(h: Column, length: Column, date: Column) -> Column:
    """Files whose bounds meet a query, from the histograms of its source and lang coordinates."""

    def most(corner: int, a: Column, b: Column) -> Column:
        """Files whose corner is at most (a, b)."""
        at = F.least(a, F.lit(SIDE - 1)) * SIDE + F.least(b, F.lit(SIDE - 1)) + corner * SIDE * SIDE
        return F.when((a < 0) | (b < 0), F.lit(0)).otherwise(F.get(h, at.cast("int")))

    top = F.lit(SIDE - 1)
    under_l, upto_l, under_d, upto_d = length - NEAR - 1, length + NEAR, date - NEAR - 1, date + NEAR
    covering = most(0, top, top)
    length_misses = most(0, under_l, top) + covering - most(3, upto_l, top)
    date_misses = most(0, top, under_d) + covering - most(3, top, upto_d)
    both = (
        most(0, under_l, under_d) + most(1, under_l, top) - most(1, under_l, upto_d) + most(2, top, under_d) - most(2, upto_l, under_d)
        + covering - most(3, upto_l, top) - most(3, top, upto_d) + most(3, upto_l, upto_d)
    )
    return covering - length_misses - date_misses + both


def queries_of_cells(placed: DataFrame, files: DataFrame) -> DataFrame:
    """(z, files_touched, files_matching): the query of every cell that has rows, CELLS at most."""
    cells = placed.groupBy("z").agg(F.min("file").alias("first"), F.max("file").alias("last"))
    asked = cells.select("z", *(coordinate(F.col("z"), i).alias(f"c{i}") for i in range(4)))
    steps = F.sequence(F.lit(-NEAR), F.lit(NEAR))
    near = asked.withColumn("l", F.explode(F.transform(steps, lambda x: F.col("c2") + x))).withColumn("d", F.explode(F.transform(steps, lambda x: F.col("c3") + x))).where(f"l between 0 and {SIDE - 1} and d between 0 and {SIDE - 1}")
    pairs = near.select(F.col("z").alias("asked"), interleave([F.col(c) for c in ("c0", "c1", "l", "d")]).alias("z")).join(cells, "z")
    # Cells follow each other in files: two intervals share one file at most, the last of the one and the first of the next.
    before = F.lag("last").over(Window.partitionBy("asked").orderBy("z"))
    matching = pairs.withColumn("new", F.col("last") - F.col("first") + 1 - F.coalesce((before == F.col("first")).cast("int"), F.lit(0))).groupBy("asked").agg(F.sum("new").alias("files_matching"))
    met = asked.join(corner_histograms(files), (F.col("c0") == F.col("s")) & (F.col("c1") == F.col("g")))
    return met.select("z", touched(F.col("h"), F.col("c2"), F.col("c3")).alias("files_touched")).join(matching.withColumnRenamed("asked", "z"), "z")


def op12_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"))
    files = cut(bounds(placed))
    text = F.concat_ws(",", *(f"{n}_{i}" for i in range(4) for n in ("min", "max")))
    # CELLS rows of three numbers, some 100 kB, whatever the size of the table; the files, which grow with it, are joined by a shuffle.
    cells = F.broadcast(queries_of_cells(placed, files))
    return placed.join(cells, "z").join(files.select("file", text.alias("file_bounds")).hint("merge"), "file").select(F.col("id").alias("doc_id"), "z", "position", "file", "files_touched", "files_matching", "file_bounds")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, CAST(coalesce(strlen(text), -1) AS BIGINT) AS length,
    -- CRC-32, byte by byte and bit by bit.
    CASE WHEN doc_id IS NOT NULL THEN CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda r, x: xor(xor(r, x) >> 1, CASE WHEN xor(r, x) & 1 = 1 THEN 3988292384 ELSE 0 END::UBIGINT)), 4294967295::UBIGINT) % 365 AS BIGINT) END AS date
  FROM documents),
c AS (
  SELECT doc_id, 8 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS s, 8 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS g,
    8 * (rank() OVER (ORDER BY length) - 1) // count(*) OVER () AS l, 8 * (rank() OVER (ORDER BY date NULLS FIRST) - 1) // count(*) OVER () AS t
  FROM d),
z AS (
  SELECT *, CAST((s >> 2 & 1) * 2048 + (g >> 2 & 1) * 1024 + (l >> 2 & 1) * 512 + (t >> 2 & 1) * 256 + (s >> 1 & 1) * 128 + (g >> 1 & 1) * 64 + (l >> 1 & 1) * 32 + (t >> 1 & 1) * 16
    + (s & 1) * 8 + (g & 1) * 4 + (l & 1) * 2 + (t & 1) AS BIGINT) AS z FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position, (row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1) // 1000 AS file FROM z),
f AS (SELECT file, min(s) AS s0, max(s) AS s1, min(g) AS g0, max(g) AS g1, min(l) AS l0, max(l) AS l1, min(t) AS t0, max(t) AS t1 FROM p GROUP BY file),
q AS (SELECT DISTINCT s, g, l, t FROM p),
touched AS (SELECT q.s, q.g, q.l, q.t, count(*) AS n FROM q JOIN f ON q.s BETWEEN s0 AND s1 AND q.g BETWEEN g0 AND g1 AND l0 <= q.l + 1 AND l1 >= q.l - 1 AND t0 <= q.t + 1 AND t1 >= q.t - 1 GROUP BY ALL),
held AS (SELECT DISTINCT s, g, l, t, file FROM p),
matching AS (SELECT q.s, q.g, q.l, q.t, count(DISTINCT file) AS n FROM q JOIN held h ON q.s = h.s AND q.g = h.g AND abs(q.l - h.l) <= 1 AND abs(q.t - h.t) <= 1 GROUP BY ALL)
SELECT doc_id, z, position, p.file, touched.n AS files_touched, matching.n AS files_matching, concat_ws(',', s0, s1, g0, g1, l0, l1, t0, t1) AS file_bounds
FROM p JOIN f ON p.file = f.file JOIN touched USING (s, g, l, t) JOIN matching USING (s, g, l, t)
"""
