"""Mixing sources to target weights, by DataFrame functions only.

Every row gets a hash-random key, and rows are sorted by source and key in ranges, so that no range holds many
more rows than another, whatever a source's share of the table: rows equal in source, key and id are
dealt apart by a salt. Sizes are summed per range, added up by a tree over the ranges, and then within each range: a distributed
prefix sum. A source's budget is cut out of that order: whole epochs first, then the first rows up to the
rest, the row at the cut in part. Sources have one row each where targets are set, so they may be some millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, running_totals, table

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all sizes, in hundredths.
SHARE_PERCENT = 150
#: Copies of a row that are made in one place.
PIECE = 10_000
#: No source is taken more often than this.
MAX_EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size, ...): the same with the target of each source.

    Sources that would exceed their cap are those with the least cap per weight. Sorted by it, the
    level is the first at which what is left, shared by weight, stays below the next cap.
    """
    # One row per source: these windows see the sources, not the documents.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = sizes.withColumns(
        {"cap": F.col("source_size") * max_epochs, "weight": F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")}
    )
    left = ranked.withColumns(
        {
            "place": F.row_number().over(by_cap),
            "left_size": F.sum("source_size").over(every) * share_percent / 100.0 - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    fits = F.col("left_size") * F.col("weight") <= F.col("cap") * F.col("left_weight")
    level = left.withColumn("level", F.min(F.when(fits, F.struct("place", "left_size", "left_weight"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level.left_size") / F.col("level.left_weight"))
    return level.select(*sizes.columns, F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def hash_key(id_col: Column, seed: int) -> Column:
    """52 hash-random bits of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 10) -> DataFrame:
    """(id, source, size, source_size, target, taken), one row per row of `docs`.

    Null and empty texts have size 0 and are taken 0 times. Null sources form one source, the last.
    Rows that repeat an id and a size are interchangeable. An empty table gives no rows. Other
    columns of `docs`, whatever their names, play no part.
    """
    return _mixed(docs, id_col, text_col, source_col, seed, []).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, ties: list[Column]) -> DataFrame:
    """The mix, with columns that settle the order of rows of one id and size before chance does."""
    # "s" + source or "n": a key without nulls. The salt is drawn once and written, so that rows equal in all else can be dealt apart.
    source = F.col(source_col).cast("string")
    s_key = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    names = [f"tie_{i}" for i in range(len(ties))]
    narrow = cut(docs.select(F.col(id_col).alias("id"), source.alias("source"), s_key.alias("s"), word_count(F.col(text_col)).alias("size"), hash_key(F.col(id_col), seed).alias("key"), *[t.alias(n) for t, n in zip(ties, names, strict=True)], F.rand(seed).alias("salt")))
    totals = narrow.groupBy("source", "s").agg(F.sum("size").alias("source_size"))
    # A row per source: what comes before a source in the order of all rows.
    earlier = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    targets = cut(source_targets(totals).select("s", "source_size", "target", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)).alias("start")))
    # Sorted by ranges within each source; ranges hold about as many rows each, whatever a source's or an id's share.
    ranked = running_totals(narrow, ["s", "key", "id", "size", *names, "salt"], "size")
    placed = ranked.join(F.broadcast(targets) if _few(targets) else targets, "s")
    budget = "cast(floor(target + 0.5D) as bigint)"
    epochs = f"if(source_size > 0, {budget} div source_size, 0)"
    rest = f"({budget} - {epochs} * source_size - (before - start))"
    return placed.withColumn("taken", F.expr(f"{epochs} * size + greatest(0, least(size, {rest}))").cast("long"))


def _few(targets: DataFrame, most: int = 20_000) -> bool:
    """Whether the sources are few enough to broadcast their targets; counted, as sources may grow with the data."""
    return targets.limit(most + 1).count() <= most


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in the columns of `docs`: a row for each time that a document is taken.

    The document at a source's cut is taken up to its last word within the budget. Documents that
    are not taken are absent, so those of size 0 are. Rows that are equal in all columns (maps aside, which
    have no hash) are counted, not told apart: one of them stands for all, for as often as they are taken together.
    """
    hashed = [F.col(c) for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    keys = [F.xxhash64(*hashed), F.xxhash64(F.lit(1), *hashed)]
    mixed = _mixed(docs, id_col, text_col, source_col, 10, keys)
    # Equal rows are taken as often as each other but for one cut: three numbers of times at most.
    shares = mixed.groupBy("tie_0", "tie_1", "size", "taken").agg(F.count("*").alias("n")).groupBy("tie_0", "tie_1", "size").agg(F.sum("n").alias("rows"), F.collect_list(F.struct("taken", "n")).alias("shares"))
    shares = cut(shares.select(F.col("tie_0").alias("__a"), F.col("tie_1").alias("__b"), F.col("size").alias("__n"), "rows", F.filter("shares", lambda x: x["taken"] > 0).alias("__s")).where(F.size("__s") > 0))
    left, by = docs.withColumns({"__a": keys[0], "__b": keys[1]}), ["__a", "__b"]
    both = left.join(shares.where("rows = 1").select(*by, "__n", F.col("__s")[0]["taken"].alias("__t")), by)
    many = shares.where("rows > 1")
    if not many.isEmpty():
        one = left.join(many.select(*by), by, "left_semi").dropDuplicates(by)
        # In pieces of PIECE copies, which can be dealt out.
        pieces = many.select(*by, "__n", F.explode("__s").alias("x")).select(*by, "__n", F.col("x.taken").alias("__t"), "x.n", F.explode(F.expr(f"sequence(0, cast((x.n - 1) div {PIECE} as int))")).alias("piece"))
        pieces = pieces.select(*by, "__n", "__t", F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).cast("int").alias("__m"))
        copied = one.join(pieces, by).withColumn("__m", F.explode(F.sequence(F.lit(1), "__m"))).drop("__m")
        both = both.unionByName(copied.select(both.columns))
    times = both.withColumn("__take", F.explode(F.expr("transform(sequence(1, cast(ceil(__t / __n) as int)), i -> least(__n, __t - (i - 1) * __n))")))
    # Each element is a word with the white space before it; the last one may be white space only.
    words = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("__take") < F.col("__n"), F.array_join(F.slice(words, 1, F.col("__take").cast("int")), "")).otherwise(F.col(text_col))
    return times.withColumn(text_col, text).select(*docs.columns)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with the production weights."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || left(md5('10:' || coalesce(CAST(doc_id AS VARCHAR), '')), 13) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER w AS place,
    CAST(CAST(sum(source_size) OVER () AS BIGINT) AS DOUBLE) * 150 / 100.0 - CAST(coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_size,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_weight
  FROM s WINDOW w AS (ORDER BY cap / weight, source IS NULL, source)),
l AS (SELECT left_size, left_weight FROM p WHERE left_size * weight <= cap * left_weight ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * l.left_size / l.left_weight) AS target FROM p, l),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""
