"""SimHash near-duplicates by an inverted index of fingerprint bytes with count filtering.

Fingerprints of 64 bits link at 3 or fewer differing bits, so linked ones share at least 5 of their
8 positional bytes. The index's keys are sets of positions with their bytes, chosen so that any 5
shared positions contain a whole set: no link is lost. For each pair that meets under a key the
shared positional bytes are tallied, pairs below the guaranteed minimum go, and the rest is verified
by Hamming distance. A pair counts under the first key that it shares only. Keys have as many bytes
as the number of fingerprints asks for, so that lists stay short; the links are the same with any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import components, cut, table

SEED = 42
SHINGLE = 3
MAX_BITS = 3
BYTES = 8
#: Bytes shared at least by fingerprints that differ in at most MAX_BITS bits.
MIN_SHARED = BYTES - MAX_BITS
#: Fingerprints that a key's list holds on average, at most, where longer keys could be taken.
FEW = 2
#: Hashes whose bits are summed at once.
SLAB = 1 << 16


def position_sets(key_bytes: int = 3) -> list[tuple[int, ...]]:
    """Sets of `key_bytes` positions such that any MIN_SHARED of the BYTES positions contain one.

    By halves of four: of 3 positions, one half has 3 or more of any 5. Of 4 positions, a half whole,
    or two pairs; pairs of a half fall into three ways to split it, three positions have a pair of
    each way, so that only pairs of the same way need to be joined. Of 5 positions, all.
    """
    low, high = range(4), range(4, 8)
    if key_bytes == 2:
        return [(0, 1), (2, 3), (4, 5), (6, 7)]
    if key_bytes == 3:
        return [*combinations(low, 3), *combinations(high, 3)]
    if key_bytes == 4:
        way = lambda pair: pair[0] ^ pair[1]
        return [tuple(low), tuple(high), *(a + b for a in combinations(low, 2) for b in combinations(high, 2) if way(a) == way(b))]
    if key_bytes == 5:
        return [*combinations(range(BYTES), 5)]
    raise ValueError("key_bytes is 2, 3, 4 or 5")


def key_bytes_for(fingerprints: int) -> int:
    """The shortest keys, which need the fewest sets, whose lists hold a few of so many fingerprints."""
    return next((k for k in (3, 4) if fingerprints <= FEW << 8 * k), 5)


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLAB):
        ones += np.unpackbits(hashes[i : i + SLAB].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def simhash(text: Column) -> Column:
    """The fingerprint as a signed long."""

    @arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return run(text)


def candidates(prints: DataFrame, col: str = "fp", key_bytes: int = 3) -> DataFrame:
    """(a, b, shared) with a < b: pairs of the distinct fingerprints in `col` that meet under a key, each under its first one, with the tally of their positional bytes that are equal.

    Only different fingerprints are paired. The joins are on the key, which Spark splits where it is skewed.
    """
    mask = lambda positions: reduce(lambda m, p: m | 255 << 8 * p, positions, 0)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(mask(s)) for s in position_sets(key_bytes)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(col).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    index = prints.select(col, keys.alias("k")).select("k.place", "k.key", F.col(col).alias("fp"))
    a, b = index.alias("a"), index.alias("b")
    x = "(a.fp ^ b.fp)"
    first = "case " + " ".join(f"when ({x} & {m}L) = 0 then {i}" for i, m in enumerate(masks)) + " end"
    tally = " + ".join(f"if(({x} & {signed(255 << 8 * p)}L) = 0, 1, 0)" for p in range(BYTES))
    # No key is broadcast: the index has as many rows as the corpus has fingerprints, times the sets.
    met = a.hint("merge").join(b.hint("merge"), F.expr(f"a.place = b.place and a.key = b.key and a.fp < b.fp and a.place = {first}"))
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), F.expr(tally).alias("shared"))


def links(prints: DataFrame, col: str = "fp", key_bytes: int = 3) -> DataFrame:
    """(a, b) with a < b: pairs of the distinct fingerprints in `col` at MAX_BITS or fewer differing bits, each once: candidates that share the guaranteed minimum of bytes, verified."""
    retained = candidates(prints, col, key_bytes).where(F.col("shared") >= MIN_SHARED)
    return retained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")


def classes(prints: DataFrame, id_col: str, fp_col: str = "fp") -> DataFrame:
    """(fp, root, component_id): for each distinct fingerprint its class, named by its smallest fingerprint, and the smallest id in it."""
    reps = cut(prints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("id")))
    found = components(links(reps, key_bytes=key_bytes_for(reps.count())), "a", "b")
    joined = reps.join(found, reps.fp == found.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    least = joined.where("fp <> root").groupBy("root").agg(F.min("id").alias("least"))
    # Classes of one fingerprint, nearly all, need no shuffle of their own.
    roots = joined.where("fp = root").select("root", "id").join(least, "root", "left").select("root", F.least("id", "least").alias("component_id"))
    return joined.join(roots, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id), one row per row of `docs`.

    Null and empty texts have fingerprint 0, linked like any other. Null ids never name a class,
    unless it has no other id. Rows that repeat an id have the classes of their own texts.
    """
    prints = cut(docs.select(F.col(id_col), simhash(F.col(text_col)).alias("fp")))
    return prints.join(classes(prints, id_col), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each class that with the smallest id (not null, if it has one), of rows that repeat it the one with the smallest text hash. Classes that share an id keep one row each."""
    narrow = cut(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp"), F.xxhash64(text_col).alias("h")))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("k")
    best = narrow.join(classes(narrow, "id"), "fp").groupBy("root").agg(first).select(F.xxhash64("k.id", "k.h").alias("__key"), F.col("k.id").alias("__id"), F.col("k.h").alias("__hash"))
    keyed = docs.withColumn("__text_hash", F.xxhash64(text_col)).withColumn("__key", F.xxhash64(id_col, "__text_hash"))
    kept = keyed.join(best, "__key").where(F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")))
    return kept.dropDuplicates(["__key"]).select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
