"""Benchmark decontamination by winnowing.

Of every `w` successive hashes of `k` words the smallest is kept, the last of equals: any span of k + w - 1
words that two texts share has a fingerprint at the same place in both. A benchmark item asks for windows of
`WINDOW` words, or for all its words where it has fewer; for each window length that occurs, k and w
are chosen to add up to it. Fingerprints of the documents pass a bitmap of the benchmark's, of fixed size, in the
task that made them. Those left meet the benchmark's in a join, each with the words around it that its windows
can reach, and are extended to both sides word by word. Texts and contexts that are equal are taken
once, whatever the number of rows that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh64_intdigest

from .common import cut, release, table

#: Everything but letters of A-Z in either case, digits and non-ASCII characters separates words; A-Z is lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 10
#: Bits of the map that documents' fingerprints pass, 4 MB: with two million fingerprints of benchmarks one in sixteen others passes too, and goes at the join.
FILTER_BITS = 1 << 25
#: Bytes of texts that are hashed at once; a longer text is by itself.
SLAB = 4 << 20
#: Words whose hashes a worker remembers.
MOST_WORDS = 1 << 20
MARKS = "array<struct<fp: bigint, at: bigint, left: array<string>, words: string, right: array<string>>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def gram_of(window: int) -> int:
    """Words of a gram for windows of so many words; the others of a window are how far its smallest gram can be."""
    return (window + 1) // 2


def winnow(hashes: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints) kept of texts with `sizes` words, one after the other, for one window length."""
    k = gram_of(window)
    w, n = window - k + 1, len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.full(n + w - 1, window, np.uint64)
    for j in range(k):
        grams = (grams ^ hashes[j : j + n + w - 1]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
    least = grams[:n].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : j + n], out=least)
    at = np.zeros(n, np.int64)
    for j in range(w):
        np.copyto(at, np.arange(j, n + j), where=grams[j : j + n] == least)
    # A window must lie in one text.
    last = np.repeat(np.cumsum(sizes), sizes)
    at = at[np.arange(n) + window <= last[:n]]
    kept = at[np.flatnonzero(np.diff(at, prepend=-1))]
    return kept, grams[kept]


def fingerprints(text: Column, windows: list[int], passing: bytes | None = None) -> Column:
    """struct(n_words, marks) of a text: its number of words, and the fingerprints whose bit is set in `passing` (all without it), each with its gram and the words before (nearest first) and after it that its windows can reach. Null and empty texts have no words."""

    @arrow_udf(f"struct<n_words: bigint, marks: {MARKS}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        strings = pa.list_(pa.string())
        kind = pa.struct([("n_words", pa.int64()), ("marks", pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("left", strings), ("words", pa.string()), ("right", strings)])))])
        bits = np.frombuffer(passing, np.uint8) if passing is not None else None
        known: dict[bytes, int] = {}

        def hash_of(word: bytes) -> int:
            if len(known) >= MOST_WORDS:
                known.clear()
            return known.setdefault(word, xxh64_intdigest(word))

        def marks(texts: list[list[bytes]]) -> list[list[dict]]:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            hashes = np.fromiter((known.get(w) or hash_of(w) for t in texts for w in t), np.uint64, int(sizes.sum()))
            ends, out = np.cumsum(sizes), [[] for _ in texts]
            utf8 = lambda ws: [w.decode("utf-8", "replace") for w in ws]
            for window in windows:
                at, fp = winnow(hashes, sizes, window)
                if bits is not None:
                    place = fp % np.uint64(FILTER_BITS)
                    sure = bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                    at, fp = at[sure > 0], fp[sure > 0]
                k = gram_of(window)
                for p, f, owner in zip(at.tolist(), fp.view(np.int64).tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True):
                    ws = texts[owner]
                    i = p - int(ends[owner] - sizes[owner])
                    out[owner].append({"fp": f, "at": i, "left": utf8(ws[max(0, i - window + k) : i][::-1]), "words": b" ".join(ws[i : i + k]).decode("utf-8", "replace"), "right": utf8(ws[i + k : i + window])})
            return out

        for batch in batches:
            rows, slab, size = [], [], 0
            texts = batch.cast(pa.binary())
            for i, t in enumerate(texts, 1):
                raw = t.as_py()
                slab.append(words_of(raw))
                size += len(raw or b"")
                if size >= SLAB or i == len(texts):
                    rows += [{"n_words": len(w), "marks": m} for w, m in zip(slab, marks(slab), strict=True)]
                    slab, size = [], 0
            yield pa.array(rows, kind)
        release()

    return run(text)


def item_windows(n_words: Column) -> Column:
    """The length of an item's windows: null without words."""
    return F.when(n_words > 0, F.least(n_words, F.lit(WINDOW)))


def bitmap(prints: DataFrame) -> bytes:
    """A map of FILTER_BITS bits of the fingerprints `fp`, made in parts of 4 kB where the fingerprints are: of a fixed size, whatever their number."""
    place = F.expr(f"(fp & {FILTER_BITS - 1}L) + 1")
    parts = prints.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in parts:
        out[(r.b - 1) * len(r.bits) : r.b * len(r.bits)] = r.bits
    return bytes(out)


def common_start(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from their start."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b))).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs`, one row each, with n_words, n_hit and items in place of the text: the words of a text, those inside any occurrence of an item's window, and the ids of the items with occurring windows, as sorted strings.

    An item of WINDOW words or more has all windows of WINDOW successive words, a shorter one its whole text, one without
    words none. Rows that repeat an item's id are one item; those with null ids are one, listed as the empty string.
    Null and empty texts have no words and no hits. Rows with equal texts have equal values. An empty table of
    either kind gives no hits. Other columns of `docs` stay; those named n_words, n_hit or items are replaced.
    """
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "n_hit", "items")]
    docs = docs.select(*kept, F.col(text_col).alias("__t"))
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    # One text, however many items hold it, is one entry.
    entries = cut(words.groupBy(F.md5("text").alias("entry")).agg(F.first("text").alias("text")).where("entry is not null"))
    sized = entries.select("entry", "text", item_windows(fingerprints(F.col("text"), [])["n_words"]).alias("window"))
    windows = [r.window for r in sized.where("window > 0").select("window").distinct().collect()]
    marked = None
    for window in sorted(windows):
        found = sized.where(F.col("window") == window).select("entry", F.explode(fingerprints(F.col("text"), [window])["marks"]).alias("m")).select("entry", F.lit(window).alias("window"), "m.*")
        marked = found if marked is None else marked.unionByName(found)
    if marked is None:
        return docs.select(*kept, fingerprints(F.col("__t"), [])["n_words"].alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    # Contexts that many entries share are met once.
    context = ["fp", "window", "left", "words", "right"]
    marked = cut(marked.select("entry", *context).distinct().withColumn("context", F.md5(F.to_json(F.struct(*context)))))
    contexts = marked.select(F.col("context"), *(F.col(c).alias(f"i_{c}") for c in context)).distinct()

    f = fingerprints(F.col("__t"), sorted(windows), bitmap(contexts.select(F.col("i_fp").alias("fp"))))
    # Without the texts themselves: hits depend on a text's words alone.
    read = cut(docs.select(*kept, F.md5("__t").alias("__text"), f.alias("__f")).select(*kept, "__text", F.col("__f.n_words").alias("n_words"), F.col("__f.marks").alias("__marks")))
    some = F.size("__marks") > 0
    # Copies of a text are taken once, before anything is shuffled.
    texts = read.where(some).groupBy(F.col("__text").alias("text")).agg(F.first("__marks").alias("marks"))
    met = texts.select("text", F.explode("marks").alias("m")).select("text", "m.*").join(contexts, (F.col("fp") == F.col("i_fp")) & (F.col("words") == F.col("i_words")))
    before, after = common_start(F.col("left"), F.col("i_left")), common_start(F.col("right"), F.col("i_right"))
    gram = F.floor((F.col("i_window") + 1) / 2)
    extended = met.select("text", "context", "i_window", (F.col("at") - before).alias("start"), (F.col("at") + gram + after).alias("stop"))
    spans = cut(extended.where(F.col("stop") - F.col("start") >= F.col("i_window")).select("text", "context", "start", "stop").distinct())

    places = spans.select("text", "start", "stop").distinct()
    seen = F.coalesce(F.max("stop").over(Window.partitionBy("text").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = places.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", seen))).groupBy("text").agg(F.sum("new").cast("long").alias("n_hit"))
    held = spans.select("text", "context").distinct().join(marked.select("context", "entry").distinct(), "context").select("text", "entry").distinct()
    ids = words.select(F.md5("text").alias("entry"), "item").distinct()
    lists = held.join(ids, "entry").groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = hits.join(lists, "text").withColumnRenamed("text", "__text")
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}
    clean = read.where(~some).withColumns(none)
    joined = read.where(some).join(found, "__text", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    return clean.select(*kept, "n_words", *none).unionByName(joined.select(*kept, "n_words", *none))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
n AS (SELECT item, ws, least(10, len(ws)) AS size FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, size, array_to_string(ws[k:k + size - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS k FROM n)),
dw AS (
  SELECT row, k, size, array_to_string(ws[k:k + size - 1], ' ') AS words
  FROM (SELECT row, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM n) WHERE len(ws) >= size)),
m AS (SELECT DISTINCT row, k, size, item FROM dw JOIN iw USING (size, words)),
hit AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(k, k + size)) AS place FROM (SELECT DISTINCT row, k, size FROM m)) GROUP BY row),
held AS (SELECT row, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN held USING (row)
"""
