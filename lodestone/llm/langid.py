"""Language identification by n-gram filters that answer for all languages at once.

Character n-grams of the training texts are counted by language. Each language's frequent n-grams
go into its Bloom filter; the filters are bit-sliced, so that slot `i` of all of them is one row of
bits, and the conjunction of an n-gram's slots is the mask of the languages that contain it. A
text's n-grams are counted per language by their bits, the counts are corrected for the filters'
false positives, and the largest decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fold, map_arrow, small_pieces, table

#: A language's n-grams of at least this share of its own are its profile: at most 1 / MIN_RATE of them.
MIN_RATE = 2e-5
#: An n-gram is left out of a language where it is this many times rarer than where it is most frequent.
RATIO = 5.0
HASHES = 3
SLOTS_PER_NGRAM = 16
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTER


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all 4-grams of letters, words padded by one boundary on either side; the text of each; and how many letters each text has.

    Words of one letter have no 4-gram: the boundary, the letter, the boundary.
    """
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    # A lone surrogate can't be in UTF-8 columns; "surrogatepass" only spares a crash.
    code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner[is_letter], minlength=len(texts))
    code = np.where(is_letter, code, 0).astype(np.uint64)
    if len(code) < 4:
        return np.array([], np.uint64), np.array([], np.int64), counts
    a, b, c, d = code[:-3], code[1:-2], code[2:-1], code[3:]
    keep = np.flatnonzero(is_letter[1:-2] & is_letter[2:-1])
    h = ((a[keep] << np.uint64(42)) ^ (b[keep] << np.uint64(21)) ^ c[keep]) * np.uint64(0x9E3779B97F4A7C15) + d[keep]
    return mix64(h), owner[keep + 1], counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: how often each language has each n-gram."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(keys, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64))]

    for batch in batches:
        for piece in small_pieces(batch, "text"):
            langs = np.array(piece.column("lang").to_pylist(), object)
            h, owner, _ = ngrams(piece.column("text").to_pylist())
            for lang in set(langs):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(h[(langs == lang)[owner]], return_counts=True))
                if len(parts) > 8:
                    held[lang] = packed(parts)
    for lang, parts in held.items():
        keys, n = packed(parts)[0]
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000].view(np.int64)
            yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[i : i + 50_000])], names=["lang", "ngram", "n"])


@dataclass
class Filters:
    """`bits[slot]` holds a bit for each of `langs`; `false_rate` is the chance that a language without an n-gram seems to have it."""

    langs: list[str]
    bits: np.ndarray
    false_rate: np.ndarray
    fallback: str

    @classmethod
    def build(cls, langs: list[str], grams: dict[str, np.ndarray], fallback: str) -> Filters:
        size = 1 << max(10, int(SLOTS_PER_NGRAM * max([1, *map(len, grams.values())]) - 1).bit_length())
        bits = np.zeros((size, (len(langs) + 7) // 8), np.uint8)
        rate = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            for seed in range(HASHES):
                bits[(mix64(grams[lang], seed + 1) & np.uint64(size - 1)).astype(np.int64), i // 8] |= np.uint8(128 >> i % 8)
            rate[i] = ((bits[:, i // 8] & (128 >> i % 8)) > 0).mean() ** HASHES
        return cls(langs, bits, rate, fallback)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of the languages that contain it."""
        m = self.bits[(mix64(h, 1) & np.uint64(len(self.bits) - 1)).astype(np.int64)]
        for seed in range(1, HASHES):
            m = m & self.bits[(mix64(h, seed + 1) & np.uint64(len(self.bits) - 1)).astype(np.int64)]
        return m

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        h, owner, n_letters = ngrams(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        m, hits = self.masks(h), np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            hits[:, i] = np.bincount(owner[(m[:, i // 8] & (128 >> i % 8)) > 0], minlength=len(texts))
        true = np.maximum(0, hits - n[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999))
        langs, scores = [], np.zeros(len(texts))
        for j, total in enumerate(true.sum(1)):
            if not n_letters[j] or not self.langs:
                langs.append(UNKNOWN)
            elif total <= 0:
                langs.append(self.fallback)
            else:
                i = int(true[j].argmax())
                langs.append(self.langs[i])
                scores[j] = min(1.0, true[j, i] / total)
        return langs, scores


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from all the rows; rows of null text or language teach nothing.

    The driver receives each language's number of n-grams and its profile, at most 1 / MIN_RATE rows.
    """
    counts = map_arrow(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), _count, "lang string, ngram long, n long")
    counts = counts.groupBy("lang", "ngram").agg(F.sum("n").alias("n")).persist()
    try:
        totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, max(2.0, MIN_RATE * n))]) if totals else None
        profile = counts.where(F.col("n") >= F.element_at(least, F.col("lang"))).toPandas() if totals else None
    finally:
        counts.unpersist()
    langs = sorted(totals)
    if not langs:
        return Filters.build([], {}, UNKNOWN)
    profile["rate"] = profile.n / profile.lang.map(totals)
    profile = profile[profile.rate * RATIO >= profile.groupby("ngram").rate.transform("max")]
    grams = {lang: profile.ngram[profile.lang == lang].to_numpy(np.int64).view(np.uint64) for lang in langs}
    return Filters.build(langs, grams, max(langs, key=lambda x: (totals[x], x)))


def identify(spark: SparkSession, text: Column, filters: Filters) -> Column:
    """A struct of the language and its share of the corrected counts.

    `und` with score 0 for null texts and texts without a letter (or where nothing was learned);
    texts whose n-grams no language has get the most frequent training language with score 0.
    """
    shared = spark.sparkContext.broadcast(filters)  # bounded by the profiles

    @arrow_udf("lang string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = [], []
            for piece in small_pieces(pa.record_batch([texts], names=["text"]), "text"):
                got = shared.value.predict(piece.column(0).to_pylist())
                langs += got[0]
                scores += got[1].tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return run(text)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents of four folds; a null id is held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)))
    filters = fit(docs.where("not held_out"))
    return docs.select("doc_id", "held_out", identify(spark, F.col("text"), filters).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
