"""Periodic runs of words by a suffix automaton with small-to-large merging of ordered end positions.

A run is a stretch of words with smallest period q that neither neighbour extends, of MIN_PERIODS
periods and MIN_LENGTH words at least. Each state of the automaton stands for strings that end at the same
positions. Bottom-up over the suffix links, the smaller of two ordered sets of end positions is put into
the larger; two positions that so become neighbours in a state, at a distance not above its length, seed a
square, and a square is extended to its run.

Within a run of such a length every GRAM words come twice at least, so only stretches of words whose grams
all come twice in the document are given to an automaton: each run, with the words beside it that end it, lies
in one of them. Memory is some 1 kB per word of the longest such stretch of one text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import release, table

MIN_LENGTH, MIN_PERIODS = 24, 3
#: q words further on, a run of L words goes on as at its start for L - q words: never for fewer than this.
MIN_SHARED = -(-MIN_LENGTH * (MIN_PERIODS - 1) // MIN_PERIODS)
#: Grams of so many words: of 2 q + GRAM - 1 words with period q, each gram comes twice.
GRAM = MIN_LENGTH - 2 * MIN_LENGTH // MIN_PERIODS + 1
#: Bytes of texts whose grams are compared at once; a longer text is by itself.
SLAB = 4 << 20
RUNS = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, state of each prefix) of the suffix automaton of `words`; state 0 is the empty string."""
    step, length, link, at = [{}], [0], [-1], []
    last = 0
    for i, c in enumerate(words, 1):
        new = len(length)
        step.append({})
        length.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                clone = len(length)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                q = clone
            link[new] = q
        at.append(new)
        last = new
    return length, link, at


def squares(words: list[int], shortest: int = 1) -> Iterator[tuple[int, int]]:
    """(end, d): words end - d + 1 .. end equal the d words after them.

    From states of length `shortest` or more: each run whose words, but for one period, are as many, has a seed.
    """
    length, link, at = automaton(words)
    ends: list[list[int] | None] = [None] * len(length)
    for i, s in enumerate(at):
        ends[s] = [i]
    for v in sorted((v for v in range(1, len(length)) if length[link[v]] >= shortest), key=length.__getitem__, reverse=True):
        parent, small = link[v], ends[v]
        large, most = ends[parent], length[parent]
        ends[v] = None
        if large is None:
            ends[parent] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        for e in small:
            k = bisect_left(large, e)
            if k and e - large[k - 1] <= most:
                yield large[k - 1], e - large[k - 1]
            if k < len(large) and large[k] - e <= most:
                yield e, large[k] - e
            large.insert(k, e)
        ends[parent] = large


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many words from their start two sequences have in common."""
    n, done, width = min(len(a), len(b)), 0, 32
    while done < n:
        differ = a[done : min(n, done + width)] != b[done : min(n, done + width)]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, width = done + len(differ), width * 4
    return n


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start and period."""
    known: dict[int, tuple[list[int], list[int]]] = {}
    period: dict[tuple[int, int], int] = {}
    for end, d in squares(words.tolist(), MIN_SHARED):
        starts, stops = known.setdefault(d, ([], []))
        k = bisect_right(starts, end - d + 1) - 1
        if k >= 0 and stops[k] >= end + d + 1:
            continue  # within a run that is known
        cut = end + 1
        start = cut - d - reach(words[: cut - d][::-1], words[:cut][::-1])
        stop = cut + d + reach(words[cut + d :], words[cut:])
        starts.insert(k + 1, start)
        stops.insert(k + 1, stop)
        # A multiple of a run's period seeds the same stretch: the smallest is its period.
        period[start, stop] = min(d, period.get((start, stop), d))
    return sorted((a, b - a, q) for (a, b), q in period.items() if b - a >= max(MIN_LENGTH, MIN_PERIODS * q))


def stretches(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, start, stop) of the stretches, in words of `codes`, in which each gram comes twice in its text; the texts have `sizes` words, one after the other. A chance equality of hashes only adds a stretch."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams = np.zeros(n, np.uint64)
    for j in range(GRAM):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    grams ^= grams >> np.uint64(32)
    grams += owner[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    inside = owner[:n] == owner[GRAM - 1 :]
    ordered = np.sort(grams[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return
    hit = inside & (twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
    # Where one text ends grams are not inside, so that no stretch goes over it.
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a + GRAM - 1 >= MIN_LENGTH:
            yield int(owner[a]), a, b + GRAM - 1


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each sequence of words."""
    number: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, a, b in stretches(codes, sizes):
        found[k] += [(s + a - int(begins[k]), n, q) for s, n, q in runs_of(codes[a:b])]
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those that any run holds after its first period."""
    if runs:
        drop = np.zeros(len(words), bool)
        for start, n, q in runs:
            drop[start + q : start + n] = True
        words = [words[i] for i in np.flatnonzero(~drop).tolist()]
    return b" ".join(words)


def slabs(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts as UTF-8, null as empty, in lists of about SLAB bytes."""
    out, size = [], 0
    for t in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()):
        out.append(t.as_py() or b"")
        size += len(out[-1])
        if size >= SLAB:
            yield out
            out, size = [], 0
    yield out


def periodic_runs(text: Column) -> Column:
    """struct(n_words, runs by start and period, collapsed): the runs of words of a text, and its words without their repeats.

    Null and empty texts have no words, no runs and collapse to the empty text. Depends on the text alone, so that
    repeated rows have equal values.
    """

    @arrow_udf(RUNS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
        for batch in batches:
            rows = []
            for slab in slabs(batch):
                words = [t.split() for t in slab]
                rows += [
                    {"n_words": len(w), "runs": [{"start": s, "length": n, "period": q} for s, n, q in r], "collapsed": collapse(w, r).decode("utf-8", "replace")}
                    for w, r in zip(words, find_runs(words), strict=True)
                ]
            yield pa.array(rows, kind)
        release()

    return run(text)


def longest(runs: Column) -> Column:
    """Of runs by start and period the first of those with the most periods, compared exactly; null if there are none."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_tail(text: Column, crc: Column) -> Column:
    """The words of a text, joined by spaces; where the remainder of `crc` by 10 is 0, its words from a drawn place on repeat with a drawn period. Null for a null text; a null `crc` repeats nothing."""

    @arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, draws in batches:
            out = []
            for t, h in zip(texts.cast(pa.binary()), draws.to_pylist(), strict=True):
                words = (t.as_py() or b"").split() if h is not None and h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    out.append(b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]))
                else:
                    out.append(t.as_py())
            yield pa.array(out, pa.binary()).cast(pa.string())

    return run(text, crc)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_tail(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))
    found = docs.select("doc_id", periodic_runs(F.col("text")).alias("r")).select("doc_id", F.col("r.runs").alias("runs"), longest(F.col("r.runs")).alias("top"), F.col("r.collapsed").alias("collapsed"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
