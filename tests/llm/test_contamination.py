"""Decontamination against a plain search for every window, and the winnowing's guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import contamination as C

from .conftest import DOCS, SCHEMA


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    """(words, words hit, ids) of each text, by every window of every item at every place."""
    windows = {}
    for item, text in items:
        ws = plain_words(text)
        for k in range(max(1, len(ws) - 9)) if ws else ():
            windows.setdefault(tuple(ws[k : k + 10]), set()).add("" if item is None else str(item))
    out, sizes = [], {len(w) for w in windows}
    for text in docs:
        ws, hit, ids = plain_words(text), set(), set()
        for m in sizes:
            for k in range(len(ws) - m + 1):
                found = windows.get(tuple(ws[k : k + m]))
                if found:
                    hit.update(range(k, k + m))
                    ids |= found
        out.append((len(ws), len(hit), tuple(sorted(ids))))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 10))
def test_every_shared_window_has_a_fingerprint_at_the_same_place(a, b, window):
    """Of each window of words that two texts share, a gram at the same place in it is kept of both."""
    kept = []
    for words in (a, b):
        hashes = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11)
        at, fp = C.winnow(hashes, np.array([len(words)]), window)
        kept.append(dict(zip(at.tolist(), fp.tolist(), strict=True)))
    for i in range(len(a) - window + 1):
        for j in range(len(b) - window + 1):
            if a[i : i + window] == b[j : j + window]:
                assert any(i + o in kept[0] and kept[0][i + o] == kept[1].get(j + o) for o in range(window - C.gram_of(window) + 1))


def test_texts_of_one_slab_do_not_meet():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 3, 25, 10, 9, 40, 0])
    hashes = rng.integers(0, 2**63, int(sizes.sum()), dtype=np.uint64)
    at, fp = C.winnow(hashes, sizes, 10)
    want, start = [], 0
    for n in sizes:
        one, prints = C.winnow(hashes[start : start + n], np.array([n]), 10)
        want += [(start + p, f) for p, f in zip(one.tolist(), prints.tolist(), strict=True)]
        start += n
    assert list(zip(at.tolist(), fp.tolist(), strict=True)) == want and len(want) > 5


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "Éa", "x1", "ÜBER", "the"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=n))
    long = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(10, 60))) for _ in range(20)]
    items = [(i, t) for i, t in enumerate(long)] + [(100, long[0]), (100, long[1]), (None, long[2]), (None, "q r s t"), (7, None), (8, ""), (9, "...!"), (50, "The"), (51, "h A É"), (52, text(7)), (53, text(9)), (54, text(6))]
    docs = []
    for _ in range(120):
        words = [f"n{rng.randrange(400)}" for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            source = plain_words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(source) - 5))
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.3 and w.isascii() else w for w in source[a : a + rng.randint(3, 30)]]
        docs.append(rng.choice([" ", ", ", "\n"]).join(words))
    return docs + docs[:15], items


def result(spark, docs, items):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, n_hit long").repartition(3)
    out = C.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "n_words", "n_hit", "items"]
    return {r.doc_id: (r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_equal_all_windows_at_all_places(spark, seed):
    docs, items = fixture(seed)
    docs += [None, "", "word", "the the the", "x " * 5000 + " ".join(["q r s t"] * 3)]
    got, want = result(spark, docs, items), plain(docs, items)
    assert got == dict(enumerate(want)) and sum(n > 0 for _, n, _ in want) > 50


def test_only_long_windows(spark):
    docs, items = fixture(3)
    items = [x for x in items if len(plain_words(x[1])) >= 10]
    assert result(spark, docs, items) == dict(enumerate(plain(docs, items)))


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """Fingerprints that pass by chance go at the join."""
    docs, items = fixture(4)
    monkeypatch.setattr(C, "bitmap", lambda prints: b"\xff" * (C.FILTER_BITS // 8))
    assert result(spark, docs, items) == dict(enumerate(plain(docs, items)))


def test_the_bitmap_is_that_of_the_fingerprints(spark):
    prints = [0, 1, -1, 12345, -(2**63), 2**40 + 77]
    bits = np.unpackbits(np.frombuffer(C.bitmap(spark.createDataFrame([(p,) for p in prints], "fp long")), np.uint8), bitorder="little")
    assert set(np.flatnonzero(bits).tolist()) == {p % C.FILTER_BITS for p in prints}


def test_edges_and_empty_tables(spark, docs, none):
    items = spark.createDataFrame([(1, "the cat sat on the mat today"), (2, "cat")], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in C.decontaminate(docs, items).collect())
    want = plain([t for _, t, *_ in DOCS], [(1, "the cat sat on the mat today"), (2, "cat")])
    assert got == Counter((r[0], *w) for r, w in zip(DOCS, want, strict=True)) and got[1, 7, 7, ("1", "2")]
    assert C.decontaminate(none, items).count() == 0
    for empty in (items.where("false"), items.withColumn("text", F.lit(None).cast("string"))):
        assert {(r.n_hit, tuple(r["items"])) for r in C.decontaminate(docs, empty).collect()} == {(0, ())}
    assert len(SCHEMA.split(",")) == len(DOCS[0])
