"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import registry, runs

from .conftest import DOCS, SCHEMA


def plain_runs(words):
    """For each period the stretches whose words equal those a period on, kept where no smaller period has the same stretch."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                best.setdefault((start, i + q), q)
    return sorted((a, b - a, q) for (a, b), q in best.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 30)), max_size=6))
def test_runs_equal_all_periods(parts):
    words = [w.encode() for part, times in parts for w in part * times][:250]
    assert runs.find_runs([words])[0] == plain_runs(words)


def test_states_of_all_lengths_seed_every_square():
    """Without the shortest length: each square whose period is not a multiple of a smaller one is within a run of a seed."""
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.randrange(2) for _ in range(40)]
        seeds = set(runs.squares(words))
        for end, d in seeds:
            assert words[end - d + 1 : end + 1] == words[end + 1 : end + d + 1]
        for d in range(1, 20):
            for s in range(40 - 2 * d + 1):
                if words[s : s + d] == words[s + d : s + 2 * d]:
                    # Of this period or of a part of it, within the same stretch of that period.
                    assert any(d % q == 0 and all(words[i] == words[i + q] for i in range(min(s, e - q + 1), max(s + 2 * d, e + q + 1) - q)) for e, q in seeds)


def test_the_states_and_suffix_links():
    length, link, at = runs.automaton([0, 1, 0, 0, 1])
    assert len(at) == 5 and all(length[link[v]] < length[v] for v in range(1, len(length)))
    # As many substrings as the states' lengths say.
    assert sum(length[v] - length[link[v]] for v in range(1, len(length))) == len({(0, 1, 0, 0, 1)[i:j] for i in range(5) for j in range(i + 1, 6)})


def test_long_texts_and_texts_in_one_slab_do_not_meet():
    rng = random.Random(5)
    noise = [f"w{rng.randrange(10**6)}".encode() for _ in range(60_000)]
    period = [f"p{i}".encode() for i in range(700)]
    one, two, flat = noise[:20_000] + period * 5 + noise[20_000:], noise[:50], [b"x"] * 30_000
    found = runs.find_runs([one, two, flat, [], two, two])
    assert found == [[(20_000, 3500, 700)], [], [(0, 30_000, 1)], [], [], []]
    assert runs.collapse(one, found[0]) == b" ".join(noise[:20_000] + period + noise[20_000:])


def test_grams_that_never_come_twice_leave_nothing_to_an_automaton(monkeypatch):
    monkeypatch.setattr(runs, "runs_of", lambda words: pytest.fail("not needed"))
    assert runs.find_runs([[f"{i}".encode() for i in range(5000)]]) == [[]]


def planted(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op11(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 30)) * rng.randint(1, 9)) for _ in range(300)]
    rows = [*DOCS, *((100 + i, t, "en", "a", "x", 0.5) for i, t in enumerate(texts)), (None, "a b " * 20, "en", "a", "x", 0.5)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t, *_ in rows:
        words = planted(i, t)
        # Long texts have long runs of one word, which the plain search finds too.
        found = plain_runs(words) if len(words) < 1000 else runs.find_runs([words])[0]
        top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        drop = {j for s, n, q in found for j in range(s + q, s + n)}
        digest = lambda x: hashlib.sha256(x).hexdigest()
        milli = None if top[0] is None else 1000 * top[1] // top[2]
        want[i, len(found), *top, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), digest(b" ".join(w for j, w in enumerate(words) if j not in drop))] += 1
    got = registry.QUERIES["op11_runs"](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == want and sum(r[1] for r in want) > 100
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_an_empty_table(spark, none):
    assert none.select(runs.periodic_runs(none.text)).count() == 0


def test_the_longest_run_is_the_first_of_equals(spark):
    rows = [([(0, 30, 10), (40, 24, 8), (70, 33, 11)],), ([(0, 30, 10), (40, 25, 8)],), ([],)]
    df = spark.createDataFrame(rows, "r array<struct<start: long, length: long, period: long>>")
    assert [r.top and tuple(r.top) for r in df.select(runs.longest(df.r).alias("top")).collect()] == [(0, 30, 10), (40, 25, 8), None]


def test_numbers_reach():
    a = np.arange(1000)
    assert runs.reach(a, a) == 1000 and runs.reach(a, np.where(a == 777, 0, a)) == 777 and runs.reach(a[:0], a) == 0
