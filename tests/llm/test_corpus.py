"""SimHash, vectors, WARC, toxicity, LM, mixing and the pipeline: operators that see the whole table."""

import hashlib
import os
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import attention, lm, mixing, simhash, toxicity, vectors, warc
from lodestone.llm.bpe import default_pattern, default_ranks
from lodestone.llm.common import components, local_roots

from .conftest import DOCS, SCHEMA


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    place = {x: i for i, x in enumerate(nodes)}
    real = [p for p in pairs if p[0] != p[1]]
    root = local_roots(len(nodes), np.array([place[a] for a, _ in real]), np.array([place[b] for _, b in real]))
    assert got == {x: nodes[root[i]] for x, i in place.items()}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_position_sets_lose_no_pair(k):
    sets = [set(s) for s in simhash.position_sets(k)]
    assert all(any(s <= set(shared) for s in sets) for shared in combinations(range(8), simhash.MIN_SHARED))


def test_longer_keys_for_more_fingerprints():
    assert [simhash.key_bytes_for(n) for n in (0, 1 << 20, 1 << 25, (1 << 25) + 1, 1 << 33, 25_000_000_000)] == [3, 3, 3, 4, 4, 5]


def test_candidates_are_tallied(spark):
    rng = random.Random(6)
    prints = list({rng.getrandbits(8) * 0x0101010101010101 ^ sum(rng.getrandbits(1) << 8 * i for i in range(8)) for _ in range(300)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = simhash.candidates(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect()
    same = lambda a, b: sum((a ^ b) >> 8 * i & 255 == 0 for i in range(8))
    assert rows and all(r.shared == same(r.a, r.b) for r in rows) and min(r.shared for r in rows) < simhash.MIN_SHARED
    every = {tuple(sorted(map(signed, p))): same(*p) for p in combinations(prints, 2)}
    assert {(r.a, r.b) for r in rows} >= {p for p, s in every.items() if s >= simhash.MIN_SHARED}


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {0, *base} | {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))) for b in base for _ in range(5)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 3}
    for k in (2, 3, 4, 5):
        got = [(r.a, r.b) for r in simhash.links(df, key_bytes=k).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_simhash_edges(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(DOCS)
    prints = {t: plain_print(t) for _, t, *_ in DOCS}
    by_print = {}
    for r in rows:
        by_print.setdefault(r.fp & (1 << 64) - 1, []).append(r)
    assert Counter(prints[t] for _, t, *_ in DOCS) == Counter({p: len(r) for p, r in by_print.items()})
    assert {r.component_id for r in by_print[0]} == {3} and {r.component_id for r in by_print[prints[DOCS[0][1]]]} == {1}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "3", "5", "6", "6", "None", "7", "8"])
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(vectors.hadamard(vectors.hadamard(x)), x)


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)  # so that buckets are split
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    rows, n = [], 0
    for c in centres:
        for _ in range(int(rng.integers(1, 9))):
            rows.append((n, (c + rng.normal(size=32) * rng.choice([0.05, 0.2])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            n += 1
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(30)]
    n += 30
    bad = [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, [None] + [1.0] * 31, 1), (n + 4, rows[0][1], None), (n + 5, [1.0] * 4, 1), (n + 6, [float("inf")] * 32, 0), (n + 7, [], 0)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows + bad], "vec_id long, embedding array<float>, label int, n_links double").repartition(3)
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(bad)
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    root = local_roots(len(x), *np.nonzero(near))
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= near.sum() and found >= 0.99 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.99
    assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] and got[b[0]].kept for b in bad)
    assert vectors.near_vectors(df.where("vec_id < 0")).count() == 0


def test_a_large_group_of_distinct_near_copies(spark, monkeypatch):
    """One label of 5,000 distinct vectors around one: every pair is compared, in several blocks, and none is lost."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=32) + rng.normal(size=(5000, 32)) * 0.2
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(1) - 1
    assert len(got) == 5000 and all(got[i] <= want[i] for i in range(5000)) and sum(got.values()) >= 0.98 * want.sum() > 10_000_000


def test_vectors_that_repeat_an_id(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 32))
    near = lambda x: (x + rng.normal(size=32) * 0.03).astype(np.float32).tolist()
    first = near(a)
    rows = [(1, first), (1, near(a)), (2, near(a)), (3, first), (5, near(b)), (2, near(b)), (9, near(b)), (9, rng.normal(size=32).tolist())]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label long")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    root = local_roots(len(x), *np.nonzero(links))
    component = [min(r[0] for r, k in zip(rows, root, strict=True) if k == root[i]) for i in range(len(rows))]
    want = Counter((r[0], int(links[i].sum()), component[i], r[0] == component[i]) for i, r in enumerate(rows))
    assert Counter(map(tuple, vectors.near_vectors(df).collect())) == want and links.sum() == 18


def test_cosines_at_the_threshold_do_not_depend_on_order():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 64))
    order = rng.permutation(64)
    assert vectors._exact(a, b) == vectors._exact(b, a) == vectors._exact(a[order], b[order])


@pytest.mark.parametrize("dim", [64, 256])
def test_buckets_find_pairs_just_above_the_threshold(dim):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * y
    a, b = vectors.buckets(x), vectors.buckets(y)
    met = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))
    assert met.mean() > 0.98


def test_warc_round_trip_and_lookup(spark):
    big = "<p>é" * 400
    pages = [(1, "http://www.A.example/x?q=1#f", big), (2, "https://b.example:8080/", big), (3, "http://a.example/x?q=1", "small"), (4, "http://c.example/", "small"), (5, None, None), (6, "", big + "y"), (6, "", big + "y"), (None, "http://n.example/  ", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    a = warc.write(df)
    every = df.select(warc.url_keys(F.col("url")).alias("key"))
    rows = a.find(every).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = [p[2] for p in pages if p[0] == r.page_id][0]
        raw = (html or "").encode()
        revisit = html == big and r.page_id != 2  # the null id too
        assert r.payload_digest == hashlib.sha1(raw).hexdigest() and r.payload_bytes == len(raw) and r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (2 if revisit else None) and (revisit or bytes(r.payload) == raw) and r.url == [p[1] for p in pages if p[0] == r.page_id][0]
    assert sorted(r["page_id"] for r in a.lookup("http://a.example/x?q=1")) == [1, 3] and a.lookup("http://zz.example/") == []
    assert warc.write(df.where("page_id > 99")).find(every).count() == 0
    assert [r.page_id for r in a.find(spark.createDataFrame([("example,c)/",), ("zz)/",), ("example,c)/",), (None,)], "key string")).collect()] == [4]
    alone = warc.write(df.where("page_id is null").unionAll(df.where("page_id is null"))).find(every).collect()
    assert [(r.record_type, r.refers_to) for r in alone] == [("response", None)] * 2


def test_warc_reads_neighbours_at_once(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 20)
    rows = [(i, f"http://h{i % 7}.example/{'same' if i % 3 == 0 else i}", f"<p>{i}" * 10) for i in range(400)]
    a = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    places, blocks = [], 0
    for s in a.shards().collect():
        shard = warc.Shard(s.shard, s.offset, s.length)
        blocks += len(shard.blocks)
        keys = sorted({warc.url_key(u) for _, u, _ in rows if s.first <= warc.url_key(u) <= s.last})
        places += [p for k in keys for p in shard.entries(k)]
    reads = []
    real = warc.read_range
    monkeypatch.setattr(warc, "read_range", lambda *x: reads.append(x) or real(*x))
    assert sorted(r["page_id"] for r in warc.read_records(places)) == list(range(400))
    assert blocks >= 20 and len(reads) == len({p[0] for p in places})
    for _, url, _ in rows[:20]:
        assert sorted(r["page_id"] for r in a.lookup(url)) == [i for i, u, _ in rows if u == url]


@pytest.mark.parametrize(("url", "key"), [("http://www.a.b.c/P?q#f", "c,b,a)/p?q"), ("https://u@x.y:443/", "y,x)/"), ("x.y:81", "y,x:81)/"), (None, ")/")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_restoring_words():
    known = ["idiot", "loser", "moron", "hello"]
    n = np.full((toxicity.STATES, toxicity.STATES), 0.01)
    for w in known:
        codes = [toxicity.EDGE, *map(ord, w), toxicity.EDGE]
        for a, b in zip(codes, codes[1:], strict=False):
            n[a, b] += 100
    lm_ = np.log(n / n.sum(1, keepdims=True))
    for seen, word in {"1d10t": "idiot", "l.o.s.e.r": "loser", "m0rooon": "moron", "h3ll0": "hello"}.items():
        assert toxicity.restore(seen, lm_) == word
    assert "idiot" in {w for t in toxicity.tokens("you I d i o t !") for w in toxicity.readings(t, lm_)}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    lm_ = np.log(rng.dirichlet(np.full(toxicity.STATES, 0.05), toxicity.STATES) + 1e-6)
    pick = random.Random(4)

    def paths(token):
        out = [(0.0, "", "")]  # log probability, letters of all words, last letter
        for i, c in enumerate(token):
            again = c.isalpha() and i > 0 and c == token[i - 1]
            drop = toxicity.SEPARATE if c in toxicity.SEPARATORS else toxicity.STRAY if not c.isalpha() else None if not again else toxicity.REPEAT if i > 1 and c == token[i - 2] else toxicity.DOUBLE
            options = [(c, 0.0)] * c.isalpha() + [(x, toxicity.SUBSTITUTE) for x in toxicity.LOOKALIKES.get(c, "")]
            state = lambda last: toxicity._state(last) if last else toxicity.EDGE
            new = [(p + drop, s, last) for p, s, last in out] if drop is not None else []
            new += [(p + lm_[state(last), toxicity.EDGE], s + " ", "") for p, s, last in out if c == " " and last]
            new += [(p + cost + lm_[state(last), toxicity._state(x)], s + x, x) for p, s, last in out for x, cost in options]
            out = new
        return max((p + lm_[toxicity._state(last) if last else toxicity.EDGE, toxicity.EDGE], s) for p, s, last in out)

    for _ in range(150):
        token = "".join(pick.choice("ab0013!. ") for _ in range(pick.randint(1, 6)))
        best, letters = paths(token)
        got = toxicity.viterbi(token, lm_)
        assert got == letters or any(abs(p - best) < 1e-9 for p, s in [paths(token)] if s == got), token
    for _ in range(300):
        token = "".join(pick.choice("abéß") for _ in range(pick.randint(1, 9)))
        assert toxicity.restore(token, lm_) == toxicity.viterbi(token, lm_)


def test_a_long_suspicious_token():
    lm_ = np.log(np.full((toxicity.STATES, toxicity.STATES), 1 / toxicity.STATES))
    assert len(toxicity.restore("a1" * 20_000, lm_)) > 10_000


def letters_of(words):
    n = np.full((toxicity.STATES, toxicity.STATES), 0.01)
    for w in words:
        codes = [toxicity.EDGE, *map(ord, w), toxicity.EDGE]
        for a, b in zip(codes, codes[1:], strict=False):
            n[a, b] += 100
    return np.log(n / n.sum(1, keepdims=True))


def test_doubled_letters_are_restored():
    lm_ = letters_of(["idiot", "loser", "moron", "hello", "llama", "moon"])
    for seen, word in {"mmoorroonn": "moron", "iddiott": "idiot", "llooser": "loser", "iddiott!": "idiot"}.items():
        assert word in toxicity.readings(seen, lm_)
    assert "hello" in toxicity.readings("hello", lm_)
    assert toxicity.readings("moron.", lm_) == {"moron"}


def test_spaced_words_have_boundaries():
    lm_ = letters_of(["idiot", "loser", "moron", "such", "you", "a", "what"])
    for text, word in {"such a m o r o n": "moron", "y o u i d i o t": "idiot", "a m o r o n.": "moron", "a m 0 r o n.": "moron"}.items():
        assert word in {w for t in toxicity.tokens(text) for w in toxicity.readings(t, lm_)}
    # Bigrams that know nothing: the words of the classifier are found all the same.
    model = toxicity.Model(np.log(np.full_like(lm_, 1 / toxicity.STATES)), {"moron$": 6.0, "idiot$": 6.0}, -3.0)
    for text in ("such a m o r o n", "y o u i d i o t", "a m o r o n.", "i a m a m o r o n", "m o r o n !"):
        assert model.score(text) > 0.5, text
    for text in ("m o r e", "a b", "n.", "", "i o n", "a b n."):
        assert model.score(text) < 0.1, text


def test_toxicity_learns_and_edges(spark, docs, none):
    rng = random.Random(1)
    words = "sun moon river stone tree cloud grass bird fish hill".split()
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" you moron" if i % 4 == 0 else "")) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(d, labels)
    test = spark.createDataFrame([("a stone and a m0r0n",), ("m o r o n !",), ("a stone and a bird",), (None,), ("",)], "text string")
    s = [r.s for r in test.select(toxicity.toxicity(spark, F.col("text"), model).alias("s")).collect()]
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.2 and s[3] == s[4] < 0.2
    assert docs.select(toxicity.toxicity(spark, F.col("text"), model)).count() == len(DOCS)
    assert toxicity.fit(docs, labels.where("false")).score("x") < 0.01 and toxicity.fit(none, labels).score("") < 0.01


def test_toxicity_learns_many_and_rare_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    plain, toxic = [word() for _ in range(50)], [word() for _ in range(200)]
    # 200 toxic words, each in 4 of 8,000 texts.
    rows = [(i, " ".join([*rng.choices(plain, k=10), *([toxic[i // 10 % 200]] if i % 10 == 0 else [])]), int(i % 10 == 0)) for i in range(8000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert min(model.score(f"{rng.choice(plain)} {w} {rng.choice(plain)}") for w in toxic) > toxicity.THRESHOLD
    assert max(model.score(f"{w} {v}") for w, v in zip(plain, plain[1:], strict=False)) < toxicity.THRESHOLD


def test_sparse_logistic_meets_its_gradient():
    rng = np.random.default_rng(3)
    x = rng.random((300, 8)) < 0.3
    y, n = (rng.random(300) < 0.2 + 0.6 * x[:, 0]).astype(float), rng.integers(1, 4, 300).astype(float)
    w = toxicity.logistic([tuple(np.flatnonzero(r)) for r in x], 8, y, n)
    x = np.column_stack([x, np.ones(300)])
    gradient = x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + np.append(np.full(8, 0.05), 1e-3) * w
    assert np.abs(gradient).max() < 1e-4


def some_prior(rng):
    return attention.Prior.counted(rng.integers(0, 3, (attention.VOCAB, attention.VOCAB)).astype(float))


def test_gradients():
    rng = np.random.default_rng(4)
    prior = some_prior(rng)
    p = {k: v.astype(np.float64) for k, v in attention.initial().items()}
    stream = rng.integers(0, attention.VOCAB, 60)
    w = attention.Windows(stream, np.array([1, 30]), np.array([29, 25]))
    inputs, before, targets, real = w.take(slice(None))
    loss = lambda q: -float(np.where(real, attention.forward(q, prior, inputs, before, targets)[0], 0).sum() / real.sum())
    g = attention.backward(p, inputs, real, attention.forward(p, prior, inputs, before, targets)[1])
    assert set(g) == set(p)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += 1e-4
        down[k][i] -= 1e-4
        assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(g[k][i], rel=2e-2, abs=1e-5), k


def test_large_logits_stay_finite_and_equal():
    rng = np.random.default_rng(6)
    prior, p = some_prior(rng), attention.initial()
    inputs, before, targets, _ = attention.Windows(rng.integers(0, attention.VOCAB, 60), np.array([1]), np.array([50])).take(slice(None))
    for k in ("u1", "u2", "back"):
        large = {**p, k: p[k] * 1e5}
        lp = attention.forward(large, prior, inputs, before, targets)[0]
        assert np.isfinite(lp).all()
        exact = attention.forward({n: v.astype(np.float64) for n, v in large.items()}, prior, inputs, before, targets)[0]
        assert np.allclose(lp, exact, rtol=1e-2, atol=1e-2)


def test_each_token_is_scored_once_and_from_the_past_only():
    rng = np.random.default_rng(5)
    prior, p = some_prior(rng), attention.initial()
    stream = rng.integers(0, attention.VOCAB, 200)
    sizes = np.array([1, 12, 13, 100])
    starts = np.array([1, 3, 16, 40])
    w = attention.Windows(stream, starts, sizes)
    inputs, before, targets, real = w.take(slice(None))
    assert Counter(w.text[np.nonzero(real)[0]].tolist()) == dict(enumerate(sizes.tolist()))
    first = attention.log10_scores(p, prior, stream, starts, sizes)
    changed = stream.copy()
    changed[139] = (changed[139] + 1) % attention.VOCAB  # the last target of the last text
    again = attention.log10_scores(p, prior, changed, starts, sizes)
    assert np.allclose(first[:3], again[:3])
    every = np.array([attention.forward(p, prior, inputs[:1], before[:1], np.full((1, 12), v))[0][0, 3] for v in range(attention.VOCAB)])
    assert np.exp(every).sum() == pytest.approx(1, rel=1e-4)


def test_lm_base_by_plain_counts_and_edges(docs, none):
    rows = lm.score(docs, F.col("doc_id") != 2).collect()
    assert len(rows) == len(DOCS)
    words = lambda t: (t or "").encode().lower().split()
    n = Counter()
    for i, t, *_ in DOCS:
        if i is not None and i != 2:
            n.update([*words(t), None])
    total, distinct = sum(n.values()), len(n)
    plain = Counter((i, len(words(t)) + 1, sum(n[w] > 0 for w in [*words(t), None]), round(sum(np.log10((n[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*words(t), None]), 4)) for i, t, *_ in DOCS)
    assert plain == Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows)
    assert all(r.train_tokens == total and np.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.score(none, F.lit(True)).count() == 0
    assert lm.score(docs, F.lit(False)).where("n_known = 0 and train_tokens = 0").count() == len(DOCS)


def test_chunks_lay_out_and_count_their_texts():
    s = lm.subwords(default_ranks(), default_pattern())
    texts = ["the cat the dog", None, "", "Ein Hund läuft", "the\u00a0cat\u2003 sat!  it's 2\tthe", "x" * 3000 + " é" * 5]
    learned = [True, True, True, False, True, True]
    chunk, found = lm.Chunk.of(texts, learned, s)
    alone = lambda w: s._encode(" " + w.decode()) if w else [s.end]
    assert np.array_equal(chunk.ids, np.concatenate([alone(w) for w in found])) and chunk.id_sizes.tolist() == [len(alone(w)) for w in found]
    plain = [[i for w in [*lm.words(t), b""] for i in alone(w)] for t in texts]
    identity = np.arange(len(s.tokens))
    stream, starts, sizes = chunk.stream(identity)
    assert [stream[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == plain and (stream[starts - 1] == s.end).all()
    l = chunk.learning()  # noqa: E741
    assert l.counts().tolist() == [sum([*lm.words(t), b""].count(w) for t, y in zip(texts, learned, strict=True) if y) for w in found]
    symbol = identity % attention.VOCAB
    x = l.stream(symbol)[0].astype(np.int64)
    assert np.array_equal(l.pairs(symbol), np.bincount(x[:-1] * attention.VOCAB + x[1:], minlength=attention.VOCAB**2))


def test_words_are_counted_by_lots_and_not_by_rows(spark, tmp_path):
    rng, long = random.Random(8), "é" * lm.LONGEST
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)] + [long, long + "x"], k=rng.randint(0, 80))) for _ in range(400)] + [None, "  ", " a b "]
    rows = [(i, i % 5 > 0, t) for i, t in enumerate(texts)]
    stored = lm.store(spark.createDataFrame(rows, "__id long, learned boolean, text string"), default_ranks(), default_pattern(), f"file://{tmp_path}")
    plain = Counter(w for _, y, t in rows if y for w in [*lm.words(t), b""])
    kept, words = stored.select("chunk", F.explode("lots").alias("x")).select("chunk", "x.*"), {}
    for r in kept.collect():
        ends = np.cumsum(np.frombuffer(r.length, np.int32)).tolist()
        words[r.chunk] = words.get(r.chunk, {}) | {n: r.word[a:b] for n, a, b in zip(np.frombuffer(r.number, np.int32).tolist(), [0, *ends], ends, strict=False)}
    assert kept.count() <= stored.count() ** 2 < sum(map(len, words.values()))
    short = lambda w: w if len(w) <= lm.LONGEST else b" " + hashlib.sha256(w).digest()
    want, got = {short(w): n for w, n in plain.items()}, {}
    counted = kept.groupBy("lot").applyInArrow(lm.count_lot, "chunk long, number binary, c binary, tokens long, words long").collect()
    for r in counted:
        for number, c in zip(np.frombuffer(r.number, np.int32).tolist(), np.frombuffer(r.c, np.int64).tolist(), strict=True):
            assert c == want.get(words[r.chunk][number], 0)
            got[words[r.chunk][number]] = c
    assert {w: c for w, c in got.items() if c} == want
    assert sum(r.tokens for r in counted) == plain.total() and sum(r.words for r in counted) == len(plain)


def test_lm_trains_on_every_text(spark, tmp_path):
    path, pattern = default_ranks(), default_pattern()
    s = lm.subwords(path, pattern)
    # A word of one subword id for each text.
    known = [t[1:] for t in s.tokens if re.fullmatch(rb" [a-z]{4,8}", t) and len(s.encode([t[1:]])[0]) == 1][:60]
    ids = s.encode(known)[0]
    rows = [(i, True, f"{w.decode()} " * 5) for i, w in enumerate(known)]
    stored = lm.store(spark.createDataFrame(rows, "__id long, learned boolean, text string"), path, pattern, f"file://{tmp_path}")
    scale = lm.symbols(stored, s)
    prior = lm.prior(stored, scale)
    before, after = attention.initial(), lm.fit(stored, scale, prior)
    # An embedding moves only where its symbol was read.
    moved = (np.abs(after["emb"] - before["emb"]) > 1e-5).any(1)
    assert moved[scale.symbol[ids]].all()
    assert not moved[attention.VOCAB - 1]


def test_lm_does_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "FEW_BYTES", 50_000)
    learn = F.col("doc_id") != 2
    a = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.score(docs, learn).collect())
    monkeypatch.setattr(lm, "MOST_PARTITIONS", 2)
    assert a == Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm.score(docs.repartition(7), learn).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_lm_is_better_than_word_counts_on_held_out_texts(spark):
    held = lm.op6_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]


def test_mixing_meets_targets(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(DOCS)
    size = {}
    for _, t, _, s, *_ in DOCS:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    assert {s: r[0].source_size for s, r in by.items()} == size
    assert all(abs(sum(r.taken for r in g) - g[0].target) <= 0.5 for g in by.values())
    assert sum(g[0].target for g in by.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(g[0].target <= 2 * size[s] + 1e-9 for s, g in by.items())
    again = Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert again == Counter(map(tuple, rows))
    assert mixing.mix(none).count() == 0


def test_mixing_splits_rows_of_one_id(spark):
    """Half of all rows have no id and one text: they are dealt apart, and the sums are met all the same."""
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, id, null) doc_id", "if(id % 2 = 0, repeat('w ', int(id % 9)), 'a b c') text", "if(id % 3 = 0, 'x', 'y') source")
    mixed = mixing.mix(rows)
    got = mixed.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert sum(r.n for r in got) == 40_000 and all(r.size == r.source_size and abs(r.taken - r.target) <= 0.5 and r.over <= 0 for r in got)
    narrow = rows.select("source", mixing.hash_key(F.col("doc_id"), 10).alias("key"), "doc_id", F.rand(10).alias("salt"))
    parts = [r["count"] for r in narrow.repartitionByRange(16, "source", "key", "doc_id", "salt").groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 16 and max(parts) < 4 * 40_000 / 16


def test_take_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 700)
    rows = spark.range(5_000).selectExpr("if(id % 5 = 0, id, null) doc_id", "if(id % 5 = 0, 'p q', 'a b c') text", "if(id % 5 = 0, 'x', 'y') source", "if(id % 4 = 0, 1, 2) other")
    taken = mixing.take(rows)
    got = taken.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    targets = {r.source: r.target for r in mixing.mix(rows).select("source", "target").distinct().collect()}
    assert taken.columns == rows.columns and {r.source: abs(r.n - targets[r.source]) <= 0.5 for r in got} == {"x": True, "y": True}
    # Columns that differ stay apart, and none comes more often than its rows twice.
    kinds = {(r.source, r.other): r["count"] for r in taken.groupBy("source", "other").count().collect()}
    have = {(r.source, r.other): r["count"] for r in rows.groupBy("source", "other").count().collect()}
    assert all(n <= 2 * have[k] for k, n in kinds.items()) and len(kinds) == 4


def test_take_repeats_and_cuts(docs, none):
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    rows = taken.collect()
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    texts = {}
    for i, t, *_ in DOCS:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        got[r.doc_id] += len(r.text.encode().split())
        assert any(t.startswith(r.text) for t in texts[r.doc_id])
    assert +got == +want and mixing.take(none).count() == 0


def test_water_level(spark):
    rng = random.Random(7)
    for n in (1, 2, 5, 9):
        sizes = [(f"s{i}", rng.randint(0, 1000)) for i in range(n)]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        total, weight = 1.5 * sum(s for _, s in sizes), {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sorted(sizes))}
        target, free = {s: 0.0 for s, _ in sizes}, dict(sizes)
        rest = total
        while free:
            share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 2 * free[s]]
            if not over:
                target.update(share)
                break
            for s in over:
                target[s] = 2.0 * free.pop(s)
                rest -= target[s]
        assert got == pytest.approx(target)


def test_pipeline_on_edge_rows(spark, docs, tmp_path):
    import corpus_pipeline as P

    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    stage, seen = docs, []
    for name, f in P.STAGES:
        stage = f(spark, stage, d)
        stage.write.parquet(f"{d}/{name}")
        stage = spark.read.parquet(f"{d}/{name}")
        seen.append(name)
        if name != "bpe":
            assert stage.columns == docs.columns
    assert len(seen) == 5 and stage.where("not decoded_ok").count() == 0
    assert Counter(map(str, P.run(spark, d).select("doc_id", "n_tokens").collect())) == Counter(map(str, stage.select("doc_id", "n_tokens").collect()))
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, empty).count() == 0


def test_words_of_any_alphabet_are_encoded_together_as_they_are_alone(monkeypatch):
    s = lm.subwords(default_ranks(), default_pattern())
    found = [w.encode() for w in ["", "plain", "élève", "été,", "日本語", "ß's", "a b", " x", "y　", " ", "naïve!?", "x\x1cy", "end"]] + [b"\xff\xfe", b"cut\xc3"]
    alone = [[s.end] if not w else s._encode(" " + w.decode("utf-8", "replace")) for w in found]
    calls, real = [], s._encode
    monkeypatch.setattr(s, "_encode", lambda t: calls.append(t) or real(t))
    ids, sizes = s.encode(found)
    assert sizes.tolist() == [len(x) for x in alone] and ids.tolist() == [i for x in alone for i in x]
    # Together, but for those with white space of other alphabets and what is no text.
    assert len(calls) == 1 + 6
    chunk, words = lm.Chunk.of(["été THE été", None, "the\tx"], [True] * 3, s)
    assert words == [b"", "été".encode(), b"the", b"x"] and chunk.numbers.tolist() == [1, 2, 1, 2, 3] and chunk.sizes.tolist() == [3, 0, 2]
