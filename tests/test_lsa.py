"""A latent semantic model brought up to date against one fitted anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import features
from lodestone.operators.features import LsaModel, fit_lsa, turned, update_lsa
from lodestone.plans import registry

TOPICS = ["river stream water flood bridge bank", "engine wheel motor gear brake road", "bread flour oven yeast butter salt", "court judge law trial witness verdict"]


def corpus(seed, n, topics=TOPICS):
    rng = random.Random(seed)
    return [(seed * 10_000 + i, " ".join(rng.choices(topics[i % len(topics)].split(), k=25) + rng.choices("note page item common usual".split(), k=8))) for i in range(n)]


def cosines(a, b, df):
    """Of each document the cosine of its vectors in both spaces, a's laid upon b's."""
    rows = df.select(a.transform(F.col("text")).alias("a"), b.transform(F.col("text")).alias("b")).collect()
    x, y = (np.array([r[k] for r in rows], np.float64) for k in ("a", "b"))
    return (x @ turned(a, b) * y).sum(1)


def test_an_update_comes_near_a_fit_of_all(spark):
    kind = "doc long, text string"
    old, new = corpus(1, 120), corpus(2, 60, [*TOPICS[:2], "planet star orbit moon comet rocket"])
    df = lambda rows: spark.createDataFrame(rows, kind)
    first, full = fit_lsa(df(old), 6, False), fit_lsa(df(old + new), 6, False)
    up = update_lsa(first, df(new))
    assert up.state.n == 180 and set(up.terms) == set(full.terms) and "planet" in up.terms and "planet" not in first.terms
    assert np.allclose(sorted(up.idf), sorted(full.idf), atol=1e-5)
    near = cosines(up, full, df(old + new))
    assert near.mean() > 0.99 and near.min() > 0.9
    # In parts, and with what was saved.
    parts = update_lsa(LsaModel.from_json(update_lsa(first, df(new[:30])).to_json()), df(new[30:]))
    assert cosines(parts, full, df(old + new)).mean() > 0.98


def test_edges(spark):
    df = spark.createDataFrame(corpus(3, 12), "doc long, text string")
    model = fit_lsa(df, 3, False)
    assert update_lsa(model, df.limit(0)) is model
    model.state = None
    with pytest.raises(ValueError):
        update_lsa(model, df)


def test_few_passes_find_the_largest_eigenvectors():
    rng = np.random.default_rng(3)
    basis, want = np.linalg.qr(rng.normal(size=(300, 300)))[0], 0.97 ** np.arange(300)
    matrix, passes = basis * want @ basis.T, []
    values, vectors = features._largest(lambda q: passes.append(1) or matrix @ q, 300, 8)
    assert np.allclose(np.sort(values)[::-1][:8], want[:8], rtol=1e-8) and len(passes) < 15
    assert np.allclose(np.abs(vectors[:, np.argsort(values)[::-1][:8]].T @ basis[:, :8]), np.eye(8), atol=1e-3)
    # A space that is used up, and one of fewer dimensions than a block.
    for few in (5, 30):
        values, _ = features._largest(lambda q: basis[:, :few] @ (want[:few, None] * (basis[:, :few].T @ q)), 300, 4)  # noqa: B023
        assert np.allclose(np.sort(values)[::-1][:4], want[:4])


def test_bags_that_are_stored_give_the_fit_of_their_texts(spark):
    texts = [(None, ""), (1, None), (2, "a lonely word")] + corpus(4, 60)
    df = spark.createDataFrame(texts, "doc long, text string").withColumn("part", (F.col("doc") % 3).cast("int"))
    bags = features.stored_bags(df)
    for rows, stored in ((df, bags), (df.where("part = 0"), bags.where("part = 0")), (df.where("part is null"), bags.where("part is null"))):
        assert features.document_frequencies(rows).exceptAll(features.document_frequencies(stored)).isEmpty()
    a, b = fit_lsa(df, 6, False), fit_lsa(bags, 6, False)
    assert a.terms == b.terms and np.array_equal(a.idf, b.idf) and np.allclose(a.state.values[:6], b.state.values[:6])
    got = features.cosines(bags, b, a).collect()
    assert len(got) == len(texts) and sum(r.known for r in got) == 60 and all(r.cosine > 0.999 for r in got if r.known)


def test_the_update_query_cuts_its_texts_once(spark, monkeypatch):
    cuts, real = [], features.cut_words
    monkeypatch.setattr(features, "cut_words", lambda text: cuts.append(1) or real(text))
    assert [tuple(r) for r in registry.QUERIES["lsa_update"](spark, "/root/testdata/sf0.001").collect()] == [(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count(), True)]
    assert len(cuts) == 1
