"""Exact ranks and lexical top-k against plain sorts."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import lexical, ranks
from lodestone.operators.tools import percentiles


def test_bits_have_the_order_of_numbers(spark):
    values = [-math.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e18, math.inf, math.nan]
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", ranks.ordered_bits(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got) and got[4] == got[5] and len(set(got)) == len(values) - 1
    assert spark.createDataFrame([(None,)], "v double").select(ranks.ordered_bits(F.col("v"))).first()[0] is None


def groups():
    rng = random.Random(5)
    out = [("same", 7.25)] * 400 + [("mixed", rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), -0.0, 0.0, 1e-300 * rng.random()])) for _ in range(3000)]
    return out + [(None, float(i)) for i in range(31)] + [("one", 4.0)] + [("none", None)] + [("close", 1 + i * 2.0**-52) for i in range(500)]


def test_percentiles_equal_sorts_whatever_is_told_apart_at_once(spark, monkeypatch):
    """One group holds most rows; with a small bound every pass refines."""
    rows = spark.createDataFrame(groups(), "k string, v double").repartition(5)
    want = {}
    for k in {k for k, _ in groups()}:
        vs = sorted(v for g, v in groups() if g == k and v is not None)
        if vs:
            want[k] = (*[vs[-(-q * len(vs) // 100) - 1] for q in (50, 95, 99)], float(np.median(vs)))
    for few in (100_000, 3):
        monkeypatch.setattr(ranks.select, "__defaults__", (few,))
        got = {r.k: (r.p50, r.p95, r.p99, r["median"]) for r in percentiles(rows, ["k"], "v").collect()}
        assert got == want
    longs = spark.range(1001).selectExpr("id * 4611686018427387 - 2305843009213693952 v", "1 k")
    assert percentiles(longs, ["k"], "v").first().p50 == 500 * 4611686018427387 - 2305843009213693952


def test_the_best_by_shared_terms_without_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, sorted({f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.randint(0, 40))})) for i in range(800)]
    asked = [(q, sorted({f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.randint(0, 25))})) for q in range(30)] + [(90, []), (91, ["nowhere"]), (92, ["w1"])]
    want = {}
    for q, terms in asked:
        counts = sorted(((-len(set(terms) & set(t)), d) for d, t in docs if set(terms) & set(t)))[:5]
        want |= {(q, rank): (d, -n) for rank, (n, d) in enumerate(counts, 1)}
    formed = []
    real = lexical._pairs
    monkeypatch.setattr(lexical, "_pairs", lambda p, t: formed.append(real(p, t)) or formed[-1])
    found = lexical.best_covering(spark.createDataFrame(docs, "doc long, terms array<string>"), spark.createDataFrame(asked, "query_id long, terms array<string>"), 5)
    assert {(r.query_id, r["rank"]): (r.doc, r.shared) for r in found.collect()} == want
    every = sum(bool(set(a) & set(t)) for _, a in asked for _, t in docs)
    assert formed[1].count() < 0.5 * every, (formed[1].count(), every)


def test_postings_are_cut_from_the_texts_once(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import lexical

    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def terms(text):
        cuts.add(1)
        return text.split(" ")

    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(40)], "doc long, text string").select("doc", terms("text").alias("terms"))
    asked = spark.createDataFrame([(1, ["a", "b1", "c4"])], "query_id long, terms array<string>")
    found = lexical.best_covering(docs, asked, 2).collect()
    assert [(r.doc, r.shared) for r in sorted(found, key=lambda r: r.rank)] == [(4, 3), (1, 2)]
    # For the postings (which the checkpoint computes twice at most), and to complete the two rounds of pairs.
    assert cuts.value <= 4 * 40
