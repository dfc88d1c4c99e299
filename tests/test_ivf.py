"""The inverted file against the full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators.ivf import VectorIndex, fit_centers


def clustered(seed=3, n=3000, dim=16, groups=40):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)
    x[:5] = 0
    x[100:140] = x[100]  # ties
    return x


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered())], "id long, vector array<float>").repartition(3).persist()


def hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


def asked(data):
    return data.where("id % 60 = 0 or id = 100").select(F.col("id").alias("query_id"), "vector")


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    return VectorIndex.build(data, f"file://{tmp_path_factory.mktemp('ivf')}/x", cells=40)


def test_exact_equals_the_scan_and_reads_a_part(data, index):
    q = asked(data)
    assert hits(index.search(q, 7)) == hits(R.knn(data, q, 7))
    # A zero query has equal scores everywhere, so its cells are all; of the pairs few are scored.
    assert index.last["of_cells"] >= 40 and index.last["pairs_share"] < 0.2, index.last
    few = q.where("query_id in (60, 120, 180)")
    assert hits(index.search(few, 7)) == hits(R.knn(data, few, 7)) and index.last["rows_share"] < 0.3, index.last
    assert hits(index.search(few, 5, min_score=0.99)) == hits(R.knn(data, few, 5, 0.99))


def test_exact_where_nothing_can_be_pruned(spark, tmp_path):
    """Vectors without any structure: everything is read, and right."""
    x = np.random.default_rng(1).normal(size=(500, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    q = df.where("id < 10").select(F.col("id").alias("query_id"), "vector")
    assert hits(VectorIndex.build(df, f"file://{tmp_path}/i").search(q, 600)) == hits(R.knn(df, q, 600))


def test_a_few_cells_find_most(data, index):
    q = asked(data)
    want = {(i, j) for i, j, *_ in hits(R.knn(data, q, 10)) if i}
    got = {(i, j) for i, j, *_ in hits(index.search(q, 10, probes=4)) if i}
    assert len(want & got) >= 0.9 * len(want) and index.last["pairs_share"] < 0.2


def test_added_vectors_are_found(spark, data, index):
    q = asked(data).where("query_id = 180")
    new = data.where("id in (180, 300)").select((F.col("id") + 10_000).alias("id"), "vector")
    index.add(new)
    best = [r[1] for r in hits(index.search(q, 2))]
    assert best == [180, 10_180]


def test_cells_are_pruned_in_the_scan(index, data):
    plan = index.search(asked(data).where("query_id = 60"), 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan or "PartitionFilters: [(cell" in plan


def test_edges(spark, tmp_path):
    one = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert hits(VectorIndex.build(one, f"file://{tmp_path}/zero").search(q, 5)) == [(1, 1, 0.0, 1), (1, 2, 0.0, 2)]
    x = VectorIndex.build(one, f"file://{tmp_path}/again")
    assert x.search(q.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        x.search(q, 0)
    assert len(fit_centers(one.limit(0), 4)) == 0
