"""The registered queries that SQL can express, against it, on the smallest tables and on planted vectors."""

import os

import duckdb
import numpy as np
import pytest

from lodestone.llm import registry

SF = "/root/testdata/sf0.001"


def same(spark, name, folder, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet{'' if os.path.isfile(f'{folder}/{t}.parquet') else '/*.parquet'}'")
    df = registry.QUERIES[name](spark, folder)
    want = c.sql(registry.SQL[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    a, b = (sorted(map(str, (tuple(dict(zip(cols, r, strict=True))[k] for k in order) for r in rows))) for cols, rows in ((df.columns, map(tuple, df.collect())), (want.columns, want.fetchall())))
    assert a == b and a


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    same(spark, name, SF, ["documents", "embeddings", "pages", "benchmark"])


def test_planted_vectors_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, (c + rng.normal(size=64) * 0.03).astype(np.float32).tolist(), i % 2) for i, c in enumerate(np.repeat(rng.normal(size=(30, 64)), 6, 0))]
    rows += [(1000, None, 0), (1001, [0.0] * 64, 0), (1002, rows[0][1], None), (1003, rows[0][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, "op3_vectors", str(tmp_path), ["embeddings"])
