"""Registration of a query with its SQL, and fragments that the SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..sources.shared import new_folder  # noqa: F401
from . import registry

FILES = "f AS (SELECT doc_id, source || '/' || lang || '/doc' || doc_id || '.txt' AS path, text, source, lang FROM documents)"
CHUNKS = r"""tk AS (SELECT path, regexp_extract_all(text, '\S+') AS tok FROM f),
ci AS (SELECT path, tok, len(tok) AS n, unnest(range(0, CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= 256 THEN 1 ELSE 1 + CAST(ceil((len(tok) - 256) / 224.0) AS BIGINT) END)) AS i FROM tk),
cw AS (SELECT path, CAST(i AS BIGINT) AS chunk_index, CAST(i * 224 AS BIGINT) AS token_start, CAST(least(n, i * 224 + 256) AS BIGINT) AS token_end, array_to_string(tok[i * 224 + 1 : i * 224 + 256], ' ') AS content, sha256('file::' || path) AS file_id FROM ci),
ck AS (SELECT *, sha256(content) AS chunk_hash, sha256('chunk::' || file_id || '::' || chunk_index || '::' || sha256(content)) AS chunk_id FROM cw)"""
TERMS = r"list_distinct(list_transform(list_filter(regexp_extract_all({}, '[\p{{L}}\p{{Nd}}]+'), lambda x: len(x) > 1), lambda x: lower(x)))"


def query(name: str, sql: str | None = None) -> Callable[[registry.Query], registry.Query]:
    """Registers a query; its integers are longs, as they are in the SQL."""

    def add(build: registry.Query) -> registry.Query:
        def run(spark, sf_dir):
            df = build(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

        registry.QUERIES[name] = run
        if sql:
            registry.SQL[name] = sql
        return run

    return add
