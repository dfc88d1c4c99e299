"""Files to overlapping token windows with content-addressed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import has_token, tokens


def file_id(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("file::"), path), 256)


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def chunk_count(n: Column, config: Config = DEFAULT) -> Column:
    """Windows over n tokens; one that its predecessor would cover is left out."""
    return F.when(n == 0, 0).when(n <= config.chunk_tokens, 1).otherwise(1 + F.ceil((n - config.chunk_tokens) / config.step)).cast("int")


def chunks(files: DataFrame, config: Config = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """From (path, text): (path, file_id, chunk_index, token_start, token_end, chunk_hash, chunk_id, content), and columns of the file to keep.

    No shuffle: a file's windows come from its own tokens.
    """
    # A condition on the tokens themselves would be pushed below a join of `files`, and cut the texts once more, all of them.
    tok = files.where(has_token(F.col("text"))).select("path", *keep, tokens(F.col("text")).alias("tok")).withColumn("n", F.size("tok"))
    rows = tok.select("path", *keep, "tok", "n", F.explode(F.sequence(F.lit(0), chunk_count(F.col("n"), config) - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * config.step
    rows = rows.select("path", *keep, "chunk_index", start.alias("token_start"), F.least("n", start + config.chunk_tokens).alias("token_end"), F.array_join(F.slice("tok", start + 1, F.lit(config.chunk_tokens)), " ").alias("content"))
    rows = rows.withColumn("file_id", file_id(F.col("path"))).withColumn("chunk_hash", F.sha2("content", 256))
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("::", F.lit("chunk"), "file_id", F.col("chunk_index").cast("string"), "chunk_hash"), 256))


def verify(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits (path, token_start, token_end, chunk_hash, ...) with their text rebuilt from the files as they are, and a state.

    verified: the window's hash is as recorded; stale: it is not; unavailable: the file is gone.
    """
    tok = files.select("path", tokens(F.col("text")).alias("tok"))
    rebuilt = hits.join(tok, "path", "left").withColumn("text", F.array_join(F.slice("tok", F.col("token_start") + 1, F.greatest(F.lit(0), F.col("token_end") - F.col("token_start"))), " "))
    state = F.when(F.col("tok").isNull(), "unavailable").when(F.sha2("text", 256) == F.col("chunk_hash"), "verified").otherwise("stale")
    return rebuilt.withColumn("state", state).withColumn("text", F.when(F.col("state") == "verified", F.col("text"))).drop("tok")
