"""Byte-level BPE encoding by given ranks, and decoding.

Each match of the split pattern is merged on its own. A segment tree over the piece's byte
positions holds the rank of the pair that starts at each live position; its root leads to the
leftmost pair of the smallest rank, and each merge updates the ranks of two live neighbours.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table

NONE = 1 << 62
#: Children of a node of the segment tree.
FAN = 16
#: Pieces whose ids a Python worker remembers, in each of two generations, and their characters, at most.
CACHED_PIECES, LONGEST = 150_000, 64

RESULT = "n_tokens long, ids array<int>, decoded binary"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece. A byte that has no rank raises KeyError."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, rank = len(piece), ranks.get
    bits = n.bit_length()
    place = (1 << bits) - 1
    # Rank and position in one number, so that the minimum is the leftmost of the smallest rank. A node is the minimum of FAN below it.
    leaves = [NONE if (r := rank(piece[i : i + 2])) is None else r << bits | i for i in range(n - 1)]
    leaves.append(NONE)
    levels = [leaves]
    while len(below := levels[-1]) > FAN:
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, after, before = levels[-1], list(range(1, n + 2)), list(range(-1, n))
    while (low := min(top)) < NONE:
        i = low & place
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        h = before[i]
        leaves[j] = NONE
        leaves[i] = NONE if k == n or (r := rank(piece[i : after[k]])) is None else r << bits | i
        if h >= 0:
            leaves[h] = NONE if (r := rank(piece[h:k])) is None else r << bits | h
        if top is not leaves:
            for at in (j, i, h) if h >= 0 else (j, i):
                for below, nodes in zip(levels, levels[1:], strict=False):
                    at //= FAN
                    value = min(below[at * FAN : at * FAN + FAN])
                    if nodes[at] == value:
                        break
                    nodes[at] = value
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class _Cache(dict):
    """Piece to the bytes of its ids; the older generation goes when the newer is full. Long pieces are not kept."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes with one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.split, self.cache = regex.compile(pattern).findall, _Cache(ranks)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers; none for null and empty text."""
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.split(text or ""))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and parameters, so that its cache outlives a task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def bpe(text: Column, path: str | None = None, pattern: str | None = None, digest: bool = False) -> Column:
    """A struct of the number of ids, the ids and the bytes decoded from them, or of their digests.

    Null and empty texts have no ids and decode to no bytes. Texts are encoded whole.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()

    @arrow_udf(DIGEST if digest else RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            n, ids_out, decoded_out = [], [], []
            for text in texts:
                ids = c.encode(text.as_py())
                decoded = c.decode(ids)
                n.append(len(ids))
                ids_out.append(hashlib.sha256(ids).hexdigest() if digest else ids.view("<i4"))
                decoded_out.append(hashlib.sha256(decoded).hexdigest() if digest else decoded)
            if digest:
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_out, pa.string()), pa.array(decoded_out, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ends = np.cumsum([0, *n]).astype(np.int32)
                values = np.concatenate(ids_out) if ids_out else np.array([], np.int32)
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(values, pa.int32())), pa.array(decoded_out, pa.binary())], ["n_tokens", "ids", "decoded"])

    return run(text)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", bpe(F.col("text"), digest=True).alias("b")).select("doc_id", "b.*")
