"""Language-model scores of whole texts: word counts of the training texts, and a causal self-attention model on subword ids.

Words are lower-cased (A-Z) and followed by one end. The model reads each word's subword ids; ids
outside its VOCAB - 1 most frequent share one symbol, within which they keep their share of the
counts, so that the probabilities of all texts are proper. Word counts, symbol counts, the counts
of symbols after symbols that the model starts from, and its training cover all training texts.

Texts are dealt to chunks by hash, as many as their bytes ask for, and sorted within them. So a
chunk, the unit of training, is the same on any cluster: in each round, chunks of their own train
the parameters of the round before, and the results are averaged in integers, weighted by tokens.

A chunk is a dictionary of its words with their subword ids, and its texts as word numbers. Only
words with their counts are shuffled to make the corpus counts, which come back to the chunks by
number; then each chunk is scored by itself. Words travel in lots, a row for the words of a chunk
that share a hash.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .common import fold, map_arrow, release, remove, shared_dir, table

#: Bytes of text in a chunk, about; one of twice as many is cut in two, and a longer text is a chunk by itself.
CHUNK_BYTES = 8 << 20
#: Small corpora make chunks of FEW_BYTES, up to FEW_CHUNKS of them, so that they can be worked on side by side.
FEW_BYTES, FEW_CHUNKS = 1 << 20, 24
#: Partitions that chunks are dealt to, at most.
MOST_PARTITIONS = 50_000
#: Chunks whose words would fill a lot, were they all different; small corpora make up to FEW_CHUNKS lots.
LOT_CHUNKS = 8
#: Bytes of a word that a lot holds; of a longer one it holds the digest.
LONGEST = 256
#: Words whose ids are laid out, and encoded, at once.
SLICE_WORDS = 250_000
#: Each training text trains the model in one of the rounds.
RATES = (0.03, 0.03, 0.02)
ADD = 0.1
#: Parameters are averaged as integers, in these units and by tokens in thousands, so that no order of summation matters.
UNIT, TOKENS = float(1 << 20), 1000


class Subwords:
    """Words to ids of a public byte-level tokenizer of fewer than 65,536 ids; the end of a text is the id after the last."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens = [b""] * (max(ranks.values()) + 2)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.end = len(self.tokens) - 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one word after the other, and each word's number of ids; the empty word is the end.

        Words without white space of any alphabet are encoded together, as words between spaces are split before each space.
        """
        sizes, together, alone = np.ones(len(words), np.int64), [], []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        plain = np.flatnonzero(lengths)
        if not _unbroken(b" ".join(words)):
            plain = plain[np.fromiter((_unbroken(words[i]) for i in plain.tolist()), bool, len(plain))]
        for at in range(0, len(plain), SLICE_WORDS):
            part = plain[at : at + SLICE_WORDS]
            joined = np.array(self._encode(" " + b" ".join([words[i] for i in part.tolist()]).decode()), np.uint16)
            want = np.cumsum(1 + lengths[part])
            ends = np.cumsum(self.lengths[joined])
            cut = np.minimum(np.searchsorted(ends, want), len(ends) - 1)
            if (ends[cut] == want).all():
                sizes[part] = np.diff(cut, prepend=-1)
                together.append(joined)
            else:
                plain = plain[:at]  # this slice and those after it one by one
                break
        rest = np.ones(len(words), bool)
        rest[plain] = False
        for i in np.flatnonzero(rest).tolist():
            alone.append(self._encode(" " + words[i].decode("utf-8", "replace")) if words[i] else [self.end])
            sizes[i] = len(alone[-1])
        # Each kind fills its own words' places in order.
        out, by_word = np.empty(int(sizes.sum()), np.uint16), np.repeat(rest, sizes)
        out[~by_word] = np.concatenate(together) if together else []
        out[by_word] = list(chain.from_iterable(alone))
        return out, sizes


def settle() -> None:
    """Once per worker: what is loaded by then, mostly libraries, need not be walked through when memory is given back."""
    if not gc.get_freeze_count():
        gc.freeze()


_SUBWORDS: dict[tuple[str, str], Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    """One per worker."""
    if (path, pattern) not in _SUBWORDS:
        _SUBWORDS[path, pattern] = Subwords(path, pattern)
    return _SUBWORDS[path, pattern]


#: White space of any alphabet but the blank, as the tokenizer has it.
_BLANKS = re.compile(r"[^\S \x1C-\x1F]")


def _unbroken(text: bytes) -> bool:
    """Whether these are whole characters, and none of them is white space but the blank."""
    try:
        return not _BLANKS.search(text.decode())
    except UnicodeDecodeError:
        return False


def cut_words(words: pa.Array) -> list[bytes]:
    """All of them as Python has them, cut from one piece of memory."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in pairwise(ends)]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Chunk:
    """Texts as numbers of their words, one text after the other; number 0 is the end, whose word is empty. `ids` are the words' subword ids, `id_sizes` how many each word has."""

    numbers: np.ndarray
    sizes: np.ndarray
    learned: np.ndarray
    ids: np.ndarray
    id_sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None] | pa.Array, learned: list[bool], s: Subwords) -> tuple[Chunk, list[bytes]]:
        """The chunk and its words."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).view(pa.string())
        # Texts that begin or end with a blank have an empty word there.
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
        there = pc.not_equal(pc.binary_length(split.flatten()), 0)
        sizes = np.bincount(pc.list_parent_indices(split).to_numpy()[there.to_numpy(zero_copy_only=False)], minlength=len(texts))
        # Words are numbered as they first occur, the end before all.
        coded = pa.concat_arrays([pa.array([""], pa.large_string()), split.flatten().filter(there)]).dictionary_encode()
        found = cut_words(coded.dictionary)
        return cls(coded.indices.to_numpy()[1:], sizes, np.array(learned, bool), *s.encode(found)), found

    def learning(self) -> Chunk:
        """The chunk of its training texts only."""
        return Chunk(self.numbers[np.repeat(self.learned, self.sizes)], self.sizes[self.learned], self.learned[self.learned], self.ids, self.id_sizes)

    def with_ends(self) -> np.ndarray:
        """The word numbers with an end before, between and after the texts."""
        out = np.zeros(len(self.numbers) + len(self.sizes) + 1, np.int32)
        out[np.arange(1, len(self.numbers) + 1) + np.repeat(np.arange(len(self.sizes)), self.sizes)] = self.numbers
        return out

    def counts(self) -> np.ndarray:
        """How often its texts have each word."""
        n = np.bincount(self.numbers, minlength=len(self.id_sizes))
        n[0] = len(self.sizes)
        return n

    def stream(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts as symbols of their subword ids, each text after an end and followed by one; where each begins, and its number of symbols with its end."""
        numbers, flat, offset = self.with_ends(), symbol[self.ids].astype(np.uint16), np.cumsum(self.id_sizes) - self.id_sizes
        n = self.id_sizes[numbers]
        stops = np.cumsum(n)
        out = np.empty(int(stops[-1]), np.uint16)
        for i in range(0, len(numbers), SLICE_WORDS):
            part, k = numbers[i : i + SLICE_WORDS], n[i : i + SLICE_WORDS]
            begin, stop = int(stops[i] - k[0]), int(stops[i + len(part) - 1])
            out[begin:stop] = flat[np.arange(stop - begin) + np.repeat(offset[part] - np.cumsum(k) + k, k)]
        ends = stops[np.flatnonzero(numbers == 0)] - 1
        return out, ends[:-1] + 1, np.diff(ends)

    def pairs(self, symbol: np.ndarray) -> np.ndarray:
        """How often each symbol follows each, as one number for both: within words by the words' counts, and from word to word."""
        flat, n = symbol[self.ids].astype(np.int64), attention.VOCAB
        stops = np.cumsum(self.id_sizes)
        inner = np.ones(max(0, len(flat) - 1), bool)
        inner[stops[:-1] - 1] = False
        inside = np.bincount((flat[:-1] * n + flat[1:])[inner], np.repeat(self.counts(), self.id_sizes)[:-1][inner], n * n)
        numbers = self.with_ends()
        return inside.astype(np.int64) + np.bincount(flat[stops - 1][numbers[:-1]] * n + flat[stops - self.id_sizes][numbers[1:]], minlength=n * n)


class Scale:
    """The model's symbols: the VOCAB - 1 most frequent ids in the order of their bytes, so that the members of a class begin alike, and one for the others."""

    def __init__(self, counts: np.ndarray, tokens: list[bytes]):
        top = np.argsort(-counts, kind="stable")[: attention.VOCAB - 1]
        top = sorted(top.tolist(), key=lambda i: (i == len(tokens) - 1, tokens[i]))
        self.symbol = np.full(len(counts), attention.VOCAB - 1, np.int32)
        self.symbol[top] = np.arange(len(top))
        rest = self.symbol == attention.VOCAB - 1
        self.within = np.zeros(len(counts))
        self.within[rest] = np.log10((counts[rest] + 0.5) / (counts[rest] + 0.5).sum())


_BINARY = ("numbers", "sizes", "ids", "id_sizes")
_LOT = "struct<lot: int, number: binary, n: binary, length: binary, word: binary>"


def lots(found: list[bytes], counts: np.ndarray, k: int) -> pa.ListArray:
    """A chunk's words and their counts as one list of at most `k` lots, by hash: the words' numbers, counts and lengths, and their bytes one after the other."""
    # No word holds a blank.
    kept = [w if len(w) <= LONGEST else b" " + hashlib.sha256(w).digest() for w in found]
    lot = (np.fromiter(map(zlib.crc32, kept), np.uint32, len(kept)) % k).astype(np.min_scalar_type(k))
    order = np.argsort(lot, kind="stable")
    length, joined = np.fromiter(map(len, kept), np.int32, len(kept))[order], b"".join([kept[i] for i in order.tolist()])
    begins = np.flatnonzero(np.diff(lot[order].astype(np.int64), prepend=-1))
    places = np.concatenate([[0], np.cumsum(length)])
    spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(kept)], strict=True))
    cut = lambda values: pa.array([values[a:b].tobytes() for a, b in spans], pa.binary())
    of_lot = pa.array([joined[places[a] : places[b]] for a, b in spans], pa.binary())
    fields = [pa.array(lot[order][begins].astype(np.int32)), cut(order.astype(np.int32)), cut(counts[order]), cut(length), of_lot]
    return pa.ListArray.from_arrays(pa.array([0, len(spans)], pa.int32()), pa.StructArray.from_arrays(fields, ["lot", "number", "n", "length", "word"]))


def count_lot(rows: pa.Table) -> pa.Table:
    """For each chunk of a lot its words' numbers and counts in the corpus; the first row has the lot's tokens and different words."""
    arrays = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name).combine_chunks()]
    length, n = arrays("length", np.int32), np.concatenate(arrays("n", np.int64))
    coded = pa.chunked_array(
        [pa.Array.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(k, dtype=np.int64)])), x.as_buffer()]) for k, x in zip(length, rows.column("word").combine_chunks(), strict=True)]
    ).combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy()
    c = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(c, code, n)
    ends = np.cumsum([len(k) for k in length])
    known = pa.array([x.tobytes() for x in np.split(c[code], ends[:-1])], pa.binary())
    once = lambda value: pa.array([value, *[0] * (rows.num_rows - 1)], pa.int64())
    release()
    return pa.table([rows.column("chunk"), rows.column("number"), known, once(int(c.sum())), once(int((c > 0).sum()))], names=["chunk", "number", "c", "tokens", "words"])


def chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[Chunk, dict]]:
    """The chunks of stored rows, and their columns as they are."""
    settle()
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in columns}
            arrays = {c: np.frombuffer(row[c].as_buffer(), t) for c, t in zip(_BINARY, (np.int32, np.int64, np.uint16, np.int64), strict=True)}
            yield Chunk(**arrays, learned=row["learned"].values.to_numpy(zero_copy_only=False)), row


def store(rows: DataFrame, path: str, pattern: str, root: str) -> DataFrame:
    """The chunks of (__id, learned, text), written under `root`: a row each."""
    id_type = rows.schema["__id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(len(RATES), min(FEW_CHUNKS, total // FEW_BYTES), -(-total // CHUNK_BYTES))
    # By id and text, so that no id, null or repeated, makes a chunk large.
    dealt = rows.withColumn("key", F.xxhash64(F.lit(6), "__id", "text")).withColumn("deal", F.pmod("key", F.lit(n)))
    parts, n_lots = min(n, MOST_PARTITIONS), max(min(n, FEW_CHUNKS), -(-n // LOT_CHUNKS))
    dealt = dealt.repartitionById(parts, F.pmod("deal", F.lit(parts)).cast("int")).sortWithinPartitions("deal", "key", "__id", "learned")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = subwords(path, pattern)
        settle()
        held: list[pa.RecordBatch] = []
        size, deal, k, kind = 0, None, 0, None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            chunk, found = Chunk.of(t.column("text").combine_chunks(), t.column("learned").to_pylist(), s)
            counts, ends = chunk.learning().counts(), lambda n: pa.array([0, n], pa.int32())
            binary = [pa.array([getattr(chunk, c).tobytes()], pa.binary()) for c in _BINARY]
            lists = [pa.ListArray.from_arrays(ends(len(x)), x) for x in (t.column("__id").combine_chunks(), pa.array(chunk.learned))]
            return pa.record_batch([pa.array([(deal << 20) + k]), pa.array([deal % len(RATES)], pa.int32()), *lists, lots(found, counts, n_lots), *binary], names=["chunk", "turn", "id", "learned", "lots", *_BINARY])

        for batch in batches:
            deals = batch.column("deal").to_numpy()
            lengths = np.fromiter((x.as_buffer().size if x.is_valid else 0 for x in batch.column("text")), np.int64, batch.num_rows)
            start = 0
            for i in range(batch.num_rows):
                if deals[i] != deal or size + lengths[i] > 2 * CHUNK_BYTES:
                    held += [batch.slice(start, i - start)] if i > start else []
                    if held:
                        yield flush()
                    k = k + 1 if deals[i] == deal else 0
                    held, size, deal, start = [], 0, int(deals[i]), i
                size += lengths[i]
            held.append(batch.slice(start))
        if held:
            yield flush()

    schema = f"chunk long, turn int, id array<{id_type}>, learned array<boolean>, lots array<{_LOT}>, numbers binary, sizes binary, ids binary, id_sizes binary"
    map_arrow(dealt.select("deal", "__id", "learned", "text"), cut_up, schema).write.option("compression", "zstd").parquet(f"{root}/chunks")
    return rows.sparkSession.read.parquet(f"{root}/chunks")


def _summed(stored: DataFrame, size: int, count) -> np.ndarray:
    """The sum over all chunks of `count(chunk)`, an array of `size`; the driver gets at most a row per element."""
    columns = ["learned", *_BINARY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for chunk, _ in chunks(batches, columns):
            total += count(chunk.learning())
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["at", "n"])

    got = map_arrow(stored.select(*columns), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def symbols(stored: DataFrame, s: Subwords) -> Scale:
    n = len(s.tokens)
    return Scale(_summed(stored, n, lambda c: np.bincount(c.ids, np.repeat(c.counts(), c.id_sizes), n).astype(np.int64)), s.tokens)


def prior(stored: DataFrame, scale: Scale) -> attention.Prior:
    symbol = scale.symbol
    return attention.Prior.counted(_summed(stored, attention.VOCAB**2, lambda c: c.pairs(symbol)).reshape(attention.VOCAB, -1).astype(np.float64))


def fit(stored: DataFrame, scale: Scale, before: attention.Prior) -> attention.Params:
    """The parameters learned from all training texts of the stored chunks; the driver gets a row per parameter and round."""
    sc, columns = stored.sparkSession.sparkContext, ["learned", *_BINARY]
    params = attention.initial()
    known = sc.broadcast((scale.symbol, before))
    for turn, rate in enumerate(RATES):
        shared = sc.broadcast(params)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            weight, total = 0, 0
            for chunk, _ in chunks(batches, columns):
                stream, starts, sizes = chunk.learning().stream(known.value[0])
                if len(sizes):
                    p = attention.train(shared.value, known.value[1], stream, starts, sizes, rate)
                    w = -(-len(stream) // TOKENS)
                    weight, total = weight + w, total + w * np.rint(np.concatenate([v.ravel() for v in p.values()]) * UNIT).astype(np.int64)
            if weight:
                yield pa.record_batch([pa.array(np.full(len(total), weight)), pa.array(np.arange(len(total))), pa.array(total)], names=["w", "i", "v"])

        trained = map_arrow(stored.where(F.col("turn") == turn).select(*columns), train, "w long, i long, v long")
        sums = trained.groupBy("i").agg(F.sum("w").alias("w"), F.sum("v").alias("v")).toArrow()
        if sums.num_rows:
            flat = np.empty(sums.num_rows)
            flat[sums.column("i").to_numpy()] = sums.column("v").to_numpy() / sums.column("w").to_numpy() / UNIT
            params = dict(attention.unflatten(flat.astype(np.float32), params))
    return params


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`.

    Null and empty texts are an end only. Where nothing is learned every count is 0. Rows that
    repeat an id are rows of their own. A null `learn` is false. The scores are the same on any
    cluster, but for the last digits that a sum's order may change.
    """
    from .bpe import default_pattern, default_ranks

    spark, path, pattern = docs.sparkSession, path or default_ranks(), pattern or default_pattern()
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col(text_col).alias("text"))
    id_type = rows.schema["__id"].dataType.simpleString()
    root = shared_dir(spark)
    stored = store(rows, path, pattern, root)
    dealt = stored.select("chunk", F.explode("lots").alias("x")).select("chunk", "x.*")
    dealt.groupBy("lot").applyInArrow(count_lot, "chunk long, number binary, c binary, tokens long, words long").write.option("compression", "zstd").parquet(f"{root}/words")
    counted = spark.read.parquet(f"{root}/words")
    total, distinct = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    scale = symbols(stored, subwords(path, pattern))
    before = prior(stored, scale)
    shared = spark.sparkContext.broadcast((scale, before, fit(stored, scale, before)))
    columns = ["id", "learned", *_BINARY]

    def score_chunk(texts: pa.Table, known: pa.Table) -> pa.Table:
        scale, before, params = shared.value
        ((chunk, row),) = chunks(texts.to_batches(), columns)
        n, c = len(chunk.sizes), np.empty(len(chunk.id_sizes), np.int64)
        for number, of_number in zip(known.column("number"), known.column("c"), strict=True):
            c[np.frombuffer(number.as_buffer(), np.int32)] = np.frombuffer(of_number.as_buffer(), np.int64)
        log = np.log10((c + ADD) / (total + ADD * (distinct + 1)))
        # Ids that share a symbol, by word.
        within = np.add.reduceat(scale.within[chunk.ids], np.cumsum(chunk.id_sizes) - chunk.id_sizes)
        owner = np.repeat(np.arange(n), chunk.sizes)
        per_text = lambda values: np.bincount(owner, values[chunk.numbers], n) + values[0]
        scores = attention.log10_scores(params, before, *chunk.stream(scale.symbol)) + per_text(within)
        n_known = per_text((c > 0).astype(np.float64)).astype(np.int64)
        release()
        return pa.table([row["id"].values, row["learned"].values, pa.array(chunk.sizes + 1), pa.array(n_known), pa.array(np.full(n, total)), pa.array(per_text(log)), pa.array(scores)], names=["__id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"__id {id_type}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = spark.read.parquet(f"{root}/chunks").select("chunk", *columns).groupBy("chunk").cogroup(counted.select("chunk", "number", "c").groupBy("chunk")).applyInArrow(score_chunk, schema)
    out.write.parquet(f"{root}/scores")
    remove(spark, f"{root}/chunks", f"{root}/words")
    return spark.read.parquet(f"{root}/scores").withColumnRenamed("__id", id_col)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents of nine folds; a null id is held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fold(F.col("doc_id"), 10) != 0).select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
