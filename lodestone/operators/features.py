"""Corpus-fitted features: document frequencies, TF-IDF and latent semantic vectors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.slabs import slabs
from ..functions.text import IDENTIFIER_CUT, STOPWORDS

MAX_TERMS = 4096
#: What lies between the runs that are words.
NOT_TERM = r"[^\p{L}\p{Nd}]+"
#: Documents whose rows of the Gram matrix are computed at once.
SLAB = 512
#: Of these, as many as are laid out over all terms at once.
DENSE = 64
#: Terms that a task counts before it passes them on.
HELD_TERMS = 1 << 17
#: Vectors beside those wanted in a block of the iteration, and its passes, at most.
SPARE, PASSES = 16, 30
_STOP = frozenset(STOPWORDS)
_CUT = regex.compile(IDENTIFIER_CUT)
#: Words of capitals and small letters behind them, which are cut nowhere, and whose case is alike in all libraries.
PLAIN = "^[A-Z]*[a-zß-öø-ÿ]*$"


def stem_word(w: str) -> str:
    """As `stem` of a column."""
    n = len(w)
    if n > 5 and w.endswith("ing"):
        return w[:-3]
    if n > 4 and w.endswith(("ed", "es")):
        return w[:-2]
    return w[:-1] if n > 3 and w.endswith("s") and not w.endswith("ss") else w


def word_terms(w: str) -> list[str]:
    """The index's terms of a run of letters and digits, with repeats: of each of its parts, cut as identifiers are, the lower-case stem, unless that is short or a stop word."""
    return [t for p in _CUT.sub(" ", w).lower().split(" ") if len(t := stem_word(p)) > 1 and t not in _STOP]


def words_terms(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of distinct words: places of words, ascending, and a term of each; those that no cut can be in are stemmed as a column."""
    plain = pc.match_substring_regex(words, PLAIN)
    at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
    w = pc.utf8_lower(words.filter(plain))
    n = pc.utf8_length(w)
    ends = lambda suffix, least: pc.and_(pc.ends_with(w, suffix), pc.greater(n, least))
    rules = [ends("ing", 5), pc.or_(ends("ed", 4), ends("es", 4)), pc.and_(ends("s", 3), pc.invert(pc.ends_with(w, "ss")))]
    stems = pc.case_when(pa.StructArray.from_arrays(rules, ["ing", "ed", "s"]), *(pc.utf8_slice_codeunits(w, 0, -k) for k in (3, 2, 1)), w)
    kept = pc.and_(pc.greater(pc.utf8_length(stems), 1), pc.invert(pc.is_in(stems, pa.array(STOPWORDS))))
    at, stems = at[kept.to_numpy(zero_copy_only=False)], stems.filter(kept)
    rest = np.flatnonzero(pc.invert(plain).to_numpy(zero_copy_only=False))
    of_rest = [word_terms(w) for w in words.take(pa.array(rest)).to_pylist()]
    owner = np.concatenate([at, np.repeat(rest, [len(t) for t in of_rest])])
    order = np.argsort(owner, kind="stable")
    return owner[order], pa.concat_arrays([stems, pa.array([t for ts in of_rest for t in ts], pa.string())]).take(pa.array(order))


def spread(sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places in a concatenation of lists of these sizes: those of each list of `of`, one after the other."""
    n = sizes[of]
    return np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[of] - np.cumsum(n) + n, n)


def marked_trigrams(terms: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The number of each term's trigrams, which they are among the distinct ones, and those."""
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    if not len(sizes):
        return sizes, sizes, []
    points = np.frombuffer("".join(f"^{t}$" for t in terms).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    first = spread(sizes + 2, np.arange(len(sizes)))
    # All places of a padded term but its last two.
    first = first[np.arange(len(first)) < np.repeat(np.cumsum(sizes + 2) - 2, sizes + 2)]
    key, which = np.unique(points[first] << 42 | points[first + 1] << 21 | points[first + 2], return_inverse=True)
    letters = np.stack([key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF], 1).astype("<u4")
    return sizes, which, [f"3:{t}" for t in np.ascontiguousarray(letters).view("<U3").ravel().tolist()]


def cut_words(text: Column) -> Column:
    """The text's runs of letters and digits, with single spaces between; what is in a run is looked at once for each distinct one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOT_TERM, " ")


def counted(texts: pa.Array, include_trigrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of cut texts: row, number of the term and its count, in the order of rows; and the terms, and with them the trigrams of each. Each distinct word is looked at once."""
    split = pc.split_pattern(texts, " ")
    coded = split.flatten().dictionary_encode()
    words, owner = coded.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(split).to_numpy()
    of, terms = words_terms(coded.dictionary)
    terms = terms.dictionary_encode()
    flat, names = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary.to_pylist()
    sizes = np.bincount(of, minlength=len(coded.dictionary))
    # Each occurrence of a word brings all of its terms, and each term its trigrams.
    row, features = np.repeat(owner, sizes[words]), flat[spread(sizes, words)]
    if include_trigrams:
        n, which, trigrams = marked_trigrams(names)
        row, features = np.concatenate([row, np.repeat(row, n[features])]), np.concatenate([features, len(names) + which[spread(n, features)]])
        names += trigrams
    key, tf = np.unique(row * max(1, len(names)) + features, return_counts=True)
    return *np.divmod(key, max(1, len(names))), tf.astype(np.int64), names


def known_terms(texts: pa.Array, known: pa.Array, include_trigrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cut texts: row, place of the term among those known, and count; terms that aren't known have none."""
    row, term, tf, names = counted(texts, include_trigrams)
    return placed_terms(row, term, tf, pa.array(names, pa.string()), known)


def placed_terms(row: np.ndarray, term: np.ndarray, tf: np.ndarray, names: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place of the term among those known instead of among the names, and count; terms that aren't known have none."""
    at = pc.fill_null(pc.index_in(names, known), -1).to_numpy()[term]
    keep = at >= 0
    return row[keep], at[keep], tf[keep]


def bags(docs: DataFrame, include_trigrams: bool = False) -> DataFrame:
    """(doc, bag) of (doc, text): each document's terms with how often it has them.

    Words are cut in the JVM and counted by document in slabs of Arrow batches; nothing is shuffled,
    as a document's words are in its row.
    """

    @arrow_udf("array<struct<term: string, tf: long>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (part for batch in batches for part in slabs(batch)):
            row, term, tf, names = counted(texts, include_trigrams)
            ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(term)), pa.array(tf)], ["term", "tf"]))

    return docs.select("doc", count(cut_words(F.col("text"))).alias("bag"))


def sorted_terms(text: Column) -> Column:
    """(n_terms, n_words, terms): of a text the distinct terms, their occurrences, and the terms in order with single spaces between."""

    @arrow_udf("struct<n_terms: long, n_words: long, terms: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (part for batch in batches for part in slabs(batch)):
            row, term, tf, names = counted(texts, False)
            # By code points, which is the order of UTF-8 too.
            rank = np.empty(len(names), np.int64)
            rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
            ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            ordered = pa.array(names, pa.string()).take(pa.array(term[np.lexsort((rank[term], row))]))
            sums = np.bincount(row, tf, len(texts)).astype(np.int64)
            yield pa.StructArray.from_arrays([pa.array(np.diff(ends).astype(np.int64)), pa.array(sums), pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), ordered), " ")], ["n_terms", "n_words", "terms"])

    return run(cut_words(text))


def term_rows(docs: DataFrame, include_trigrams: bool = False) -> DataFrame:
    """(doc, term, tf) of (doc, text), a row per document; rows that repeat a doc stay apart."""
    return bags(docs, include_trigrams).select("doc", F.explode("bag").alias("b")).select("doc", "b.term", "b.tf")


def document_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def document_frequencies(docs: DataFrame, include_trigrams: bool = False) -> DataFrame:
    """(term, df) of (doc, text), and under the null term the number of documents.

    A task adds up its terms, at most HELD_TERMS of them before they are passed on, so that no row is made for a document's term.
    """

    docs = _cut_or_stored(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(["term", "df"])

        for n, _, term, _, names in _slab_bags(batches, include_trigrams):
            df = np.append(np.bincount(term, minlength=len(names)), n)
            held.append(pa.table([pa.concat_arrays([names, pa.nulls(1, pa.string())]), pa.array(df)], names=["term", "df"]))
            size += len(df)
            if size >= 2 * HELD_TERMS:
                held = [summed()]
                size = len(held[0])
                if size >= HELD_TERMS:
                    yield from held.pop().to_batches()
                    size = 0
        if held:
            yield from summed().to_batches()

    return docs.mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def stored_bags(docs: DataFrame, include_trigrams: bool = False) -> DataFrame:
    """(part, n, names, sizes, terms, tfs) of (part, text): the texts' terms counted once, for several fits and updates to read; persist it.

    A row is about at most SLAB documents of one part (an int, null in none): their terms' names, each document's number of
    terms, and these as places among the names and counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part")
            for p in pc.unique(part).to_pylist():
                for texts in slabs(batch.column("text").filter(pc.is_null(part) if p is None else pc.equal(part, p)), SLAB):
                    row, term, tf, names = counted(texts, include_trigrams)
                    packed = (np.bincount(row, minlength=len(texts)), term, tf)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(names, pa.string()))
                    yield pa.record_batch([pa.array([p], pa.int32()), pa.array([len(texts)], pa.int32()), lists, *(pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in packed)], names=["part", *_STORED])

    rows = docs.select(F.col("part").cast("int").alias("part"), cut_words(F.col("text")).alias("text"))
    return rows.mapInArrow(count, "part int, n int, names array<string>, sizes binary, terms binary, tfs binary")


_STORED = ["n", "names", "sizes", "terms", "tfs"]


def _cut_or_stored(docs: DataFrame) -> DataFrame:
    """What `_slab_bags` reads of texts, or of `stored_bags`."""
    return docs.select(*_STORED) if "names" in docs.columns else docs.select(cut_words(F.col("text")).alias("text"))


def _slab_bags(batches: Iterator[pa.RecordBatch], include_trigrams: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Slab by slab the number of documents, the rows, places among the names, and counts of their terms, and the names."""
    for batch in batches:
        if "names" not in batch.schema.names:
            for texts in slabs(batch.column("text"), SLAB):
                row, term, tf, names = counted(texts, include_trigrams)
                yield len(texts), row, term, tf, pa.array(names, pa.string())
            continue
        for n, names, *packed in zip(*(batch.column(c) for c in _STORED), strict=True):
            sizes, term, tf = (np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in packed)
            yield n.as_py(), np.repeat(np.arange(len(sizes)), sizes), term, tf, names.values


def vocabulary(df: DataFrame, min_df: int = 2, most: int = MAX_TERMS) -> DataFrame:
    """The terms of the largest document frequencies, ties by term; at most `most` rows, so it may be broadcast."""
    return df.where(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(most)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def tf_idf(rows: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(doc, term, weight) over the vocabulary."""
    return rows.join(F.broadcast(vocab), "term").select("doc", "term", ((1 + F.log("tf")) * idf(F.lit(n_docs), F.col("df"))).alias("weight"))


@dataclass
class LsaState:
    """What an update of a fitted model starts from: the number of documents, its terms' document frequencies, and more of the largest eigenvectors, with their values, than the projection takes."""

    n: int
    df: np.ndarray
    basis: np.ndarray
    values: np.ndarray


@dataclass
class LsaModel:
    """Terms with their inverse document frequencies and their rows of the projection."""

    terms: list[str]
    idf: np.ndarray
    projection: np.ndarray
    include_trigrams: bool = True
    state: LsaState | None = None

    @property
    def dimension(self) -> int:
        return self.projection.shape[1]

    def to_json(self) -> str:
        kept = {"state": {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self.state).items()}} if self.state else {}
        return json.dumps({"terms": self.terms, "idf": self.idf.tolist(), "projection": self.projection.tolist(), "dimension": self.dimension, "include_trigrams": self.include_trigrams} | kept)

    @classmethod
    def from_json(cls, text: str) -> LsaModel:
        d = json.loads(text)
        x = d.get("state")
        state = x and LsaState(x["n"], np.array(x["df"]), np.array(x["basis"]).reshape(len(d["terms"]), len(x["values"])), np.array(x["values"]))
        return cls(d["terms"], np.array(d["idf"], np.float32), np.array(d["projection"], np.float32).reshape(len(d["terms"]), d["dimension"]), d["include_trigrams"], state)

    def vectors(self, n: int, row: np.ndarray, col: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Unit vectors of n documents, of whose terms these are the places in the model and the counts."""
        a = np.zeros((n, len(self.terms)), np.float32)
        a[row, col] = (1 + np.log(tf)) * self.idf[col]
        out = a @ self.projection
        size = np.sqrt((out * out).sum(1, keepdims=True))
        np.divide(out, size, out=out, where=size > 0)
        return out

    def transform(self, text: Column) -> Column:
        """Unit vectors; zero where no term is known."""
        shared = self

        @arrow_udf("array<float>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = pa.array(shared.terms, pa.string())
            for texts in batches:
                for part in slabs(texts, SLAB):
                    out = shared.vectors(len(part), *known_terms(part, known, shared.include_trigrams))
                    ends = np.arange(len(part) + 1, dtype=np.int32) * shared.dimension
                    yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return run(cut_words(text))


def fit_lsa(docs: DataFrame, dimension: int, include_trigrams: bool = True) -> LsaModel:
    """From (doc, text), or `stored_bags` of texts, by the largest eigenvectors of the term-by-term Gram matrix, which is never formed.

    Block Krylov iteration: a pass multiplies the documents' weights, and then their transpose, with a
    few vectors, so that a task returns and the driver holds only those, at most MAX_TERMS rows. The
    rank is `dimension` cut to the number of documents and terms and to eigenvalues over 1e-9. An empty
    corpus or one without terms raises ValueError.
    """
    n, top = _frequent(docs, include_trigrams, 2, MAX_TERMS)
    if not n:
        raise ValueError("an empty corpus can't be fitted")
    top = top or _frequent(docs, include_trigrams, 1, MAX_TERMS)[1]
    if not top:
        raise ValueError("a corpus without terms can't be fitted")
    terms = sorted(top)
    df = np.array([top[t] for t in terms])
    weights = np.log((1 + n) / (1 + df)) + 1
    held = _packed(docs, terms, include_trigrams).persist()
    try:
        values, vectors = _largest(lambda q: _gram_times(held, weights.astype(np.float32), q), len(terms), dimension)
    finally:
        held.unpersist()
    return _model(terms, n, df, values, vectors, dimension, include_trigrams)


def update_lsa(model: LsaModel, docs: DataFrame, dimension: int | None = None) -> LsaModel:
    """A fitted model brought up to date with new documents (doc, text), or `stored_bags` of them, which alone are read.

    The old documents are taken as the model's largest eigenvectors have them, scaled by how their terms' inverse
    document frequencies have changed, and the Gram matrix of the new ones is added: the iteration is over that sum. Terms that
    the old model didn't have count from now on. Without new documents the model stays as it is.
    """
    if model.state is None:
        raise ValueError("the model was saved without what an update needs: it must be fitted again")
    old, dimension = model.state, dimension or model.dimension
    m, fresh = _frequent(docs, model.include_trigrams, 1, 2 * MAX_TERMS)
    if not m:
        return model
    total = dict(zip(model.terms, old.df.tolist(), strict=True))
    for t, d in fresh.items():
        total[t] = total.get(t, 0) + d
    n = old.n + m
    terms = sorted(sorted((t for t in total if total[t] >= 2), key=lambda t: (-total[t], t))[:MAX_TERMS]) or sorted(total)
    df = np.array([total[t] for t in terms])
    weights = np.log((1 + n) / (1 + df)) + 1
    # The old eigenvectors' rows at the new terms' places, each scaled to its new weight.
    at = {t: i for i, t in enumerate(model.terms)}
    rows = np.array([at.get(t, -1) for t in terms])
    basis = np.zeros((len(terms), old.basis.shape[1]))
    was = np.log((1 + old.n) / (1 + old.df)) + 1
    basis[rows >= 0] = old.basis[rows[rows >= 0]] * (weights[rows >= 0] / was[rows[rows >= 0]])[:, None]
    held = _packed(docs, terms, model.include_trigrams).persist()
    try:
        times = lambda q: basis @ (old.values[:, None] * (basis.T @ q)) + _gram_times(held, weights.astype(np.float32), q)
        values, vectors = _largest(times, len(terms), dimension, basis)
    finally:
        held.unpersist()
    return _model(terms, n, df, values, vectors, dimension, model.include_trigrams)


def _largest(times: Callable[[np.ndarray], np.ndarray], size: int, dimension: int, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, and their vectors, of a symmetric matrix that is only multiplied with; SPARE more than wanted.

    The best approximations in the space of all blocks so far (a block Krylov space), which takes some third of the passes
    that powers of the last block alone do; the driver holds at most PASSES blocks and their products. From vectors that are `near`
    already, a third of the passes is enough.
    """
    width = min(size, dimension + SPARE)
    q = np.random.default_rng(1).normal(size=(size, width))
    if near is not None:
        q[:, : near.shape[1]] = near[:, :width] + 1e-3 * q[:, : near.shape[1]] / size**0.5
    q, last = np.linalg.qr(q)[0], np.zeros(width)
    space, products = np.empty((size, 0)), np.empty((size, 0))
    for _ in range(PASSES if near is None else PASSES // 3):
        y = times(q)
        space, products = np.hstack([space, q]), np.hstack([products, y])
        values, turn = np.linalg.eigh((h := space.T @ products) / 2 + h.T / 2)
        values, turn = values[-width:], turn[:, -width:]
        if np.abs(values - last)[-dimension:].max() <= 1e-9 * max(1.0, np.abs(values).max()):
            break
        # What the space lacks of the products; what is in it but for rounding adds nothing.
        rest = y - space @ (space.T @ y)
        rest -= space @ (space.T @ rest)
        u, sizes, _ = np.linalg.svd(rest, full_matrices=False)
        q = u[:, sizes > 1e-10 * max(1.0, np.abs(values).max())][:, : size - space.shape[1]]
        if not q.shape[1]:
            break
        q = np.linalg.qr(q - space @ (space.T @ q))[0]
        last = values
    return values, space @ turn


def _model(terms: list[str], n: int, df: np.ndarray, values: np.ndarray, vectors: np.ndarray, dimension: int, include_trigrams: bool) -> LsaModel:
    every = np.argsort(values)[::-1]
    every = every[values[every] > 1e-9]
    order = every[: max(1, min(dimension, n, len(terms)))]
    weights = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    return LsaModel(terms, weights, vectors[:, order].astype(np.float32), include_trigrams, LsaState(n, df, vectors[:, every], values[every]))


def turned(a: LsaModel, b: LsaModel) -> np.ndarray:
    """The rotation that lays a's space upon b's, by the terms that both have; eigenvectors are free to turn where their values are alike."""
    at = {t: i for i, t in enumerate(b.terms)}
    both = [(i, at[t]) for i, t in enumerate(a.terms) if t in at]
    x, y = (m.projection[[p[k] for p in both]].astype(np.float64) for k, m in enumerate((a, b)))
    u, _, v = np.linalg.svd(x.T @ y)
    return u @ v


def cosines(bags: DataFrame, a: LsaModel, b: LsaModel) -> DataFrame:
    """(cosine, known) of each document of `stored_bags`: between its vectors in both spaces, a's laid upon b's, and whether b knows a term of it."""
    shared = bags.sparkSession.sparkContext.broadcast((a, b, turned(a, b)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, turn = shared.value
        terms = [pa.array(m.terms, pa.string()) for m in (a, b)]
        for n, *bag in _slab_bags(batches, a.include_trigrams):
            x, y = (m.vectors(n, *placed_terms(*bag, t)).astype(np.float64) for m, t in zip((a, b), terms, strict=True))
            yield pa.record_batch([pa.array((x @ turn * y).sum(1)), pa.array((y != 0).any(1))], names=["cosine", "known"])

    return _cut_or_stored(bags).mapInArrow(compare, "cosine double, known boolean")


def _frequent(docs: DataFrame, include_trigrams: bool, min_df: int, most: int) -> tuple[int, dict[str, int]]:
    """The number of documents, and the vocabulary with its document frequencies, by one pass."""
    counts = document_frequencies(docs, include_trigrams).where(F.col("term").isNull() | (F.col("df") >= min_df))
    # The row of the null term, which is the number of documents, comes first.
    rows = counts.orderBy(F.col("term").isNotNull(), F.desc("df"), "term").limit(most + 1).collect()
    return (rows[0].df, {r.term: r.df for r in rows[1:]}) if rows else (0, {})


def _packed(docs: DataFrame, terms: list[str], include_trigrams: bool) -> DataFrame:
    """(n, sizes, cols, weights): at most SLAB documents a row, with the number of each one's terms, the terms' places and logarithmic counts, in 6 bytes a term."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for n, *bag in _slab_bags(batches, include_trigrams):
            row, col, tf = placed_terms(*bag, known)
            packed = np.bincount(row, minlength=n).astype("<u2"), col.astype("<u2"), (1 + np.log(tf)).astype("<f4")
            yield pa.record_batch([pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["n", "sizes", "cols", "weights"])

    return _cut_or_stored(docs).mapInArrow(pack, "n int, sizes binary, cols binary, weights binary")


def _gram_times(held: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Gram matrix of the packed documents' weighted terms times `q`; a task sends a row for each term."""
    shared, width = held.sparkSession.sparkContext.broadcast((idf, q)), q.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = shared.value
        y, dense = np.zeros_like(q), np.zeros((DENSE, len(idf)))
        for batch in batches:
            for _, *packed in zip(*batch.columns, strict=True):
                sizes, col, weight = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, ("<u2", "<u2", "<f4"), strict=True))
                weight = weight * idf[col]
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                for i in range(0, len(sizes), DENSE):
                    a = dense[: len(sizes[i : i + DENSE])]
                    part = slice(ends[i], ends[i + len(a)])
                    at = np.repeat(np.arange(len(a)), sizes[i : i + DENSE]), col[part]
                    a[at] = weight[part]
                    y += a.T @ (a @ q)
                    a[at] = 0
        yield pa.record_batch([pa.array(np.arange(len(y), dtype=np.int32)), *map(pa.array, y.T)], names=["i", *(f"y{j}" for j in range(width))])

    names = [f"y{j}" for j in range(width)]
    sums = held.mapInArrow(multiply, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros_like(q)
    out[sums.column("i").to_numpy()] = np.column_stack([sums.column(c).to_numpy() for c in names])
    return out
