"""Toxicity scores of texts restored from disguise.

A noisy channel explains each suspicious token: letters may be written as look-alikes, spaced out,
or repeated. The possible readings of its characters form a lattice, and the Viterbi path under a
character bigram model of the corpus is the restored word; in a run of spaced letters it may be
several. A logistic model over the restored words and their beginnings gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fold, map_arrow, small_pieces, table

THRESHOLD = 0.3
#: Labelled rows that the classifier is fitted on, at most; those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Rows of a class, at least, and log-likelihood ratio (0.1 % by chance) that a feature of the classifier needs.
MIN_ROWS, MIN_RATIO = 3, 10.83
PREFIXES = (3, 4, 5, 6)
#: Code points below this have a class of their own in the character model; the rest share one.
ALPHABET = 592
OTHER, EDGE = ALPHABET, ALPHABET + 1
STATES = ALPHABET + 2

#: Letters that a character may stand for, besides itself.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Natural logs of the channel: a look-alike, a separator dropped, a letter dropped that repeats the one before, or the two before, a digit or sign left out though none of these.
SUBSTITUTE, SEPARATE, DOUBLE, REPEAT, STRAY = -1.0, -0.7, -2.5, -0.4, -6.0
SEPARATORS = frozenset(".-_*~,;:'`^·​ ")
#: Letters of a word that is looked for within a run of spaced letters, at most.
LONGEST = 24
#: Restored tokens and their features that a Python worker remembers, in each of two generations.
CACHED = 150_000

_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+[.,;:!?]?")
_TWICE, _THRICE = re.compile(r"(.)\1+"), re.compile(r"(.)\1\1")
_ALONE = re.compile(r"[^\w\s]?[\w@$!|+(€£][.,;:!?'\")\]…]*")
_EDGES = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$|+(€£]+$")


def _state(c: str) -> int:
    o = ord(c)
    return o if o < ALPHABET else OTHER


def restore(token: str, lm: np.ndarray) -> str:
    """The likeliest letters behind a lower-case token; `lm[a, b]` is the log probability of b after a.

    A space, which only runs of single characters hold, is dropped or ends a word. Letters alone can only
    be repeats: each is its own next state, so the path is the better of keeping and dropping at each.
    """
    if token.isalpha():

        def run(m: re.Match) -> str:
            again = float(lm[_state(m[1]), _state(m[1])])
            return m[0][: 2 if again > DOUBLE else 1] + (m[0][2:] if again > REPEAT else "")

        return _TWICE.sub(run, token)
    return viterbi(token, lm)


def viterbi(token: str, lm: np.ndarray) -> str:
    """The likeliest path through the lattice of a token's readings."""
    best: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}  # by last letter: log probability, letters as a linked list
    for i, c in enumerate(token):
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
        options += [(x, SUBSTITUTE) for x in LOOKALIKES.get(c, "")]
        again = c.isalpha() and i > 0 and c == token[i - 1]
        drop = SEPARATE if c in SEPARATORS else STRAY if not c.isalpha() else None if not again else REPEAT if i > 1 and c == token[i - 2] else DOUBLE
        new: dict[str, tuple[float, tuple | None]] = {}
        for last, (p, path) in best.items():
            if drop is not None and p + drop > new.get(last, (-math.inf, None))[0]:
                new[last] = (p + drop, path)
            row = lm[_state(last) if last else EDGE]
            if c == " " and last and p + row[EDGE] > new.get("", (-math.inf, None))[0]:
                new[""] = (p + row[EDGE], (" ", path))
            for x, cost in options:
                q = p + cost + row[_state(x)]
                if q > new.get(x, (-math.inf, None))[0]:
                    new[x] = (q, (x, path))
        best = new
    p, path = max(((p + lm[_state(last) if last else EDGE, EDGE], path) for last, (p, path) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def tokens(text: str | None) -> list[str]:
    """Lower-case tokens between white space; three or more single characters in a row, the letters with punctuation or not, are also one token with spaces."""
    parts = (text or "").lower().split()
    single = np.fromiter(map(len, parts), np.int64, len(parts)) == 1
    if single.sum() >= 2:
        # Characters with punctuation count in a run, whose others are single.
        beside = np.pad(single, 1)
        for i in np.flatnonzero(~single & (beside[:-2] | beside[2:])).tolist():
            single[i] = _ALONE.fullmatch(parts[i]) is not None
        step = np.diff(np.concatenate([[0], single.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True):
            if b - a >= 3:
                parts.append(" ".join(parts[a:b]))
    return parts


def restored(token: str, lm: np.ndarray) -> set[str]:
    """The restored word, and that with each letter once where it still repeats: the bigrams may speak for 'll' at the begin of a word."""
    word = restore(token, lm)
    return {word, _TWICE.sub(r"\1", word)}


def readings(token: str, lm: np.ndarray) -> set[str]:
    """The words of a token as it stands, and the restored word if something in it is suspicious; of a run with spaces, as one word and as the words on its likeliest path."""
    if " " in token:
        words = readings(token.replace(" ", ""), lm)
        for word in restore(_EDGES.sub("", token), lm).split():
            words |= {word, _TWICE.sub(r"\1", word)}
        return words
    if _PLAIN.fullmatch(token) and not _THRICE.search(token):
        word = token.rstrip(".,;:!?")
        return {word} | restored(word, lm) if _TWICE.search(word) else {word}
    words = set(_LETTERS.findall(token))
    core = _EDGES.sub("", token)
    if core and not core.isdigit() and any(c.isalpha() for c in core) or len(core) >= 3 and any(c in LOOKALIKES for c in core):
        words |= restored(core, lm)
    words.discard("")
    return words


def within(token: str, lm: np.ndarray) -> Iterator[str]:
    """All stretches of a run's restored letters that may be words: bigrams alone do not tell well where words begin."""
    letters = restore(_EDGES.sub("", token.replace(" ", "")), lm)
    for i in range(len(letters)):
        for j in range(i + 3, min(i + LONGEST, len(letters)) + 1):
            yield letters[i:j]


def features_of(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)]


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: how often each letter follows each; words begin and end at EDGE."""
    total = np.zeros(STATES * STATES, np.int64)
    from .langid import letters

    for batch in batches:
        for piece in small_pieces(batch, "text"):
            text = "\n" + "\n".join((t or "").lower() for t in piece.column("text").to_pylist()) + "\n"
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.where(letters()[code], np.minimum(code, OTHER), EDGE).astype(np.int64)
            total += np.bincount(s[:-1] * STATES + s[1:], minlength=STATES * STATES)
    pairs = np.flatnonzero(total)
    yield pa.record_batch([pa.array(pairs), pa.array(total[pairs])], names=["pair", "n"])


def letter_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of letters after letters over all the texts; at most STATES squared counts reach the driver."""
    counts = map_arrow(docs.select(F.col(text_col).alias("text")), _count_letters, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.full((STATES, STATES), 0.01)
    for r in counts:
        n[divmod(r.pair, STATES)] += r.n
    n[EDGE, EDGE] = 0.01
    return np.log(n / n.sum(1, keepdims=True))


@dataclass
class Model:
    lm: np.ndarray
    weights: dict[str, float]
    bias: float
    _cache: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    _older: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def known(self, token: str) -> tuple[str, ...]:
        """The classifier's features in a token."""
        got = self._cache.get(token)
        if got is None:
            if len(self._cache) >= CACHED:
                self._older = dict(self._cache)
                self._cache.clear()
            if (got := self._older.get(token)) is not None:
                self._cache[token] = got
                return got
            words = readings(token, self.lm)
            if " " in token:
                words |= {w for w in within(token, self.lm) if w + "$" in self.weights}
            got = self._cache[token] = tuple(f for w in words for f in features_of(w) if f in self.weights)
        return got

    def score(self, text: str | None) -> float:
        found = set().union(*map(self.known, set(tokens(text))))
        z = self.bias + math.fsum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def _labelled(label_rows: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """(text, y) of the fit rows: at most `rows`, so they are broadcast to the documents."""
    fit = label_rows.orderBy(F.xxhash64(F.lit(9), "id"), "id", "y").limit(rows)
    return docs.join(F.broadcast(fit), "id").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows given; the character model is counted over all texts.

    Rows of null id, text or label teach nothing. Without both labels the score is the share of 1.
    """
    lm = letter_model(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(lm)
    rows = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("y")).where("id is not null and y is not null").distinct()
    sample = _labelled(rows, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null"), fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                words = set().union(*(readings(t, shared.value) for t in set(tokens(text.as_py()))))
                for f in {f for w in words for f in features_of(w)} | {""}:
                    seen.setdefault(f, [0, 0])[y] += 1
        names = list(seen)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.record_batch([pa.array(part, pa.string()), pa.array([seen[f][0] for f in part], pa.int64()), pa.array([seen[f][1] for f in part], pa.int64())], names=["f", "n0", "n1"])

    counts = map_arrow(sample, count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    try:
        if not (whole := counts.where("f = ''").first()) or not whole.n0 or not whole.n1:
            share = (whole.n1 / (whole.n0 + whole.n1)) if whole else 0.0
            return Model(lm, {}, 30.0 if share == 1 else -30.0)
        n0, n1 = whole.n0, whole.n1
        total, log = n0 + n1, lambda x: f"if({x} > 0, ({x}) * ln({x}), 0)"
        cells = " + ".join(map(log, ("n0", "n1", f"({n0}D - n0)", f"({n1}D - n1)")))
        ratio = F.expr(f"2 * ({cells} - {log('(n0 + n1)')} - {log(f'({total}D - n0 - n1)')}) - {2 * (math.log(n0) * n0 + math.log(n1) * n1 - math.log(total) * total)!r}D")
        top = [r.f for r in counts.where(f"f <> '' and greatest(n0, n1) >= {MIN_ROWS}").where(ratio >= MIN_RATIO).orderBy("f").select("f").collect()]
    finally:
        counts.unpersist()
    place = {f: i for i, f in enumerate(top)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, dict.fromkeys(place, 0.0), 0.0)
        for batch in batches:
            found = [sorted(place[f] for f in set().union(*map(model.known, set(tokens(t.as_py()))))) for t in batch.column("text")]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column("y")], names=["x", "y"])

    # As many patterns as fit rows at most; equal ones are counted first.
    patterns = map_arrow(sample, present, "x array<int>, y int").groupBy("x", "y").count().collect()
    patterns = sorted((tuple(r.x), r.y, r["count"]) for r in patterns)
    y, n = (np.array([p[k] for p in patterns], np.float64) for k in (1, 2))
    w = logistic([p[0] for p in patterns], len(top), y, n)
    return Model(lm, {f: float(w[i]) for f, i in place.items()}, float(w[-1]))


def logistic(on: list[tuple[int, ...]], features: int, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression on the features that are 1 in each row, by Newton's method with conjugate gradients; the last weight is the bias, hardly penalised."""
    row = np.repeat(np.arange(len(on)), [len(x) for x in on])
    col = np.fromiter((i for x in on for i in x), np.int64, len(row))
    times = lambda w: np.bincount(row, w[col], len(on)) + w[-1]
    back = lambda r: np.append(np.bincount(col, r[row], features), r.sum())
    penalty = np.append(np.full(features, ridge), 1e-3)
    w = np.zeros(features + 1)

    def loss(w: np.ndarray) -> float:
        z = times(w)
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        g, h = back(n * (p - y)) + penalty * w, n * p * (1 - p)
        diagonal, step, r = back(h) + penalty, np.zeros_like(w), g.copy()
        d = r / diagonal
        first = rz = r @ d
        for _ in range(200):
            if rz < max(1e-16, 1e-4 * first):  # the next step of Newton's goes on from there
                break
            hd = back(h * times(d)) + penalty * d
            a = rz / (d @ hd)
            step += a * d
            r -= a * hd
            z = r / diagonal
            rz, before = r @ z, rz
            d = z + rz / before * d
        while (after := loss(w - step)) > now + 1e-9 * abs(now) and np.abs(step).max() > 1e-6:
            step /= 2
        w, now = w - step, after
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(spark: SparkSession, text: Column, model: Model) -> Column:
    """The score; null and empty texts get that of a text without features."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Whether the id's fold is kept from learning; a null id's is."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(True))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(spark, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
