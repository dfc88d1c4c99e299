"""Text search over an inverted index of trigrams: one call with scope, bounds, counts and limits of time.

Files whose text can't match are never opened: the trigrams that a pattern requires are looked up in the index, and the
pattern runs over the files that have them. A pattern of the user's is matched with a limit on each match, and the whole
search can have a deadline.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..config import DEFAULT
from ..functions.text import WHOLE, match_window, matcher
from ..functions.trigrams import folded, holds, literal, required, trigram_number, trigram_numbers, trigrams_of
from ..sources.folder import READ, Files, files_of
from .service import within
from .tools import _scoped, bounded, line_rows

#: In place of a match's place, where the pattern took too long. What can be matched in linear time runs in the JVM, a user's pattern where its time can be limited.
TIMED_OUT = -1


#: A shelf, the files that one row of postings is about, is full at so many characters, or so many files.
SHELF_CHARS, SHELF_FILES = 2 << 20, 2048


def _shelves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's folded texts, shelf by shelf: a row (shelf, null, null, paths), then (shelf, trigram, places, null) by trigram.

    A shelf's number is that of the task and its own there; only one attempt's rows are written, so a shelf and its postings belong together.
    """
    base = TaskContext.get().partitionId() << 32
    paths: list[str] = []
    found: list[np.ndarray] = []
    chars = 0
    for batch in batches:
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            paths.append(path)
            found.append(trigram_numbers(text or ""))
            chars += len(text or "")
            if chars >= SHELF_CHARS or len(paths) == SHELF_FILES:
                yield from _shelf(base, paths, found)
                base, paths, found, chars = base + 1, [], [], 0
    if paths:
        yield from _shelf(base, paths, found)


def _shelf(shelf: int, paths: list[str], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of one shelf, whose files have these trigrams."""
    numbers = np.concatenate(found)
    places = np.repeat(np.arange(len(found), dtype=np.int16), [len(x) for x in found])
    order = np.argsort(numbers, kind="stable")
    numbers, places = numbers[order], places[order]
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(numbers)), pa.int32()), pa.array(places))
    yield pa.record_batch([pa.array([shelf]), pa.nulls(1, pa.int64()), pa.nulls(1, lists.type), pa.array([paths], pa.list_(pa.string()))], names=SHELVES)
    if len(starts):
        yield pa.record_batch([pa.array(np.full(len(starts), shelf)), pa.array(numbers[starts]), lists, pa.nulls(len(starts), pa.list_(pa.string()))], names=SHELVES)


SHELVES, POSTING = ["shelf", "trigram", "places", "paths"], "trigram long, places array<smallint>"


def timed_place(text: Column, pattern: str, seconds: float = DEFAULT.match_s) -> Column:
    """The 1-based place of the first match, 0 without one, TIMED_OUT if the search took longer than `seconds`; null for a null text.

    Patterns are those that mean the same to Java and to the library that runs them; one that either refuses raises ValueError.
    """
    compiled = _Timed.of(pattern)

    @arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                if t is None:
                    out.append(None)
                    continue
                out.append(compiled.place(t, seconds))
            yield pa.array(out, pa.int32())

    return run(text)


def timed_places(text: Column, wanted: Column, patterns: dict[int, str], seconds: float = DEFAULT.match_s) -> Column:
    """What `timed_place` gives for each of the patterns, in their order, whose number's bit is set in `wanted`; 0 for others."""
    compiled = [(1 << i, _Timed.of(p)) for i, p in patterns.items()]

    @arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, bits in batches:
            out = np.zeros((len(texts), len(compiled)), np.int32)
            for row, (t, b) in enumerate(zip(texts.to_pylist(), bits.to_pylist(), strict=True)):
                for j, (bit, pattern) in enumerate(compiled):
                    if b & bit and t is not None:
                        out[row, j] = pattern.place(t, seconds)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(compiled)), pa.array(out.ravel()))

    return run(text, wanted)


def timed(pattern: str) -> regex.Pattern:
    """The pattern compiled by the library that can limit its time; Java's flag for Unicode is how it works anyway."""
    body = pattern.replace("(?iu)", "(?i)", 1) if pattern.startswith("(?iu)") else pattern
    try:
        return regex.compile(body, regex.V0)
    except regex.error as e:
        raise ValueError(f"not a pattern: {e}") from None


@dataclass
class _Timed:
    """A compiled pattern, and for a whole word the pattern without what stands around it, which is looked for first: where that isn't, neither is the word, and it is found faster."""

    whole: regex.Pattern
    inner: regex.Pattern | None

    @classmethod
    def of(cls, pattern: str) -> _Timed:
        flags, begin, inner = pattern.partition(WHOLE[0])
        is_word = begin and flags in ("", "(?iu)") and inner.endswith(WHOLE[1])
        return cls(timed(pattern), timed(flags + inner.removesuffix(WHOLE[1])) if is_word else None)

    def place(self, text: str, seconds: float) -> int:
        """As `timed_place`; the first look has a tenth of the time, beside that of the pattern itself."""
        if self.inner is not None:
            try:
                if self.inner.search(text, timeout=seconds / 10) is None:
                    return 0
            except TimeoutError:
                pass
        try:
            found = self.whole.search(text, timeout=seconds)
        except TimeoutError:
            return TIMED_OUT
        return 0 if found is None else found.start() + 1


@dataclass
class TextIndex:
    """An inverted index in a folder that every executor reaches: `postings` (trigram, shelf, places), sorted by trigram, `shelves` (shelf, paths), and `files` (path, size) of all that it knows.

    A shelf is some hundred files that one task read; a posting tells their places on it, so postings are gathered before they are shuffled. A file's size and whether it could be read are kept, so that a search counts what it skips without opening anything.
    """

    spark: SparkSession
    root: str

    @classmethod
    def build(cls, files: DataFrame, root: str, max_bytes: int = DEFAULT.search_file_bytes) -> TextIndex:
        """Of files (path, text); a null text could not be read. Those over `max_bytes` are never searched, so they have no postings."""
        spark = files.sparkSession
        size = F.octet_length("text").cast("long")
        files.select("path", size.alias("size")).write.parquet(f"{root}/files")
        rows = files.where(size <= max_bytes).select("path", folded(F.col("text")).alias("text"))
        rows.mapInArrow(_shelves, f"shelf long, {POSTING}, paths array<string>").write.parquet(f"{root}/staged")
        # Read again, as texts are cut once, though ranges are drawn from a sample; and a task that is lost afterwards finds the same shelves.
        staged = spark.read.schema(f"shelf long, {POSTING}, paths array<string>").parquet(f"{root}/staged")
        staged.where("trigram IS NULL").select("shelf", "paths").write.parquet(f"{root}/shelves")
        # By ranges of trigrams and shelves, so that a frequent trigram has several ranges, and a lookup reads the row groups that its trigrams are in.
        postings = staged.where("trigram IS NOT NULL").select("trigram", "shelf", "places").repartitionByRange("trigram", "shelf").sortWithinPartitions("trigram", "shelf")
        postings.write.option("parquet.bloom.filter.enabled#trigram", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{root}/postings")
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/staged")
        done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
        return cls(spark, root)

    def files(self) -> DataFrame:
        return self.spark.read.schema("path string, size long").parquet(f"{self.root}/files")

    def candidates(self, pattern: str, is_regex: bool = False, ignore_case: bool = False) -> DataFrame:
        """(path) of the files that may match: those with the trigrams that the pattern requires; all, if it requires none."""
        condition = required(pattern, ignore_case) if is_regex else literal(pattern, ignore_case)
        wanted = trigrams_of(condition)
        if not wanted:
            return self.files().select("path")
        numbers = {t: trigram_number(t) for t in wanted}
        postings = self.spark.read.schema(f"shelf long, {POSTING}").parquet(f"{self.root}/postings").where(F.col("trigram").isin(list(numbers.values())))
        none = F.array().cast("array<smallint>")
        at = {t: F.coalesce(F.max(F.when(F.col("trigram") == n, F.col("places"))), none) for t, n in numbers.items()}
        may = postings.groupBy("shelf").agg(holds(condition, at, F.array_intersect, F.array_union).alias("may")).where(F.size("may") > 0)
        shelves = self.spark.read.schema("shelf long, paths array<string>").parquet(f"{self.root}/shelves")
        return may.join(shelves, "shelf").select(F.explode(F.transform("may", lambda i: F.get("paths", i))).alias("path")).distinct()


def search_lines(index: TextIndex, files: Files | DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False, scope: str = "", max_bytes: int = DEFAULT.search_file_bytes, match_s: float = DEFAULT.match_s) -> DataFrame:
    """(path, line, place, text): every matching line in scope, as of `grep` over the files in scope; `place` is TIMED_OUT on lines whose match took too long.

    Only files that may match are opened.
    """
    p = matcher(pattern, regex, ignore_case, whole_word)
    some = _scoped(index.candidates(pattern, regex, ignore_case), scope)
    sized = some.join(_scoped(index.files(), scope).where(F.col("size") <= max_bytes).select("path"), "path", "left_semi")
    if isinstance(files, DataFrame):
        opened = files.join(sized, "path", "left_semi").select("path", "text")
    else:
        opened = files_of(files).read(sized).where(F.col("state") == READ).select("path", "text")
    rows = line_rows(opened)
    if regex:
        rows = rows.withColumn("place", timed_place(F.col("text"), p, match_s)).where("place <> 0")
    else:
        rows = rows.where(F.col("text").rlike(p)).withColumn("place", F.regexp_instr("text", F.lit(p)))
    return rows.select("path", "line", "place", match_window(F.col("text"), F.greatest(F.col("place"), F.lit(1))).alias("text"))


#: Patterns that are searched in one reading: the bits of a long, but for its sign.
TOGETHER = 63


def search_many(index: TextIndex, files: Files | DataFrame, patterns: list[tuple[str, dict]], scope: str = "", max_bytes: int = DEFAULT.search_file_bytes, match_s: float = DEFAULT.match_s) -> DataFrame:
    """(pattern, path, line, place, text): what `search_lines` finds for each of (pattern, options), by its number.

    A file is opened, and cut into lines, once for all patterns that may match in it, and tried for those only.
    """
    if len(patterns) > TOGETHER:
        rest = search_many(index, files, patterns[TOGETHER:], scope, max_bytes, match_s).withColumn("pattern", F.col("pattern") + TOGETHER)
        return search_many(index, files, patterns[:TOGETHER], scope, max_bytes, match_s).unionByName(rest)
    compiled = [matcher(p, **o) for p, o in patterns]
    may = [index.candidates(p, o.get("regex", False), o.get("ignore_case", False)).select("path", F.lit(1 << i).alias("bit")) for i, (p, o) in enumerate(patterns)]
    wanted = _scoped(reduce(DataFrame.unionByName, may), scope).groupBy("path").agg(F.bit_or("bit").alias("wanted"))
    sized = wanted.join(_scoped(index.files(), scope).where(F.col("size") <= max_bytes).select("path"), "path", "left_semi")
    opened = files if isinstance(files, DataFrame) else files_of(files).read(sized.select("path")).where(F.col("state") == READ)
    texts = opened.select("path", "text").join(sized, "path")
    rows = line_rows(texts.select(F.struct("path", "wanted").alias("path"), "text")).select("path.*", "line", "text")
    by_user = {i: p for i, (p, (_, o)) in enumerate(zip(compiled, patterns, strict=True)) if o.get("regex", False)}
    at = lambda i, p: F.when((F.col("wanted").bitwiseAND(F.lit(1 << i)) != 0) & F.col("text").rlike(p), F.regexp_instr("text", F.lit(p))).otherwise(0)
    found = rows.withColumn("places", timed_places(F.col("text"), F.col("wanted"), by_user, match_s) if by_user else F.array().cast("array<int>"))
    number = {i: n for n, i in enumerate(by_user)}
    hits = F.array(*[F.struct(F.lit(i).alias("pattern"), (F.get("places", F.lit(number[i])) if i in number else at(i, p)).alias("place")) for i, p in enumerate(compiled)])
    found = found.withColumn("hit", F.explode(F.filter(hits, lambda h: h["place"] != 0)))
    return found.select("hit.pattern", "path", "line", "hit.place", match_window(F.col("text"), F.greatest(F.col("hit.place"), F.lit(1))).alias("text"))


def search_notes(index: TextIndex, scope: str = "", max_bytes: int = DEFAULT.search_file_bytes) -> DataFrame:
    """(searched, oversize, unreadable) files in scope, out of the index."""
    size = F.col("size")
    return _scoped(index.files(), scope).agg(F.count_if(size <= max_bytes).alias("searched"), F.count_if(size > max_bytes).alias("oversize"), F.count_if(size.isNull()).alias("unreadable"))


@dataclass
class Found:
    """The first matches in walk order as (path, line, place, text), and what the search looked at and left out."""

    lines: list[tuple]
    searched: int
    oversize: int
    unreadable: int
    opened: int
    timed_out: int
    truncated: bool
    late: bool


def search_text(index: TextIndex, files: Files | DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False, scope: str = "", most: int = DEFAULT.grep_rows, chars: int = DEFAULT.grep_chars, max_bytes: int = DEFAULT.search_file_bytes, match_s: float = DEFAULT.match_s, seconds: float = DEFAULT.search_s) -> Found:
    """One bounded search with its counts. After `seconds` its jobs are cancelled: then there are no lines, and `late` is set.

    At most `most` lines come to the driver, and one more that tells whether there are others.
    """
    spark = index.spark
    notes = search_notes(index, scope, max_bytes).first()

    def run() -> tuple[list[tuple], int, int, bool]:
        opened = _scoped(index.candidates(pattern, regex, ignore_case), scope).join(index.files().where(F.col("size") <= max_bytes), "path", "left_semi").count()
        hits = search_lines(index, files, pattern, regex, ignore_case, whole_word, scope, max_bytes, match_s)
        late = hits.where(F.col("place") == TIMED_OUT).count() if regex else 0
        hits = hits.where(F.col("place") > 0)
        got = [tuple(r) for r in bounded(hits, most + 1, chars).select("path", "line", "place", "text").collect()]
        shown = got[:most]
        return shown, opened, late, len(got) > most or (0 < len(got) <= most and _more(hits, len(got), most))

    try:
        lines, opened, late, truncated = within(spark, seconds, run)
    except TimeoutError:
        return Found([], notes.searched, notes.oversize, notes.unreadable, 0, 0, True, True)
    return Found(lines, notes.searched, notes.oversize, notes.unreadable, opened, late, truncated, False)


def _more(hits: DataFrame, got: int, most: int) -> bool:
    """Whether a bound on characters cut the lines."""
    return hits.limit(most + 1).count() > got
