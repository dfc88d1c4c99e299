"""Exact tools over files: listing, finding, reading, searching, editing; status, history and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, METADATA_DIR
from ..functions.text import glob_pattern, lines, match_window, matcher, newline_of
from .ranks import nearest_rank, select


def inspect_directory(paths: DataFrame, directory: str = "", most: int = DEFAULT.listing) -> DataFrame:
    """(name, is_directory) of the direct children, by name; the metadata folder is hidden, and so are links, where `paths` has a column `link`."""
    names = _children(paths, directory)
    if "link" in paths.columns:
        names = names.where("not link")
    return names.select("name", "is_directory").distinct().orderBy("name").limit(most)


def _children(paths: DataFrame, directory: str) -> DataFrame:
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    link = [F.coalesce(F.col("link"), F.lit(False)).alias("link")] if "link" in paths.columns else []
    below = paths.where(F.col("path").startswith(prefix)).select(F.split(F.substring("path", F.lit(len(prefix) + 1), F.length("path")), "/").alias("s"), *link)
    rows = below.select(F.get("s", F.lit(0)).alias("name"), (F.size("s") > 1).alias("is_directory"), *[c for c in ("link",) if link])
    return rows.where(F.lower("name") != METADATA_DIR.lower())


def directory_notes(paths: DataFrame, directory: str = "", most: int = DEFAULT.listing) -> DataFrame:
    """(entries, hidden_links, truncated) of a directory whose `paths` have a column `link`: what its listing shows and leaves out."""
    names = _children(paths, directory).groupBy("name").agg(F.min(F.col("link")).alias("link"))
    n = names.agg(F.count_if(~F.col("link")).alias("n"), F.count_if("link").alias("hidden_links"))
    return n.select(F.least("n", F.lit(most)).alias("entries"), "hidden_links", (F.col("n") > most).alias("truncated"))


def walk_key(path: Column) -> Column:
    """Sorts paths as a walk does: a directory's files by name, then its subdirectories in order."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.struct((i < F.size(parts) - 1).cast("int").alias("below"), p.alias("name")))


def find_files(paths: DataFrame, glob: str, most: int | None = DEFAULT.glob_rows, examined: int | None = None) -> DataFrame:
    """Paths that fit the glob, in walk order; with `examined`, among the first so many only."""
    if examined is not None:
        paths = paths.orderBy(walk_key(F.col("path"))).limit(examined)
    found = paths.where(F.col("path").rlike(glob_pattern(glob))).select("path")
    return found if most is None else found.orderBy(walk_key(F.col("path"))).limit(most)


def line_rows(files: DataFrame) -> DataFrame:
    """(path, line, text), lines numbered from 1."""
    return files.select("path", F.posexplode(lines(F.col("text"))).alias("i", "line_text")).select("path", (F.col("i") + 1).alias("line"), F.col("line_text").alias("text"))


def grep(files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, whole_word: bool = False) -> DataFrame:
    """(path, line, place, text): every matching line, the 1-based place of its first match and a window around it."""
    p = matcher(pattern, regex, ignore_case, whole_word)
    hit = line_rows(files).where(F.col("text").rlike(p))
    at = F.regexp_instr("text", F.lit(p))
    return hit.select("path", "line", at.alias("place"), match_window(F.col("text"), at).alias("text"))


def in_scope(files: DataFrame, scope: str = "", max_bytes: int = DEFAULT.search_file_bytes) -> DataFrame:
    """The files that a search in a path (a file, or a directory and all below it) looks into: those that are not too large."""
    return _scoped(files, scope).where(F.octet_length("text") <= max_bytes)


def _scoped(files: DataFrame, scope: str) -> DataFrame:
    at = scope.strip("/")
    return files.where((F.col("path") == at) | F.col("path").startswith(at + "/")) if at else files


def search_counts(files: DataFrame, scope: str = "", max_bytes: int = DEFAULT.search_file_bytes) -> DataFrame:
    """(searched, oversize, unreadable) files of a search; those of null text could not be read."""
    size = F.octet_length("text")
    return _scoped(files, scope).agg(F.count_if(size <= max_bytes).alias("searched"), F.count_if(size > max_bytes).alias("oversize"), F.count_if(size.isNull()).alias("unreadable"))


def bounded(hits: DataFrame, most: int = DEFAULT.grep_rows, chars: int = DEFAULT.grep_chars) -> DataFrame:
    """The first matches in walk order, until a bound is met; the first is always there. A sort with limit, then a sum over at most `most` rows."""
    first = hits.withColumn("w", walk_key(F.col("path"))).orderBy("w", "line").limit(most)
    order = Window.orderBy("w", "line")
    summed = first.withColumn("sum", F.sum(F.length("text")).over(order)).withColumn("n", F.row_number().over(order))
    over = F.min(F.when((F.col("sum") > chars) & (F.col("n") > 1), F.col("n"))).over(Window.partitionBy())
    return summed.withColumn("stop", over).where("stop is null or n < stop").drop("w", "sum", "n", "stop")


def read_lines(files: DataFrame, start: int = 1, end: int | None = None, most: int = DEFAULT.read_lines, chars: int = DEFAULT.grep_chars) -> DataFrame:
    """(path, line, text) of each file's range of lines, cut where it passes a bound; the first line is always there."""
    stop = start + most - 1 if end is None else min(end, start + most - 1)
    part = files.select("path", lines(F.col("text")).alias("l")).select("path", F.posexplode(F.slice("l", start, max(0, stop - start + 1))).alias("i", "text"))
    used = F.sum(F.length("text")).over(Window.partitionBy("path").orderBy("i"))
    return part.withColumn("used", used).where((F.col("used") <= chars) | (F.col("i") == 0)).select("path", (F.col("i") + start).alias("line"), "text")


def read_notes(files: DataFrame, start: int = 1, end: int | None = None, most: int = DEFAULT.read_lines, chars: int = DEFAULT.grep_chars) -> DataFrame:
    """(path, total, returned, truncated, next_line, version, note) of the same ranges as read_lines: where each was cut and where to go on.

    No row per line: the lines that fit are counted within the array of their lengths.
    """
    if start < 1 or (end is not None and end < start):
        raise ValueError("lines are counted from 1, and end after they start")
    stop = start + most - 1 if end is None else min(end, start + most - 1)
    sizes = F.transform(lines(F.col("text")), F.length)
    rows = files.select("path", F.left(F.sha2("text", 256), F.lit(16)).alias("version"), sizes.alias("sizes")).withColumn("total", F.size("sizes"))
    rows = rows.withColumn("asked", F.when(F.col("total") >= start, F.slice("sizes", start, max(0, stop - start + 1))).otherwise(F.array().cast("array<int>")))
    step = lambda s, n: F.when(s["stop"] | ((s["n"] > 0) & (s["used"] + n > chars)), F.struct(s["used"].alias("used"), s["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(F.struct((s["used"] + n).alias("used"), (s["n"] + 1).alias("n"), F.lit(False).alias("stop")))
    none = F.struct(F.lit(0).cast("int").alias("used"), F.lit(0).cast("int").alias("n"), F.lit(False).alias("stop"))
    rows = rows.withColumn("got", F.aggregate("asked", none, step))
    wanted = F.col("total") if end is None else F.least(F.lit(end), F.col("total"))
    by_chars, by_lines = F.col("got.stop"), ~F.col("got.stop") & (wanted > stop)
    following = F.lit(start) + F.col("got.n")
    stopped = lambda why: F.format_string(f"stopped after {why}; line %d of %d is next", following, F.col("total"))
    note = F.when(by_chars, stopped(f"{chars} characters")).when(by_lines, stopped(f"{most} lines")).when(F.col("total") == 0, "no lines").when(F.col("got.n") == 0, F.format_string(f"{start} is past the last line, %d", "total"))
    if end is not None:
        note = note.when(F.lit(end) > F.col("total"), F.format_string("ends early, with line %d", "total"))
    cut = by_chars | by_lines
    return rows.select("path", "total", F.col("got.n").alias("returned"), cut.alias("truncated"), F.when(cut, following).alias("next_line"), "version", note.alias("note"))


def file_text(files: DataFrame, most: int = DEFAULT.read_chars) -> DataFrame:
    """(path, text, size_bytes, version, truncated) of whole files, cut at `most` characters."""
    text = F.col("text")
    return files.select("path", F.left(text, F.lit(most)).alias("text"), F.octet_length(text).cast("long").alias("size_bytes"), F.left(F.sha2(text, 256), F.lit(16)).alias("version"), (F.length(text) > most).alias("truncated"))


def replace_lines(text: Column, start: int, end: int, replacement: str) -> Column:
    """The text with lines start to end replaced, its own line ends kept; a range outside the text raises an error."""
    span = r"(?:[^\r\n]*(?:\r\n|\r|\n|\z))"
    ended = F.when(F.lit(bool(replacement)) & (F.size(lines(text)) > end), F.concat(F.lit(replacement), newline_of(text))).otherwise(F.lit(replacement))
    new = F.regexp_replace(text, F.lit(rf"\A({span}{{{start - 1}}}){span}{{{end - start + 1}}}"), F.concat(F.lit("$1"), F.regexp_replace(ended, r"([\\$])", r"\\$1")))
    return F.when((F.lit(start) >= 1) & (F.lit(end) >= start) & (F.size(lines(text)) >= end), new).otherwise(F.raise_error(F.concat(F.lit("the text has lines 1 to "), F.size(lines(text)).cast("string"))).cast("string"))


def status_counts(manifest: DataFrame) -> DataFrame:
    """Delivered and pending among the active files."""
    delivered = F.col("last_synced_hash").isNotNull() & (F.col("last_synced_hash") == F.col("hash"))
    return manifest.where("status = 'active'").agg(F.count_if(delivered).alias("delivered"), F.count_if(~delivered).alias("pending"), F.count("*").alias("active"))


def failed_latest(outbox: DataFrame, most: int = 20) -> DataFrame:
    """Each failed file's latest failure, by path; one more than `most` rows tells that there are more."""
    return outbox.where("status = 3").groupBy("file_path").agg(F.max_by(F.struct("error", "attempts"), "id").alias("x"), F.max("id").alias("id")).select("file_path", "id", "x.error", "x.attempts").orderBy("file_path").limit(most + 1)


def index_status(manifest: DataFrame, outbox: DataFrame, most: int = 20) -> DataFrame:
    """One row: delivered, pending and active files, those whose latest operations failed, the first `most` failures by path, and whether there are more."""
    failed = failed_latest(outbox, most).withColumn("n", F.row_number().over(Window.orderBy("file_path")))
    shown = F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("file_path", "error", "attempts"))))
    sample = failed.agg(shown.alias("failures"), (F.count("*") > most).alias("more_failures"))
    counts = outbox.where("status = 3").agg(F.countDistinct("file_path").alias("failed"))
    # Single rows each.
    return status_counts(manifest).crossJoin(counts).crossJoin(sample)


def history(conversations: DataFrame, messages: DataFrame, most: int = 50) -> DataFrame:
    """(conversation_id, updated, messages, place, truncated): the latest conversations first, ties by id; `truncated` tells that there are more. Sorts `most` + 1 rows at the end, not the table."""
    latest = conversations.orderBy(F.desc("updated"), "conversation_id").limit(most + 1)
    order = Window.orderBy(F.desc("updated"), "conversation_id")
    rows = latest.withColumn("place", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most).where(F.col("place") <= most)
    # Only the messages of those few are counted.
    counts = messages.join(F.broadcast(rows.select("conversation_id")), "conversation_id", "left_semi").groupBy("conversation_id").agg(F.count("*").alias("messages"))
    return rows.join(F.broadcast(counts), "conversation_id", "left").select("conversation_id", "updated", F.coalesce("messages", F.lit(0)).alias("messages"), "place", "truncated")


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    return conversations.join(counts, "conversation_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def conversation_tail(messages: DataFrame, n: int = 200, chars: int = 4000) -> DataFrame:
    """The latest n messages of each conversation in order, long texts cut, with the number left out."""
    w = Window.partitionBy("conversation_id")
    rows = messages.withColumn("back", F.row_number().over(w.orderBy(F.desc("seq")))).withColumn("total", F.count("*").over(w)).where(F.col("back") <= n)
    return rows.select("conversation_id", "seq", "agent_name", F.left("text", F.lit(chars)).alias("text"), (F.length("text") > chars).alias("truncated"), F.greatest(F.lit(0), F.col("total") - n).alias("omitted"))


def allocate_sequence(next_seq: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (conversation_id, at) numbered on from each conversation's next number, 1 for a new one."""
    order = F.row_number().over(Window.partitionBy("conversation_id").orderBy("at"))
    return new.join(next_seq, "conversation_id", "left").withColumn("seq", F.coalesce("next_seq", F.lit(1)) + order - 1).drop("next_seq")


def message_fields(message_json: Column) -> Column:
    """Role, text and number of tool calls; an unreadable message is a row of that role, not an error."""
    m, ok = _message(message_json)
    return F.struct(F.when(ok, m["role"]).otherwise("unreadable").alias("role"), F.when(ok, m["text"]).alias("text"), F.when(ok, F.coalesce(F.size(m["tool_calls"]), F.lit(0))).otherwise(0).alias("tool_calls"))


def _message(message_json: Column) -> tuple[Column, Column]:
    kind = "role string, text string, tool_calls array<struct<name string, arguments map<string, string>>>, tool_results array<string>, _corrupt string"
    m = F.from_json(message_json, kind, {"columnNameOfCorruptRecord": "_corrupt"})
    return m, m.isNotNull() & m["_corrupt"].isNull() & m["role"].isNotNull()


def transcript(message_json: Column, chars: int = DEFAULT.message_chars) -> Column:
    """Role, text, calls (name(argument=value, ...), arguments by name), results and whether the text was cut; long texts, calls and results are cut. An unreadable message has no more than that role."""
    m, ok = _message(message_json)
    cut = lambda c: F.left(c, F.lit(chars))
    arguments = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c["arguments"])), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ", ")
    calls = F.transform(m["tool_calls"], lambda c: F.concat(c["name"], F.lit("("), cut(F.coalesce(arguments(c), F.lit(""))), F.lit(")")))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(ok, m["role"]).otherwise("unreadable").alias("role"), F.when(ok & (m["text"] != ""), cut(m["text"])).alias("text"), F.coalesce(F.when(ok, calls), none).alias("calls"),
        F.coalesce(F.when(ok, F.transform(m["tool_results"], lambda r: F.coalesce(cut(r), F.lit("")))), none).alias("results"), F.coalesce(ok & (F.length(m["text"]) > chars), F.lit(False)).alias("truncated"),
    )


def telemetry(points: DataFrame, tags: list[str], value: str, width: float, buckets: int) -> DataFrame:
    """Count, mean and fixed-width histogram buckets of a value by tags; the last bucket takes the rest."""
    bucket = F.least(F.floor(F.col(value) / width), F.lit(buckets)).cast("int")
    return points.withColumn("bucket", bucket).groupBy(*tags, "bucket").agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))


def percentiles(points: DataFrame, tags: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles and the median, without a task that sees all values of a group."""
    ranks = {f"p{t // 10}": nearest_rank(t) for t in (500, 950, 990)} | {"low": F.expr("(n + 1) div 2"), "high": F.expr("n div 2 + 1")}
    found = select(points, tags, value, ranks)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col(value)))
    return found.groupBy(*tags).agg(at("p50").alias("p50"), at("p95").alias("p95"), at("p99").alias("p99"), ((at("low") + at("high")) / 2).alias("median"))
