"""Snapshots, change folding, the manifest and the delivery queue, as batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, IGNORED_DIRS, METADATA_DIR, TEXT_EXTENSIONS
from ..functions.text import extension
from ..sources.shared import cut

PENDING, IN_FLIGHT, DONE, FAILED = range(4)


def indexable(path: Column, size: Column | None = None, extensions: tuple[str, ...] = TEXT_EXTENSIONS, max_bytes: int = DEFAULT.max_file_bytes, metadata_dir: str = METADATA_DIR) -> Column:
    """No temporary file, a known extension, no segment ignored, and not too large."""
    segments = F.split(path, "/")
    ok = ~F.lower(path).endswith(".tmp") & extension(path).isin(*extensions) & ~F.exists(segments, lambda s: s.isin(metadata_dir, *IGNORED_DIRS))
    return ok if size is None else ok & (size <= max_bytes)


def snapshot_diff(disk: DataFrame, recorded: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(path, change, hash, size, created): what turns the recorded snapshot into the one on disk. A file that couldn't be read is not removed; a modified one keeps its creation time."""
    d, r = (x.select("path", *[F.col(c).alias(f"{p}_{c}") for c in ("hash", "size", "created")]) for x, p in ((disk, "d"), (recorded, "r")))
    both = d.join(r, "path", "full_outer")
    change = F.when(F.col("r_hash").isNull(), "Added").when(F.col("d_hash").isNull(), "Removed").when(F.col("d_hash") != F.col("r_hash"), "Modified")
    out = both.withColumn("change", change).where("change is not null")
    if skipped is not None:
        gone = out.where("change = 'Removed'").join(skipped.select("path"), "path", "left_anti")
        out = out.where("change <> 'Removed'").unionByName(gone)
    created = F.when(F.col("change") == "Removed", F.lit(None)).otherwise(F.coalesce("r_created", "d_created"))
    return out.select("path", "change", F.col("d_hash").alias("hash"), F.col("d_size").alias("size"), created.alias("created"))


def directory_of(path: Column) -> Column:
    """The path without its last segment; empty at the top."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def tree_digests(files: DataFrame) -> DataFrame:
    """(directory, own, tree, files) of (path, sign): the digests of the files directly in each directory and of all below it, and their number.

    Digests are sums of hashes, so that a directory's files are added up where they are and never meet, whatever their number.
    A directory's sums go up to all that it is in, a row for each level.
    """
    # Two hashes with different seeds; sums of 64 bits wrap around, so they are taken by halves.
    halves = [F.col(h) for h in ("a", "b")]
    signs = files.select(directory_of(F.col("path")).alias("directory"), F.xxhash64("path", "sign").alias("a"), F.xxhash64(F.lit(1), "sign", "path").alias("b"))
    split = [e.alias(f"{n}{i}") for n, h in zip("ab", halves, strict=True) for i, e in enumerate((F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1))))]
    sums = ["a0", "a1", "b0", "b1"]
    own = signs.select("directory", *split).groupBy("directory").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n"))
    parts = F.when(F.col("directory") == "", F.array().cast("array<string>")).otherwise(F.split("directory", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory"), (i == F.size(parts)).alias("own")))
    up = own.select(*sums, "n", F.explode(above).alias("up")).select("up.*", *sums, "n")
    trees = up.groupBy("directory").agg(*[F.sum(c).alias(c) for c in sums], F.sum("n").alias("files"), *[F.coalesce(F.max(F.when(F.col("own"), F.col(c))), F.lit(0)).alias(f"o_{c}") for c in sums])
    digest = lambda pre: F.concat_ws(".", *[F.hex(f"{pre}{c}") for c in sums])
    return trees.select("directory", digest("o_").alias("own"), digest("").alias("tree"), "files")


def changed_directories(a: DataFrame, b: DataFrame) -> DataFrame:
    """(directory) of the directories whose own files differ between two relations (path, sign); none if the digests of the roots are equal."""
    x, y = tree_digests(a), tree_digests(b)
    both = x.select("directory", F.col("own").alias("x")).join(y.select("directory", F.col("own").alias("y")), "directory", "full_outer")
    # A directory that only leads to others has no files of its own, on one side or both.
    nothing = F.lit("0.0.0.0")
    return both.where(F.coalesce("x", nothing) != F.coalesce("y", nothing)).select("directory")


def in_directories(files: DataFrame, directories: DataFrame) -> DataFrame:
    """The files directly in the directories."""
    return files.withColumn("__d", directory_of(F.col("path"))).join(directories.withColumnRenamed("directory", "__d"), "__d", "left_semi").drop("__d")


def snapshot_diff_by_tree(disk: DataFrame, recorded: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """`snapshot_diff` of the directories alone whose digests differ; files of others never meet."""
    sign = lambda df: df.select("path", F.col("hash").alias("sign"))
    where = changed_directories(sign(disk), sign(recorded))
    return snapshot_diff(in_directories(disk, where), in_directories(recorded, where), skipped)


def classify(files: DataFrame, states: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, disposition): Embed if changed in this pass or without vectors, Deferred if its recorded hash is not yet the file's, else Unchanged."""
    marked = changed.select("path", F.lit(True).alias("is_changed"))
    rows = files.select("path", "hash").join(states.select("path", F.col("hash").alias("recorded"), "has_vectors"), "path", "left").join(marked, "path", "left")
    disposition = F.when(F.col("is_changed") | F.col("recorded").isNull() | ~F.col("has_vectors"), "Embed").when(F.col("recorded") != F.col("hash"), "Deferred").otherwise("Unchanged")
    return rows.select("path", disposition.alias("disposition"))


def apply_changes(manifest: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The manifest after the changes: upserts and soft deletes. The first creation time stays; a path that comes back after its deletion has nothing delivered."""
    c = changes.select("path", "change", *[F.col(x).alias(f"c_{x}") for x in ("hash", "size", "created")])
    both = manifest.join(c, "path", "full_outer")
    removed = F.col("change") == "Removed"
    upsert = F.col("change").isin("Added", "Modified")
    return both.where(~(F.col("status").isNull() & removed)).select(
        "path",
        F.when(upsert, F.col("c_hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(upsert, F.col("c_size")).otherwise(F.col("size")).alias("size"),
        F.when(removed, "deleted").when(upsert, "active").otherwise(F.col("status")).alias("status"),
        F.coalesce("created", "c_created").alias("created"),
        F.when(upsert & (F.col("status") == "deleted"), F.lit(None)).otherwise(F.col("last_synced_hash")).alias("last_synced_hash"),
        F.when(F.col("change").isNotNull(), now).otherwise(F.col("updated")).alias("updated"),
    )


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """The rows with `place`, from 0 in the order of `by`.

    Places are dealt in ranges, so that no window sees all rows. Ranges are drawn from a sample and joined by size, so another
    run may cut them elsewhere: they are written once, and a range's size and its rows are read from that.
    """
    dealt = cut(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()))
    # The number has the range in its upper bits, and the place there in the lower 33.
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("__part", part).join(F.broadcast(before), "__part").select(*rows.columns, place.alias("place"))


def enqueue(changes: DataFrame, first_id: int, now: Column) -> DataFrame:
    """Outbox rows of the changes, numbered in the order of their paths."""
    rows = numbered(changes.select("path", "change"), "path")
    return rows.select((F.lit(first_id) + F.col("place")).alias("id"), F.col("path").alias("file_path"), F.when(F.col("change") == "Removed", 1).otherwise(0).alias("op_type"), F.lit(PENDING).alias("status"), F.lit(0).alias("attempts"), now.alias("created_utc"), now.alias("next_attempt_utc"), F.lit(None).cast("string").alias("error"))


def fold_kinds(kinds: Column) -> Column:
    """The net of kinds in order; null where creation and deletion cancel out, after which the next kind starts anew."""
    def step(state: Column, kind: Column) -> Column:
        return (
            F.when(state == "", kind)
            .when((state == "Created") & (kind == "Deleted"), "")
            .when(state == "Created", "Created")
            .when((state == "Deleted") & (kind == "Created"), "Modified")
            .when(state == "Deleted", "Deleted")
            .otherwise(kind)
        )

    return F.nullif(F.aggregate(kinds, F.lit(""), step), F.lit(""))


def debounce(events: DataFrame, quiet_us: int) -> DataFrame:
    """(path, settled, kind, n) from (path, kind, ts, seq): an event after a quiet window begins a new burst; each burst settles to one change or none."""
    order = Window.partitionBy("path").orderBy("ts", "seq")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    burst = F.sum(F.when(gap.isNull() | (gap >= quiet_us), 1).otherwise(0)).over(order)
    bursts = events.withColumn("burst", burst).groupBy("path", "burst").agg(F.max("ts").alias("last"), F.array_sort(F.collect_list(F.struct("ts", "seq", "kind"))).alias("e"))
    return bursts.select("path", "last", F.size("e").alias("n"), fold_kinds(F.transform("e", lambda x: x.kind)).alias("kind"))


def expand_renames(events: DataFrame) -> DataFrame:
    """A rename becomes the deletion of its old path and the creation of its new one."""
    pair = F.array(F.struct(F.col("old_path").alias("path"), F.lit("Deleted").alias("kind")), F.struct(F.col("path"), F.lit("Created").alias("kind")))
    one = F.array(F.struct(F.col("path"), F.col("kind")))
    return events.select("seq", "ts", F.explode(F.when(F.col("kind") == "Renamed", pair).otherwise(one)).alias("e")).select("seq", "ts", "e.path", "e.kind")


def claim(outbox: DataFrame, now: Column, most: int = 32) -> DataFrame:
    """The first due operations by id, in flight."""
    return outbox.where((F.col("status") == PENDING) & (F.col("next_attempt_utc") <= now)).orderBy("id").limit(most).withColumn("status", F.lit(IN_FLIGHT))


def requeue(outbox: DataFrame) -> DataFrame:
    """Operations that were in flight when the last run ended are due again."""
    return outbox.withColumn("status", F.when(F.col("status") == IN_FLIGHT, PENDING).otherwise(F.col("status")))


def backoff_s(attempts: Column, base: float = DEFAULT.backoff_s, cap: float = DEFAULT.backoff_cap_s) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(30))), F.lit(cap))


def fail(ops: DataFrame, now: Column, error: Column, most: int = DEFAULT.max_attempts) -> DataFrame:
    """Operations after a failure: due again later, or failed for good."""
    n = F.col("attempts") + 1
    later = F.timestamp_micros(F.unix_micros(now) + (backoff_s(n) * 1e6).cast("long"))
    return ops.withColumns({"attempts": n, "status": F.when(n >= most, FAILED).otherwise(PENDING), "next_attempt_utc": F.when(n >= most, F.col("next_attempt_utc")).otherwise(later), "error": error})


def created_or_modified(created: Column, modified: Column) -> Column:
    """The time of creation; where a file system has none, and gives the beginning of its calendar or nothing, that of the last write."""
    return F.when(created > F.lit("1601-01-01 00:00:00").cast("timestamp"), created).otherwise(modified)


def in_order(ops: DataFrame) -> DataFrame:
    """Operations with `step`, their place among those of their path by id: paths side by side, each path's one after the other."""
    return ops.withColumn("step", F.row_number().over(Window.partitionBy("file_path").orderBy("id")))


def claim_in_order(outbox: DataFrame, now: Column, most: int = 32) -> DataFrame:
    """As `claim`, without operations that a path's earlier one, which waits for its next try, is before."""
    waiting = outbox.where((F.col("status") == PENDING) & (F.col("next_attempt_utc") > now)).groupBy("file_path").agg(F.min("id").alias("__first"))
    free = outbox.join(waiting, "file_path", "left").where(F.col("__first").isNull() | (F.col("id") < F.col("__first"))).drop("__first")
    return claim(free.select(*outbox.columns), now, most)


def stop_at_failures(tried: DataFrame) -> DataFrame:
    """Operations (id, file_path, ok, ...) with `outcome`: a path's are done in the order of their ids until the first that fails; those behind it are blocked, and other paths go on.

    The first failure of a path is a minimum, so that no path's operations are gathered or sorted.
    """
    first = tried.where(~F.coalesce("ok", F.lit(False))).groupBy("file_path").agg(F.min("id").alias("__first"))
    outcome = F.when(F.col("__first").isNull() | (F.col("id") < F.col("__first")), "done").when(F.col("id") == F.col("__first"), "failed").otherwise("blocked")
    return tried.join(first, "file_path", "left").withColumn("outcome", outcome).drop("__first")


def delivered_state(outcomes: DataFrame) -> DataFrame:
    """(file_path, id, op_type): what a sink holds after the operations that were done: of each path the last one."""
    last = outcomes.where("outcome = 'done'").groupBy("file_path").agg(F.max(F.struct("id", "op_type")).alias("x"))
    return last.select("file_path", "x.id", "x.op_type")


def own(path: Column, metadata_dir: str = METADATA_DIR) -> Column:
    """Whether a path is in the index's own folder, in whatever case that is written."""
    return F.exists(F.split(path, r"[/\\]"), lambda s: F.lower(s) == metadata_dir.lower())


def deliverable(ops: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, file_path, op_type, action): upserts of files that are recorded and not yet delivered, deletes of paths that were not recorded again; others are skipped, and so are the index's own files."""
    active = manifest.where("status = 'active'").select(F.col("path").alias("file_path"), "hash", "last_synced_hash")
    rows = ops.join(active, "file_path", "left")
    synced = F.col("last_synced_hash").isNotNull() & (F.col("last_synced_hash") == F.col("hash"))
    action = F.when(own(F.col("file_path")), "skip").when(F.col("op_type") == 1, F.when(F.col("hash").isNull(), "delete").otherwise("skip")).when(F.col("hash").isNull() | synced, "skip").otherwise("upsert")
    return rows.select("id", "file_path", "op_type", action.alias("action"))


def mark_synced(manifest: DataFrame, delivered: DataFrame) -> DataFrame:
    """The delivered hash (path, delivered_hash) is noted only where it still is the file's."""
    rows = manifest.join(delivered, "path", "left")
    ok = (F.col("status") == "active") & (F.col("hash") == F.col("delivered_hash"))
    return rows.withColumn("last_synced_hash", F.when(ok, F.col("delivered_hash")).otherwise(F.col("last_synced_hash"))).drop("delivered_hash")


def prune(outbox: DataFrame, now: Column, days: int = DEFAULT.retention_days) -> DataFrame:
    return outbox.where(~((F.col("status") == DONE) & (F.unix_micros("created_utc") < F.unix_micros(now) - days * 86_400_000_000)))


def superseded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recorded chunks (file_id, chunk_id) of the rewritten files that the new set lacks."""
    return old.join(new.select("file_id", "chunk_id"), ["file_id", "chunk_id"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it lacks."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete_files(files: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three relations without the deleted files (file_id) that are still marked so."""
    out = files.where("status = 'deleted'").join(gone, "file_id", "left_semi").select("file_id")
    dead = chunks.join(out, "file_id", "left_semi").select("chunk_id")
    return files.join(out, "file_id", "left_anti"), chunks.join(out, "file_id", "left_anti"), vectors.join(dead, "chunk_id", "left_anti")


def activate_model(registry: DataFrame, model: DataFrame) -> DataFrame:
    """The registry with the model added or replaced, active, and every other demoted."""
    others = registry.join(model.select("model_version_id"), "model_version_id", "left_anti").withColumn("is_active_for_write", F.lit(False))
    return others.unionByName(model.withColumn("is_active_for_write", F.lit(True)))
