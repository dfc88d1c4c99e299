"""The index as a whole: passes over a folder, delivery of the queue, and searches, over the relations of a store.

Files are a `Folder`, of which only what is asked for is opened, or a relation (path, length,
modified_utc, hash, text), such as `format("folder")` reads; load that anew for each pass, as a
relation keeps its first listing. What a pass finds is staged under the store's folder before
anything is decided by it, so that a file which changes meanwhile, or a task that runs again, can't
mix two versions.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.folder import READ, SKIPPED, Files, files_of
from ..sources.store import Store
from . import changes as C
from . import retrieval as R
from .chunking import chunks, file_id, verify
from .ivf import VectorIndex
from .service import Embedder

CHUNK = ["chunk_id", "file_id", "chunk_index", "token_start", "token_end", "chunk_hash"]
MOST_RESULTS, MOST_FILES, MOST_HITS = 20, 20, 100
#: Hits that are broadcast at most: some 30 MB.
FEW_HITS = 100_000
#: A file that was written within so many seconds before it was recorded may have changed since without a new time.
RACY_S = 10.0
LAST_OPERATION = "last_operation"


class _Stage:
    """Intermediate relations of one run, in the store's folder; gone when it ends."""

    def __init__(self, store: Store):
        self.store, self.at, self.n = store, f"_stage/{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.store.root}/{self.at}/{self.n}"
        df.write.parquet(path)
        return self.store.spark.read.parquet(path)

    def __enter__(self) -> _Stage:
        return self

    def __exit__(self, *error) -> None:
        self.store.remove(self.at)


def _now() -> Column:
    return F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")


def _ids(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.select(file_id(F.col(path)).alias("file_id"))


def manifest(store: Store, only: DataFrame | None = None) -> DataFrame:
    """The file manifest in the names that the change operators use, or what it has of the paths asked for; then only their buckets are read."""
    rows = store.read("file_manifest", None if only is None else _ids(only))
    rows = rows if only is None else rows.join(only.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return rows.selectExpr("file_path path", "file_hash hash", "size_bytes size", "status", "created_utc created", "last_synced_hash", "updated_utc updated", "modified_utc modified")


def files_with_vectors(store: Store, model: str, only: DataFrame | None = None) -> DataFrame:
    """(file_id) of the files, or of the paths asked for only, that have vectors of the model."""
    asked = None if only is None else _ids(only)
    windows = store.read("chunk_manifest", asked).select("file_id", "chunk_id", (F.col("model_version_id") == model).alias("own"))
    if asked is not None:
        windows = windows.join(asked, "file_id", "left_semi")
    # A window is recorded with the vector of its model, in one commit; only windows of other models may have this one's, or not.
    own = windows.where("own").select("file_id").distinct()
    others = windows.where("not own")
    if others.isEmpty():
        return own
    vectors = store.read("chunk_vector", None if only is None else others.select("chunk_id")).where(F.col("model_version_id") == model)
    return own.unionByName(others.join(vectors.select("chunk_id"), "chunk_id", "left_semi").select("file_id")).distinct()


def lookup(store: Store, path: str) -> DataFrame:
    """The manifest's row of a path, if it is active; only the bucket that the path falls in is read."""
    row = store.read("file_manifest", store.spark.range(1).select(file_id(F.lit(path)).alias("file_id")))
    return row.where((F.col("file_path") == path) & (F.col("status") == "active"))


def _embedded(files: DataFrame, embedder: Embedder, config: Config) -> DataFrame:
    """The files' windows with their vectors and the hash of the text that they come from, without that text."""
    return chunks(files, config, ("hash",)).select("path", *CHUNK, embedder.embed(F.col("content")).alias("vector"), F.col("hash").alias("read_hash"))


def _placed(store: Store, stage: _Stage, rows: DataFrame, gone: DataFrame, embedder: Embedder, now: Column, keyed: bool = True) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Merges that put the windows in place of those that their files had, and take out those of the files (file_id) that are gone."""
    touched = rows.select("file_id").unionByName(gone.select("file_id")).distinct()
    # Of a batch, only the buckets of its files, and of the chunks that go, are read; a whole pass may touch all.
    old = store.read("chunk_manifest", touched if keyed else None).join(touched, "file_id", "left_semi")
    dead = C.superseded(old, rows).select("file_id", "chunk_id")
    dead = stage(dead) if store.holds("chunk_manifest") else dead
    # Vectors of every model go with their chunk.
    dead_vectors = store.read("chunk_vector", dead.select("chunk_id") if keyed else None).join(dead.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "model_version_id")
    model = F.lit(embedder.model_version_id).alias("model_version_id")
    return {
        "chunk_manifest": (rows.select(*CHUNK, model, now.alias("updated_utc")), dead),
        "chunk_vector": (rows.select("chunk_id", model, "vector", F.lit(embedder.dimension).alias("vector_dimension"), now.alias("updated_utc")), dead_vectors),
    }


def _recorded(rows: DataFrame) -> DataFrame:
    """Rows of `manifest` as the table has them."""
    return rows.select(file_id(F.col("path")).alias("file_id"), F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.col("size").alias("size_bytes"), F.col("modified").alias("modified_utc"), "status", F.col("updated").alias("updated_utc"), F.col("created").alias("created_utc"), "last_synced_hash")


def _seen(store: Store, files: Files, known: DataFrame, only: DataFrame | None, full: bool, stage: _Stage) -> tuple[DataFrame | None, DataFrame, int]:
    """(found, recorded, unmoved): the files in directories that have changed, as found now, what is recorded of those directories, and the number of files in others; None where no directory has changed.

    A file of recorded length and time is as recorded, unless it was written so shortly before it was recorded that a
    later write could have the same time. Directories are compared by digests, so that only files of those
    that differ are compared one by one, and of these only those that differ are read.
    """
    listed = stage(files.listing(only).select("path", F.col("length").alias("size"), F.col("created_utc").alias("created"), F.col("modified_utc").alias("seen"), "hash"))
    active = known.where("status = 'active'")
    racy = F.unix_micros("modified") > F.unix_micros("updated") - int(RACY_S * 1e6)
    now = F.col("hash") if files.hashed else F.xxhash64("size", "seen").cast("string")
    then = F.col("hash") if files.hashed else F.when(racy | F.col("modified").isNull(), "racy").otherwise(F.xxhash64("size", F.col("modified").alias("seen")).cast("string"))
    listed, active, unmoved = listed.withColumn("sign", now), active.withColumn("sign", then), 0
    full = full or not store.holds("file_manifest")
    if not full and only is None:
        where = stage(C.changed_directories(listed.select("path", "sign"), active.select("path", "sign")))
        if where.isEmpty():
            return None, active.drop("sign"), listed.count()
        n = listed.count()
        listed, active = C.in_directories(listed, where), C.in_directories(active, where)
        unmoved = n - listed.count()
    columns = ["path", "hash", "size", "created", "seen", "state"]
    if files.hashed:
        return listed.withColumn("state", F.lit(READ)).select(*columns), active.drop("sign"), unmoved
    same = listed.join(active.select("path", "sign", F.col("hash").alias("known")).where(F.lit(not full)), ["path", "sign"])
    same = same.select("path", F.col("known").alias("hash"), "size", "created", "seen", F.lit(READ).alias("state"))
    fresh = files.read(listed.join(same.select("path"), "path", "left_anti").select("path"))
    fresh = fresh.select("path", "hash", F.col("length").alias("size"), F.col("created_utc").alias("created"), F.col("modified_utc").alias("seen"), "state")
    return stage(same.unionByName(fresh)), active.drop("sign"), unmoved


def index_pass(store: Store, files: Files | DataFrame, embedder: Embedder, skipped: DataFrame | None = None, config: Config = DEFAULT, only: DataFrame | None = None, full: bool = False) -> dict[str, int]:
    """Brings the index up to the folder, in one commit, and counts what it did.

    New and changed files are recorded, queued and embedded, as are files without vectors of this
    model; files that are gone are marked deleted and queued; files that can't be read now, and
    `skipped` paths, stay as they are. A file that changes between the listing and its embedding is
    deferred to the next pass. A file of the length and time that were recorded is not read, unless the pass is a
    `full` one; another is read for its hash, and once more if it is to be embedded. With `only` (path), such as
    a batch of changes, other files of a `Folder` are neither looked at nor judged, and only the paths' buckets of the store are read.
    """
    now, model, files = _now(), embedder.model_version_id, files_of(files)
    entry = store.read("embedding_model_registry").where(F.col("model_version_id") == model).first()
    if entry is not None and entry.vector_dimension != embedder.dimension:
        raise ValueError(f"vectors of {model} have dimension {entry.vector_dimension}, not {embedder.dimension}: the index must be rebuilt")
    with _Stage(store) as stage:
        only = None if only is None else stage(only.select("path").distinct())
        known = manifest(store, only)
        found, recorded, unmoved = _seen(store, files, known, only, full, stage)
        kept = known.where("status = 'active'").select("path", "hash", "size", "created", "modified", file_id(F.col("path")).alias("file_id"))
        bare = stage(kept.join(files_with_vectors(store, model, only), "file_id", "left_anti").drop("file_id"))
        n_bare = bare.count()
        if found is None and not n_bare:
            return {"scanned": unmoved, "indexed": 0, "unchanged": unmoved, "deferred": 0, "chunks": 0, "vectors": 0, "changes": 0}
        if found is None:
            recorded, found = recorded.limit(0), bare.limit(0).select("path", "hash", "size", "created", F.col("modified").alias("seen"), F.lit(READ).alias("state"))
        listing = found.where(F.col("state") == READ).drop("state")
        unread = found.where(F.col("state") == SKIPPED).select("path")
        skipped = unread if skipped is None else unread.unionByName(skipped.select("path"))
        changed = stage(C.snapshot_diff(listing, recorded, skipped))
        states = recorded.join(changed.select("path"), "path", "left_anti").select("path", "hash").join(bare.select("path", F.lit(False).alias("v")), "path", "left").select("path", "hash", F.coalesce("v", F.lit(True)).alias("has_vectors"))
        if n_bare:
            # Files in directories that have not changed, of which nothing else was found, may be without vectors of this model.
            still = bare.join(recorded.select("path"), "path", "left_anti").select("path", "hash", "size", "created", F.col("modified").alias("seen"))
            still = stage(still.join(files.listing(still.select("path")).select("path"), "path", "left_semi"))
            unmoved -= still.count()
            listing, states = listing.unionByName(still), states.unionByName(still.select("path", "hash", F.lit(False).alias("has_vectors")))
        judged = stage(C.classify(listing, states, changed))
        counts = {r.disposition: r["count"] for r in judged.groupBy("disposition").count().collect()}
        counts["Unchanged"] = counts.get("Unchanged", 0) + unmoved
        n_scanned, n_changed = sum(counts.values()), changed.count()
        if not counts.get("Embed") and not n_changed:
            return {"scanned": n_scanned, "indexed": 0, "unchanged": counts["Unchanged"], "deferred": counts.get("Deferred", 0), "chunks": 0, "vectors": 0, "changes": 0}
        # Staged, so that its size is known: few files are sent to the texts, which then aren't shuffled.
        wanted = stage(judged.where("disposition = 'Embed'").select("path").join(listing.select("path", F.col("hash").alias("listed")), "path"))
        if files.hashed:
            rows = stage(_embedded(files.read(wanted.select("path", F.col("listed").alias("hash"))).where(F.col("state") == READ), embedder, config))
        else:
            read = _embedded(files.read(wanted.select("path")).where(F.col("state") == READ), embedder, config)
            rows = stage(read.join(wanted, "path").where("read_hash = listed").drop("listed"))

        done = stage(rows.select("path", F.col("read_hash").alias("delivered_hash")).distinct())
        paths = changed.select("path").unionByName(done.select("path")).distinct()
        before = known.join(paths, "path", "left_semi")
        after = C.mark_synced(C.apply_changes(before, changed, now), done)
        times = listing.select("path", "seen")
        after = after.join(times, "path", "left").join(before.select("path", "modified"), "path", "left").withColumn("modified", F.coalesce("seen", "modified")).drop("seen")
        n_chunks, n_done = rows.count(), done.count()
        if n_chunks or n_changed:
            last = store.noted(LAST_OPERATION) if store.noted(LAST_OPERATION) is not None else store.read("outbox").agg(F.max("id")).first()[0] or 0
            queued = C.enqueue(changed, last + 1, now)
            entry = store.spark.createDataFrame([(model, type(embedder).__name__, model, embedder.dimension, "cosine", True, None)], "model_version_id string, provider_type string, model_name string, vector_dimension int, distance_metric string, is_active_for_write boolean, activated_utc timestamp").withColumn("activated_utc", now)
            merge = _placed(store, stage, rows, rows.select("file_id").limit(0), embedder, now, only is not None) | {"file_manifest": (_recorded(after), None), "outbox": (queued, None)}
            store.commit(merge, {LAST_OPERATION: last + n_changed}, embedding_model_registry=C.activate_model(store.read("embedding_model_registry"), entry))
    embed = counts.get("Embed", 0)
    return {"scanned": n_scanned, "indexed": n_done, "unchanged": counts["Unchanged"], "deferred": counts.get("Deferred", 0) + embed - n_done, "chunks": n_chunks, "vectors": n_chunks, "changes": n_changed}


def deliver_due(store: Store, files: Files | DataFrame, embedder: Embedder, most: int = 32, config: Config = DEFAULT) -> dict[str, int]:
    """Claims the queue's first due operations and carries them out, in one commit; returns how many were done and failed.

    Upserts that are already delivered and deletes of paths that were recorded again are skipped.
    Only files to upsert are read, and only the paths' buckets of the store. An upsert whose file isn't there as
    recorded is due again later, and fails for good in the end. A path's operations are done in their order:
    those behind one that failed wait until it was tried again, while other paths go on.
    """
    now, files = _now(), files_of(files)
    with _Stage(store) as stage:
        ops = stage(C.claim_in_order(store.read("outbox"), now, most))
        known = manifest(store, ops.select(F.col("file_path").alias("path")).distinct())
        what = stage(C.deliverable(ops, known))
        upserts = what.where("action = 'upsert'").select(F.col("file_path").alias("path")).distinct().join(known.select("path", F.col("hash").alias("listed")), "path")
        found = stage(files.read(upserts.select("path")).join(upserts, "path").where("hash = listed").select("path", "hash", "text"))
        rows = stage(_embedded(found, embedder, config))
        gone = what.where("action = 'delete'").select(F.col("file_path").alias("path")).distinct()
        gone = gone.join(known.where("status = 'deleted'"), "path", "left_semi").select(file_id(F.col("path")).alias("file_id"))
        there = found.select(F.col("path").alias("file_path"), F.lit(True).alias("there"))
        acted = ops.join(what.select("id", "action"), "id").join(there, "file_path", "left")
        acted = stage(C.stop_at_failures(acted.withColumn("ok", (F.col("action") != "upsert") | F.col("there"))))
        done = acted.where("outcome = 'done'").withColumn("status", F.lit(C.DONE))
        failed = C.fail(acted.where("outcome = 'failed'"), now, F.lit("the file is not as recorded"))
        # Blocked ones stay in the queue as they were.
        result = stage(done.unionByName(failed).select(*ops.columns))
        gone = gone.join(_ids(acted.where("outcome <> 'done'"), "file_path"), "file_id", "left_anti")
        counts = {r.status: r["count"] for r in result.groupBy("status").count().collect()}
        if counts:
            synced = C.mark_synced(known.join(found.select("path"), "path", "left_semi"), found.select("path", F.col("hash").alias("delivered_hash")))
            merge = _placed(store, stage, rows, gone, embedder, now) | {"file_manifest": (_recorded(synced), gone), "outbox": (result, None)}
            store.commit(merge)
    return {"done": counts.get(C.DONE, 0), "retried": counts.get(C.PENDING, 0), "failed": counts.get(C.FAILED, 0)}


def vector_index(store: Store, embedder: Embedder, cells: int | None = None) -> VectorIndex:
    """An inverted file over the store's vectors of the model, under the store's folder. Windows recorded later are not in it until it is brought up to date."""
    rows = store.vectors(embedder.model_version_id).select(F.col("chunk_id").alias("id"), "vector")
    return VectorIndex.build(rows, f"{store.root}/_cells/{uuid.uuid4().hex}", cells)


def bring_up_to_date(store: Store, embedder: Embedder, index: VectorIndex) -> int:
    """Adds the vectors that the index lacks, and tells how many of its own are of windows that are gone; a search leaves those out, so rebuild it when they are many."""
    rows, held = store.vectors(embedder.model_version_id).select(F.col("chunk_id").alias("id"), "vector"), index.rows().select("id")
    with _Stage(store) as stage:
        index.add(stage(rows.join(held, "id", "left_anti")))
    return index.rows().select("id").join(rows.select("id"), "id", "left_anti").count()


def _hits(store: Store, queries: DataFrame, embedder: Embedder, k: int, config: Config, index: VectorIndex | None = None) -> tuple[DataFrame, bool]:
    """Each (query_id, query)'s k nearest windows with the path and place of each, and whether they are few.

    Few hits, which `k` and the number of queries bound, are taken to the driver, so that the vectors are scanned once whatever
    follows, and sent to the large relations; more of them meet those by shuffles.
    """
    asked = queries.select("query_id", embedder.embed(F.col("query"), query=True).alias("vector"))
    few = queries.count() * k <= FEW_HITS
    if index is not None:
        near = index.search(asked, k, config.min_score)
    else:
        near = R.knn(store.vectors(embedder.model_version_id).select(F.col("chunk_id").alias("id"), "vector"), asked, k, config.min_score)
    if few:
        near = store.spark.createDataFrame(near.toArrow(), near.schema)
    files = store.read("file_manifest").select("file_id", F.col("file_path").alias("path"))
    located = R.locate(_sent(near, few), store.read("chunk_manifest").drop("model_version_id"))
    return _sent(located, few).join(files, "file_id"), few


def _sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _passages(store: Store, files: Files, queries: DataFrame, embedder: Embedder, results: int, config: Config, index: VectorIndex | None = None) -> DataFrame:
    """The hits with their text as the files are now and a state; only files with hits are opened."""
    hits, few = _hits(store, queries, embedder, min(min(results, MOST_RESULTS) * 4, MOST_HITS), config, index)
    now = files.read(_sent(hits.select("path").distinct(), few)).where(F.col("state") == READ)
    return verify(hits, now.select("path", "text"))


def search(store: Store, files: Files | DataFrame, queries: DataFrame, embedder: Embedder, results: int = 5, config: Config = DEFAULT, index: VectorIndex | None = None) -> DataFrame:
    """(query_id, id, path, text, score, relevance, place): passages of the files as they are now, in the order chosen.

    Only windows whose text is still as indexed are returned. Queries without results have no rows;
    `search_notes` tells why. With an `index`, only the cells that can hold a hit are read instead of all vectors.
    """
    rebuilt = _passages(store, files_of(files), queries, embedder, results, config, index)
    passages = R.screen(rebuilt.where("state = 'verified'"), config.floor, config.gap)
    passages = passages.join(queries.select("query_id", "query"), "query_id").withColumn("token_count", F.col("token_end") - F.col("token_start"))
    # The passages come along, so that no file is read again for them.
    chosen = R.rerank(passages, min(results, MOST_RESULTS), config.budget_tokens, config, ("path", "text", "score"))
    return chosen.select("query_id", "id", "path", "text", "score", "relevance", "place")


def search_notes(store: Store, files: Files | DataFrame, queries: DataFrame, embedder: Embedder, results: int = 5, config: Config = DEFAULT, index: VectorIndex | None = None) -> DataFrame:
    """(query_id, ranked, stale, unavailable, best, below_floor, dropped, selected, truncated): what a search ranked, withheld and chose, a row per query.

    The passages are rebuilt once and staged, so that all numbers are of the same files, each opened once.
    """
    with _Stage(store) as stage:
        rebuilt = stage(_passages(store, files_of(files), queries, embedder, results, config, index))
        kept = R.screen(rebuilt.where("state = 'verified'"), config.floor, config.gap).join(queries.select("query_id", "query"), "query_id")
        chosen = R.rerank(kept.withColumn("token_count", F.col("token_end") - F.col("token_start")), min(results, MOST_RESULTS), config.budget_tokens, config)
        counts = chosen.groupBy("query_id").agg(F.count("*").alias("selected"))
        rows = queries.select("query_id").join(R.notes(rebuilt, config.floor, config.gap), "query_id", "left").join(counts, "query_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        numbers = [zero(c).alias(c) for c in ("ranked", "stale", "unavailable", "dropped", "selected")]
        out = rows.select("query_id", *numbers, "best", F.coalesce("below_floor", F.lit(False)).alias("below_floor"), (zero("kept") > zero("selected")).alias("truncated"))
        # One narrow row per query, under the store's folder until it is vacuumed.
        path = f"{store.root}/_notes/{uuid.uuid4().hex}"
        out.write.parquet(path)
    return store.spark.read.parquet(path)


def find_files(store: Store, files: Files | DataFrame, queries: DataFrame, embedder: Embedder, results: int = 10, config: Config = DEFAULT) -> DataFrame:
    """(query_id, path, score, passages, rank): the files that still exist, best passage first. None is opened."""
    wanted = min(results, MOST_FILES)
    hits, few = _hits(store, queries, embedder, min(wanted * 5, MOST_HITS), config)
    there = files_of(files).there(_sent(hits.select("path").distinct(), few))
    return R.files_about(hits.join(_sent(there, few), "path", "left_semi"), wanted)
