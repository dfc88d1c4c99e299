"""Relations of the index as Parquet versions behind one pointer, so that several change together or not at all."""

from __future__ import annotations

import json
import os
import re
import stat
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "file_manifest": "file_id string, file_path string, file_hash string, size_bytes long, modified_utc timestamp, status string, updated_utc timestamp, created_utc timestamp, last_synced_hash string",
    "chunk_manifest": "chunk_id string, file_id string, chunk_index int, token_start int, token_end int, chunk_hash string, model_version_id string, updated_utc timestamp",
    "embedding_model_registry": "model_version_id string, provider_type string, model_name string, vector_dimension int, distance_metric string, is_active_for_write boolean, activated_utc timestamp",
    "chunk_vector": "chunk_id string, model_version_id string, vector array<float>, vector_dimension int, updated_utc timestamp",
    "embedding_fit_artifact": "model_version_id string, artifact_json string, created_utc timestamp",
    "outbox": "id long, file_path string, op_type int, status int, attempts int, created_utc timestamp, next_attempt_utc timestamp, error string",
    "conversation": "conversation_id string, created_utc timestamp, updated_utc timestamp, next_seq long",
    "message": "conversation_id string, seq long, agent_name string, message_json string, created_utc timestamp",
    "session_state": "agent_name string, conversation_id string, session_json string, updated_utc timestamp",
}
#: What a merge finds rows by; a table's buckets are dealt by the first of its columns.
KEYS = {"file_manifest": ["file_id"], "chunk_manifest": ["file_id", "chunk_id"], "chunk_vector": ["chunk_id", "model_version_id"], "outbox": ["id"], "conversation": ["conversation_id"], "message": ["conversation_id", "seq"], "session_state": ["conversation_id", "agent_name"], "embedding_model_registry": ["model_version_id"], "embedding_fit_artifact": ["model_version_id"]}
#: Tables that grow with the corpus are dealt to the store's buckets; the others have one.
LARGE = ("file_manifest", "chunk_manifest", "chunk_vector", "outbox", "message")
#: Columns that a scan of one value prunes by, within a bucket.
PARTITIONED = {"chunk_vector": ["model_version_id"], "outbox": ["status"]}
#: Keys that a read filters by value, so that files' Bloom filters and ranges of keys apply; more keys choose buckets only.
FEW_KEYS = 1_000


class Store:
    """Tables under a folder that every executor reaches, of any file system that Spark knows.

    The pointer file names the version of each bucket of each table. A commit writes the buckets that
    change as new versions, then swaps the pointer: readers keep the versions that they began with,
    and what an aborted commit wrote is never read. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.spark, self._conf = spark, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")
        self._fs.mkdirs(path)
        #: The number of buckets is that of the first commit.
        self.buckets = self._pointer().get("buckets", buckets)
        #: Where a list: what was read, as (table, buckets).
        self.trace: list[tuple[str, int]] | None = None

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _pointer(self) -> dict:
        if not self._fs.exists(self._path("CURRENT")):
            return {"tables": {}}
        stream = self._fs.open(self._path("CURRENT"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, pointer: dict) -> None:
        """The pointer is replaced by a rename, which is atomic where the file system's is."""
        temp = self._path(f"CURRENT.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(pointer | {"buckets": self.buckets}).encode()))
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self._conf).rename(temp, self._path("CURRENT"), how)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(KEYS[name][0]), F.lit(self.buckets)).cast("int") if name in LARGE else F.lit(0)

    def read(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """A table, or of a large one only the buckets that `keys` (its first key column, ...) fall in; of few keys no more than their rows, which files' Bloom filters help to find."""
        versions, wanted = self._pointer()["tables"].get(name, {}), None
        if keys is not None and name in LARGE and versions:
            key = KEYS[name][0]
            keys = self._typed(name, keys, [key]).where(F.col(key).isNotNull()).distinct()
            few = keys.select(key, self.bucket(name).alias("b")).limit(FEW_KEYS + 1).collect()
            wanted = [r[0] for r in few] if len(few) <= FEW_KEYS else None
            touched = {str(r.b) for r in few} if wanted is not None else set(self._touched(name, keys))
            versions = {b: v for b, v in versions.items() if b in touched}
        if self.trace is not None:
            self.trace.append((name, len(versions)))
        rows = self._buckets(name, versions)
        return rows.where(F.col(KEYS[name][0]).isin(wanted)) if wanted else rows

    def _touched(self, name: str, keys: DataFrame) -> list[str]:
        """At most as many rows as there are buckets."""
        return [str(r[0]) for r in keys.select(self.bucket(name)).distinct().collect()]

    def _buckets(self, name: str, versions: dict[str, str]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, v in versions.items()]
        rows = self.spark.read.schema(f"{SCHEMAS[name]}, v string, bucket int").option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.drop("v", "bucket")

    def _typed(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The table's columns in its own types, by which rows are dealt to buckets."""
        types = {f.name: f.dataType for f in self._buckets(name, {}).schema}
        return rows.select(*[F.col(c).cast(types[c]).alias(c) for c in columns or types])

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Rows as a new version; the buckets that have rows. Adaptive execution splits large buckets into several tasks and files, and writes small ones together."""
        version = uuid.uuid4().hex
        at = f"{self.root}/{name}/v={version}"
        rows = self._typed(name, rows).withColumn("bucket", self.bucket(name))
        key, parts = KEYS[name][0], ["bucket", *PARTITIONED.get(name, [])]
        # Sorted, so that each file's ranges of keys are narrow, with a Bloom filter for those that they don't tell apart.
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions(*parts, key) if name in LARGE else rows.coalesce(1)
        rows.write.partitionBy(*parts).option(f"parquet.bloom.filter.enabled#{key}", str(name in LARGE).lower()).option("parquet.bloom.filter.adaptive.enabled", "true").parquet(at)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{name}/v={version}"))]
        return {b.removeprefix("bucket="): version for b in found if b.startswith("bucket=")}

    def holds(self, name: str) -> bool:
        """Whether a table has any version."""
        return bool(self._pointer()["tables"].get(name))

    def noted(self, name: str) -> int | dict | None:
        """A number, or numbers by name, that a commit noted."""
        return self._pointer().get("notes", {}).get(name)

    def commit(self, merge: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None, notes: dict[str, int | dict] | None = None, **tables: DataFrame) -> None:
        """Whole tables given by name, merges by name (rows to add or replace by key, and keys of rows to delete) and a few numbers to note, at once.

        A merge rewrites only the buckets that its rows and keys fall in. The tables are written side by side.
        """
        pointer, merge = self._pointer(), merge or {}
        now = pointer["tables"]
        with ThreadPoolExecutor(max(1, len(tables) + len(merge))) as pool:
            whole = {name: pool.submit(self._write, name, df) for name, df in tables.items()}
            parts = {name: pool.submit(self._merge, name, now.get(name, {}), *x) for name, x in merge.items()}
        # The pointer is left alone if any of them failed.
        self._swap(pointer | {"tables": now | {name: f.result() for name, f in (whole | parts).items()}, "notes": pointer.get("notes", {}) | (notes or {})})

    def _merge(self, name: str, versions: dict[str, str], new: DataFrame | None, dead: DataFrame | None) -> dict[str, str]:
        """The table's versions after a merge."""
        if not versions:
            return {} if new is None else self._write(name, new)
        keys = [self._typed(name, x, KEYS[name]) for x in (new, dead) if x is not None]
        gone = (keys[0] if len(keys) == 1 else keys[0].union(keys[1])).distinct().persist()
        try:
            touched = self._touched(name, gone)
            if not touched:
                return versions
            old = self._buckets(name, {b: v for b, v in versions.items() if b in touched})
            rest = old.join(gone, KEYS[name], "left_anti")
            written = self._write(name, rest if new is None else rest.unionByName(self._typed(name, new)))
        finally:
            gone.unpersist()
        return {b: v for b, v in versions.items() if b not in touched} | written

    def grow(self, most: int = 5_000_000) -> int:
        """Deals the large tables to more buckets, doubled until those of the largest table have `most` rows on average, in one commit; the number of buckets."""
        tables = self._pointer()["tables"]
        largest = max((self._buckets(n, tables[n]).count() for n in LARGE if tables.get(n)), default=0)
        n = self.buckets
        while largest > most * n:
            n *= 2
        if n > self.buckets:
            # Readers keep the versions, and so the buckets, that they began with.
            rows = {name: self._buckets(name, tables[name]) for name in LARGE if tables.get(name)}
            self.buckets = n
            self.commit(**rows)
        return n

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def vacuum(self) -> int:
        """Deletes versions that the pointer doesn't name, and returns how many; for when no reader is left on an older one."""
        live = {(name, v) for name, versions in self._pointer()["tables"].items() for v in versions.values()}
        gone = 0
        self.remove("_notes")
        for name in SCHEMAS:
            top = self._path(name)
            for s in self._fs.listStatus(top) if self._fs.exists(top) else []:
                if (name, s.getPath().getName().removeprefix("v=")) not in live:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone

    def vectors(self, model: str) -> DataFrame:
        """One model's vectors; none for a model that has none."""
        return self.read("chunk_vector").where(F.col("model_version_id") == model)

    def models(self) -> list[str]:
        """Models that have vectors, by the names of their folders."""
        found, mark = set(), "model_version_id="
        for b, v in self._pointer()["tables"].get("chunk_vector", {}).items():
            for s in self._fs.listStatus(self._path(f"chunk_vector/v={v}/bucket={b}")):
                if (name := s.getPath().getName()).startswith(mark):
                    found.add(unquote(name.removeprefix(mark)))
        return sorted(found)

    def save_fit(self, model: str, artifact: str) -> None:
        """A model's fit artifact, in place of an older one."""
        row = self.spark.createDataFrame([(model, artifact)], "model_version_id string, artifact_json string").withColumn("created_utc", F.current_timestamp())
        self.commit({"embedding_fit_artifact": (row, None)})

    def fit(self, model: str) -> str | None:
        row = self.read("embedding_fit_artifact").where(F.col("model_version_id") == model).first()
        return row and row.artifact_json


def write_atomically(path: str, data: bytes, tries: int = 6, delay: float = 0.025) -> None:
    """A temporary file beside it, then a rename, tried again with twice the wait each time."""
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    retry(lambda: os.replace(temp, path), tries, delay)


def retry(action: Callable[[], None], tries: int, delay: float) -> None:
    for i in range(tries):
        try:
            return action()
        except OSError:
            if i == tries - 1:
                raise
            time.sleep(delay * 2**i)


# Names that some systems take for devices, in whatever case and with whatever extension.
DEVICES = ("con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10)))


def guard(root: str, path: str) -> str:
    """The real path of a relative one inside the root.

    Empty, outside, linked and metadata paths raise ValueError, and so do device names, what is neither
    file nor folder, and files that have another name (a hard link) outside the root.
    """
    from ..config import METADATA_DIR

    if not path.strip() or re.match(r"^[A-Za-z]:|^[\\/]{2}", path):
        raise ValueError(f"not a path: {path!r}")
    top = os.path.realpath(root)
    full = os.path.normpath(os.path.join(top, path.replace("\\", "/").lstrip("/")))
    if full != top and not full.startswith(top + os.sep):
        raise ValueError(f"{path} is outside the folder")
    if os.path.realpath(full) != full:
        raise ValueError(f"{path} is or follows a link")
    names = [s.lower() for s in os.path.relpath(full, top).split(os.sep)]
    if METADATA_DIR.lower() in names:
        raise ValueError(f"{path} is the index's own")
    if any(s.split(".")[0].rstrip() in DEVICES for s in names):
        raise ValueError(f"{path} names a device")
    if os.path.lexists(full):
        s = os.lstat(full)
        if not stat.S_ISREG(s.st_mode) and not stat.S_ISDIR(s.st_mode):
            raise ValueError(f"{path} is no file")
        if stat.S_ISREG(s.st_mode) and s.st_nlink > 1 and _names_inside(top, s) < s.st_nlink:
            raise ValueError(f"{path} has another name outside the folder")
    return full


def _names_inside(top: str, wanted: os.stat_result) -> int:
    """How many names a file has below the root; asked only of files that have several."""
    same = lambda s: (s.st_dev, s.st_ino) == (wanted.st_dev, wanted.st_ino)
    return sum(same(os.lstat(os.path.join(d, name))) for d, _, names in os.walk(top) for name in names)


def read_text_file(path: str, most: int = 16 << 20) -> bytes:
    """A file's bytes; directories, larger files and files with a NUL in the first 8 KiB raise ValueError."""
    if os.path.isdir(path):
        raise ValueError("a directory")
    if os.path.getsize(path) > most:
        raise ValueError("too large")
    with open(path, "rb") as f:
        data = f.read()
    if b"\0" in data[:8192]:
        raise ValueError("not a text file")
    return data
