"""The change stream: a stateful debounce per path, direct notifications, and micro-batches applied to the manifest and the queue."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import changes as C

RESULT = "path string, kind string, ts timestamp, n long"


def net(state: str, kind: str) -> str:
    """The fold of two kinds; "" is no change."""
    if not state:
        return kind
    if state == "Created":
        return "" if kind == "Deleted" else "Created"
    if state == "Deleted":
        return "Modified" if kind == "Created" else "Deleted"
    return kind


class Debounce(StatefulProcessor):
    """Holds each path's net change until no event has come for the quiet window, by the events' times or by the clock."""

    def __init__(self, quiet_ms: int, by_clock: bool = False):
        self.quiet_ms, self.by_clock = quiet_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "kind string, last long, n long, quiet_from long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, last, n, quiet_from = self.pending.get() if self.pending.exists() else ("", 0, 0, 0)
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else 0
        for ts, k in zip(events.ts, events.kind, strict=True):
            ms = int(ts.timestamp() * 1000)
            seen = now if self.by_clock else ms
            if n and seen - quiet_from >= self.quiet_ms:
                if kind:
                    out.append((key[0], kind, pd.Timestamp(last, unit="ms"), n))
                kind, n = "", 0
            kind, last, n, quiet_from = net(kind, k), ms, n + 1, seen
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.pending.update((kind, last, n, quiet_from))
        self.handle.registerTimer(quiet_from + self.quiet_ms)
        yield pd.DataFrame(out, columns=["path", "kind", "ts", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind, last, n, _ = self.pending.get()
        self.pending.clear()
        yield pd.DataFrame([(key[0], kind, pd.Timestamp(last, unit="ms"), n)] if kind else [], columns=["path", "kind", "ts", "n"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_ms: int, late: str = "0 seconds", by_clock: bool = False) -> DataFrame:
    """(path, kind, ts, n) of a stream (seq, path, kind, ts); needs the RocksDB state store.

    By the events' times, a window that is open at the end stays pending until a later event moves the
    watermark; by the clock, it settles by itself. What a stopped stream still held, `pending` gives.
    """
    if by_clock:
        return events.groupBy("path").transformWithStateInPandas(Debounce(quiet_ms, True), outputStructType=RESULT, outputMode="append", timeMode="processingTime")
    stream = events.withWatermark("ts", late)
    return stream.groupBy("path").transformWithStateInPandas(Debounce(quiet_ms), outputStructType=RESULT, outputMode="append", timeMode="eventTime")


#: Kinds of control events that begin and end a hold; they name no path.
HOLD, RELEASE = "Hold", "Release"


class Gate(StatefulProcessor):
    """Lets a shard's changes through unless they are held, and then keeps each path's net change until the last release, or until the first hold is `most_ms` old."""

    def __init__(self, most_ms: int):
        self.most_ms = most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holds = handle.getValueState("holds", "n int, since long")
        self.kept = handle.getMapState("kept", "path string", "kind string, last long, n long")

    def _release(self, out: list[tuple]) -> None:
        """What was kept, as its net changes."""
        if self.kept.exists():
            out += [(path, kind, pd.Timestamp(last, unit="ms"), n) for (path,), (kind, last, n) in self.kept.iterator() if kind]
            self.kept.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, since = self.holds.get() if self.holds.exists() else (0, 0)
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for path, kind, ts in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")[["path", "kind", "ts"]].itertuples(index=False):
            if kind == HOLD:
                since = since if held else now
                held += 1
                if held == 1:
                    self.handle.registerTimer(now + self.most_ms)
            elif kind == RELEASE:
                held = max(0, held - 1)
                if not held:
                    self._release(out)
            elif held and now - since < self.most_ms:
                before, _, n = self.kept.getValue((path,)) if self.kept.containsKey((path,)) else ("", 0, 0)
                self.kept.updateValue((path,), (net(before, kind), int(ts.timestamp() * 1000), n + 1))
            else:
                out.append((path, kind, ts, 1))
        if not held:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
        self.holds.update((held, since))
        yield pd.DataFrame(out, columns=["path", "kind", "ts", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        self._release(out)
        yield pd.DataFrame(out, columns=["path", "kind", "ts", "n"])

    def close(self) -> None:
        pass


def gated(events: DataFrame, most_ms: int = 120_000, shards: int = 64) -> DataFrame:
    """(path, kind, ts, n) of a stream (seq, path, kind, ts) of changes and of HOLD and RELEASE events, which name no path.

    Holds are state, so that they and what they hold back survive a restart; the last release publishes at once, and a hold that
    nobody releases ends by itself. A control event goes to every shard of the paths. Needs the RocksDB state store.
    """
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    control = F.col("kind").isin(HOLD, RELEASE)
    one = F.array(F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int"))
    dealt = events.withColumn("shard", F.explode(F.when(control, everywhere).otherwise(one)))
    return dealt.groupBy("shard").transformWithStateInPandas(Gate(most_ms), outputStructType=RESULT, outputMode="append", timeMode="processingTime")


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, kind, ts, n): the changes that a stopped debounce held back, read from its state, so that none is lost at the end."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pending").load()
    return state.select(F.col("key.path").alias("path"), "value.kind", F.timestamp_millis("value.last").alias("ts"), "value.n").where("kind <> ''")


class Notifications:
    """Changes told directly, such as by an edit, as files of a folder that a stream reads beside the folder's own; nothing is noted while not running.

    On a cluster `root` is a mounted folder that all executors see. `held` is a hold as two events, for `gated`.
    """

    def __init__(self, root: str):
        self.root, self.running = root, False
        os.makedirs(root, exist_ok=True)

    @contextlib.contextmanager
    def held(self) -> Iterator[None]:
        self._write(None, HOLD)
        try:
            yield
        finally:
            self._write(None, RELEASE)

    def __call__(self, path: str, kind: str) -> None:
        if self.running:
            self._write(path, kind)

    def _write(self, path: str | None, kind: str) -> None:
        temp = os.path.join(self.root, f".{uuid.uuid4().hex}.tmp")
        with open(temp, "w", encoding="utf-8") as f:
            json.dump({"path": path, "kind": kind, "ts": datetime.now(UTC).isoformat()}, f)
        os.replace(temp, os.path.join(self.root, f"{uuid.uuid4().hex}.json"))

    def stream(self, spark: SparkSession) -> DataFrame:
        """(path, kind, ts); to be joined to others by a union."""
        return spark.readStream.schema("path string, kind string, ts timestamp").json(f"file://{self.root}")


def deliver(read_manifest: Callable[[], DataFrame], read_disk: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a change only names a path, the disk tells what it is now; nothing is written where nothing changed.

    `apply` gets the manifest after the batch and its changes, and commits both at once.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        touched = batch.select("path").distinct().persist()
        try:
            manifest = read_manifest()
            recorded = manifest.where("status = 'active'").join(touched, "path", "left_semi").select("path", "hash", "size", "created")
            found = C.snapshot_diff(read_disk().join(touched, "path", "left_semi"), recorded).persist()
            try:
                if not found.isEmpty():
                    apply(C.apply_changes(manifest, found, F.current_timestamp()), found)
            finally:
                found.unpersist()
        finally:
            touched.unpersist()

    return run
