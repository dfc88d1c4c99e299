"""A store kept up to a folder: a first pass, changes as they come, passes now and then, and the queue drained behind them."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import changes as C
from ..operators.indexing import deliver_due, index_pass
from ..operators.service import READY, Embedder, Hold, IndexState
from ..sources.folder import Files, Folder
from ..sources.store import Store

LOG = logging.getLogger(__name__)
WAITING = "waiting"


class Indexer:
    """One writer's loop. `load` gives the folder's files anew; `apply` is the foreachBatch function of a stream of changes (path, ...).

    A failing pass is noted and tried again, after `retry` seconds while the index isn't ready and
    `every` seconds later on. While changes are held, none are taken in. A change to a file that is
    still being written waits for another try, while others go on. A delivery takes `most` operations
    at once, as each is one commit.
    """

    def __init__(self, store: Store, load: Callable[[], Files | DataFrame], embedder: Embedder, state: IndexState, hold: Hold | None = None, every: float = 300.0, retry: float = 30.0, most: int = 10_000, config: Config = DEFAULT, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.store, self.load, self.embedder, self.state, self.hold, self.config = store, load, embedder, state, hold or Hold(), config
        self.every, self.retry, self.most, self.clock, self.sleep = every, retry, most, clock, sleep
        self.due, self.started = clock(), False
        #: Paths of busy files: when each is due again, and how often it was tried.
        self.waiting: dict[str, tuple[float, int]] = {}
        #: Batches of a stream come in a thread of their own; there is one writer at a time.
        self.writing = threading.RLock()

    def start(self) -> None:
        """What was in flight when the last run ended is due again."""
        flying = self.store.read("outbox").where(F.col("status") == C.IN_FLIGHT)
        if not flying.isEmpty():
            self.store.commit({"outbox": (C.requeue(flying), None)})
        # Busy files that the last run still waited for are due at once.
        self.waiting |= {path: (self.clock(), attempt) for path, attempt in (self.store.noted(WAITING) or {}).items()}
        self.started = True

    def _keep(self) -> None:
        """Notes in the store which busy files wait, so that a restart goes on with them."""
        now = {path: attempt for path, (_, attempt) in self.waiting.items()}
        if now != (self.store.noted(WAITING) or {}):
            self.store.commit(notes={WAITING: now})

    def tick(self) -> bool:
        """A whole pass, if one is due and nothing is held; whether it was made."""
        if self.clock() < self.due or self.hold.active:
            return False
        try:
            if not self.started:
                self.start()
            with self.writing:
                index_pass(self.store, self.load(), self.embedder, config=self.config)
        except Exception as e:
            LOG.warning("the pass failed: %s", e)
            self.state.failed(str(e))
            return False
        else:
            self.state.succeeded()
            return True
        finally:
            self.due = self.clock() + (self.every if self.state.state == READY else self.retry)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """A micro-batch of changes, of which only the paths count: what they are now, the folder tells."""
        while self.hold.active:
            self.sleep(0.25)
        self._take_in(batch.select("path").distinct(), 1)

    def _take_in(self, paths: DataFrame, attempt: int) -> None:
        files = self.load()
        with self.writing:
            if isinstance(files, Folder):
                looked = files.settled(paths, self.config.settle_s).persist()
                try:
                    # As many as a batch has files that are being written.
                    busy = [r.path for r in looked.where("state = 'Busy'").select("path").collect()]
                    index_pass(self.store, files, self.embedder, config=self.config, only=looked.where("state <> 'Busy'").select("path"))
                finally:
                    looked.unpersist()
            else:
                busy = []
                index_pass(self.store, files, self.embedder, config=self.config, only=paths)
        for path in busy:
            if attempt < self.config.retries:
                self.waiting[path] = (self.clock() + self.config.retry_s, attempt)
            else:
                LOG.warning("%s was busy %d times; it is stale until the next pass", path, attempt)
        with self.writing:
            self._keep()

    def again(self) -> int:
        """Takes in the waiting changes that are due; how many still wait."""
        due: dict[int, list[str]] = {}
        for path, (at, attempt) in list(self.waiting.items()):
            if at <= self.clock():
                del self.waiting[path]
                due.setdefault(attempt, []).append(path)
        for attempt, paths in due.items():
            self._take_in(self.store.spark.createDataFrame([(p,) for p in paths], "path string"), attempt + 1)
        return len(self.waiting)

    def drain(self) -> int:
        """Carries out what is due, then drops old finished operations; how many were done."""
        done = 0
        with self.writing:
            while n := sum((r := deliver_due(self.store, self.load(), self.embedder, self.most, self.config)).values()):
                done += r["done"]
                if n == r["retried"] + r["failed"]:
                    break
            if done:
                queue = self.store.read("outbox")
                now = F.current_timestamp()
                old = queue.join(C.prune(queue, now, self.config.retention_days).select("id"), "id", "left_anti")
                if not old.isEmpty():
                    self.store.commit({"outbox": (None, old)})
        return done

    def run(self, stopped: Callable[[], bool], pause: float = 1.0, changes: DataFrame | None = None, checkpoint: str | None = None) -> None:
        """Passes and deliveries until `stopped`, and a stream of changes once the first pass has ended; then what waits is taken in and delivered."""
        query = None
        try:
            while not stopped():
                self.tick()
                if self.state.state == READY:
                    if changes is not None and query is None:
                        query = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()
                    self.again()
                    self.drain()
                self.sleep(pause)
        finally:
            if query is not None:
                query.processAllAvailable()
                query.stop()
        if self.state.state == READY:
            while self.again():
                self.sleep(self.config.retry_s)
            self.drain()
