"""What surrounds a search: readiness, telemetry, embedders and the choice among them."""

from __future__ import annotations

import hashlib
import ipaddress
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import CancelledError, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from typing import Protocol, TypeVar
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf

from ..config import DEFAULT
from ..functions.vector import unit_histogram
from ..sources.shared import cut
from ..sources.store import Store
from .features import LsaModel, fit_lsa

T = TypeVar("T")
BUILDING, READY, FAILED = "Building", "Ready", "Failed"


class NotReady(RuntimeError):
    """The index can't be queried yet."""


class IndexState:
    """Building until the first pass has ended; ready for good after that, whatever fails later."""

    def __init__(self) -> None:
        self.state, self.error = BUILDING, ""

    def succeeded(self) -> None:
        self.state, self.error = READY, ""

    def failed(self, error: str) -> None:
        self.error = error
        if self.state != READY:
            self.state = FAILED

    def ensure_queryable(self) -> None:
        if self.state != READY:
            raise NotReady(f"the index is {self.state.lower()}{': ' + self.error if self.error else ''}")


def materialised(df: DataFrame) -> DataFrame:
    """The rows computed and written once, so that what follows doesn't run the search again; no executor's memory is held, and the files go with the relation where Spark cleans checkpoints."""
    return cut(df)


def within(spark: SparkSession, seconds: float, act: Callable[[], T]) -> T:
    """The action's result; jobs that it still has after `seconds` are cancelled, and TimeoutError is raised."""
    sc, tag, got = spark.sparkContext, uuid.uuid4().hex, {}

    def run() -> None:
        sc.addJobTag(tag)
        try:
            got["value"] = act()
        except Exception as e:
            got["error"] = e
        finally:
            sc.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        sc.cancelJobsWithTag(tag)
        raise TimeoutError(f"not done in {seconds} s")
    if "error" in got:
        raise got["error"]
    return got["value"]


@dataclass
class Telemetry:
    """A row per call: backend, status and milliseconds."""

    points: list[tuple[str, str, float]] = field(default_factory=list)

    def call(self, backend: str, run: Callable[[], DataFrame], act: Callable[[DataFrame], DataFrame] = materialised) -> DataFrame:
        """Builds a search's plan and runs it by `act`; errors of either are classified and raised again."""
        start, status = time.perf_counter(), "Success"
        try:
            found = run()
            return found if found is None else act(found)
        except NotReady:
            status = "NotReady"
            raise
        except TimeoutError:
            status = "TimedOut"
            raise
        except Exception:
            status = "Failed"
            raise
        finally:
            self.points.append((backend, status, (time.perf_counter() - start) * 1000))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.points, "backend string, status string, ms double")


class _Sums(AccumulatorParam):
    """Sums by key."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = tuple(x + y for x, y in zip(a.get(k, (0,) * len(v)), v, strict=True))
        return a


class EmbeddingTelemetry:
    """Calls, texts and milliseconds of embedding models by model and status, summed over all workers."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sums = spark, spark.sparkContext.accumulator({}, _Sums())

    def measured(self, model: str, run: Callable[[list[str]], list]) -> Callable[[list[str]], list]:
        """The model's function, which notes each call."""
        sums = self.sums

        def call(texts: list[str]) -> list:
            start, status = time.perf_counter(), "Success"
            try:
                return run(texts)
            except TimeoutError:
                status = "TimedOut"
                raise
            except (CancelledError, KeyboardInterrupt):
                status = "Cancelled"
                raise
            except Exception:
                status = "Failed"
                raise
            finally:
                sums.add({(model, status): (1, len(texts), (time.perf_counter() - start) * 1000)})

        return call

    def rows(self) -> DataFrame:
        rows = [(*k, *v) for k, v in sorted(self.sums.value.items())]
        return self.spark.createDataFrame(rows, "model string, status string, calls long, texts long, ms double")


class Embedder(Protocol):
    """Texts to vectors of one model version; queries may be embedded unlike passages."""

    model_version_id: str
    dimension: int

    def embed(self, text: Column, query: bool = False) -> Column: ...


@dataclass(frozen=True)
class HistogramEmbedder:
    dimension: int = DEFAULT.dimension

    @property
    def model_version_id(self) -> str:
        return f"histogram-{self.dimension}"

    def embed(self, text: Column, query: bool = False) -> Column:
        """Unit vectors; blank texts give zeros."""
        return unit_histogram(text, self.dimension)


@dataclass(frozen=True)
class LsaEmbedder:
    """A latent semantic model, fitted on a corpus and kept in the store as an artifact; its dimension is the rank that the fit reached."""

    model: LsaModel

    @property
    def dimension(self) -> int:
        return self.model.dimension

    @property
    def model_version_id(self) -> str:
        return f"lsa-{self.dimension}-{hashlib.sha256(self.model.to_json().encode()).hexdigest()[:12]}"

    def embed(self, text: Column, query: bool = False) -> Column:
        return self.model.transform(text)

    @classmethod
    def fitted(cls, store: Store, docs: DataFrame, dimension: int, include_trigrams: bool = True) -> LsaEmbedder:
        """Fitted on (doc, text) and saved under its version."""
        e = cls(fit_lsa(docs, dimension, include_trigrams))
        store.save_fit(e.model_version_id, e.model.to_json())
        return e

    @classmethod
    def loaded(cls, store: Store, model_version_id: str) -> LsaEmbedder:
        """As it was saved, its settings too; a version without an artifact raises LookupError."""
        artifact = store.fit(model_version_id)
        if artifact is None:
            raise LookupError(f"no artifact of {model_version_id}: it must be fitted again")
        return cls(LsaModel.from_json(artifact))


def loopback(url: str) -> str:
    """The address of a model on this machine; any other raises ValueError, so that no text leaves it."""
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    try:
        local = host == "localhost" or ipaddress.ip_address(host).is_loopback
    except ValueError:
        local = False
    if parts.scheme not in ("http", "https") or not local or parts.username is not None:
        raise ValueError(f"not an address of this machine: {url!r}")
    return url


@dataclass(frozen=True)
class ExternalEmbedder:
    """A model behind a function from a batch of texts to vectors; counts and widths are validated, and queries get an instruction before them.

    `run` is called in the workers with `batch` texts at most; a call that takes longer than `deadline` seconds raises TimeoutError.
    """

    model_version_id: str
    dimension: int
    run: Callable[[list[str]], list[list[float]]]
    instruction: str = ""
    batch: int = DEFAULT.embed_batch
    deadline: float | None = None

    def embed(self, text: Column, query: bool = False) -> Column:
        run, size, dim, before, deadline = self.run, self.batch, self.dimension, self.instruction if query else "", self.deadline

        def ask(texts: list[str]) -> list[list[float]]:
            if deadline is None:
                return run(texts)
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(run, texts).result(deadline)
            except Late:
                raise TimeoutError(f"the model took longer than {deadline} s") from None
            finally:
                pool.shutdown(wait=False, cancel_futures=True)

        @arrow_udf("array<float>")
        def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                values = [before + (t or "") for t in texts.to_pylist()]
                out: list[list[float]] = []
                for i in range(0, len(values), size):
                    got = ask(values[i : i + size])
                    if len(got) != len(values[i : i + size]) or any(len(v) != dim for v in got):
                        raise ValueError("the model's answer has another number or width of vectors")
                    out += [np.asarray(v, np.float32).tolist() for v in got]
                yield pa.array(out, pa.list_(pa.float32()))

        return call(text)


def choose(profiles: dict[str, Callable[[], Embedder]], name: str | None, default: str) -> Embedder:
    """The named profile's embedder; an unknown name raises ValueError and is never replaced by another."""
    if name is not None and name not in profiles:
        raise ValueError(f"no profile {name!r}; there are {', '.join(sorted(profiles))}")
    return profiles[name or default]()


class Hold:
    """Counted, nested holds on publishing changes; a hold that is not released ends by itself after `most` seconds. The last release calls `released`."""

    def __init__(self, most: float = 120.0, clock: Callable[[], float] = time.monotonic, released: Callable[[], None] = lambda: None):
        self.most, self.clock, self.released, self.begun, self._lock = most, clock, released, [], threading.Lock()

    def __enter__(self) -> Hold:
        with self._lock:
            self.begun.append(self.clock())
        return self

    def __exit__(self, *error) -> None:
        with self._lock:
            self.begun.pop()
            last = not self.begun
        if last:
            self.released()

    @property
    def active(self) -> bool:
        return any(self.clock() - t < self.most for t in self.begun)
