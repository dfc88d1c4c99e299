"""Audio columns: bytes stored as 8-bit samples, and features computed from the stored form.

A payload becomes an 8-bit mono WAV file. Features come from that file, read back: a polyphase
filter changes its rate, overlapped frames give log-mel energies, and a hysteresis on the frames'
energy cuts out active segments. The log-mel frames are kept as fixed-shape tensors (an Arrow IPC
stream per row), each with the time spans that it covers and in which it is active. The feature
column is printed from that stream, read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table

PAD = 64
IN_RATE, OUT_RATE = 16_000, 8_000
TAPS_PER_PHASE = 8
FRAME, HOP, MELS = 256, 128, 16
#: Frames of one tensor.
PATCH = 32
#: Standard deviations above the mean energy at which a segment begins, and below which it ends.
RISE, FALL = 0.5, 0.0
#: Frames that are transformed at once.
SLAB = 4096

RESULT = "media binary, tensors binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
DIGEST = RESULT.removeprefix("media binary, tensors binary, ")


def padded(data: bytes) -> bytes:
    """Followed by zeros up to a positive multiple of PAD."""
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\0")


def to_wav(payload: bytes, rate: int = IN_RATE) -> bytes:
    """8-bit unsigned mono PCM; the payload's bytes are the samples."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(wav: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono PCM file; anything else raises ValueError."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(wav):
        name, size = struct.unpack_from("<4sI", wav, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data" and rate:
            return wav[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def phases(up: int, down: int) -> np.ndarray:
    """[up, taps]: a windowed sinc low-pass at the lower of the two rates, a phase a row, taps reversed."""
    n = TAPS_PER_PHASE * up * max(1, -(-down // up))
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(-1, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """The samples at up / down times the rate: output n is one phase's dot product with the input around n * down / up."""
    h = phases(up, down)
    taps, n_out = h.shape[1], -(-len(x) * up // down)
    left = taps // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (left, taps + down)), taps)
    out = np.empty(n_out, np.float32)
    for first in range(min(up, n_out)):
        y = out[first::up]
        start = first * down // up
        y[:] = (windows[start :: down][: len(y)] @ h[first * down % up])[: len(y)]
    return out


@lru_cache
def mel_bank(rate: int) -> np.ndarray:
    """[bins, MELS]: triangles evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """[frames, MELS] log10 energies and each frame's energy in dB; the last frame is filled up with silence."""
    n = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    x = np.pad(x, (0, max(0, (n - 1) * HOP + FRAME - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, SLAB):
        part = frames[i : i + SLAB]
        spectrum = np.fft.rfft(part * _WINDOW)
        power = spectrum.real**2 + spectrum.imag**2
        mel[i : i + SLAB] = np.log10(power.astype(np.float32) @ mel_bank(rate) + 1e-6)
        energy[i : i + SLAB] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-6)
    return mel, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """[n, 2] first and end frame of each stretch that begins above the upper and lasts until below the lower threshold."""
    mean, spread = float(energy.mean()), float(energy.std())
    mark = (energy > mean + RISE * spread).astype(np.int8) - (energy < mean + FALL * spread)
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[0], ((last >= 0) & (mark[last] > 0)).astype(np.int8), [0]])
    step = np.diff(on)
    return np.stack([np.flatnonzero(step > 0), np.flatnonzero(step < 0)], 1)


_TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
TENSORS = pa.schema([("log_mel", _TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("active_frames", pa.int32()), ("segments", _SPANS)])


@dataclass
class Features:
    mel: np.ndarray
    active: np.ndarray
    rate: int

    def spans(self) -> np.ndarray:
        """Seconds at which each active segment begins and ends."""
        return (self.active * HOP + [0, FRAME - HOP]) / self.rate

    def tensors(self) -> bytes:
        """An Arrow IPC stream: a [PATCH, MELS] tensor a row, the last filled up with zeros, with its span in seconds, its frames, its active frames and the spans of the segments that begin in it."""
        n = -(-len(self.mel) // PATCH)
        values = np.zeros((n * PATCH, MELS), np.float32)
        values[: len(self.mel)] = self.mel
        on = np.zeros(n * PATCH + 1, np.int32)
        np.add.at(on, self.active[:, 0], 1)
        np.add.at(on, self.active[:, 1], -1)
        active = np.cumsum(on)[:-1].reshape(n, PATCH).sum(1)
        start = np.arange(n) * PATCH
        frames = np.minimum(PATCH, len(self.mel) - start)
        spans = self.spans()
        begins = np.searchsorted(self.active[:, 0], np.append(start, n * PATCH)).astype(np.int32)
        segments = pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start_s", "end_s"]))
        tensors = pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), PATCH * MELS))
        columns = [tensors, pa.array(start * HOP / self.rate), pa.array(((start + frames - 1) * HOP + FRAME) / self.rate), pa.array(frames.astype(np.int32)), pa.array(active.astype(np.int32)), segments]
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, TENSORS) as w:
            w.write_batch(pa.record_batch(columns, schema=TENSORS))
        return out.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def described(stream: bytes) -> str:
    """Of stored tensors: frames, active segments, active frames, then the mean log energy of each band."""
    batch = pa.ipc.open_stream(stream).read_next_batch()
    total = lambda name: int(batch.column(name).to_numpy().sum())
    frames, spans = total("frames"), batch.column("segments")
    mel = batch.column("log_mel").storage.flatten().to_numpy().reshape(-1, MELS)[:frames]
    return f"{frames}:{len(spans.flatten())}:{total('active_frames')}:" + ",".join([f"{v:.3f}" for v in mel.mean(0, dtype=np.float64)])


def features(wav: bytes) -> Features:
    samples, rate = from_wav(wav)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    if rate != OUT_RATE:
        g = int(np.gcd(rate, OUT_RATE))
        x = resample(x, OUT_RATE // g, rate // g)
    mel, energy = log_mel(x, OUT_RATE)
    return Features(mel, segments(energy), OUT_RATE)


def audio(data: Column, digest: bool = False) -> Column:
    """A struct of the stored file, its tensors and their digests, or of the digests alone.

    Strings are taken as UTF-8; null and empty data give a payload of PAD zeros.
    """

    @arrow_udf(DIGEST if digest else RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([(c.split()[0], {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in (DIGEST if digest else RESULT).split(", ")])
        for values in batches:
            rows = []
            for value in values.cast(pa.binary()):
                raw = value.as_py() or b""
                wav = to_wav(padded(raw))
                stored, _ = from_wav(wav)
                tensors = features(wav).tensors()
                row = {} if digest else {"media": wav, "tensors": tensors}
                rows.append(row | {"n_bytes": len(raw), "payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-PAD:]), "media_bytes": len(wav), "media_sha256": hashlib.sha256(wav).hexdigest(), "feature": described(tensors)})
            yield pa.array(rows, kind)

    return run(data)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", audio(F.col("text"), digest=True).alias("a")).select("doc_id", "a.*")
