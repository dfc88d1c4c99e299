"""PII, language, media, BPE: one row in, one row out."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, media, pii

from .conftest import DOCS

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0, "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@", "@", ".", "c.d", "-", "4", "4111111111111111", "4111-1111 1111 1111", "255.1.2.3", "1.2.3.4.5.6.7.8", "256", "+1 (555) 123-4567", "+", " ", "\n", "é", "0", "x@y.z@w.v", "\U0001f600"]), max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    got = [s[:3] for s in pii.spans(text)]
    assert [s for s in got if s[0] in pii.BASE] == base_spans(text)


def test_added_kinds_need_checksum_or_context():
    iban = "GB82 WEST 1234 5698 7654 32"
    assert [s[0] for s in pii.spans(f"pay to {iban} now")] == ["iban"]
    assert not pii.spans(f"pay to {iban[:-1]}3 now")
    assert [s[0] for s in pii.spans("SSN 123-45-6789")] == ["ssn"] and not pii.spans("part 123-45-6789")
    assert [s[0] for s in pii.spans("call (555) 123-4567")] == ["local_phone"] and not pii.spans("order (555) 123-4567")


def test_long_runs_stay_linear():
    for text in ("1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 300_000, "a" * 300_000 + "@", "x.y-" * 80_000):
        pii.spans(text)


def test_mask_and_edge_rows(docs, none):
    assert pii.mask("mail a@b.cd or 10.0.0.1!") == "mail [EMAIL] or [IP]!" and pii.mask(None) is None and pii.mask("") == ""
    rows = docs.withColumn("p", pii.find_pii(F.col("text"))).withColumn("m", pii.mask_pii(F.col("text"))).collect()
    assert len(rows) == len(DOCS) and all(r.p.kinds == [] and r.m == r.text for r in rows)
    assert none.select(pii.find_pii(F.col("text"))).count() == 0


def test_filters_have_all_members_and_few_others():
    rng = np.random.default_rng(0)
    grams = {lang: rng.integers(0, 1 << 62, 5000).astype(np.uint64) for lang in ("a", "b", "c")}
    f = langid.Filters.build(["a", "b", "c"], grams, "a")
    for i, lang in enumerate(f.langs):
        assert ((f.masks(grams[lang])[:, 0] & (128 >> i)) > 0).all()
    other = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    for i in range(3):
        assert abs(((f.masks(other)[:, 0] & (128 >> i)) > 0).mean() - f.false_rate[i]) < 0.01


def test_language_edges(spark, docs, none):
    filters = langid.fit(docs)
    rows = docs.select("doc_id", "text", langid.identify(spark, F.col("text"), filters).alias("l")).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.l.lang == "und") == (not letters) and 0 <= r.l.score <= 1 and r.l.lang in {"und", "en", "de", "fr"}
    assert {r.l.lang for r in rows if r.text and "Hund" in r.text} == {"de"}
    nothing = langid.fit(none)
    assert {r.l.lang for r in docs.select(langid.identify(spark, F.col("text"), nothing).alias("l")).collect()} == {"und"}
    assert none.select(langid.identify(spark, F.col("text"), filters)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_wav_round_trip(n):
    data = bytes(range(256)) * (n // 256 + 1)
    p = media.padded(data[:n])
    assert len(p) % 64 == 0 and len(p) >= max(64, n) and len(p) - n <= 64 and media.from_wav(media.to_wav(p)) == (p, media.IN_RATE)
    odd = b"\1\2\3"
    assert media.from_wav(media.to_wav(odd))[0] == odd


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 1), (1, 1)])
def test_resample_equals_direct_sum(up, down):
    x = np.random.default_rng(1).normal(size=500).astype(np.float32)
    h, y = media.phases(up, down), media.resample(x, up, down)
    padded = np.pad(x, (h.shape[1] // 2, h.shape[1] + down))
    want = [padded[n * down // up : n * down // up + h.shape[1]] @ h[n * down % up] for n in range(len(y))]
    assert len(y) == -(-500 * up // down) and np.allclose(y, want, atol=1e-5)


def test_tone_lands_in_its_band_and_segment():
    t = np.arange(32_000) / media.IN_RATE
    x = np.where((t > 0.5) & (t < 1.5), np.sin(2 * np.pi * 1000 * t) * 100, 0) + 128
    f = media.features(media.to_wav(x.astype(np.uint8).tobytes()))
    assert len(f.active) == 1 and np.allclose(f.spans()[0], [0.5, 1.5], atol=0.06)
    tensors = media.read_tensors(f.tensors())
    assert tensors.schema.field("log_mel").type.shape == [media.PATCH, media.MELS]
    assert np.allclose(np.concatenate(tensors["log_mel"].combine_chunks().to_numpy_ndarray() if hasattr(tensors["log_mel"], "combine_chunks") else [])[: len(f.mel)], f.mel)
    edges = np.linspace(0, 2595 * np.log10(1 + 4000 / 700), media.MELS + 2)
    centre = np.abs(edges[1:-1] - 2595 * np.log10(1 + 1000 / 700)).argmin()
    assert f.mel.mean(0).argmax() == centre


def plain_segments(energy):
    """Loops: on above the upper threshold, off below the lower."""
    mean, spread, on, out = float(energy.mean()), float(energy.std()), None, []
    for i, e in enumerate(energy):
        if on is None and e > mean + media.RISE * spread:
            on = i
        elif on is not None and e < mean + media.FALL * spread:
            out.append((on, i))
            on = None
    return out + [(on, len(energy))] * (on is not None)


def plain_feature(payload):
    """Resampling and mel bands by direct sums."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    h = media.phases(1, 2)[0].astype(np.float64)
    wide = np.concatenate([np.zeros(len(h) // 2), x, np.zeros(len(h) + 2)])
    y = np.array([wide[2 * k : 2 * k + len(h)] @ h for k in range(-(-len(x) // 2))])
    n = max(1, 1 + -(-(len(y) - media.FRAME) // media.HOP))
    y = np.concatenate([y, np.zeros(n * media.HOP + media.FRAME)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    dft = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    frames = np.stack([y[k * media.HOP : k * media.HOP + media.FRAME] for k in range(n)])
    mel = np.log10(np.abs((frames * window) @ dft.T) ** 2 @ media.mel_bank(media.OUT_RATE).astype(np.float64) + 1e-6)
    segments = plain_segments(10 * np.log10((frames**2).mean(1) + 1e-6))
    return (n, len(segments), sum(b - a for a, b in segments)), mel.mean(0)


def test_tensors_hold_frames_and_spans():
    t = np.arange(80_000) / media.IN_RATE
    x = np.where((t % 1 > 0.3) & (t % 1 < 0.6), np.sin(2 * np.pi * 700 * t) * 90, 0) + 128
    f = media.features(media.to_wav(x.astype(np.uint8).tobytes()))
    rows = media.read_tensors(f.tensors()).select(["start_s", "end_s", "frames", "active_frames", "segments"]).to_pylist()
    assert len(f.active) == 5 and [tuple(s.values()) for r in rows for s in r["segments"]] == [tuple(s) for s in f.spans()]
    assert sum(r["frames"] for r in rows) == len(f.mel) and sum(r["active_frames"] for r in rows) == (f.active[:, 1] - f.active[:, 0]).sum()
    assert all(r["start_s"] <= s["start_s"] < rows[i + 1]["start_s"] for i, r in enumerate(rows[:-1]) for s in r["segments"])
    assert rows[-1]["end_s"] == pytest.approx(((len(f.mel) - 1) * media.HOP + media.FRAME) / media.OUT_RATE)


def test_media_edges(docs, none):
    rows = docs.select("text", media.audio(F.col("text")).alias("a")).collect()
    for r in rows:
        raw = (r.text or "").encode()
        p = media.padded(raw)
        assert (r.a.n_bytes, r.a.payload_bytes, r.a.payload_sha256, r.a.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert media.from_wav(r.a.media)[0] == p and hashlib.sha256(r.a.media).hexdigest() == r.a.media_sha256
        assert media.described(r.a.tensors) == r.a.feature
        counts, bands = plain_feature(p)
        *got, mel = r.a.feature.split(":")
        assert tuple(map(int, got)) == counts and np.allclose([float(x) for x in mel.split(",")], bands, atol=2e-3)
    assert none.select(media.audio(F.col("text"))).count() == 0


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(tiktoken_encoding, text):
    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    ids = c.encode(text)
    assert ids.tolist() == tiktoken_encoding.encode_ordinary(text) and c.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "the", "it's", "'s", "12", "é", "!?", "\U0001f600", "\u0301", "\r\n", "x" * 40]), max_size=20))
def test_bpe_of_words_and_spaces(tiktoken_encoding, parts):
    text = "".join(parts)
    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    ids = c.encode(text)
    assert ids.tolist() == tiktoken_encoding.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_bpe_cache_forgets_and_stays_right(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    c = bpe.Codec(bpe.default_ranks(), bpe.default_pattern())
    for text in ["a b c d e f a b", "g h  i", "f e d c b a" + "x" * 99, ""] * 3:
        assert c.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)
    assert len(c.cache) <= 3 and len(c.cache.older) <= 3


def test_bpe_edges(docs, none, tiktoken_encoding):
    rows = docs.select("text", bpe.bpe(F.col("text")).alias("b"), bpe.bpe(F.col("text"), digest=True).alias("d")).collect()
    for r in rows:
        want = tiktoken_encoding.encode_ordinary(r.text or "")
        assert list(r.b.ids) == want and bytes(r.b.decoded) == (r.text or "").encode() and r.b.n_tokens == len(want) == r.d.n_tokens
        assert r.d.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert none.select(bpe.bpe(F.col("text"))).count() == 0
