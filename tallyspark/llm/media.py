"""Media columns: payloads stored as WAV, read with the wave module, and spectral-peak fingerprints.

``write_media`` stores each payload as 8-bit mono samples in a ``media`` column of a Parquet table; the stored form is a
whole WAV file. ``write_features`` reads it with the wave module, takes short-time Fourier transforms (frames of 256
samples, hop 128, Hann window, the last frame filled up with silence) and keeps as peaks the bins that no bin within three frames and
eight bins of theirs is stronger than, of at least a hundredth of their frame's greatest power, at most the strongest two of a frame. Each peak is paired with the next three in order of
(frame, bin): code = bin << 16 | other bin << 8 | frames between (at most 255). The pairs are stored beside the digests as a
time-coded array, the frame numbers (times) and the codes; ``features`` reads them back. ``feature`` is their number and
the least 16 bits of the hashes of the codes in each of 16 classes: of clips that differ in few peaks most of the 16 agree (``alike``).

Null texts count as empty; an empty payload is 64 zero bytes, silent, and has no peaks. Equal payloads give equal
values. Very long media are transformed in blocks of frames. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

FRAME, HOP, NEAR, BESIDE, EACH, FAN, RATE = 256, 128, 3, 8, 2, 3, 8000
FLOOR = np.float32(0.01)
HANN = np.hanning(FRAME).astype(np.float32)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the local maxima in time and frequency, in this order; bins from 1, the constant one is left out."""
    x = np.frombuffer(samples, np.uint8)
    count = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    frames, bins = [], []
    for a in range(0, count, block):  # each block with the frames around it, so that very long media need no more memory
        low, high = max(0, a - NEAR), min(count, a + block + NEAR)
        part = np.zeros((high - low - 1) * HOP + FRAME, np.float32)
        some = x[low * HOP : low * HOP + len(part)]
        part[: len(some)] = some.astype(np.float32) - np.float32(128)
        view = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        spectrum = np.fft.rfft((view - view.mean(axis=1, keepdims=True)) * HANN, axis=1)[:, 1:]
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        best = power.copy()
        for k in range(1, NEAR + 1):
            best[k:] = np.maximum(best[k:], power[:-k])
            best[:-k] = np.maximum(best[:-k], power[k:])
        around = best.copy()
        for k in range(1, BESIDE + 1):
            around[:, k:] = np.maximum(around[:, k:], best[:, :-k])
            around[:, :-k] = np.maximum(around[:, :-k], best[:, k:])
        f, c = np.nonzero((power >= around) & (power > 1.0) & (power >= FLOOR * power.max(axis=1, keepdims=True)))
        inside = (f >= a - low) & (f < min(count, a + block) - low)
        f, c = f[inside], c[inside]
        order = np.lexsort((c, -power[f, c], f))
        f, c = f[order], c[order]
        nth = np.arange(len(f)) - np.searchsorted(f, f)
        f, c = f[nth < EACH], c[nth < EACH]
        order = np.lexsort((c, f))
        frames.append(f[order] + low)
        bins.append(c[order] + 1)
    return np.concatenate(frames).astype(np.int64), np.concatenate(bins).astype(np.int64)


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of the pairs of spectral peaks."""
    frames, bins = spectral_peaks(samples)
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = np.minimum(frames[k:] - frames[:-k], 255)
        times.append(frames[:-k])
        codes.append(bins[:-k] << 16 | bins[k:] << 8 | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def feature_of(times: np.ndarray, codes: np.ndarray) -> str:
    """Number of pairs and, for 16 classes of codes, the least 16 bits of their hashes (ffff where a class has none)."""
    h = np.unique(codes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least = np.full(16, 0xFFFF, np.int64)
    np.minimum.at(least, (h >> np.uint64(60)).astype(np.int64), (h >> np.uint64(40) & np.uint64(0xFFFF)).astype(np.int64))
    return f"{len(codes)}:" + "".join(f"{x:04x}" for x in least.tolist())


def alike(a: str, b: str) -> float:
    """The share of equal parts of two features: an estimate of how many codes the two clips share."""
    x, y = a.split(":")[1], b.split(":")[1]
    return sum(x[i : i + 4] == y[i : i + 4] for i in range(0, 64, 4)) / 16


def payload_of(text: str, unit: int = 64) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (-len(data) % unit or (0 if data else unit))


def write_media(docs: DataFrame, path: str) -> DataFrame:
    """Stores doc_id, n_bytes, media (a WAV file each) and returns the table as read back."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"].astype("Int64")
            for a, b in common.slices(texts):
                made = [payload_of(t) for t in texts[a:b]]
                yield pd.DataFrame({"doc_id": keys.iloc[a:b].reset_index(drop=True), "n_bytes": [n for n, _ in made], "media": [to_wav(p) for _, p in made]})

    media = common.texts_of(docs).mapInPandas(encode, "doc_id long, n_bytes long, media binary")
    media.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(media.schema).parquet(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"


def write_features(media: DataFrame, path: str) -> DataFrame:
    """Reads the stored media back and stores digests and time-coded arrays; returns that table as read back."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, n, stored in zip(batch["doc_id"].tolist(), batch["n_bytes"].tolist(), batch["media"].tolist()):
                payload = from_wav(stored)
                times, codes = peak_pairs(payload)
                rows.append((None if pd.isna(key) else int(key), n, len(payload), hashlib.sha256(payload).hexdigest(), common.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), times.astype(np.int32), codes.astype(np.int32)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    found = media.select("doc_id", "n_bytes", "media").mapInPandas(read, FEATURES)
    found.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(found.schema).parquet(path)


def features(media: DataFrame, path: str | None = None) -> DataFrame:
    """The stored digests and arrays of the media (times, codes), and a short ``feature`` of what was read back."""

    @F.pandas_udf("string")
    def feature(times: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([feature_of(np.asarray(t, np.int64), np.asarray(c, np.int64)) for t, c in zip(times, codes)], dtype="object")

    return write_features(media, path or common.shared_dir(media.sparkSession)).withColumn("feature", feature("times", "codes"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = write_media(common.table(spark, sf_dir, "documents"), common.shared_dir(spark))
    return features(media).drop("times", "codes")
