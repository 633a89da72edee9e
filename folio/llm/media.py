"""Media columns: payloads as WAV samples, spectra and fingerprints.

Method: a payload's bytes are the samples of an 8-bit mono WAV file, written and read back by the wave module. A
short-time Fourier transform of the samples read back gives a spectrogram; its local peaks are paired with the next few
peaks within a span of time, and each pair's two frequencies and distance, with the time of the first, make the
fingerprint: an array of codes and one of times.

Memory is bounded by ``BLOCK_FRAMES`` frames of spectrogram whatever a payload's length; blocks overlap by a frame on
either side, so their seams don't show.

Defined results: a null text is empty; an empty text is 64 zero bytes, whose spectrum is flat and has no peaks; equal
texts give equal values, so repeated rows do; a very long text is one file, read in blocks of frames; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import documents, lean, python_ready, text_rows, utf8

UNIT = 64
RATE = 8_000
FRAME, HOP = 256, 128
BLOCK_FRAMES = 4_096
NEAR, FAN, SPAN = 3, 3, 24  # bins beside a peak, partners of a peak, frames between them
ABOVE = 1.5  # times a frame's mean magnitude

_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


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


def spectrogram(samples: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Magnitudes of frames lo to hi; the last frames are filled up with silence."""
    need = (hi - 1) * HOP + FRAME
    part = samples[lo * HOP : need].astype(np.float32) - np.float32(128)
    if len(part) < need - lo * HOP:
        part = np.append(part, np.zeros(need - lo * HOP - len(part), np.float32))
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each peak, in order of both."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    times, bins = [], []
    for lo in range(0, n, BLOCK_FRAMES):
        hi = min(n, lo + BLOCK_FRAMES)
        a, b = max(0, lo - 1), min(n, hi + 1)
        m = spectrogram(samples, a, b)
        m[:, 0] = 0  # the mean is no tone
        top = m > ABOVE * m.mean(axis=1, keepdims=True)
        for d in range(1, NEAR + 1):
            top[:, d:] &= m[:, d:] > m[:, :-d]
            top[:, :-d] &= m[:, :-d] >= m[:, d:]
        top[1:] &= m[1:] > m[:-1]
        top[:-1] &= m[:-1] >= m[1:]
        t, f = np.nonzero(top[lo - a : hi - a])
        times.append(t + lo)
        bins.append(f)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (two frequencies and a distance) and the times of their first peaks."""
    t, f = peaks(samples)
    codes, times = [], []
    for d in range(1, FAN + 1):
        if len(t) <= d:
            break
        apart = t[d:] - t[:-d]
        near = apart <= SPAN
        codes.append((f[:-d] << 16 | f[d:] << 8 | apart)[near])
        times.append(t[:-d][near])
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code, time = np.concatenate(codes).astype(np.int32), np.concatenate(times).astype(np.int32)
    order = np.lexsort((code, time))
    return code[order], time[order]


MEDIA = "doc_id bigint, media binary, codes array<int>, times array<int>"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _texts(batch: pa.RecordBatch) -> Iterator[memoryview]:
    data, offsets = utf8(batch.column(1))
    view, cuts = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    return (view[a:b] for a, b in zip(cuts, cuts[1:]))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media (the WAV file), codes and times of every row: the operator's general output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(_texts(batch)):  # media are as large as texts: one row at a time
                media = to_wav(payload(bytes(text)))
                code, time = fingerprint(np.frombuffer(from_wav(media), np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), pa.array([media], pa.binary()), pa.array([code], pa.list_(pa.int32())), pa.array([time], pa.list_(pa.int32()))],
                    ["doc_id", "media", "codes", "times"],
                )

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), MEDIA)


def media_features(docs: DataFrame) -> DataFrame:
    """Digests of each row's payload, stored media and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch):
                media = to_wav(payload(bytes(text)))
                back = from_wav(media)
                code, time = fingerprint(np.frombuffer(back, np.uint8))
                shape = hashlib.sha256(code.astype("<i4").tobytes() + time.astype("<i4").tobytes()).hexdigest()
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), f"pairs={len(code)};sha256={shape}"))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), FEATURES)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))
