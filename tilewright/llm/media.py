"""Media columns: bytes kept as 8-bit WAV, short-time Fourier transforms, and spectral-peak pair fingerprints.

`encode` writes each payload as a mono WAV file with the wave module, `describe` reads the stored file back, takes its
spectrogram and pairs each frame's strongest peaks with those of the frames that follow. A fingerprint is a pair of
arrays: time codes (frame numbers) and codes (both frequency bins and the distance in frames).

Null text is empty text; a payload is never empty, as empty ones are padded to one frame. Very long payloads are
transformed in blocks of frames. Equal payloads have equal results, repeated rows are kept, an empty table gives an
empty result. `encode` and `describe` keep all columns of their input beside those they add; a column of the same name is
replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tilewright.llm.common import slices

#: Frame length in samples, also the unit of padding; the padding byte; samples a second.
FRAME, PAD, RATE = 576, 255, 8000
BLOCK = 512
PEAKS, REACH = 3, 3


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(data: bytes) -> bytes:
    """data and PAD bytes up to a positive multiple of FRAME."""
    return data + bytes([PAD]) * (FRAME * max(1, -(-len(data) // FRAME)) - len(data))


_TAPER = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray) -> np.ndarray:
    """(frames, PEAKS) bins of each frame's strongest local maxima, strongest first, -1 where there are fewer."""
    frames = samples.reshape(-1, FRAME)
    out = np.full((len(frames), PEAKS), -1, dtype=np.int32)
    for i in range(0, len(frames), BLOCK):
        part = frames[i : i + BLOCK].astype(np.float32)
        part = (part - part.mean(axis=1, keepdims=True)) * _TAPER
        power = np.abs(np.fft.rfft(part, axis=1)) ** 2
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-3), np.round(inner, 3), 0)
        best = np.argpartition(-top, PEAKS, axis=1)[:, :PEAKS]
        value = np.take_along_axis(top, best, axis=1)
        rank = np.lexsort((best, -value), axis=1)
        best, value = np.take_along_axis(best, rank, axis=1), np.take_along_axis(value, rank, axis=1)
        out[i : i + BLOCK] = np.where(value > 0, best + 1, -1)
    return out


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and pair codes: each peak with each peak of the next REACH frames."""
    p = peaks(samples)
    times, codes = [], []
    for d in range(1, REACH + 1):
        if len(p) > d:
            a, b = p[:-d, :, None], p[d:, None, :]
            code = (a.astype(np.int64) << 20) | (b.astype(np.int64) << 4) | d
            ok = (a >= 0) & (b >= 0)
            times.append(np.broadcast_to(np.arange(len(p) - d)[:, None, None], code.shape)[ok])
            codes.append(code[ok])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order]


def _added(schema: T.StructType, more: list[T.StructField]) -> T.StructType:
    names = {f.name for f in more}
    return T.StructType([f for f in schema.fields if f.name not in names] + more)


def _extend(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in columns}
    return pa.RecordBatch.from_arrays([*kept.values(), *columns.values()], names=[*kept, *columns])


_STORED = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
_FOUND = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail", T.BinaryType()),
    T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.LongType())),
]


def _stored(whole: pa.RecordBatch, text: str, slice_rows: int, size: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    for batch in slices(whole, text, slice_rows, size):
        raw = [(x or "").encode() for x in batch.column(text).to_pylist()]
        yield _extend(batch, {
            "n_bytes": pa.array([len(x) for x in raw], pa.int64()),
            "media": pa.array([to_wav(padded(x)) for x in raw], pa.binary()),
        })


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _described(whole: pa.RecordBatch, column: str, slice_rows: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(whole, column, slice_rows):
        raw = [from_wav(x) for x in batch.column(column).to_pylist()]
        found = [fingerprint(np.frombuffer(x, dtype=np.uint8)) for x in raw]
        yield _extend(batch, {
            "payload_bytes": pa.array([len(x) for x in raw], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
            "tail": pa.array([x[-32:] for x in raw], pa.binary()),
            "times": _lists([f[0] for f in found], pa.int32()),
            "codes": _lists([f[1] for f in found], pa.int64()),
        })


def encode(docs: DataFrame, text: str = "text", slice_rows: int = 256) -> DataFrame:
    """docs with n_bytes (long) and media (binary, a WAV file of the padded UTF-8 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from _stored(whole, text, slice_rows)

    return docs.mapInArrow(run, _added(docs.schema, _STORED))


def describe(media: DataFrame, column: str = "media", slice_rows: int = 256) -> DataFrame:
    """media with payload_bytes, payload_sha256, tail (its last 32 bytes), and the fingerprint's times and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from _described(whole, column, slice_rows)

    return media.mapInArrow(run, _added(media.schema, _FOUND))


def stored_and_described(docs: DataFrame, text: str = "text", slice_rows: int = 256) -> DataFrame:
    """docs without the text, with what encode and describe add: both in one pass, so that a task has one worker and media do not go back and forth."""
    kept = _added(T.StructType([f for f in docs.schema.fields if f.name != text]), _STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _stored(whole, text, slice_rows, 1 << 22):
                yield from _described(batch.select(kept.names), "media", slice_rows)

    return docs.mapInArrow(run, _added(kept, _FOUND))
