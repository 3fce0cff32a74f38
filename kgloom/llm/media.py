"""Media columns: texts held as 8-bit WAV, short-time Fourier transforms, spectral-peak pair fingerprints.

A payload is the UTF-8 text followed by spaces (byte 32) up to a positive multiple of 192 bytes. Each payload byte is
one unsigned 8-bit sample of a mono WAV file, so the file holds the payload without loss. Everything else is computed
from the samples that the ``wave`` module reads back from the stored bytes.

Defined cases: a null or empty text is 192 spaces; a file of any length is transformed in blocks of frames, so memory is
bounded by the file itself; equal texts give equal files, hashes and fingerprints; an empty table gives no rows; only
``doc_id`` and ``text`` are read, whatever other columns there are; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

UNIT = 192
RATE = 8000
FRAME, HOP, BLOCK = 512, 256, 2048
#: Spectrum bins where each band begins; the last is the end of the spectrum.
BANDS = (1, 12, 36, 96, 257)
#: A peak is paired with the next so many peaks, at most so many frames later.
FAN_OUT, REACH = 3, 63

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, pair_times array<int>, pair_codes array<int>"
)


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """``raw`` and spaces up to a positive multiple of ``unit``."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" ")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One unsigned 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def spectrogram(samples: np.ndarray, frame: int = FRAME, hop: int = HOP, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Magnitudes of windowed frames, in blocks of at most ``block`` frames. The last frame is padded with silence."""
    frames = 1 + max(0, -(-(len(samples) - frame) // hop))
    window = np.hanning(frame).astype(np.float32)
    for first in range(0, frames, block):
        n = min(block, frames - first)
        part = samples[first * hop : first * hop + (n - 1) * hop + frame].astype(np.float32) - np.float32(128)
        part = np.pad(part, (0, (n - 1) * hop + frame - len(part)))
        yield np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, frame)[::hop] * window, axis=1))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and bins of spectral peaks: the strongest bin of a band, where no adjoining frame has a stronger one."""
    bins, heights = [], []
    for block in spectrogram(samples):
        best = [lo + block[:, lo:hi].argmax(axis=1) for lo, hi in zip(BANDS, BANDS[1:])]
        bins.append(np.stack(best, axis=1))
        heights.append(np.take_along_axis(block, bins[-1], axis=1))
    bin_, height = np.concatenate(bins), np.concatenate(heights)
    around = np.pad(height, ((1, 1), (0, 0)), constant_values=-1)
    keep = (height > 1e-3) & (height > around[:-2]) & (height >= around[2:])
    time, band = np.nonzero(keep)
    return time.astype(np.int64), bin_[time, band].astype(np.int64)


def peak_pairs(time: np.ndarray, bin_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each peak with the next ``FAN_OUT`` within ``REACH`` frames: the time of the first, and both bins and the lag as a code."""
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        lag = time[k:] - time[:-k]
        near = lag <= REACH
        times.append(time[:-k][near])
        codes.append((bin_[:-k][near] << 15) | (bin_[k:][near] << 6) | lag[near])
    at, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, at))
    return at[order].astype(np.int32), code[order].astype(np.int32)


def describe(raw: bytes) -> tuple:
    """The columns of ``SCHEMA`` after doc_id."""
    media = to_wav(pad(raw))
    payload = from_wav(media)
    at, code = peak_pairs(*peaks(np.frombuffer(payload, dtype=np.uint8)))
    feature = f"{len(at)}:{hashlib.sha256(at.astype('<i4').tobytes() + code.astype('<i4').tobytes()).hexdigest()}"
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, at, code)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


#: Rows of a result batch; a long text's arrays then never wait for thousands of others.
OUT_ROWS = 256


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for whole in batches:
        for first in range(0, whole.num_rows, OUT_ROWS):
            batch = whole.slice(first, OUT_ROWS)
            rows = list(zip(*(describe(raw.as_py()) for raw in batch.column(1))))
            columns = [batch.column(0)] + [pa.array(rows[k], pa.int64()) if k in (0, 1, 3, 4) else pa.array(rows[k]) for k in range(7)] + [_lists(rows[7]), _lists(rows[8])]
            yield pa.RecordBatch.from_arrays(columns, names)


def media_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each document: its WAV's checksums and its spectral-peak pairs as time-coded arrays. No shuffle."""
    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("raw")).mapInArrow(_describe_batches, SCHEMA)
