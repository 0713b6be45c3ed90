"""Media columns: audio features as fixed-shape Arrow tensors with time spans.

``audio_features`` reads stored 8-bit mono WAV clips, resamples them with a polyphase filter, computes overlapped
log-mel frames and segments them by energy with two thresholds. All of it is a narrow map: no shuffle, no state
between rows, so a lost executor costs the rows of its own tasks. Samples, frames and spectra are worked on in blocks of ``BLOCK_FRAMES``
frames; what is held of a whole clip is its log-mel frames (160 bytes for each 240 bytes of samples) and its stored tensors, which repeat each frame at half the width.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import byte_slices, map_arrow, table

SOURCE_HZ, TARGET_HZ = 24_000, 16_000
UP, DOWN, TAPS = 2, 3, 16  # taps of each phase
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
TENSOR_FRAMES, TENSOR_HOP = 96, 48  # frames of one stored tensor, and between the starts of two
BLOCK_FRAMES = 8192
ON_DB, OFF_DB = 0.5, -0.5  # against the clip's mean frame energy
SLICE = 2 << 20  # bytes of clips or texts whose media, frames and tensors a task holds together
UNIT = 576  # bytes that a payload is padded to


def encode_wav(payload: bytes) -> bytes:
    """The payload's bytes as unsigned 8-bit mono samples in a RIFF/WAVE file; nothing is lost."""
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, SOURCE_HZ, SOURCE_HZ, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def decode_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAVE file."""
    with wave.open(io.BytesIO(media)) as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return f.readframes(f.getnframes())


@lru_cache(1)
def phases() -> np.ndarray:
    """Windowed-sinc low-pass at the lower Nyquist frequency, split into ``UP`` phases of ``TAPS`` taps."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.kaiser(UP * TAPS, 6.0)
    return (h * UP / h.sum()).reshape(TAPS, UP).T.astype(np.float32)


def resample(samples: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Outputs ``start`` to ``stop`` (exclusive) of the polyphase resampler over 8-bit samples.

    Every output is the same sum in the same order wherever the range begins, so blocks join without a seam.
    """
    first = start * DOWN // UP - TAPS + 1
    last = (stop - 1) * DOWN // UP + 1
    held = samples[max(0, first) : max(0, last)].astype(np.float32)
    held = (held - 128.0) / 128.0
    held = np.pad(held, (max(0, -first), max(0, last - max(0, first) - len(held))))
    out = np.empty(stop - start, np.float32)
    for r in range(UP):
        n0 = start + (r - start) % UP
        count = len(range(n0, stop, UP))
        if not count:
            continue
        taps = phases()[n0 * DOWN % UP]
        at = n0 * DOWN // UP - first
        total = np.zeros(count, np.float32)
        for k in range(TAPS):
            total += taps[k] * held[at - k : at - k + (count - 1) * DOWN + 1 : DOWN]
        out[n0 - start :: UP] = total
    return out


@lru_cache(1)
def mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale: FFT bins by ``MELS``."""
    top = 2595 * np.log10(1 + TARGET_HZ / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    hz = np.arange(FFT // 2 + 1) * TARGET_HZ / FFT
    rise = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames by ``MELS``) and the frames' energies in dB."""
    length = -(-len(samples) * UP // DOWN)
    frames = max(1, 1 + -(-max(0, length - FRAME) // HOP))
    hann = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for f in range(0, frames, BLOCK_FRAMES):
        g = min(frames, f + BLOCK_FRAMES)
        y = resample(samples, f * HOP, (g - 1) * HOP + FRAME)
        windows = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * hann
        energy[f:g] = 10 * np.log10((windows * windows).mean(axis=1) + 1e-9)
        spectrum = np.fft.rfft(windows, FFT)
        mels[f:g] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ mel_bank() + 1e-6)
    return mels, energy


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames (start, stop) that begin at ``ON_DB`` above the mean energy and end at ``OFF_DB``."""
    level = energy - energy.mean()
    mark = np.where(level >= ON_DB, 1, np.where(level <= OFF_DB, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.concatenate([[0], np.where(last >= 0, mark[last], 0), [0]])
    turns = np.flatnonzero(np.diff(on))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def ms(frame: int) -> int:
    return frame * HOP * 1000 // TARGET_HZ


def tensors(mels: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Overlapping ``TENSOR_FRAMES`` by ``MELS`` tensors (the last one padded with silence) and their time spans."""
    count = max(1, 1 + -(-(len(mels) - TENSOR_FRAMES) // TENSOR_HOP)) if len(mels) > TENSOR_FRAMES else 1
    padded = np.full(((count - 1) * TENSOR_HOP + TENSOR_FRAMES, MELS), np.log(1e-6), np.float16)
    padded[: len(mels)] = mels
    cut = np.lib.stride_tricks.sliding_window_view(padded, TENSOR_FRAMES, axis=0)[::TENSOR_HOP].transpose(0, 2, 1)
    stored = np.ascontiguousarray(cut)
    starts = [i * TENSOR_HOP for i in range(count)]
    return (
        pa.table(
            {
                "logmel": pa.FixedShapeTensorArray.from_numpy_ndarray(stored),
                "start_ms": pa.array([ms(s) for s in starts], pa.int64()),
                "end_ms": pa.array([ms(min(len(mels), s + TENSOR_FRAMES)) for s in starts], pa.int64()),
            }
        ),
        stored,
    )


def to_ipc(t: pa.Table) -> bytes:
    """An Arrow IPC stream; ``from_ipc`` gives the table with its tensor type again."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def features(media: bytes, keep_tensors: bool) -> dict:
    """Features of one stored clip, computed from the bytes read back from it."""
    payload = decode_wav(media)
    mels, energy = log_mel(np.frombuffer(payload, np.uint8))
    spans = hysteresis(energy)
    t, stored = tensors(mels)
    mean = np.round(mels.mean(axis=0, dtype=np.float64) * 8).astype(int)
    active = sum(b - a for a, b in spans)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "duration_ms": len(payload) * 1000 // SOURCE_HZ,
        "segments": [{"start_ms": ms(a), "end_ms": ms(b)} for a, b in spans],
        "tensors": to_ipc(t) if keep_tensors else None,
        "feature": f"frames={len(mels)};tensors={len(stored)}x{TENSOR_FRAMES}x{MELS};segments={len(spans)};active_ms={ms(active)};mel={','.join(map(str, mean))}",
    }


KINDS = {
    "payload_bytes": ("long", pa.int64()),
    "payload_sha256": ("string", pa.string()),
    "tail_crc32": ("long", pa.int64()),
    "media_bytes": ("long", pa.int64()),
    "media_sha256": ("string", pa.string()),
    "duration_ms": ("long", pa.int64()),
    "segments": ("array<struct<start_ms:long,end_ms:long>>", pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))),
    "tensors": ("binary", pa.binary()),
    "feature": ("string", pa.string()),
}


def text_to_media(text: bytes | None) -> bytes:
    """The text's UTF-8 bytes, padded with 255 to a positive multiple of ``UNIT``, as a WAVE file."""
    raw = text or b""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return encode_wav(raw + b"\xff" * (size - len(raw)))


def audio_features(df: DataFrame, key: str, media: str, of_text: bool = False, keep_tensors: bool = True) -> DataFrame:
    """Features of each row's clip: ``key``, ``n_bytes`` of the input and the columns of ``KINDS``.

    ``media`` holds 8-bit mono WAVE files, or with ``of_text`` texts that are stored as such files first.
    ``tensors`` is an Arrow IPC stream of fixed-shape tensors with start_ms and end_ms; ``segments`` are the spans
    of high energy. A null clip counts as an empty text with ``of_text`` and gives null features otherwise; equal
    clips give equal rows; other columns of ``df``, whatever their names, play no part. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE):
                raw = pc.cast(part.column(1), pa.binary()).to_pylist()
                rows = []
                for x in raw:
                    if x is None and not of_text:
                        rows.append(dict.fromkeys(KINDS))
                    else:
                        rows.append(features(text_to_media(x) if of_text else x, keep_tensors))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x or b"") for x in raw], pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in KINDS.items())],
                    names=[key, "n_bytes", *KINDS],
                )

    picked = df.select(df[key], df[media])
    kind = picked.schema[0].dataType.simpleString()
    return map_arrow(picked, run, f"`{key}` {kind}, n_bytes long, " + ", ".join(f"{k} {s}" for k, (s, _) in KINDS.items()))


def store_features(df: DataFrame, path: str, key: str, media: str, of_text: bool = False) -> DataFrame:
    """Write ``audio_features`` with tensors as Parquet to ``path``, a folder that all executors share, and read it back with its tensors' shape and digest.

    Columns besides those stored: ``tensor_count``, and ``tensor_sha256`` of the Arrow stream as read back. Nulls, repeats and empty tables as in ``audio_features``.
    """
    audio_features(df, key, media, of_text, keep_tensors=True).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    count = F.regexp_extract("feature", r"tensors=(\d+)x", 1).try_cast("int")
    return stored.withColumns({"tensor_count": count, "tensor_sha256": F.sha2("tensors", 256)})


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored clip, with its digests, its features and its tensors: an Arrow stream of fixed-shape tensors with time spans."""
    out = audio_features(table(spark, sf_dir, "documents"), "doc_id", "text", of_text=True)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_ms", "segments", "tensors")


QUERIES = {"op1_audio_features": op1_audio_features}
