"""Audio features of media columns: polyphase resampling, log-mel frames, energy segments, fixed-shape tensors.

The samples are 8-bit mono PCM in a WAV container. Each recording is worked on by itself with arrays whose
shapes depend on its length alone, so equal recordings give equal values wherever they are.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import arrow_rows
from tidemark.llm.wordhash import column_buffers

SOURCE_RATE, UP, DOWN = 16_000, 5, 8
RATE = SOURCE_RATE * UP // DOWN
TAPS = 12  # filter taps of each phase
FRAME, HOP, MELS = 256, 128, 32
TENSOR_FRAMES = 64
FLOOR_DB = -80.0
BLOCK_FRAMES = 1 << 14
#: A segment opens where a frame reaches OPEN times the mean energy of the recording and lasts while it keeps CLOSE times.
OPEN, CLOSE = 1.1, 0.9
UNIT = 576  # payloads are padded to a positive multiple of it

MEDIA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames long, n_segments long, media binary, tensors binary"
)


@cache
def _phases() -> np.ndarray:
    """Windowed-sinc low-pass below the lower of both Nyquist rates, one row of taps for each output phase."""
    n = TAPS * UP
    t = (np.arange(n) - (n - 1) / 2) / max(UP, DOWN)
    taps = np.sinc(t) * np.hamming(n)
    taps *= UP / taps.sum()
    return np.ascontiguousarray(taps.reshape(TAPS, UP).T[:, ::-1], np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Samples at RATE from samples at SOURCE_RATE; each output takes one phase of the filter."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(TAPS, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for k in range(UP):
        at = range(k, n, UP)
        if len(at):
            first = k * DOWN // UP
            out[k::UP] = views[first : first + DOWN * len(at) : DOWN][: len(at)] @ _phases()[k * DOWN % UP]
    return out


@cache
def _filterbank() -> np.ndarray:
    """Triangular mel filters over the power spectrum of one frame."""
    mel = np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * RATE / FRAME
    rise = (bins[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[2:] - bins[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@cache
def _window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def frames(y: np.ndarray) -> np.ndarray:
    """Overlapping frames; the last one is padded with silence, and there is at least one."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    return np.lib.stride_tricks.sliding_window_view(np.pad(y, (0, max(0, (n - 1) * HOP + FRAME - len(y)))), FRAME)[::HOP][:n]


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies in dB to two decimals, and energy, of each frame."""
    every = frames(y)
    mels, energy = np.empty((len(every), MELS), np.float32), np.empty(len(every), np.float32)
    for a in range(0, len(every), BLOCK_FRAMES):
        part = every[a : a + BLOCK_FRAMES] * _window()
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        mels[a : a + BLOCK_FRAMES] = power @ _filterbank()
        energy[a : a + BLOCK_FRAMES] = np.einsum("ij,ij->i", part, part) / FRAME
    return np.round(10 * np.log10(np.maximum(mels, 10 ** (FLOOR_DB / 10))), 2), energy


def segments(energy: np.ndarray) -> np.ndarray:
    """First and one past last frame of each active segment: opened at OPEN, closed below CLOSE times the mean."""
    mean = energy.mean(dtype=np.float64)
    state = np.where(energy >= OPEN * mean, 1, np.where(energy < CLOSE * mean, 0, -1)) if mean > 0 else np.zeros(len(energy), int)
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.concatenate([[0], np.where(last >= 0, state[last], 0), [0]])
    return np.flatnonzero(np.diff(active)).reshape(-1, 2)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SOURCE_RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def tensor_table(mels: np.ndarray) -> pa.Table:
    """Fixed-shape tensors of TENSOR_FRAMES x MELS values with their time spans in seconds; the last is padded with the floor."""
    n = -(-len(mels) // TENSOR_FRAMES)
    whole = np.full((n * TENSOR_FRAMES, MELS), FLOOR_DB, np.float32)
    whole[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
    values = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), TENSOR_FRAMES * MELS)
    begin = np.arange(n) * TENSOR_FRAMES
    last = np.minimum(begin + TENSOR_FRAMES, len(mels)) - 1
    return pa.table({"tensor": pa.ExtensionArray.from_storage(kind, values), "start_s": begin * HOP / RATE, "end_s": (last * HOP + FRAME) / RATE})


def read_tensors(stream: bytes) -> np.ndarray:
    """Frames of an Arrow stream of tensors; how many the last one holds follows from its time span."""
    t = pa.ipc.open_stream(stream).read_all()
    values = t["tensor"].combine_chunks().to_numpy_ndarray().reshape(-1, MELS)
    return values[: round((t["end_s"][-1].as_py() * RATE - FRAME) / HOP) + 1]


def describe(payload: bytes) -> dict:
    """Frames, segments and tensors of 8-bit samples."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x))
    spans = segments(energy)
    return {"mels": mels, "spans": spans}


def feature_text(found: dict) -> str:
    """Counts, active seconds, mean level, and a digest over the tensors' values and the segments."""
    mels, spans = found["mels"], found["spans"]
    digest = hashlib.sha256(mels.astype("<f4").tobytes() + spans.astype("<i8").tobytes()).hexdigest()[:16]
    active = sum((min(b, len(mels)) - a) * HOP for a, b in spans.tolist()) / RATE
    return f"frames={len(mels)};segments={len(spans)};active={active:.3f};mean={float(mels.mean(dtype=np.float64)):.2f};sha={digest}"


def write_ipc(t: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue()


def media_row(data: bytes, keep: bool) -> tuple:
    """The columns of MEDIA after doc_id; media and tensors are made and read back whether or not they are kept."""
    media = to_wav(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff"))
    back = from_wav(media)
    found = describe(back)
    tensors = write_ipc(tensor_table(found["mels"]))
    found["mels"] = read_tensors(tensors)
    return (
        len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media),
        hashlib.sha256(media).hexdigest(), feature_text(found), len(found["mels"]), len(found["spans"]),
        media if keep else None, tensors if keep else None,
    )


def media_features(docs: DataFrame, keep: bool = True) -> DataFrame:
    """Stored media of each text's bytes, what reads back, and its features.

    `docs` has doc_id and text; other columns are ignored. The UTF-8 bytes, filled with bytes 255 to a positive
    multiple of UNIT, are the samples; a null text counts as empty. `media` is the WAV file, `tensors` an Arrow
    stream of fixed-shape tensors with start and end seconds, from which the features are read; without `keep` both are
    made, read and left null. One row per input
    row, repeated rows included; no row of the table meets another, so no key can be hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 256):
            at, raw = column_buffers(batch.column(1))
            data = raw[at[0] : at[-1]].tobytes()
            rows = [media_row(data[a:b], keep) for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in MEDIA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)
