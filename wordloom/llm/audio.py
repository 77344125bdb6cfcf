"""Audio columns: 8-bit sound, polyphase resampling, log-mel filterbanks and segments of activity.

A payload is stored as an 8-bit mono WAV; reading it back gives the payload unchanged. Features are
computed on the read samples: they are centred, resampled by UP / DOWN with a windowed-sinc filter
split in phases, cut into overlapping Hann frames, and turned into log-mel energies. Frames whose
energy rises over the upper threshold open a segment and those that fall under the lower one close
it (hysteresis); the thresholds lie between the quiet and loud levels of the sound itself. Each segment is cut into
patches of PATCH frames by MELS bands, the last padded, with its time span: a fixed-shape tensor.

The tensors of a sound are stored as an Arrow stream of fixed-shape tensors, with their spans.

Resampling and spectra go through a sound in blocks of FRAMES_AT_ONCE frames; what is held of a whole sound
are its frames' energies and its patches, each some 1.2 bytes a sample.

Defined cases: a null text is the empty payload; a payload is padded with zero bytes up to a positive
multiple of 64, so there is always a sound; a constant sound has one level and is a single segment;
equal texts have equal values; repeated rows stay; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RATE = 16_000
UP, DOWN = 3, 4
TAPS = 16
WIN, HOP, FFT, MELS = 200, 80, 256, 32
PATCH = 64
FRAMES_AT_ONCE = 8192


def payload_of(text: str | None) -> bytes:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Canonical header of 44 bytes, then the samples; a pad byte keeps odd sizes even."""
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n)
    return head + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media)) as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("8-bit mono is expected")
        return w.readframes(w.getnframes()), w.getframerate()


def polyphase(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """(up, taps) filter phases of a Hann-windowed sinc at the lower of the two rates."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * t) * (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n))
    phases = h.reshape(taps, up).T[:, ::-1]
    return phases / phases.sum(1, keepdims=True)


def resampled(x: np.ndarray, first: int, count: int, phases: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Output samples first .. first + count; x is taken as zero outside its ends."""
    taps = phases.shape[1]
    pos = np.arange(first, first + count) * down
    base = pos // up - taps // 2
    lo = int(base[0]) if count else 0
    hi = int(base[-1]) + taps if count else 0
    part = np.zeros(hi - lo)
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        part[a - lo : b - lo] = x[a:b]
    out = np.empty(count)
    view = np.lib.stride_tricks.sliding_window_view(part, taps) if count else None
    for k in range(min(up, count)):  # outputs of one phase lie `down` inputs apart
        out[k::up] = view[int(base[k]) - lo :: down][: len(out[k::up])] @ phases[int(pos[k]) % up]
    return out


def mel_bank(rate: float, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    rise = (bins[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    fall = (hz[2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_PHASES = polyphase()
_BANK = mel_bank(RATE * UP / DOWN)
_HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WIN) / WIN)


def log_mels(samples: bytes):
    """Blocks of (frames, MELS) log energies, at most FRAMES_AT_ONCE frames each."""
    raw = np.frombuffer(samples, np.uint8)
    total = -(-len(raw) * UP // DOWN)
    frames = 1 + max(0, -(-(total - WIN) // HOP))
    for f in range(0, frames, FRAMES_AT_ONCE):
        n = min(FRAMES_AT_ONCE, frames - f)
        first, count = f * HOP, (n - 1) * HOP + WIN
        a = max(0, first * DOWN // UP - TAPS) // DOWN * DOWN  # where an output sample falls on an input sample
        b = min(len(raw), (first + count) * DOWN // UP + TAPS)
        x = raw[a:b].astype(np.float64)
        x -= 128
        x /= 128
        y = resampled(x, first - a // DOWN * UP, count, _PHASES)
        view = np.lib.stride_tricks.sliding_window_view(y, WIN)[::HOP] * _HANN
        power = np.abs(np.fft.rfft(view, FFT)) ** 2
        yield np.log(power @ _BANK + 1e-6).astype(np.float32)


def active(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [a, b) of segments: opened over the upper threshold, closed under the lower one."""
    quiet, loud = np.quantile(energy, [0.1, 0.9])
    upper, lower = quiet + 0.5 * (loud - quiet), quiet + 0.25 * (loud - quiet)
    state = np.where(energy >= upper, 1, np.where(energy < lower, 0, -1))
    known = np.flatnonzero(state >= 0)
    if not len(known):
        return [(0, len(energy))]
    at = np.searchsorted(known, np.arange(len(energy)), side="right") - 1
    on = np.where(at >= 0, state[known[np.maximum(at, 0)]], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel energies of all frames, and segments."""
    mel = np.concatenate(list(log_mels(samples)))
    return mel, active(mel.mean(1, dtype=np.float64))


def patches(mel: np.ndarray, segments: list[tuple[int, int]]):
    """(first frame, end frame, PATCH x MELS values) of every patch of every segment."""
    for a, b in segments:
        for s in range(a, b, PATCH):
            e = min(b, s + PATCH)
            out = np.full((PATCH, MELS), np.log(1e-6), np.float32)
            out[: e - s] = mel[s:e]
            yield s, e, out


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / (UP * RATE)


_MEDIA = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media, the WAV of each text's payload."""

    def work(batch):
        texts = batch.column(text).to_pylist()
        return [pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), pa.array([to_wav(payload_of(t)) for t in texts], pa.binary())]

    return common.append_arrow(docs, work, _MEDIA, text)


def tensors(media: DataFrame, doc_id: str = "doc_id", column: str = "media") -> DataFrame:
    """(doc_id, patch, start_s, end_s, values): one row a patch, values with PATCH * MELS floats."""

    def run(batches):
        for batch in batches:
            for key, m in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = list(patches(*features(from_wav(m)[0])))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * PATCH * MELS, pa.int32()), pa.array(np.concatenate([v.ravel() for *_, v in rows]) if rows else np.empty(0, np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), batch.column(0).type), pa.array(range(len(rows)), pa.int32()), pa.array([seconds(a) for a, *_ in rows], pa.float64()), pa.array([seconds(b) for _, b, _ in rows], pa.float64()), values], names=["doc_id", "patch", "start_s", "end_s", "values"])

    kind = media.schema[doc_id].dataType.simpleString()
    return media.select(doc_id, column).where(F.col(column).isNotNull()).mapInArrow(run, f"doc_id {kind}, patch int, start_s double, end_s double, values array<float>")


def as_tensors(table: pa.Table) -> pa.FixedShapeTensorArray:
    """Values of tensors() rows as Arrow tensors of shape (PATCH, MELS)."""
    flat = table["values"].combine_chunks()
    flat = flat.flatten() if isinstance(flat, (pa.ListArray, pa.LargeListArray)) else flat
    return pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(flat.cast(pa.float32()), PATCH * MELS))


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=["frame", "mel"])


def pack(mel: np.ndarray, segments: list[tuple[int, int]], at_once: int = 64) -> bytes:
    """An Arrow stream of (start_s, end_s, patch): every patch as a tensor of shape (PATCH, MELS) with its time span."""
    schema = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("patch", tensor_type())])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        rows = patches(mel, segments)
        while own := list(islice(rows, at_once)):
            flat = pa.array(np.concatenate([v.ravel() for *_, v in own]))
            tensor = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(flat, PATCH * MELS))
            out.write_batch(pa.RecordBatch.from_arrays([pa.array([seconds(a) for a, *_ in own]), pa.array([seconds(b) for _, b, _ in own]), tensor], schema=schema))
    return sink.getvalue().to_pybytes()


def unpack(stored: bytes) -> pa.Table:
    with pa.ipc.open_stream(stored) as got:
        return got.read_all()


AT_ONCE = 1 << 18  # bytes of text whose tensors are held at a time: short segments are padded to patches of 8 KB


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes, media and tensors: the WAV of each text's payload, and the packed features of what the WAV holds."""

    def run(batches):
        for batch in (x for b in batches for x in common.slices(b, text, most=AT_ONCE)):
            texts = batch.column(text).to_pylist()
            media = [to_wav(payload_of(t)) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            new = [pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array([pack(*features(from_wav(m)[0])) for m in media], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "n_bytes", "media", "tensors"])

    rows = docs.drop("n_bytes", "media", "tensors")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *_MEDIA, T.StructField("tensors", T.BinaryType())]))


def digest(table: pa.Table) -> str:
    """Segments, patches, active seconds, mean and spread of each eighth of the bands over active frames, and a CRC of all values."""
    start, end = (table[c].to_numpy() for c in ("start_s", "end_s"))
    values = np.concatenate([c.to_numpy_ndarray() for c in table["patch"].chunks]) if len(table) else np.empty((0, PATCH, MELS), np.float32)
    frames = np.rint((end - start) / seconds(1)).astype(np.int64)
    real = values[np.arange(PATCH) < frames[:, None]].astype(np.float64)
    bands = real.reshape(len(real), 8, MELS // 8).mean(2)
    stats = ",".join(f"{m:.3f}/{s:.3f}" for m, s in zip(bands.mean(0), bands.std(0), strict=True)) if len(real) else ""
    segments = len(table) and 1 + int((start[1:] != end[:-1]).sum())
    return f"segments={segments};patches={len(table)};active_s={float((end - start).sum()):.3f};bands={stats};crc32={zlib.crc32(np.round(values, 2).astype('<f4').tobytes()):08x}"


def op10_audio(spark, sf_dir):
    """Each text's WAV and tensors are made, stored as bytes and read back one by one, so none wait in a batch."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def row(text):
        m = to_wav(payload_of(text))
        samples, _ = from_wav(m)
        feature = digest(unpack(pack(*features(samples))))
        return (len(text.encode("utf-8", "surrogatepass")) if text else 0, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature)

    def run(batches):
        for batch in batches:
            rows = [row(t.as_py()) for t in batch.column("text")]
            cols = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *[n for n, _ in fields]])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
