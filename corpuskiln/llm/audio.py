"""Operator 1: audio features of stored 8-bit samples.

A payload is stored as a WAV file of one channel of unsigned 8-bit samples at 24 kHz, byte for byte.  Read back, it is
resampled to 16 kHz by a polyphase filter (two phases of one windowed-sinc filter, every third input), cut into
overlapping frames of 25 ms every 10 ms, and turned into 40 log-mel energies a frame.  Frames are segmented by energy
with hysteresis: a segment opens above the upper threshold and closes below the lower one, both set from the payload's
own range of frame energies.  ``feature_tensors`` cuts the frames of each segment into tensors of one fixed shape
(frames x bands, the last one filled up), kept as Arrow's fixed-shape tensor type in an IPC stream beside the time
span of each tensor.

``media_digests`` writes the WAV files as a table in the shared folder and reads that table back; features come from
the bytes read.  All work is in blocks of frames, so a long payload takes bounded memory beyond its own bytes.

Defined results: a null or empty text is 192 spaces; a very long text is one payload of its length (below the 4 GB that
a WAV file can state); equal texts give equal values; repeated rows give repeated results; null ids and ids of any size
come back as they are; other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, quoted, sliced, whole_text

BLOCK, FILL = 192, 32
RATE_IN, RATE = 24_000, 16_000
UP, DOWN, TAPS = 2, 3, 12
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
TENSOR_FRAMES = 96
#: Frames that are transformed at once.
FRAMES_AT_ONCE = 2048


def to_payload(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), bytes([FILL]))


def to_wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    pad = len(samples) % 2
    head = b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples is read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def phases() -> np.ndarray:
    """The low-pass filter at the common rate, split into its UP phases (UP x TAPS), each of unit gain."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cutoff = 1 / max(UP, DOWN)
    taps = np.sinc(cutoff * n) * np.hanning(UP * TAPS + 2)[1:-1]
    split = taps.reshape(TAPS, UP).T
    return split / split.sum(axis=1, keepdims=True)


def resample(samples: np.ndarray) -> np.ndarray:
    """24 kHz to 16 kHz: output i takes phase (i * DOWN) mod UP at input i * DOWN // UP; the edges are zeros.

    Sums run tap by tap, so the result doesn't depend on threads or on how a library splits a product.
    """
    n = len(samples) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1, "f4"), samples, np.zeros(TAPS + DOWN, "f4")])
    half = TAPS // 2
    out = np.zeros(n, "f4")
    for r in range(UP):  # outputs r, r + UP, ... share a phase and step by DOWN inputs
        first = r * DOWN // UP + half
        size = -(-(n - r) // UP)
        for k, tap in enumerate(phases()[r * DOWN % UP, ::-1].astype("f4")):
            out[r::UP] += tap * padded[first + k :: DOWN][:size]
    return out


@cache
def mel_bank() -> np.ndarray:
    """Triangles evenly spaced in mel from 20 Hz to half the rate: (FFT // 2 + 1) x MELS."""
    mel = np.linspace(*(2595 * np.log10(1 + np.array([20, RATE / 2]) / 700)), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    up = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    down = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype("f4")


@cache
def window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype("f4")


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS) and log energy of each frame; a signal shorter than a frame is filled up."""
    if len(signal) < FRAME:
        signal = np.concatenate([signal, np.zeros(FRAME - len(signal), "f4")])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    mels, energy = np.empty((len(frames), MELS), "f4"), np.empty(len(frames), "f4")
    for a in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[a : a + FRAMES_AT_ONCE] * window()
        spectrum = np.fft.rfft(part, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype("f4")
        mels[a : a + len(part)] = np.log(np.einsum("fb,bm->fm", power, mel_bank()) + 1e-6)  # no library product: equal texts, equal values
        energy[a : a + len(part)] = np.log((part * part).mean(axis=1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges: opened above the upper threshold, closed below the lower one."""
    low, high = np.quantile(energy, [0.1, 0.9])
    upper, lower = low + 0.6 * (high - low), low + 0.3 * (high - low)
    # the state after each frame: 1 opened, 0 closed, else as before
    mark = np.where(energy >= upper, 1, np.where(energy < lower, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype("i1")))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def analyse(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    samples, rate = from_wav(media)
    if rate != RATE_IN:
        raise ValueError(f"rate {rate}")
    signal = resample((np.frombuffer(samples, "u1").astype("f4") - 128) / 128)
    mels, energy = log_mel(signal)
    return mels, segments(energy)


def tensors_of(media: bytes) -> bytes:
    """An Arrow IPC stream: start_s, end_s and features (fixed-shape tensor, TENSOR_FRAMES x MELS) of each tensor."""
    mels, spans = analyse(media)
    parts, starts, ends = [], [], []
    for a, b in spans:
        for s in range(a, b, TENSOR_FRAMES):
            e = min(b, s + TENSOR_FRAMES)
            part = np.zeros((TENSOR_FRAMES, MELS), "f4")
            part[: e - s] = mels[s:e]
            parts.append(part)
            starts.append(s * HOP / RATE)
            ends.append(((e - 1) * HOP + FRAME) / RATE)
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
    flat = np.stack(parts).ravel() if parts else np.zeros(0, "f4")
    storage = pa.FixedSizeListArray.from_arrays(pa.array(flat), TENSOR_FRAMES * MELS)
    batch = pa.record_batch({"start_s": pa.array(starts, pa.float64()), "end_s": pa.array(ends, pa.float64()), "features": pa.ExtensionArray.from_storage(kind, storage)})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def feature_tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, tensors: for each WAV the Arrow stream of ``tensors_of``; a null WAV gives null."""
    rows = media.select(quoted(id_col).alias("id"), quoted(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media", 1_000_000):
            found = [None if m is None else tensors_of(m) for m in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "tensors"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tensors binary").withColumnRenamed("id", id_col)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media: each text as a WAV file."""
    rows = docs.select(quoted(id_col).alias("id"), whole_text(text_col).alias("text"))
    wavs = map_texts(rows, ["id"], "media binary", lambda: lambda texts: {"media": pa.array([to_wav(to_payload(t)) for t in texts], pa.binary())})
    return wavs.withColumnRenamed("id", id_col)


def read_tensors(tensors: bytes) -> tuple[list[tuple[float, float]], np.ndarray]:
    """The time spans and the features (tensors x TENSOR_FRAMES x MELS) of a stream of ``tensors_of``."""
    table = pa.ipc.open_stream(tensors).read_all()
    features = table["features"].combine_chunks().to_numpy_ndarray() if len(table) else np.zeros((0, TENSOR_FRAMES, MELS), "f4")
    return list(zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True)), features


def summary(tensors: bytes) -> str:
    """From the stored tensors: how many, their frames, the digest of all features, the mean log-mel energies, and every time span."""
    spans, features = read_tensors(tensors)
    counts = [round((end - start - FRAME / RATE) * RATE / HOP) + 1 for start, end in spans]
    frames = [part[:n] for part, n in zip(features, counts, strict=True)]
    mean = np.concatenate(frames).mean(axis=0, dtype="f8") if frames else []
    digest = hashlib.sha256(np.ascontiguousarray(features)).hexdigest()
    return f"tensors={len(spans)};frames={sum(counts)};sha256={digest};logmel=" + ",".join(f"{x:.2f}" for x in mean) + ";spans=" + ",".join(f"{a:.3f}-{b:.3f}" for a, b in spans)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as a WAV file in a table, read it back, and return digests of both and a summary of the feature
    tensors, which are written and read back too."""
    text = whole_text()
    media = materialize(store(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes")).alias("row"), "text"), "row"), "media")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            rows = []
            for wav in batch.column("media").to_pylist():
                payload, _ = from_wav(wav)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), summary(tensors_of(wav))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["row", *names])

    out = media.mapInArrow(run, "row struct<doc_id:bigint,n_bytes:bigint>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select("row.doc_id", "row.n_bytes", *names)


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
