"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak fingerprints.

A payload is stored as the samples of an 8-bit mono WAV file and read back with the wave module.
Overlapping frames are transformed, the strongest bin of each frequency band that is also a maximum
over its neighbouring frames is a peak, and each peak is paired with the next peaks within a short
time. A pair is one 64-bit code: time << 32 | first bin << 20 | second bin << 8 | time gap.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import map_batches

BLOCK, RATE = 64, 8000
FRAME, HOP = 256, 128
#: Bands of frequency bins (a bin is RATE / FRAME Hz); the constant part, bin 0, is left out.
BANDS = ((1, 8), (8, 24), (24, 56), (56, 129))
FAN_OUT, MAX_GAP = 3, 16
FRAMES_AT_ONCE = 16384


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of BLOCK, and how many come from the text.
    Null is as empty; a lone surrogate can't occur in a Spark string."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected 8-bit mono samples")
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band the strongest bin and its magnitude. Frames go through in blocks, so
    memory does not grow with the spectrum of a long recording."""
    signal = samples.astype(np.float32) - 128
    short = max(0, FRAME - len(signal)) or -(len(signal) - FRAME) % HOP
    if short:
        signal = np.concatenate([signal, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    bins, mags = np.empty((len(frames), len(BANDS)), np.int64), np.empty((len(frames), len(BANDS)), np.float32)
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        part = np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * _WINDOW)
        power = np.square(part.real) + np.square(part.imag)
        rows = np.arange(len(power))
        for k, (lo, hi) in enumerate(BANDS):
            best = power[:, lo:hi].argmax(axis=1) + lo
            bins[at : at + len(power), k] = best
            mags[at : at + len(power), k] = power[rows, best]
    return bins, mags


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Codes of all peak pairs, in order of time. Empty for silence (samples of 128)."""
    bins, mags = band_peaks(samples)
    before = np.vstack([np.zeros((1, len(BANDS)), np.float32), mags[:-1]])
    after = np.vstack([mags[1:], np.zeros((1, len(BANDS)), np.float32)])
    when, band = np.nonzero((mags > before) & (mags >= after) & (mags > 1e-3))
    freq = bins[when, band]
    codes = []
    for step in range(1, FAN_OUT + 1):
        gap = when[step:] - when[:-step]
        near = gap <= MAX_GAP
        codes.append(
            (when[:-step][near] << 32) | (freq[:-step][near] << 20) | (freq[step:][near] << 8) | gap[near]
        )
    return np.sort(np.concatenate(codes)).astype(np.int64)


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, n_pairs long"
)


def stored_and_marked(text: str | None) -> tuple[bytes, int, bytes, np.ndarray]:
    """The WAV file of a text, its bytes without padding, the payload read back and the fingerprint of that."""
    payload, n = payload_of(text)
    media = to_wav(payload)
    back = from_wav(media)
    return media, n, back, fingerprint(np.frombuffer(back, np.uint8))


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media (the WAV file's bytes) and fingerprint (array of time-coded pairs) of each row.

    Null or empty text gives BLOCK samples of 0. Rows are independent: repeated
    rows give repeated results, an empty table an empty one; other columns are left out."""

    def make():
        def one(batch):
            found = [stored_and_marked(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.binary()), pa.array([f[3] for f in found], pa.list_(pa.int64()))],
                ["doc_id", "media", "fingerprint"],
            )

        return one

    picked = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return map_batches(picked, make, "doc_id long, media binary, fingerprint array<long>")


def media_digests(df: DataFrame) -> DataFrame:
    """The contract's digest of the same columns, made in one pass so that no file is shuffled.

    feature: the array of time-coded pairs, 16 hexadecimal digits each. Odd rows as in media_columns."""

    def make():
        def one(batch):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media, n, back, codes = stored_and_marked(text)
                out.append(
                    (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media),
                     hashlib.sha256(media).hexdigest(), codes.astype(">i8").tobytes().hex(), len(codes))
                )
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.string() if "string" in c else pa.int64() for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
            )

        return one

    picked = df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"))
    return map_batches(picked, make, SCHEMA)
