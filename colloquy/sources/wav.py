"""RIFF/WAVE bytes to mono samples and back."""

from __future__ import annotations

import struct

import numpy as np

FULL = 32768.0


def decode(content: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples in [-1, 1] and the rate of 16-bit PCM or 32-bit float; None for anything else. Chunks are aligned to words; channels are
    averaged, whole numbers by integer division towards zero."""
    if content is None or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form, body = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        chunk = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(chunk) >= 16:
            form = struct.unpack_from("<HHIIHH", chunk)
        elif name == b"data":
            body = chunk
        at += 8 + size + (size & 1)
    if form is None or body is None or form[1] < 1:
        return None
    code, channels, rate, _, _, bits = form
    if (code, bits) == (1, 16):
        x = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], dtype="<i2").astype(np.int64).reshape(-1, channels).sum(axis=1)
        return (np.sign(x) * (np.abs(x) // channels) / FULL).astype(np.float32), rate
    if (code, bits) == (3, 32):
        x = np.frombuffer(body[: len(body) // (4 * channels) * 4 * channels], dtype="<f4").reshape(-1, channels)
        return x.mean(axis=1).astype(np.float32), rate
    return None


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono PCM; samples are cut to [-1, 1], NaN is silence."""
    x = np.clip(np.nan_to_num(np.asarray(samples, dtype=np.float64)), -1.0, 1.0)
    body = (x * 32767.0).astype("<i2").tobytes()
    if len(body) > 0xFFFFFFFF - 36:
        raise ValueError("too long for a RIFF file")
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def prepare(content: bytes | None, rate: int) -> np.ndarray | None:
    """The samples of a file at another rate."""
    from colloquy.operators.frames import resample

    got = decode(content)
    return None if got is None else resample(got[0], got[1], rate)
