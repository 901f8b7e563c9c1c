"""Two public hash functions of 64 bits, for values that must equal those of other systems."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Constants of splitmix64 and of FNV-1a with 64 bits.
_GAMMA, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of whole numbers of 64 bits."""
    z = x.astype(np.uint64) + np.uint64(_GAMMA)
    for shift, factor in zip((30, 27), _MIX):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def fnv1a(data: bytes) -> int:
    h = _BASIS
    for b in data:
        h = (h ^ b) * _PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@F.arrow_udf(T.LongType())
def splitmix64(a: pa.Array) -> pa.Array:
    """As a signed number; null stays null."""
    return pa.array(mixed(np.asarray(a.fill_null(0)).view(np.uint64)).view(np.int64), mask=np.asarray(a.is_null()))


@F.arrow_udf(T.LongType())
def fnv1a_64(a: pa.Array) -> pa.Array:
    """Of the UTF-8 bytes of a text, as a signed number; null stays null. Texts are distinct ones at a time."""
    code = a.dictionary_encode()
    known = np.array([fnv1a(t.as_py().encode()) for t in code.dictionary], dtype=np.uint64).view(np.int64)
    own = np.asarray(code.indices.fill_null(0))
    return pa.array(known[own] if len(known) else np.zeros(len(a), np.int64), mask=np.asarray(a.is_null()))
