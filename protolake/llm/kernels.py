"""Vectorised text kernels shared by the operators: joined texts, spans, span hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RADIX = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_RADIX_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer: spreads 64-bit values."""
    x = np.asarray(x, np.uint64) + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, 1 << 16), _RADIX if kind == "up" else _RADIX_INVERSE)
        base[0] = 1
        _powers[kind] = np.cumprod(base, dtype=np.uint64)
    return _powers[kind][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span; equal spans hash alike wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", len(values)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power("down", len(values) + 1)[starts] + (ends - starts).astype(np.uint64) * _ODD)


#: Random 64-bit value of each byte.
BYTE_VALUES = mixed(np.arange(256))


def joined_bytes(texts: pa.Array, sep: bytes = b" ") -> tuple[bytes, np.ndarray]:
    """Texts one after another with ``sep`` (one byte) after each, and the offsets; null counts as empty."""
    blobs = [x.encode() if x else b"" for x in texts.to_pylist()]
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1
    return sep.join([*blobs, b""]), np.concatenate([[0], np.cumsum(lengths)])


def chunks(texts: pa.Array, most: int = 400_000):
    """(first, last) ranges of rows whose texts together have about ``most`` bytes."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)) if len(texts) else np.zeros(0)
    part = (np.cumsum(sizes) // most).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def give_back() -> None:
    """Memory that is free in this process goes back to the system: idle workers would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def batch_chunks(batches, column: str = "text", most: int = 400_000):
    """Slices of record batches, each with about ``most`` bytes in ``column``; a task's end gives memory back."""
    try:
        for batch in batches:
            texts = batch.column(column)
            for a, b in chunks(texts, most):
                yield batch.slice(a, b - a)
    finally:
        give_back()


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of first sight, and each element's place among them."""
    coded = pa.array(hashes).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def first_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n codes stands first."""
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..+lengths[0], starts[1]..+lengths[1], ..."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Bytes between words for the contracts' `[^\x20\x09-\x0D]+`.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def word_spans(data: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without space; data must end with a space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~is_space[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
