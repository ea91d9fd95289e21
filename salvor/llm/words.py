"""Words, hashes and shingles of Arrow text columns, for whole batches at once.

A word is a run of bytes other than space and 0x09-0x0D. Hashes have 64 bits:
two different words (or shingles) among n share one with probability about
n * n / 2**65.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of text that are worked on together; a longer text is worked on alone.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class Words(NamedTuple):
    """Words of some texts: owner (index of the text), byte range, hash."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bytes: np.ndarray


def fold_of(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers, another one for each seed."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at.astype(np.int64) - at[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (low, high, bytes, offsets) of at most ``limit`` bytes or one row."""
    if not len(column):
        return
    raw, at = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    return raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))


@functools.cache
def _kept_powers(base: int) -> np.ndarray:
    return _made_powers(base, PIECE)


def _made_powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers, out=powers)


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n at least, made once for pieces."""
    return _kept_powers(base) if n <= PIECE else _made_powers(base, n)


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte ranges, from prefix sums of a polynomial modulo 2**64."""
    n = len(raw)
    powers, inverse = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    letters = mix(np.arange(256, dtype=np.uint64), 77 + seed)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[raw] * powers[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD, seed)


def words_of(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    """All words of the texts that lie between the offsets."""
    if lower:
        raw = lower_ascii(raw)
    kind = np.ones(256, bool)
    kind[list(_SPACES)] = False
    solid = kind[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = at[(at > 0) & (at < len(raw))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(at, start, side="right") - 1
    return Words(owner, start, end, range_hashes(raw, start, end), raw)


def bounds_of(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each owner's words begin, and the end of the last one's."""
    return np.searchsorted(owner, np.arange(n + 1))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive hashes."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xF1357AEA2E62A9C5) + hashes[i : len(hashes) - k + 1 + i]
    return mix(out, k)


def shingle_sets(words: Words, n: int, k: int) -> Iterator[np.ndarray]:
    """For each of n texts the sorted distinct k-word shingles.

    A text with fewer than k words has one, its whole sequence; one without
    words has none.
    """
    runs, at = windows(words.hash, k), bounds_of(words.owner, n)
    for i in range(n):
        low, high = at[i], at[i + 1]
        if high - low >= k:
            yield np.unique(runs[low : high - k + 1])
        elif high > low:
            yield windows(words.hash[low:high], int(high - low))
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def list_array(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """An Arrow list column of the given arrays."""
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))
