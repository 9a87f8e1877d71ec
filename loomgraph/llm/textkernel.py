"""Vectorised text primitives over Arrow string columns.

A chunk of whole documents is viewed as one byte array. Words, their 64-bit hashes and the documents they belong to come
out as NumPy arrays; no Python object is made per word. White space is the six ASCII characters 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each span, from one running sum."""
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(_P, len(values)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_P_INV, len(values) + 1)[start])


@dataclass
class Chunk:
    """Some whole documents: ``data`` is their bytes, document d is ``data[offset[d]:offset[d + 1]]``."""

    data: np.ndarray
    offset: np.ndarray
    first: int
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offset) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def word_hashes(self, lower: bool) -> np.ndarray:
        return span_hashes((_BYTE_LOWER if lower else _BYTE)[self.data], self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-aligned array over each document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offset[1:]] - total[self.offset[:-1]]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offset[0] : offset[-1]], offset - offset[0]


def chunks(column: pa.Array, limit: int = 2_000_000) -> Iterator[Chunk]:
    """Whole documents in pieces of about ``limit`` bytes; a longer document is a piece of its own, never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    data, offset = raw(column)
    first = 0
    while first < len(offset) - 1:
        last = max(first + 1, int(np.searchsorted(offset, offset[first] + limit, "right")) - 1)
        part, part_offset = data[offset[first] : offset[last]], offset[first : last + 1] - offset[first]
        word = ~IS_SPACE[part]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edge = part_offset[1:-1]
        edge = edge[(edge > 0) & (edge < len(part))]
        begins[edge] = word[edge]
        ends[edge - 1] = word[edge - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Chunk(part, part_offset, first, start, end, np.searchsorted(part_offset, start, "right") - 1)
        first = last


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The column ``text``, or that field of ``row``."""
    text = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("row"), "text")
    return text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else text.cast(pa.string())


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of each run of ``width`` words that lies in one document."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * U64(pow(_P, i + 1, 2**64))
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return at, mix(total[at])


def salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one document of the chunk."""
    return mix(hashes ^ mix(doc.astype(np.uint64) + U64(0x51)))


def lean(run: Callable) -> Callable:
    """A map over batches whose worker gives memory back: Arrow's buffers as they are freed, the rest at a task's end. Workers live on
    from stage to stage, and would otherwise keep the most that any of their tasks ever held."""

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass

    return wrapped
