"""Byte-level BPE encoding and decoding by contiguous rank arrays.

A text is cut into words by the vocabulary's pattern. For each distinct short word of a batch there is one row of parts and
one row of adjacent ranks; all rows advance together: find the row's minimum rank, delete that boundary, refresh the two
neighbouring ranks, until no row has a mergeable pair. A word longer than ``SHORT`` bytes uses the same arrays in a block of its
own length class, and one over ``LONG`` bytes a heap over linked parts, which picks the same merges.

Edge cases: a null or empty text has no ids; the special token's string inside a text is that token, as in the library; texts
of any length are encoded whole; rows with a null or shared doc_id, and repeated rows, each give a row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches

LONG = 256
_NONE = np.iinfo(np.int32).max
#: fixed value: the pattern of the ByteLevel pre-tokenizer, with white space as Unicode defines it
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next code point from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairTable:
    """(left id, right id) -> (rank, merged id), as open addressing in flat arrays, for vectorised look-ups."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(pairs))).bit_length() + 1)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = (pairs[:, 0].astype(np.int64) << 32) | pairs[:, 1]
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            free = self.keys[slot[left]] == -1
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[put], put, merged[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = np.where(self.keys[slot[left]] != -1, (slot[left] + 1) & (size - 1), slot[left])
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id); rank is _NONE where the pair does not merge. A right id of -1 never does."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], _NONE), self.merged[slot]


class Codec:
    """Encoder and decoder for a tokenizer file's vocabulary, merges and special tokens."""

    def __init__(self, spec: str, cache_size: int = 400_000):
        spec = json.loads(spec)
        vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.table = PairTable(pairs, np.array([vocab[a + b] for a, b in merges], np.int32))
        self.single = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.single[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.piece = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.piece[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.piece[i] = token.encode()
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _block(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words of similar length, as little-endian 32-bit integers."""
        n, width = len(words), max(map(len, words))
        length = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < length[:, None]
        parts = np.full((n, width + 1), -1, np.int32)
        parts[:, :width][inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((n, width), _NONE, np.int32)
        both = np.flatnonzero(parts[:, 1:].ravel() >= 0)
        ranks.ravel()[both] = self.table.find(parts[:, :-1].ravel()[both], parts[:, 1:].ravel()[both])[0]
        out = np.full((n, width), -1, np.int32)
        rows, column = np.arange(n), np.arange(width)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                out[rows[done]] = parts[done, :width]
                parts, ranks, rows, at = parts[~done], ranks[~done], rows[~done], at[~done]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            _, joined = self.table.find(parts[here, at], parts[here, at + 1])
            behind = column >= at[:, None] + 1  # the boundary goes: what follows it moves one place to the left
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            parts[here, at] = joined
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            right = parts[here, at + 1]
            ranks[here, at] = np.where(right >= 0, self.table.find(joined, right)[0], _NONE)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.table.find(parts[before, at[before] - 1], joined[before])[0]
        counts = (out >= 0).sum(1)
        flat, end = out[out >= 0].astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [flat[b:e] for b, e in zip(end - counts * 4, end, strict=True)]

    def _long(self, word: bytes) -> bytes:
        """The same merges for a very long word: a heap of (rank, place) over linked parts."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank, _ = self.table.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(rank.tolist()) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def look(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in known:
                r, m = self.table.find(np.array([a]), np.array([b]))
                known[a, b] = int(r[0]), int(m[0])
            return known[a, b]

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = look(a, b)[1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := look(ids[i], ids[after[i]])[0]) != _NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (r := look(ids[before[i]], ids[i])[0]) != _NONE:
                heapq.heappush(heap, (r, before[i], ids[before[i]], ids[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        by_class: dict[int, list[str]] = {}
        for w in words:
            b = w.encode()
            if len(b) > LONG:
                self.cache[w] = self._long(b)
            else:
                by_class.setdefault(max(4, (len(b) + 3) // 4 * 4 if len(b) <= 32 else 1 << (len(b) - 1).bit_length()), []).append(w)
        for width, group in by_class.items():
            step = max(1, 400_000 // width)
            for i in range(0, len(group), step):
                self.cache.update(zip(group[i : i + step], self._block([w.encode() for w in group[i : i + step]]), strict=True))

    def _pieces(self, text: str) -> Iterator[list[str] | int]:
        last = 0
        if self.split is not None and any(s in text for s in self.special):
            for m in self.split.finditer(text):
                yield self.words(text[last : m.start()])
                yield self.special[m.group()]
                last = m.end()
        yield self.words(text[last:] if last else text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [list(self._pieces(t)) for t in texts]
        new = {w for pieces in cut for p in pieces if not isinstance(p, int) for w in p}.difference(self.cache)
        if len(self.cache) + len(new) > self.cache_size:
            self.cache.clear()
            new = {w for pieces in cut for p in pieces if not isinstance(p, int) for w in p}
        self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in pieces) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _groups(texts: list[str], limit: int = 1_000_000) -> Iterator[list[str]]:
    """Whole texts, together about ``limit`` characters."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def read_spec(path: str) -> str:
    """A tokenizer file is a small local file of the driver; its content travels to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text and, if asked for, the ids themselves."""
    small_batches(docs)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))  # a vocabulary file: a few MB at any input size

    def run(batches):
        codec = Codec(spec.value)
        for batch in batches:
            rows = iter(batch.column("doc_id").to_pylist())
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for group in _groups(texts):
                ids = codec.encode_batch(group)
                columns = [pa.array([next(rows) for _ in group], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(codec.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids])]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.lean(run), schema)
