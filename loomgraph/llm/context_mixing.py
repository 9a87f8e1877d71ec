"""Language-model scores by online logistic context mixing over hashed contexts.

A text is a sequence of tokens: lower-cased words, then one end. A token is coded by binary decisions down a code tree of the frequent
words, whose predictors, gated weights and adaptive map :mod:`.word_mixer` carries along each document, online. A word outside the tree
is an escape, and then spelled: its letters are binary decisions along a Huffman tree that depends on the letter before, predicted by
tables of counts indexed by a hash of the last 1, 2, 3 or 5 letters and the node, mixed in the logistic domain by weights that a gate
(how much the longer contexts have seen) selects, and refined by a probability map. The spelling shares the escape with the exact
training counts of the words outside the tree, and with those that the document has held before.

All statistics cover the whole training part and do not depend on how the input is split into partitions: token counts are exact.
A word is in the tree if it occurs at least twice and makes up at least 2**-``share_bits`` of all training tokens, so that the tree has
at most 2**``share_bits`` words whatever the input's size; the counts of all others meet their occurrences in a shuffled join. The
spelling has to code new words, and learns from each distinct training word once; its tables are at least twice as large as the number
of distinct contexts and nodes, and its weights and map are fitted by passes over all those decisions, each without itself in the
counts that predict it.

Edge cases: a null or empty text is one end token; a null doc_id is trained on; words of any length are coded whole; repeated
rows each give a row; without training texts every count is 0 and the tables are flat; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import word_mixer
from .common import materialize, small_batches

STOP = 32  # ends a word: no word holds it
ORDERS = (1, 2, 3, 5)
TABLE_BITS = 20  # at least; more as more contexts are there
SPARSE = 16  # contexts of which one is counted to size the tables
SEGMENT = 4096
KNOWN = 1 << 19  # packed letters whose probability a task keeps
GATES = 9
BUCKETS = 33
CLASSES = 8
#: of an escaped word's probability: the largest share of what the document has escaped before, and how soon it is reached
REPEATS, REPEATS_AFTER = 0.5, 4.0
#: taken from each count of a word outside the tree, for words never seen
DISCOUNT = 0.5
END_KEY = np.uint64(0xE4D)
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xFF51AFD7ED558CCD))
_NODE = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def huffman_codes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, node, bit): the decisions of each (previous letter, letter), from their counts."""
    start, length = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    nodes, bits = [], []
    for before in range(256):
        heap = [(256.0 * float(n) + 1.0, s, s) for s, n in enumerate(pairs[before].tolist())]
        heapq.heapify(heap)
        children, fresh = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[fresh] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
            fresh += 1
        walk = [(heap[0][2], [])]
        while walk:
            x, path = walk.pop()
            if x in children:
                walk += [(child, [*path, (x - 256, bit)]) for bit, child in enumerate(children[x])]
            else:
                start[before * 256 + x], length[before * 256 + x] = len(nodes), len(path)
                nodes += [n for n, _ in path]
                bits += [b for _, b in path]
    return start, length, np.array(nodes, np.int64), np.array(bits, np.uint8)


def letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word, letter, last letters) of each letter and stop of the given words; before a word's first letter comes STOP."""
    size = end - start + 1
    offset = np.cumsum(size) - size
    n = int(size.sum())
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(n) - np.repeat(offset, size)
    at = np.minimum(np.repeat(start, size) + place, len(data) - 1)
    letter = np.where(place < np.repeat(end - start, size), data[at], STOP).astype(np.uint8)
    last = []
    for back in range(1, max(ORDERS) + 1):
        shifted = np.full(n, STOP, np.uint8)
        shifted[back:] = letter[:-back] if back < n else letter[:0]
        last.append(np.where(place >= back, shifted, STOP).astype(np.uint8))
    return word, letter, last


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, letter with its last letters packed into one number) of each letter and stop. All decisions of a letter follow from it."""
    word, letter, last = letters(data, start, end)
    gram = letter.astype(np.int64)
    for back, x in enumerate(last):
        gram |= x.astype(np.int64) << (8 * back + 8)
    return word, gram


def unpacked(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(index, letter, last letters) of packed letters."""
    letter, *last = (((gram >> (8 * i)) & 255).astype(np.uint8) for i in range(max(ORDERS) + 1))
    return np.arange(len(gram)), letter, last


def contexts(last: list[np.ndarray], order: int, mult: np.uint64) -> np.ndarray:
    """Hash of the last ``order`` letters."""
    context = np.full(len(last[0]), order, np.uint64)
    for back in range(order):
        context = (context + last[back]) * mult
    return context ^ (context >> np.uint64(29))


def decisions(word: np.ndarray, letter: np.ndarray, last: list[np.ndarray], codes, bits: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word, bit, slots per order) of every binary decision; order 1 has a slot for each letter and node, others 2**bits."""
    start, length, nodes, ways = codes
    key = last[0].astype(np.int64) * 256 + letter
    count = length[key]
    offset = np.cumsum(count) - count
    at = np.repeat(start[key] - offset, count) + np.arange(int(count.sum()))
    node, bit = nodes[at], ways[at]
    slots = [np.repeat(last[0].astype(np.int64) << 8, count) + node]
    for order, mult, width in zip(ORDERS[1:], _MULT, bits[1:], strict=False):
        hashed = (np.repeat(contexts(last, order, mult), count) + node.astype(np.uint64)) * _NODE
        slots.append((hashed >> np.uint64(64 - width)).astype(np.int64))
    return np.repeat(word, count), bit, slots


def _slices(size: np.ndarray, limit: int):
    """Runs of words with about ``limit`` letters together."""
    total = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + limit, "right")))
        yield slice(first, last)
        first = last


@dataclass
class Mixer:
    """Count tables, ``counts[k]`` of shape (slots, 2), as predictions mixed by ``weights`` and refined by the map ``refined``."""

    codes: tuple
    counts: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray
    known: tuple[np.ndarray, np.ndarray] | None = None

    def widths(self) -> list[int]:
        return [len(n).bit_length() - 1 for n in self.counts]

    def inputs(self, bit: np.ndarray, slots: list[np.ndarray], left_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """(gate, inputs of the mixture) of decisions; left out: without the occurrence that is predicted."""
        x, seen = [], []
        for k, s in enumerate(slots):
            n = self.counts[k][s]
            if left_out:
                n[np.arange(len(bit)), bit] -= 1
                np.maximum(n, 0, out=n)
            x.append(np.log((n[:, 1] + np.float32(0.2)) / (n[:, 0] + np.float32(0.2))))
            seen.append(n.sum(1) if k >= 2 else None)
        gate = 3 * ((seen[-1] > 2).astype(np.int64) + (seen[-1] > 30)) + (seen[-2] > 2) + (seen[-2] > 30)
        return gate, np.stack([*x, np.ones(len(bit), np.float32)])

    def mix(self, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gate))
        for k in range(len(x)):
            out += self.weights[gate, k] * x[k]
        return out

    def bits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability, its stop included."""
        out = np.zeros(len(start))
        for part in _slices(end - start + 1, 2_000_000):
            word, gram = grams(data, start[part], end[part])
            out[part] = np.bincount(word, weights=self.known_logs(gram), minlength=part.stop - part.start)
        return out

    def known_logs(self, gram: np.ndarray) -> np.ndarray:
        """:meth:`logs`, of which ``KNOWN`` places keep the last packed letter that fell on each."""
        if self.known is None:
            self.known = np.full(KNOWN, -1, np.int64), np.zeros(KNOWN)
        kept, value = self.known
        place = (tk.mix(gram.view(np.uint64)) & np.uint64(KNOWN - 1)).astype(np.int64)
        out = value.take(place)
        new = np.flatnonzero(kept.take(place) != gram)
        if len(new):
            some, _, which, _ = word_mixer.distinct(gram.take(new))
            logs = self.logs(some)
            out[new] = logs.take(which)
            place = (tk.mix(some.view(np.uint64)) & np.uint64(KNOWN - 1)).astype(np.int64)
            place, first, _, _ = word_mixer.distinct(place)
            kept[place], value[place] = some.take(first), logs.take(first)
        return out

    def logs(self, gram: np.ndarray) -> np.ndarray:
        """Natural logarithm of each packed letter's probability."""
        out = np.zeros(len(gram))
        for i in range(0, len(gram), 50_000):
            index, bit, slots = decisions(*unpacked(gram[i : i + 50_000]), self.codes, self.widths())
            gate, x = self.inputs(bit, slots, False)
            p = refine(self.mix(gate, x), gate, self.refined)
            np.subtract(1, p, out=p, where=bit == 0)
            out[i : i + 50_000] = np.bincount(index, weights=np.log(p), minlength=min(50_000, len(gram) - i))
        return out

    def slopes(self, gram: np.ndarray, times: np.ndarray) -> np.ndarray:
        """By gate: loss, gradient and curvature of the weights over all decisions of letters that occur ``times``."""
        m = self.weights.shape[1]
        out = np.zeros((GATES, 1 + m + m * m))
        word, bit, slots = decisions(*unpacked(gram), self.codes, self.widths())
        gate, x = self.inputs(bit, slots, True)
        n = times[word].astype(float)
        mixed = np.clip(self.mix(gate, x), -12, 12)
        p = 1 / (1 + np.exp(-mixed))
        out[:, 0] = np.bincount(gate, weights=-n * np.log(np.where(bit == 1, p, 1 - p)), minlength=GATES)
        for g in range(GATES):
            at = np.flatnonzero(gate == g)
            if len(at):
                v = x[:, at].astype(float)
                out[g, 1 : 1 + m] = v @ (n[at] * (p[at] - bit[at]))
                out[g, 1 + m :] = ((v * (n[at] * p[at] * (1 - p[at]))) @ v.T).ravel()
        return out

    def outcomes(self, gram: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Of the map's places: decisions and ones among all decisions of letters that occur ``times``."""
        word, bit, slots = decisions(*unpacked(gram), self.codes, self.widths())
        gate, x = self.inputs(bit, slots, True)
        low, part = _bucket(self.mix(gate, x))
        near = gate * BUCKETS + low + (part > 0.5)
        n = times[word].astype(float)
        return np.stack([np.bincount(near, weights=n * y, minlength=GATES * BUCKETS) for y in (1.0, bit)], 1)


def _bucket(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (np.clip(x, -7.99, 7.99) + 8) * ((BUCKETS - 1) / 16)
    low = place.astype(np.int64)
    return low, place - low


def refine(x: np.ndarray, gate: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """The adaptive probability map between its two nearest buckets, averaged with the plain prediction."""
    low, part = _bucket(x)
    flat = refined.ravel()
    at = gate * BUCKETS + low
    mapped = flat[at] * (1 - part) + flat[at + 1] * part
    return np.clip(0.5 * mapped + 0.5 / (1 + np.exp(-np.clip(x, -12, 12))), 1e-6, 1 - 1e-6)


_START = np.array([0.1, 0.2, 0.35, 0.35, 0.0])
_CENTERS = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))


def fit(over, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and then the map, over all training decisions, each without itself in the counts that predict it.

    ``over(name, weights)`` is the sum of Mixer's ``slopes`` or ``outcomes`` over all training letters: what a pass gathers adds up, in any
    order and partition. A pass moves each gate's weights by a Newton step from where they are; a step that made the loss worse is halved.
    """
    m = len(_START)
    best, best_loss = np.tile(_START, (GATES, 1)), np.full(GATES, np.inf)
    step = np.zeros_like(best)
    for _ in range(passes + 1):
        got = over("slopes", best + step)
        loss = got[:, 0] + ((best + step - _START) ** 2).sum(1) / 2  # gates that see little stay near the start
        better = loss <= best_loss
        best, best_loss = np.where(better[:, None], best + step, best), np.where(better, loss, best_loss)
        slope = got[:, 1 : 1 + m] + best - _START
        newton = -np.linalg.solve(got[:, 1 + m :].reshape(GATES, m, m) + np.eye(m), slope[:, :, None])[:, :, 0]
        step = np.where(better[:, None], newton, step / 2)
        if np.abs(step).max() < 1e-3:
            break
    n, ones = over("outcomes", best).T
    return best, ((ones.reshape(GATES, -1) + 20 * _CENTERS) / (n.reshape(GATES, -1) + 20)).clip(1e-5, 1 - 1e-5)


def fit_mixer(codes, counts: list[np.ndarray], words: list[bytes]) -> Mixer:
    """:func:`fit` over words at hand, with tables of shape (2, slots)."""
    tables = [np.ascontiguousarray(c.T, np.float32) for c in counts]
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    _, gram = grams(np.frombuffer(b"".join(words), np.uint8), start, end)
    times = np.ones(len(gram), np.int64)
    return Mixer(codes, tables, *fit(lambda name, weights: getattr(Mixer(codes, tables, weights, _CENTERS), name)(gram, times)))


def training(modulus: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1)) != held


def text_classes(c: tk.Chunk) -> np.ndarray:
    """A rough class of each text, for training alone: by its most frequent second byte of two-byte letters; 0 without any."""
    lead = np.flatnonzero((c.data[:-1] >= 0xC3) & (c.data[:-1] <= 0xDF)) if len(c.data) else np.empty(0, np.int64)
    if not len(lead):
        return np.zeros(c.n_docs, np.int64)
    folded = c.data[lead + 1].astype(np.int64) & 0x1F  # upper and lower case of Latin letters share these bits
    doc = np.searchsorted(c.offset, lead, "right") - 1
    key, n = np.unique(doc * 32 + folded, return_counts=True)
    best = np.lexsort((key, -n, key // 32))
    first = best[np.concatenate(([True], (key[best] // 32)[1:] != (key[best] // 32)[:-1]))]
    out = np.zeros(c.n_docs, np.int64)
    many = n[first] * 400 >= np.diff(c.offset)[key[first] // 32]
    out[(key[first] // 32)[many]] = 1 + (key[first] % 32)[many] * 5 % (CLASSES - 1)
    return out


def _rows(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~training(modulus, held)).alias("held_out"), F.col("text").cast("string").alias("text"))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of each span."""
    length = end - start
    ends = np.cumsum(length)
    source = np.arange(int(length.sum())) + np.repeat(start - (ends - length), length)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(data[source].tobytes())])


def token_counts(rows: DataFrame, flush: int = 4_000_000) -> DataFrame:
    """(kind, key, letters, n, c0, c1, ...) of the training part: words by hash (kind 0) with their counts by class of text, and
    documents (1)."""

    def run(batches):
        held, size, docs = [], 0, 0
        names = ["kind", "key", "letters", "class", "n"]

        def words():
            key, label, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            spelling = pa.concat_arrays([x[3] for x in held])
            order = np.lexsort((label, key))
            key, label, n = key[order], label[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (label[1:] != label[:-1]))))
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), np.int8)), pa.array(key[first].view(np.int64)), spelling.take(pa.array(order[first])), pa.array(label[first]), pa.array(np.add.reduceat(n, first))], names=names)

        for batch in batches:
            docs += batch.num_rows
            for c in tk.chunks(batch.column("text")):
                unique, first, inverse, _ = word_mixer.distinct(c.word_hashes(lower=True))
                n = np.bincount(inverse * CLASSES + text_classes(c)[c.doc], minlength=len(unique) * CLASSES)
                at = np.flatnonzero(n)
                if len(at):
                    spelling = spans(_FOLD[c.data], c.start[first[at // CLASSES]], c.end[first[at // CLASSES]])
                    held.append((unique[at // CLASSES], (at % CLASSES).astype(np.int8), n[at], spelling))
                    size += len(at) + spelling.nbytes // 16
                if size > flush:
                    yield words()
                    held, size = [], 0
        if size:
            yield words()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([0], pa.int8()), pa.array([docs], pa.int64())], names=names)

    sent = rows.filter("not held_out").select("text").mapInArrow(tk.lean(run), "kind byte, key long, letters binary, class byte, n long")
    # a task has added up its own already: rows travel narrow, and become wide where they meet
    by_class = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(CLASSES)]
    return sent.repartition("kind", "key").groupBy("kind", "key", "letters").agg(F.sum("n").alias("n"), *by_class)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def letter_counts(words: DataFrame) -> DataFrame:
    """(gram, n): occurrences of each letter with its last letters, from all words (letters, n)."""

    def run(batches):
        held, size = [], 0

        def flush():
            key, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            column = batch.column("letters")
            if not len(column):
                continue
            _, offset, data = column.buffers()
            offset = np.frombuffer(offset, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data, n = np.frombuffer(data, np.uint8), batch.column("n").to_numpy()
            for part in _slices(np.diff(offset) + 1, 1_000_000):
                word, gram = grams(data, offset[:-1][part], offset[1:][part])
                held.append((gram, n[part][word]))
                size += len(gram)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return words.select("letters", "n").mapInArrow(tk.lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def table_bits(runs: DataFrame, codes, least: int = TABLE_BITS) -> list[int]:
    """Bits of each order's table: at least twice as many slots as distinct (context, node) pairs of the training part.

    The pairs of one context in SPARSE are counted exactly; this decides about sizes only.
    """

    def run(batches):
        start, length, nodes, _ = codes
        for batch in batches:
            _, letter, last = unpacked(batch.column("gram").to_numpy())
            key = last[0].astype(np.int64) * 256 + letter
            for k, mult in zip(range(1, len(ORDERS)), _MULT, strict=False):
                context = contexts(last, ORDERS[k], mult)
                at = np.flatnonzero(tk.mix(context) % np.uint64(SPARSE) == 0)
                count = length[key[at]]
                node = nodes[np.repeat(start[key[at]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
                pair = np.unique((np.repeat(context[at], count) + node.astype(np.uint64)) * _NODE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), k, np.int32)), pa.array(pair.view(np.int64))], names=["order", "pair"])

    found = runs.select("gram").mapInArrow(tk.lean(run), "order int, pair long").distinct().groupBy("order").count().collect()  # a row an order
    pairs = {r["order"]: r["count"] * SPARSE for r in found}
    return [16] + [max(least, (2 * pairs.get(k, 0)).bit_length()) for k in range(1, len(ORDERS))]


def context_counts(runs: DataFrame, codes, bits: list[int]) -> DataFrame:
    """(segment, payload) of the context tables: each distinct letter with its last letters once, with its number of occurrences.

    A task holds the slots that its letters use, and sends them in compressed segments, which are added up as they stream in.
    """
    base = np.concatenate(([0], np.cumsum([1 << b for b in bits])))

    def run(batches):
        pack = zs.ZstdCompressor(level=1).compress
        slot, total = np.empty(0, np.int64), np.empty(0, np.int64)
        held, size = [], 0

        def add():
            return _summed(np.concatenate([slot, *(h[0] for h in held)]), np.concatenate([total, *(h[1] for h in held)]))

        for batch in batches:
            index, bit, slots = decisions(*unpacked(batch.column("gram").to_numpy()), codes, bits)
            n = batch.column("n").to_numpy()[index]
            held.append((np.concatenate([((base[k] + s) << 1) + bit for k, s in enumerate(slots)]), np.tile(n, len(slots))))
            size += len(held[-1][0])
            if size > 2_000_000 + len(slot):
                slot, total = add()
                held, size = [], 0
        if held:
            slot, total = add()
        at = slot // (2 * SEGMENT)
        bounds = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True]))) if len(at) else np.zeros(1, np.int64)
        for i in range(0, len(bounds) - 1, 256):
            ends = bounds[i : i + 257].tolist()
            packed = [pack((slot[x:y] % (2 * SEGMENT)).astype(np.uint16).tobytes() + total[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at[ends[:-1]]), pa.array(packed, pa.binary())], names=["segment", "payload"])

    def add_up(batches):
        unpack = zs.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, payload in zip(batch.column("segment").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                raw = unpack(payload)
                m = len(raw) // 10
                if s not in sums:
                    sums[s] = np.zeros(2 * SEGMENT, np.int64)
                sums[s][np.frombuffer(raw, np.uint16, m)] += np.frombuffer(raw[2 * m :], np.int64)
        for s, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["segment", "payload"])

    schema = "segment long, payload binary"
    return runs.mapInArrow(tk.lean(run), schema).repartition("segment").mapInArrow(tk.lean(add_up), schema)


def over_letters(runs: DataFrame, sent):
    """What :func:`fit` asks for, over the table of letters (gram, n); ``sent`` is the broadcast (codes, tables)."""

    def over(name: str, weights: np.ndarray) -> np.ndarray:
        m = weights.shape[1]
        shape = {"slopes": (GATES, 1 + m + m * m), "outcomes": (GATES * BUCKETS, 2)}[name]

        def run(batches):
            ask = getattr(Mixer(*sent.value, weights, _CENTERS), name)
            total = np.zeros(shape)
            for batch in batches:
                total += ask(batch.column("gram").to_numpy(), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["payload"])

        got = runs.mapInArrow(tk.lean(run), "payload binary").collect()  # a small row a task
        return np.sum([np.frombuffer(r["payload"]).reshape(shape) for r in got] + [np.zeros(shape)], axis=0)

    return over


@dataclass
class Scale:
    """What turns counts into probabilities."""

    total: int  # N
    distinct: int  # V
    documents: int
    escaped: float  # what the words outside the tree weigh: their tokens, and the words seen once for those never seen
    novel: float  # of that, what is left to spelling


@dataclass
class Model:
    weights: np.ndarray  # of the spelling
    refined: np.ndarray
    keys: np.ndarray  # hashes of the tree's words, in order
    counts: np.ndarray
    tree: word_mixer.Tree
    scale: Scale


def learn(counts: DataFrame, share_bits: int):
    """(model, broadcast of the spelling's codes and tables)."""
    words = counts.filter("kind = 0")
    documents = counts.filter("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = [f"c{k}" for k in range(CLASSES)]
    tokens, distinct, *sizes = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first()
    total = tokens + documents
    least = max(2, -(-total >> share_bits))
    rare = words.filter(F.col("n") < least)
    n_rare, rare_tokens, once = rare.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    # a word's class is the one of whose tokens it makes up the largest share
    shares = F.array(*(F.col(c) / F.lit(float(max(size, 1))) for c, size in zip(names, sizes, strict=True)))
    table = words.filter(F.col("n") >= least).select("key", "n", (F.array_position(shares, F.array_max(shares)) - 1).cast("byte").alias("class")).toArrow()  # at most 2**share_bits rows
    key = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, n, classes = key[order], table.column("n").to_numpy()[order], table.column("class").to_numpy()[order]
    tree = word_mixer.code_tree(n, classes, float(documents), float(rare_tokens + once))
    runs = materialize(letter_counts(words.select("letters", F.lit(1).cast("long").alias("n"))))  # each distinct word once: new words are like them
    pairs = np.zeros(65536, np.int64)
    for r in runs.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[r["pair"]] = r["n"]
    codes = huffman_codes(pairs.reshape(256, 256))
    bits = table_bits(runs, codes)
    tables = [np.zeros((1 << b, 2), np.float32) for b in bits]
    segments = [table[i : i + SEGMENT] for table in tables for i in range(0, len(table), SEGMENT)]
    for r in materialize(context_counts(runs, codes, bits)).toLocalIterator():
        segments[r["segment"]][:] = np.frombuffer(r["payload"], np.float32).reshape(SEGMENT, 2)
    sent = counts.sparkSession.sparkContext.broadcast((codes, tables))
    del tables, segments
    escaped = float(max(rare_tokens + once, 1))
    scale = Scale(total, distinct + (documents > 0), documents, escaped, escaped - (rare_tokens - DISCOUNT * n_rare))
    return Model(*fit(over_letters(runs, sent)), key, n, tree, scale), sent


def escape_logs(spelled: np.ndarray, count: np.ndarray, of: np.ndarray, kept: np.ndarray, repeated: np.ndarray, scale: Scale) -> np.ndarray:
    """Natural logarithm of every occurrence's probability after an escape: of word ``of``, with the share ``kept`` for corpus and
    spelling, and ``repeated`` from the document."""
    corpus = np.maximum(count - DISCOUNT, 0) / scale.escaped
    novel = np.log(scale.novel / scale.escaped)
    p = (corpus + np.exp(np.maximum(spelled + novel, -700)))[of] * kept + repeated
    return np.where(p > 1e-290, np.log(np.maximum(p, 1e-300)), spelled[of] + novel + np.log(kept))


def chunk_scores(c: tk.Chunk, model: Model, mixer: Mixer) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """Per document: tokens, bytes of words and ends, those in the tree with their log10 sum, and the log probability of all tokens in
    the tree, of the escapes and of what first times keep; and all other words (document, hash, spelling, further occurrences, kept and
    repeated share of each of these)."""
    n = c.n_docs
    hashes = c.word_hashes(lower=True)
    unique, first, inverse, _ = word_mixer.distinct(hashes)
    at = np.minimum(np.searchsorted(model.keys, unique), max(0, len(model.keys) - 1))
    known = model.keys[at] == unique if len(model.keys) else np.zeros(len(unique), bool)
    leaf_of = np.where(known, at, len(model.keys) + 1)
    # the tokens in order, each document's end after its words
    doc = np.concatenate([c.doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")
    leaf = np.concatenate([leaf_of[inverse], np.full(n, len(model.keys))])[order]
    logs = word_mixer.document_logs(model.tree, leaf, doc[order], np.concatenate([hashes, np.full(n, END_KEY)])[order], n)
    known_at = known[inverse]
    base = np.log10(model.counts[at[known]] + 1.0) if known.any() else np.zeros(0)
    sums = np.bincount(c.doc[known_at], weights=base[(np.cumsum(known) - 1)[inverse[known_at]]], minlength=n)
    # words outside the tree: how often they, and all such words, have come before in their document
    rare = np.flatnonzero(~known_at)
    spells = np.flatnonzero(~known)
    spelled = np.zeros(len(unique))
    spelled[spells] = mixer.bits(_FOLD[c.data], c.start[first[spells]], c.end[first[spells]])
    key = c.doc[rare] * np.int64(len(unique) + 1) + inverse[rare]
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    run = np.flatnonzero(fresh)
    times = np.diff(np.append(run, len(order)))
    before = np.arange(len(order)) - np.repeat(run, times)
    place = np.arange(len(rare)) - np.searchsorted(c.doc[rare], np.arange(n))[c.doc[rare]]
    place = place[order]
    share = REPEATS * place / (place + REPEATS_AFTER)
    start = rare[order[run]]
    # a word's first time in a document has no share of what was before: what is kept then belongs to the document's own sum
    logs += np.bincount(c.doc[start], weights=np.log(1 - share[run]), minlength=n)
    again = before > 0
    return (
        {"n_tokens": c.n_words + 1, "n_bytes": np.bincount(c.doc, weights=c.end - c.start, minlength=n).astype(np.int64) + c.n_words + 1, "n_tree": np.bincount(c.doc[known_at], minlength=n), "tree_sum": sums, "logs": logs},
        (c.doc[start], hashes[start], spelled[inverse[start]], times - 1, (1 - share)[again], (share * before / np.maximum(place, 1))[again]),
    )


#: a document's own sums, as they travel
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("has_id", "?"), ("held_out", "?"), ("n_bytes", "<i8"), ("n_tokens", "<i8"), ("n_tree", "<i8"), ("tree_sum", "<f8"), ("logs", "<f8")])


def _packed(size: np.ndarray, values: np.ndarray) -> pa.Array:
    """``values`` as binary pieces of ``size`` bytes."""
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(pieces: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(size, values) of binary pieces."""
    _, offsets, data = pieces.buffers()
    offset = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
    data = data if data is not None else b""
    return np.diff(offset), np.frombuffer(data, np.uint8)[offset[0] : offset[-1]].view(kind)


def scored(rows: DataFrame, model: Model, tables) -> DataFrame:
    """Rows of documents (even ``at``, word null) and, under the next odd number, of their words outside the tree (word, spelling).

    ``more`` has a document's sums, or of each further occurrence of a word what is kept and repeated. A document may have many words,
    so that rows are kept narrow.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)  # at most 2**share_bits words

    def run(batches):
        m = sent.value
        mixer = Mixer(*tables.value, m.weights, m.refined)
        base = TaskContext.get().partitionId() << 40
        done = 0
        names = ["at", "word", "spelled", "more"]
        for batch in batches:
            first = 0
            batch = batch.take(pc.sort_indices(pc.fill_null(pc.binary_length(batch.column("text")), 0)))  # texts of a chunk take alike many turns
            for c in tk.chunks(batch.column("text"), 1_000_000):
                got, (doc, word, spelled, times, kept, repeated) = chunk_scores(c, m, mixer)
                n, k = c.n_docs, len(word)
                at = 2 * (base + done + np.arange(n))
                ids = batch.column("doc_id").slice(first, n)
                sums = np.zeros(n, _DOCUMENT)
                sums["doc_id"], sums["has_id"] = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
                sums["held_out"] = batch.column("held_out").slice(first, n).to_numpy(zero_copy_only=False)
                for name, values in got.items():
                    sums[name] = values
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float32()), _packed(np.full(n, _DOCUMENT.itemsize), sums)], names=names)
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array(at[doc] + 1), pa.array(word.view(np.int64)), pa.array(spelled, pa.float32()), _packed(8 * times, np.stack([kept, repeated], 1).astype(np.float32))], names=names)
                first += n
                done += n

    return rows.mapInArrow(tk.lean(run), "at long, word long, spelled float, more binary")


def mixed(found: DataFrame, words: DataFrame, scale: Scale) -> DataFrame:
    """The result's rows: each document's sums, with those of its words outside the tree, whose counts come by a join.

    A document's row comes before those of its words; only the sums of the last document are held.
    """
    size, end = float(np.log10(scale.total + scale.distinct + 1)), float(np.log10(scale.documents + 1))

    def run(batches):
        def result(docs, sums):
            score = (docs["logs"] + sums[:, 0]) / np.log(10)
            tokens = docs["n_tokens"]
            known = docs["n_tree"] + sums[:, 1].astype(np.int64) + int(scale.documents > 0)
            base = docs["tree_sum"] + sums[:, 2] + end - tokens * size
            bits = -score * np.log2(10) / docs["n_bytes"]
            out = {"doc_id": pa.array(docs["doc_id"], mask=~docs["has_id"]), "held_out": pa.array(docs["held_out"]), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(tokens), scale.total, np.int64)), "base_score": pa.array(base), "score": pa.array(score), "bits_per_byte": pa.array(bits)}
            return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            is_doc = batch.column("at").to_numpy() % 2 == 0
            owner = np.cumsum(is_doc)  # 0: the document held
            sums = np.zeros((int(owner[-1]) + 1, 3))
            if not is_doc.all():
                rare, who = batch.filter(pa.array(~is_doc)), owner[~is_doc]
                times, shares = _unpacked(rare.column("more"), np.float32)
                times, shares = times // 8, shares.reshape(-1, 2)
                first = np.arange(len(times))
                of = np.concatenate([first, np.repeat(first, times)])
                kept, repeated = (np.concatenate([np.full(len(times), x), shares[:, j]]) for j, x in enumerate((1.0, 0.0)))
                n = rare.column("n").to_numpy()
                logs = escape_logs(rare.column("spelled").to_numpy().astype(float), n, of, kept, repeated, scale)
                for j, x in enumerate([logs, (n > 0)[of], np.log10(n + 1.0)[of]]):
                    sums[:, j] = np.bincount(who[of], weights=x, minlength=len(sums))
            docs = _unpacked(batch.column("more").filter(pa.array(is_doc)), _DOCUMENT)[1]
            if held is None:
                sums = sums[1:]
            else:
                sums[0] += held[1]
                docs = np.concatenate([held[0], docs])
            if len(docs) > 1:
                yield result(docs[:-1], sums[:-1])
            held = docs[-1:], sums[-1]
        if held is not None:
            yield result(held[0], held[1][None])

    counts = words.select(F.col("key").alias("word"), "n")
    rare = found.filter("word is not null").join(counts, "word", "left").select("at", "spelled", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "more")
    docs = found.filter("word is null").select("at", "spelled", F.lit(0).cast("long").alias("n"), "more")
    together = docs.unionByName(rare).repartition(F.shiftright("at", 1)).sortWithinPartitions("at")  # one key: Spark sorts it by its bytes
    return together.mapInArrow(tk.lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def score(docs: DataFrame, modulus: int = 7, held: int = 2, share_bits: int = 22) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the probability) and bits_per_byte (of the words
    and one byte for each token's end)."""
    rows = _rows(docs, modulus, held)
    counts = materialize(token_counts(rows))
    model, tables = learn(counts, share_bits)
    found = materialize(scored(rows, model, tables))
    return mixed(found, counts.filter("kind = 0"), model.scale)
