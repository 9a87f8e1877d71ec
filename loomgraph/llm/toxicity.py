"""Toxicity by compression distance: windows compressed with an ordinary and a toxic zstandard dictionary.

Each text is cut into windows of a few words. A window's distance is its compressed length under the ordinary dictionary minus
that under the toxic one. The ordinary dictionary is trained on ordinary windows; the toxic one holds the same content after
pieces that are characteristic of toxic training texts, so that ordinary windows compress alike under both. A document's score
is a calibrated logistic function of how many windows pass distance thresholds, and by how much.

Only rows of the training folds are learned from, and of these a bounded sample: at most ``max_per_class`` documents of each
class (the first by a hash of doc_id), none longer than ``max_fit_chars``, together at most ``max_total_chars``. The ordinary dictionary
is trained on at most ``max_windows`` of their windows, and the toxic one has at most ``max_bytes`` of pieces before the ordinary content.
Every document is scored whole.

Edge cases: a null or empty text has no windows and gets the score of a text without distance; very long texts are scored by all their
windows; a null doc_id is held out of training; several labels of one document count as toxic if any is; without a toxic or an ordinary
training text every score is the share of toxic labels; repeated rows each give a row; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkernel as tk
from .common import materialize, small_batches

WORDS = 3
#: each byte is written so often, in windows and dictionaries alike: what a match saves grows against what it costs to state
STRETCH = 2
#: starts every window and ends both dictionaries: each block then has a match, so that small gains are not rounded away
MARK = bytes([*range(1, 9), *range(14, 30)]) + b" "
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[tk.IS_SPACE] = 32
PREFIXES = (4, 5, 6)
#: distances, in bytes, whose windows are counted
LEVELS = (2, 3, 4, 5, 7)
FEATURES = 3 + 2 * len(LEVELS)


def fold(modulus: int, column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def stretched(data: bytes) -> bytes:
    return np.repeat(np.frombuffer(data, np.uint8), STRETCH).tobytes()


def window_spans(c: tk.Chunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end byte) of each window: runs of ``words`` words; a document's last one may be shorter."""
    if not len(c.start):
        return (np.empty(0, np.int64),) * 3
    first_word = np.searchsorted(c.doc, np.arange(c.n_docs))
    place = np.arange(len(c.doc)) - first_word[c.doc]
    head = np.flatnonzero(place % words == 0)
    last = np.append(head[1:], len(c.doc)) - 1
    return c.doc[head], c.start[head], c.end[last]


def marked_windows(c: tk.Chunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, buffer, segments): lower-cased windows, each after MARK and before a space."""
    doc, start, end = window_spans(c, words)
    body = end - start
    length = len(MARK) + STRETCH * (body + 1) + STRETCH - 1
    at = np.cumsum(length) - length
    buffer = np.full(int(length.sum()), 32, np.uint8)
    for i, b in enumerate(MARK):
        buffer[at + i] = b
    source = np.arange(int(body.sum())) + np.repeat(start - (np.cumsum(body) - body), body)
    target = STRETCH * (source - np.repeat(start, body)) + np.repeat(at + len(MARK) + STRETCH - 1, body)
    letters = _FOLDED[c.data][source]
    for i in range(STRETCH):
        buffer[target + i] = letters
    return doc, buffer, np.stack([at, length], 1).astype(np.uint64)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def compressors(self) -> list[zs.ZstdCompressor]:
        # one search depth for all windows; tables far larger than the dictionaries, so that no entry displaces another
        p = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_LAZY2, min_match=6, hash_log=17, chain_log=17, search_log=8, window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
        return [zs.ZstdCompressor(compression_params=p, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT)) for d in (self.ordinary, self.toxic)]


def _lengths(compressor: zs.ZstdCompressor, buffer: np.ndarray, segments: np.ndarray) -> np.ndarray:
    out = compressor.multi_compress_to_buffer(zs.BufferWithSegments(buffer.tobytes(), segments.tobytes()), threads=1)
    return np.fromiter(map(len, out), np.int64, len(segments))


def features(c: tk.Chunk, compressors: list[zs.ZstdCompressor]) -> np.ndarray:
    """Per document: the largest distance, the number and the share of windows at or past each of LEVELS, and
    the sum and the mean of distances past the lowest, as logarithms."""
    n = c.n_docs
    doc, buffer, segments = marked_windows(c)
    if not len(doc):
        return np.zeros((n, FEATURES))
    distance = _lengths(compressors[0], buffer, segments) - _lengths(compressors[1], buffer, segments)
    windows = np.maximum(1, np.bincount(doc, minlength=n))
    most = np.zeros(n)
    np.maximum.at(most, doc, np.minimum(distance, 12))
    past = [np.bincount(doc, weights=distance >= level, minlength=n) for level in LEVELS]
    past += [np.bincount(doc, weights=np.where(distance >= LEVELS[0], distance, 0), minlength=n)]
    return np.stack([most, *(np.log1p(x) for x in past), *(np.log1p(50 * x / windows) for x in past)], 1)


def _units(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit hash, context hash, first byte, end byte): whole words, and their beginnings; the context is the word before."""
    folded = _FOLDED[c.data]
    values = tk._BYTE[folded]
    whole = tk.span_hashes(values, c.start, c.end)
    before = np.zeros(len(whole), np.uint64)
    before[1:] = np.where(c.doc[1:] == c.doc[:-1], whole[:-1], np.uint64(0))
    out = [(tk.mix(whole ^ np.uint64(7)), before, c.start, c.end)]
    for k in PREFIXES:
        longer = np.flatnonzero(c.end - c.start > k)
        out.append((tk.span_hashes(values, c.start[longer], c.start[longer] + k), before[longer], c.start[longer], c.start[longer] + k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def characteristic_pieces(toxic: pa.Array, ordinary: pa.Array, max_bytes: int = 24 * 1024, max_share: float = 0.25) -> bytes:
    """Words and word beginnings that toxic texts hold in many contexts and ordinary ones hardly ever, the most telling last.

    Contexts are counted instead of documents, so that copies of a text count once. A piece is kept if its count in toxic texts
    is beyond chance (Chernoff bound, corrected for the number of pieces) and ordinary texts have at most ``max_share`` as many.
    """

    def counted(texts: pa.Array):
        hashes, contexts, pieces = [], [], {}
        for c in tk.chunks(texts):
            h, before, start, end = _units(c)
            hashes.append(h)
            contexts.append(tk.mix(h ^ tk.mix(before)))
            _, first = np.unique(h, return_index=True)
            folded = _FOLDED[c.data].tobytes()
            whole = first < len(c.start)
            pieces.update((int(h[i]), b" " + folded[start[i] : end[i]] + (b" " if w else b"")) for i, w in zip(first, whole, strict=True))
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int64), pieces
        _, once = np.unique(np.concatenate(contexts), return_index=True)
        return *np.unique(np.concatenate(hashes)[once], return_counts=True), pieces

    unit, count, pieces = counted(toxic)
    other, other_count, _ = counted(ordinary)
    if not len(unit) or not len(other):
        return b""
    at = np.minimum(np.searchsorted(other, unit), len(other) - 1)
    against = np.where(other[at] == unit, other_count[at], 0)
    share = count.sum() / (count.sum() + other_count.sum())
    able = (count >= 3) & (against <= max_share * count)
    n, p = count[able] + against[able], count[able] / (count[able] + against[able])
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = -n * (p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0.0))
    kept = chance < math.log(0.01 / max(1, int((count >= 3).sum())))
    found = {pieces[int(u)]: (float(c), int(n)) for u, c, n in zip(unit[able][kept], chance[kept], count[able][kept], strict=True)}
    beginnings = {p: [p[:k] for k in range(5, min(len(p), 8)) if p[:k] in found] for p in found}
    # a beginning of many words stands for them; one that nearly always goes on the same way gives way to the longer piece
    general = {p for p, (_, n) in found.items() if any(found[b][1] >= 2 * n for b in beginnings[p])}
    partial = {b for p, (_, n) in found.items() if p not in general for b in beginnings[p] if n >= 0.8 * found[b][1]}
    held, out = 0, []
    for _, piece in sorted((c, p) for p, (c, _) in found.items() if p not in general and p not in partial):
        held += len(piece)
        if held > max_bytes:
            break
        out.append(piece)
    return stretched(b"".join(reversed(out)))


def ordinary_content(texts: pa.Array, size: int = STRETCH * 12 * 1024, max_windows: int = 30_000, seed: int = 0) -> bytes:
    """Content of a zstandard dictionary trained on a sample of ordinary windows."""
    samples: list[bytes] = []
    for c in tk.chunks(texts):
        _, buffer, segments = marked_windows(c)
        data = buffer.tobytes()
        samples += [data[int(a) + len(MARK) : int(a + n)] for a, n in segments]
    samples = random.Random(seed).sample(samples, min(max_windows, len(samples)))
    try:
        return zs.train_dictionary(4 * size, samples).as_bytes()[-size:]
    except zs.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, steps: int = 30) -> np.ndarray:
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    penalty = np.diag([*[l2 * weight.sum() / len(x)] * x.shape[1], 0.0]) + 1e-9 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (weight * (p - y)) + penalty @ w
        w -= np.linalg.solve((x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + penalty, gradient)
    return w


def fit(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model | None:
    """Dictionaries of two thirds of the texts; thresholds and calibration of the third that they have not seen."""
    if not toxic or not ordinary:
        return None

    def dictionaries(t: list[str], o: list[str]) -> tuple[bytes, bytes]:
        o = pa.array(o, pa.string())
        base = ordinary_content(o) + MARK
        return base, characteristic_pieces(pa.array(t, pa.string()), o) + base

    def measured(model: Model, texts: list[str]) -> np.ndarray:
        tools = model.compressors()
        parts = [features(c, tools) for c in tk.chunks(pa.array(texts, pa.string()))]
        return np.concatenate(parts) if parts else np.zeros((0, FEATURES))

    tests = (toxic[2::3], ordinary[2::3])
    learned = [[x for i, x in enumerate(texts) if i % 3 != 2] for texts in (toxic, ordinary)]
    none = np.zeros(FEATURES)
    model = Model(*dictionaries(*learned), none, none, none)
    x = np.concatenate([measured(model, texts) for texts in tests])
    y = np.repeat([1.0, 0.0], [len(tests[0]), len(tests[1])])
    if not len(tests[0]) or not len(tests[1]):
        x = np.concatenate([measured(model, texts) for texts in learned])
        y = np.repeat([1.0, 0.0], [len(learned[0]), len(learned[1])])
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    weight = np.where(y == 1, toxic_share / max(1, (y == 1).sum()), (1 - toxic_share) / max(1, (y == 0).sum())) * len(y)
    return Model(model.ordinary, model.toxic, _logistic((x - center) / scale, y, weight), center, scale)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, max_per_class: int = 2500, max_fit_chars: int = 100_000, max_total_chars: int = 40_000_000) -> tuple[Model | None, float]:
    """The model, and the share of toxic labels in the training folds."""
    marked = labels.filter("toxic is not null and doc_id is not null").filter(fold(modulus) != 0).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    totals = dict(marked.groupBy("toxic").count().collect())
    if not totals:
        return None, 0.0
    share = totals.get(True, 0) / sum(totals.values())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample: dict[bool, list[str]] = {}
    for kind in (True, False):
        # a hash threshold leaves about max_per_class + 25% ids, of which the first by hash are taken: a top-k on ids alone
        order = F.xxhash64(F.col("doc_id").cast("long"))
        ids = marked.filter(F.col("toxic") == kind).select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("order")).orderBy("order").limit(max_per_class)
        chosen = materialize(texts.join(F.broadcast(ids), "doc_id").filter(F.length("text") <= max_fit_chars).select("order", "text"))
        upto = F.sum(F.length("text")).over(Window.orderBy("order", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
        bounded = chosen.withColumn("upto", upto).filter(F.col("upto") <= max_total_chars)  # at most max_per_class ids
        sample[kind] = [r[1] for r in sorted(bounded.select("order", "text").collect())][:max_per_class]
    return fit(sample[True], sample[False], share), share


def _scoring(model: Model | None, share: float):
    """A map over batches with a column ``text``, or ``row`` that holds one: all columns but text, score and predicted."""

    def run(batches):
        tools = model.compressors() if model is not None else []
        for batch in batches:
            parts = []
            for c in tk.chunks(tk.text_of(batch), 1_000_000):
                if model is None:
                    parts.append(np.full(c.n_docs, share))
                else:
                    x = (features(c, tools) - model.center) / model.scale
                    parts.append(1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -700, 700))))
            got = np.concatenate(parts) if parts else np.empty(0)
            kept = [k for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model | None, share: float, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(fold(modulus), F.lit(0)) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tk.lean(_scoring(model, share)), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    model, share = train(docs, labels, modulus)
    return score(docs, model, share, modulus)


def ordinary_rows(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic; each row by its own text."""
    model, share = train(docs, labels, modulus)
    small_batches(docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = StructType([*rows.schema.fields]).add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(tk.lean(_scoring(model, share)), schema).filter("predicted = 0").select("row.*")
