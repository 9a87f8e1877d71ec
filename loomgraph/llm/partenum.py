"""Near-duplicate join on word shingles by PartEnum signatures, with exact verification.

Sets of equal shingles collapse first. Size bands have a ratio of 5/4, so that sets with a Jaccard similarity of 4/5 or more lie in
one band or in two that adjoin. At the level of a band of largest size r, two such sets differ in at most k = 2r/9 elements. The
element domain is hashed into G groups of N2 parts; some group then has at most K2 differing elements, and one of its subsets
of N2 - K2 parts is equal in both sets. Each subset's content is a signature: a set signs the levels of its own band and of the
next one. G leaves room for groups with an empty part; a set with too many of those signs its prefix (its first elements in hash
order, which any similar set shares one of) as well, so that no empty content ever needs to be a signature.

Candidates are narrowed by profiles before whole sets are compared: a profile counts a set's elements in hash cells, and the
L1 distance of two profiles never exceeds the difference of the sets. A signature that few sets share compares all profiles and
passes on the few pairs that may link. A signature whose sets are mostly alike, or very many, passes on pairs with some centres
only; sets that lie in different components after that are compared further. No group is ever expanded into all its pairs.

Edge cases: a document without words has an empty set and links with nothing; with fewer words than a shingle, the whole sequence
is its one element; repeated rows and equal texts are one class; a row with a null doc_id links as any
other, and a component's name is null only if no row of it has a doc_id; an empty table gives an empty result; texts are never cut;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import materialize, small_batches

U64 = np.uint64
WIDTH = 5
CELLS = 96
PACKED = 8  # bytes of an element
DENSE = 1  # pairs passed on for each set of a signature; with more, a centre stands for the group
WIDE = 2048  # sets of a signature whose profiles are all compared; those of one with more are dealt to bins of about half as many
HELD = 65_536  # sets of one signature that a task holds
ROUNDS = 3  # with another centre each; the last compares what is still apart
N2, K2 = 2, 1


def size_bands(largest: int) -> np.ndarray:
    """Upper bounds of the bands: 4, 5, 7, 9, ... each at least 5/4 of the one before. Sets below 5 elements link only if equal."""
    out = [4, 5]
    while out[-2] < largest:
        out.append(-(-out[-1] * 5 // 4))
    return np.array(out)


def level_groups(bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(G, k): groups and the largest difference at a level."""
    k = 2 * bound // 9
    need = k // (K2 + 1) + 1
    return need + np.ceil(0.2 * need).astype(np.int64), k


def shingle_sets(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) of each distinct shingle, ordered by document and element."""
    words = c.word_hashes(lower=True)
    at, hashes = tk.windows(words, c.doc, WIDTH)
    doc = c.doc[at]
    count = c.n_words
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):
        first = np.searchsorted(c.doc, short)
        whole = np.zeros(len(short), U64)
        for i in range(WIDTH - 1):
            there = i < count[short]
            whole[there] += tk.mix(words[first[there] + i] + U64(i + 1))
        hashes = np.concatenate([hashes, tk.mix(whole ^ U64(0xABCD))])
        doc = np.concatenate([doc, short])
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _sums(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values by key, modulo 2**64. Halves of 32 bits stay exact as doubles up to two million terms."""
    low = np.bincount(key, weights=(values & U64(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(U64)
    high = np.bincount(key, weights=(values >> U64(32)).astype(np.float64), minlength=n).astype(U64)
    return low + (high << U64(32))


def fingerprints(doc: np.ndarray, element: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two independent 64-bit fingerprints) of each document's set."""
    size = np.bincount(doc, minlength=n)
    return size, tk.mix(_sums(doc, tk.mix(element ^ U64(0x1357)), n) + size.astype(U64)), tk.mix(_sums(doc, tk.mix(element ^ U64(0x2468ACE)), n) ^ size.astype(U64))


def signatures(doc: np.ndarray, element: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of all documents, for the two levels each signs."""
    size = np.bincount(doc, minlength=n)
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, U64)
    bands = size_bands(int(size.max()))
    own = np.searchsorted(bands, size)
    start = np.cumsum(size) - size
    out_doc, out = [], []
    for step in (0, 1):
        level = own + step
        signs = (size > 0) & (level > 0)  # the lowest band has equal sets only
        groups, k = level_groups(bands[level])
        parts = np.where(signs, groups * N2, 0)
        base = np.cumsum(parts) - parts
        total = int(parts.sum())
        if not total:
            continue
        here = signs[doc]
        d, e = doc[here], element[here]
        salt = tk.mix(level.astype(U64) * U64(0x9E3779B97F4A7C15))
        mixed = tk.mix(e ^ salt[d])
        part = base[d] + (((mixed >> U64(32)) * parts[d].astype(U64)) >> U64(32)).astype(np.int64)
        count = np.bincount(part, minlength=total)
        content = _sums(part, mixed, total)
        owner = np.repeat(np.arange(n), parts)
        place = np.arange(total) - base[owner]
        filled = count > 0
        # with N2 = 2 and K2 = 1 the subsets of N2 - K2 parts are the single parts
        out_doc.append(owner[filled])
        out.append(tk.mix(content[filled] ^ tk.mix(salt[owner[filled]] + place[filled].astype(U64))))
        empty_groups = np.bincount(owner[::N2], weights=~filled.reshape(-1, N2).all(1), minlength=n)
        sparse = np.flatnonzero(signs & (empty_groups > groups - k // (K2 + 1) - 1))
        for x in sparse:  # prefix in hash order: any set of similarity 4/5 shares one of the first size - ceil(4/5 size) + 1
            first = element[start[x] : start[x] + size[x] - -(-4 * size[x] // 5) + 1]
            out_doc.append(np.full(len(first), x))
            out.append(tk.mix(first ^ tk.mix(salt[x : x + 1] + U64(0xF0F0))))
    return (np.concatenate(out_doc), np.concatenate(out)) if out else (np.empty(0, np.int64), np.empty(0, U64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def profiles(doc: np.ndarray, element: np.ndarray, n: int) -> pa.Array:
    """Each set's elements per hash cell, at most 255 (which only lowers distances): CELLS cells, twice as many for each doubling of
    a set beyond 4 * CELLS elements. Neighbouring cells add up to the next coarser profile."""
    size = np.bincount(doc, minlength=n)
    cells = CELLS << np.ceil(np.log2(np.maximum(size / (4 * CELLS), 1))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(cells)))
    cell = ((tk.mix(element ^ U64(0x77)) >> U64(32)) * cells[doc].astype(U64) >> U64(32)).astype(np.int64)
    counts = np.minimum(np.bincount(base[doc] + cell, minlength=base[-1]), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(base.astype(np.int32).tobytes()), pa.py_buffer(counts.tobytes())])


def set_classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles, fp, fp2, profile of every document."""

    def run(batches):
        for batch in batches:
            first = 0
            for c in tk.chunks(batch.column("text"), 500_000):
                doc, element = shingle_sets(c)
                size, fp, fp2 = fingerprints(doc, element, c.n_docs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, c.n_docs), batch.column("key").slice(first, c.n_docs), pa.array(size, pa.int64()), _signed(fp), _signed(fp2), profiles(doc, element, c.n_docs)], names=["doc_id", "key", "n_shingles", "fp", "fp2", "profile"])
                first += c.n_docs

    return _texts(docs).mapInArrow(tk.lean(run), "doc_id long, key long, n_shingles long, fp long, fp2 long, profile binary")


def signed_sets(docs: DataFrame) -> DataFrame:
    """(sig, fp) of every set. A task emits the signatures of a set it has already seen only once, as a combiner would."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for c in tk.chunks(batch.column("text"), 500_000):
                doc, element = shingle_sets(c)
                _, fp, _ = fingerprints(doc, element, c.n_docs)
                new = np.zeros(c.n_docs, bool)
                for i, f in enumerate(fp.tolist()):
                    new[i] = f not in seen
                    seen.add(f)
                if len(seen) > 200_000:
                    seen.clear()
                keep = new[doc]
                owner, sig = signatures(doc[keep], element[keep], c.n_docs)
                if len(owner):
                    yield pa.RecordBatch.from_arrays([_signed(sig), _signed(fp[owner])], names=["sig", "fp"])

    return _texts(docs).select("text").mapInArrow(tk.lean(run), "sig long, fp long")


def _groups(key: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal keys."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)


def shared_signatures(signed: DataFrame) -> DataFrame:
    """(sig, a, b): for a signature of two sets the pair, with sig null; for one of more, a row per set, with its least set as b.

    Pairs are distinct within a task, so that sets with hundreds of signatures in common leave one row a task. Rows come ordered by
    signature and set; of one signature at most HELD sets are held, the rest pass on as they come.
    """

    def run(batches):
        held_sig, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        going: tuple[int, int, int] | None = None  # (signature, least set, last set) of one too long to hold
        pairs: list[np.ndarray] = []

        def split(sig, fp):
            bounds = _groups(sig)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            pairs.append(np.stack([fp[two], fp[two + 1]], 1))
            many = np.repeat(size > 2, size)
            lead = np.repeat(fp[bounds[:-1]], size) if len(fp) else fp
            return pa.RecordBatch.from_arrays([pa.array(sig[many]), pa.array(fp[many]), pa.array(lead[many])], names=["sig", "a", "b"])

        def flush():
            got = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(got), pa.int64()), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["sig", "a", "b"])

        for batch in batches:
            sig = np.concatenate([held_sig, batch.column("sig").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
            sig, fp = sig[new], fp[new]
            if going is not None and len(sig):
                same = int(np.searchsorted(sig, going[0], "right"))
                more = fp[:same][fp[:same] > going[2]]
                if len(more):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(more), going[0])), pa.array(more), pa.array(np.full(len(more), going[1]))], names=["sig", "a", "b"])
                    going = (going[0], going[1], int(more[-1]))
                sig, fp = sig[same:], fp[same:]
                if len(sig):
                    going = None
            if not len(sig):
                held_sig, held_fp = sig, fp
                continue
            cut = int(np.searchsorted(sig, sig[-1]))
            if cut:
                yield split(sig[:cut], fp[:cut])
            held_sig, held_fp = sig[cut:], fp[cut:]
            if len(held_fp) > HELD:
                yield split(held_sig, held_fp)
                going = (int(held_sig[0]), int(held_fp[0]), int(held_fp[-1]))
                held_sig, held_fp = held_sig[:0], held_fp[:0]
            if sum(map(len, pairs)) > 2_000_000:
                yield flush()
                pairs.clear()
        if len(held_sig):
            yield split(held_sig, held_fp)
        yield flush()

    return signed.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(tk.lean(run), "sig long, a long, b long")


def may_link(x: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Whether profiles and sizes allow a similarity of 4/5: the difference is at most a ninth of both sizes together."""
    distance = np.abs(x - y).sum(-1, dtype=np.int64)
    return (9 * distance <= x_size + y_size) & (5 * np.minimum(x_size, y_size) >= 4 * np.maximum(x_size, y_size))


def _profile_matrix(cells: list[bytes], width: int) -> np.ndarray:
    """Profiles brought to the same number of cells."""
    return np.stack([np.frombuffer(x, np.uint8).reshape(width, -1).sum(1, dtype=np.int32) for x in cells]) if cells else np.empty((0, width), np.int32)


def close_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that profiles allow."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
            width = np.array([min(len(u), len(v)) for u, v in zip(x, y, strict=True)], np.int64)
            ok = np.zeros(len(x), bool)
            for w in np.unique(width).tolist():
                for at in np.array_split(np.flatnonzero(width == w), 1 + len(x) * w // 4_000_000):
                    ok[at] = may_link(_profile_matrix([x[i] for i in at], w), batch.column("na").to_numpy()[at], _profile_matrix([y[i] for i in at], w), batch.column("nb").to_numpy()[at])
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    a = sets.select(F.col("fp").alias("a"), F.col("size").alias("na"), F.col("profile").alias("pa"))
    b = sets.select(F.col("fp").alias("b"), F.col("size").alias("nb"), F.col("profile").alias("pb"))
    near = (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    return pairs.join(a, "a").join(b, "b").filter(near).select("a", "b", "na", "nb", "pa", "pb").mapInArrow(tk.lean(run), "a long, b long")


def group_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(sig, a, b) from rows (sig, fp, lead, n, label, size, profile) of shared signatures; n: sets of the signature.

    All pairs across labels that profiles allow, if they are few for the number of sets or it is the last turn; else those with the
    group's centre of this turn, and a row with a and b null that says that the signature needs another look. The sets of a signature
    with more than WIDE are dealt anew in each turn to bins of about WIDE / 2, each a group of its own, so that no task holds them
    all; such a signature always needs another look (after the last turn, the one by rare elements).
    Signatures with the same least set meet in a few tasks, so that a pair with many signatures in common leaves a row in each of these only.
    """

    last = turn == ROUNDS - 1

    def run(batches):
        names, kinds = ["sig", "a", "b"], [pa.int64()] * 3
        columns = ("sig", "bin", "fp", "label", "size", "profile")
        held = None

        def group(one_of_many, fp, label, size, held_profiles):
            m = len(fp)
            cells = _profile_matrix(list(held_profiles), min(map(len, held_profiles)))
            at = [], []
            step = max(1, 1_000_000 // (m * cells.shape[1]))  # blocks, so that the working set stays small
            for i in range(0, m, step):
                block = slice(i, min(m, i + step))
                ok = may_link(cells[block, None], size[block, None], cells[None, i:], size[None, i:])
                ok &= np.arange(i, m)[None] > np.arange(block.start, block.stop)[:, None]
                ok &= label[block, None] != label[None, i:]
                x, y = np.nonzero(ok)
                at[0].append(x + i)
                at[1].append(y + i)
                if (not last or one_of_many) and sum(map(len, at[0])) > max(4, DENSE * m):
                    break
            else:
                x, y = np.concatenate(at[0]), np.concatenate(at[1])
                return fp[x], fp[y], one_of_many
            # the least set first: signatures of one group then mostly have the same centre
            c = int(tk.mix(fp.view(np.uint64) + U64(turn)).argmin()) if turn else 0
            other = np.flatnonzero(may_link(cells[c], size[c], cells, size) & (label != label[c]))
            return fp[np.minimum(other, c)], fp[np.maximum(other, c)], True

        pairs: list[np.ndarray] = []
        again: list[int] = []

        def take(arrays, final):
            sig, bin_ = arrays[:2]
            bounds = np.union1d(_groups(sig), _groups(bin_))
            cut = len(sig) if final or not len(sig) else int(bounds[-2])
            bounds = bounds[bounds <= cut]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                x, y, open_ = group(bin_[i] >= 0, *(v[i:j] for v in arrays[2:]))
                pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                if open_:
                    again.append(int(sig[i]))
            if sum(map(len, pairs)) > 400_000:
                pairs[:] = [np.unique(np.concatenate(pairs), axis=0)]
            return [v[cut:] for v in arrays]

        def flush():
            pair = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
            nulls = pa.nulls(len(again), kinds[0])
            out = [pa.chunked_array([pa.nulls(len(pair), kinds[0]), pa.array(again, kinds[0])]), *(pa.chunked_array([pa.array(pair[:, i]), nulls]) for i in (0, 1))]
            pairs.clear()
            again.clear()
            return pa.Table.from_arrays(out, names=names).combine_chunks().to_batches()

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in columns[:-1]] + [np.array([*batch.column("profile").to_pylist(), None], object)[:-1]]
            held = take(now if held is None else [np.concatenate(v) for v in zip(held, now, strict=True)], False)
            if sum(map(len, pairs)) > 2_000_000:
                yield from flush()
        if held is not None:
            take(held, True)
        yield from flush()

    bins = F.ceil(F.col("n") * 2 / WIDE)
    binned = rows.withColumn("bin", F.when(F.col("n") > WIDE, F.pmod(F.xxhash64("fp", F.lit(turn)), bins)).otherwise(F.lit(-1).cast("long")))
    near = F.pmod(F.xxhash64("lead", "bin", F.col("sig").bitwiseAND(F.lit(3 if turn else 7))), F.lit(1 << 20))
    placed = binned.withColumn("near", near).repartition("near").sortWithinPartitions("sig", "bin", "fp")
    return placed.select("sig", "bin", "fp", "label", "size", "profile").mapInArrow(tk.lean(run), "sig long, a long, b long")


def _elements(column: pa.Array) -> list[np.ndarray]:
    """Each row's elements, as views of the column's buffer."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [data[i:j].view(">u8") for i, j in zip(at[:-1], at[1:], strict=True)]


def linked(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of ``percent`` / 100 or more."""

    def run(batches):
        for batch in batches:
            left, right = _elements(batch.column("left")), _elements(batch.column("right"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = sorted((left[i], right[i]), key=len)
                if 100 * len(x) < percent * len(y):
                    continue
                x, y = x.astype(np.uint64), y.astype(np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("fp").alias("b"), F.col("elements").alias("right")), "b").join(sets.select(F.col("fp").alias("a"), F.col("elements").alias("left")), "a")
    return joined.select("a", "b", "left", "right").mapInArrow(tk.lean(run), "a long, b long")


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, size, elements in order) of the wanted sets, computed again from the text of one document of each.

    Elements travel as the 64 bits of their hash, which also made the sets.
    """
    rows = classes.join(wanted.distinct(), "fp", "left_semi").groupBy("fp", "doc_id", "key").agg(F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "copies"))
    chosen = materialize(rows.groupBy("fp").agg(least.alias("row")).select("fp", F.col("row.doc_id").alias("asked_id"), F.col("row.key").alias("asked_key"), (F.col("row.copies") > 1).alias("repeated")))
    some = not chosen.filter("repeated").isEmpty()
    if chosen.count() <= 1_000_000:  # four values a row; a larger table is a shuffled join
        chosen = F.broadcast(chosen)

    def run(batches):
        for batch in batches:
            first = 0
            asked = batch.column("fp").to_numpy()
            for c in tk.chunks(batch.column("text"), 500_000):
                doc, element = shingle_sets(c)
                size, fp, _ = fingerprints(doc, element, c.n_docs)
                ok = fp.view(np.int64) == asked[first : first + c.n_docs]  # keys may clash
                offset = np.concatenate(([0], np.cumsum(size))) * PACKED
                column = pa.Array.from_buffers(pa.binary(), c.n_docs, [None, pa.py_buffer(offset.astype(np.int32).tobytes()), pa.py_buffer(element.astype(">u8").tobytes())])
                yield pa.RecordBatch.from_arrays([_signed(fp), pa.array(size, pa.int64()), column], names=["fp", "size", "elements"]).filter(pa.array(ok))
                first += c.n_docs

    same = F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("key") == F.col("asked_key"))
    found = _texts(docs).join(chosen, same).select("fp", "repeated", "text")
    if some:  # of a row that is repeated, one stays: each set is given once
        found = found.filter("not repeated").unionByName(found.filter("repeated").dropDuplicates(["fp"]))
    return found.select("fp", "text").mapInArrow(tk.lean(run), "fp long, size long, elements binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each can reach. Least labels of neighbours, then of labels, until nothing changes: labels
    only fall, so it ends."""
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("heard")), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nearer = materialize(nearer.join(jump, "label", "left").select("node", "was", F.coalesce(F.least("label", "further"), F.col("label")).alias("label")))
        if nearer.filter(F.col("was") != F.col("label")).isEmpty():
            return nearer.select("node", "label")
        labels = nearer.select("node", "label")


def _rare_pairs(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of sets in different components that share one of their rarest elements.

    Similar sets share one of their first size - ceil(4/5 size) + 1 elements in any one order; in order of rarity, passages that
    many of these sets hold come last, so they alone make no pair.
    """
    each = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.substring(F.col("elements"), (i * PACKED + 1).cast("int"), F.lit(PACKED)))
    rows = sets.join(open_.select("fp", "label").distinct(), "fp").select("fp", "label", "size", F.explode(each).alias("element"))
    frequency = rows.groupBy("element").agg(F.count("*").alias("df")).filter("df > 1")
    held = rows.join(frequency, "element", "left").groupBy("fp", "label", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1).cast("long")).alias("df"), "element"))).alias("all"))
    prefix = held.select("fp", "label", "size", F.explode(F.slice("all", 1, (F.col("size") - F.ceil(F.col("size") * 4 / 5) + 1).cast("int"))).alias("e")).filter("e.df > 1").select("fp", "label", "size", "e.element")
    other = prefix.select(F.col("fp").alias("fp2"), F.col("label").alias("label2"), F.col("size").alias("size2"), "element")
    return prefix.join(other, "element").filter((F.col("fp") < F.col("fp2")) & (F.col("label") != F.col("label2")) & (5 * F.least("size", "size2") >= 4 * F.greatest("size", "size2"))).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links of similarity 0.8 or more reach."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles, label (of the component; null without words) and component_id of every row."""
    classes = materialize(set_classes(docs))
    shared = materialize(shared_signatures(signed_sets(docs)))
    sets = classes.filter("n_shingles > 0").groupBy("fp").agg(F.first("n_shingles").alias("size"), F.first("profile").alias("profile"))
    pairs = close_pairs(shared.filter("sig is null").select("a", "b").distinct(), sets)
    several = shared.filter("sig is not null").select("sig", F.col("a").alias("fp"), F.col("b").alias("lead"))
    wide = materialize(several.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") > WIDE))
    if wide.count() <= 1_000_000:  # two numbers a row; a larger table is a shuffled join
        wide = F.broadcast(wide)
    many = materialize(several.join(sets, "fp").join(wide, "sig", "left").withColumn("label", F.col("fp")).withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
    found = materialize(group_pairs(many, 0))
    pairs = materialize(pairs.unionByName(found.filter("a is not null").select("a", "b")).distinct())
    edges = verified(docs, classes, pairs)
    again = found.filter("a is null").select("sig").distinct()
    for turn in range(1, ROUNDS):
        if again.isEmpty():
            break
        labels = components(edges).withColumnRenamed("node", "fp")
        open_ = many.join(again, "sig", "left_semi").drop("label", "n").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        mixed = open_.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low != high")
        # signatures whose sets share their least component meet, as those of one large group mostly do
        many = materialize(open_.drop("lead").join(mixed.select("sig", "n", F.col("low").alias("lead")), "sig"))
        found = materialize(group_pairs(many, turn))
        more = found.filter("a is not null").select("a", "b")
        if turn == ROUNDS - 1:
            wide = many.filter(F.col("n") > WIDE).select("fp", "label").distinct()
            if not wide.isEmpty():
                more = more.unionByName(close_pairs(_rare_pairs(wide, class_sets(docs, classes, wide.select("fp"))), sets))
        more = materialize(more.distinct().join(pairs, ["a", "b"], "left_anti"))
        edges = materialize(edges.unionByName(verified(docs, classes, more)))
        pairs = pairs.unionByName(more)
        again = found.filter("a is null").select("sig").distinct()
    if edges.isEmpty():
        roots = classes.filter("n_shingles > 0").groupBy("fp", "fp2").agg(F.min("doc_id").alias("component_id")).withColumn("label", F.col("fp"))
    else:
        labels = components(edges)
        ids = classes.filter("n_shingles > 0").groupBy("fp", "fp2").agg(F.min("doc_id").alias("least")).join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        least = ids.groupBy("label").agg(F.min("least").alias("component_id"))
        roots = ids.join(least, "label").select("fp", "fp2", "component_id", "label")
    roots = materialize(roots)
    columns = ["doc_id", "key", "n_shingles", "label", "component_id"]
    placed = classes.filter("n_shingles > 0").select("doc_id", "key", "n_shingles", "fp", "fp2").join(roots, ["fp", "fp2"]).select(columns)
    wordless = classes.filter("n_shingles = 0").select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(wordless)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
    return materialize(linked(pairs, materialize(class_sets(docs, classes, wanted))))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component one row stays, that of the least doc_id (nulls
    last), then the least key of its text; rows without words all stay.

    A row is told by its doc_id and a hash of its text, so that rows with a null or shared doc_id are judged each; of rows that are
    equal in both, one stays for its component.
    """
    rows = materialize(grouped(docs).filter("label is not null").groupBy("label", "doc_id", "key").agg(F.count("*").alias("copies")))
    least = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    judged = rows.join(least, "label").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")))
    told = judged.filter("not stays or copies > 1").select(F.col("doc_id").alias("told_id"), F.col("key").alias("told_key"), "stays")
    told = materialize(told)
    names = docs.columns
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64(F.col("text").cast("string"))})

    def sided(table: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(table) if table.count() <= 500_000 else table  # three values a row; a larger table is a shuffled join
        return keyed.join(side, F.col("__id").eqNullSafe(F.col("told_id")) & (F.col("__key") == F.col("told_key")), how)

    plain = sided(told, "left_anti").select(names)
    repeated = told.filter("stays")
    if repeated.isEmpty():
        return plain
    return plain.unionByName(sided(repeated, "left_semi").dropDuplicates(["__id", "__key"]).select(names))
