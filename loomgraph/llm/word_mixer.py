"""Online logistic mixing of hashed-context bit predictors, over the decisions that code the tokens of a text.

A token is a path in a binary code tree of the frequent words, an end and an escape. Each decision of a path is predicted by several
contexts, all hashed with the tree node: the training counts below the node; what this document has decided at the node so far; the
same after the same previous word; and after the same two previous words. The predictions are mixed in the logistic domain by weights
that a gate selects (which contexts have been seen, and how deep the node lies), and refined by a map of mixed predictions to
outcomes. Every document starts from the same weights and an even map, and moves both by what the bits of its last turn were: a turn
is a token at first, then 4 and from some hundreds on 16 (TURNS). The score of a text depends on nothing but the model and the text.

All documents of a chunk advance together, turn by turn: contexts and their counts are known beforehand, since they depend on the
text alone, so that only weights and maps are carried from step to step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

INPUTS = 4
ORDERS = 3  # highest context met: the node, after the previous word, after the two previous words
DEPTHS = 3
WORD = 31  # decisions of a path in one number
GATES = ORDERS * DEPTHS
BUCKETS = 24
WEIGHTS = np.array([1.0, 0.6, 0.5, 0.5])
PRIOR = (2.0, 0.6, 0.3)  # decisions that a document's own counts are worth less than
RATE, LEAST_RATE, SETTLING = 0.03, 0.004, 30.0
MAP_RATE = 0.03
#: (first token, tokens a turn): the further a document has come, the less a token moves
TURNS = ((0, 1), (64, 4), (512, 16))
START_KEY = np.uint64(0x5A5A5A5A5A5A5A5A)


def huffman_parents(weights: np.ndarray, first: int) -> tuple[list[int], list[int], int]:
    """Parents of ``len(weights)`` leaves and of the inner nodes made, numbered from ``first``; the last one is the root.

    Two queues: leaves by weight, and inner nodes as they are made, which is by weight too.
    """
    order = np.argsort(weights, kind="stable").tolist()
    value = weights.tolist()
    made: list[float] = []
    leaf_parent, inner_parent = [0] * len(value), []
    i = j = 0

    def least() -> tuple[float, bool, int]:
        nonlocal i, j
        if i < len(order) and (j >= len(made) or value[order[i]] <= made[j]):
            i += 1
            return value[order[i - 1]], True, order[i - 1]
        j += 1
        return made[j - 1], False, j - 1

    for k in range(len(value) - 1):
        total = 0.0
        for _ in range(2):
            w, is_leaf, x = least()
            total += w
            if is_leaf:
                leaf_parent[x] = first + k
            else:
                inner_parent[x] = first + k
        made.append(total)
        inner_parent.append(-1)
    return leaf_parent, inner_parent, first + len(made) - 1


@dataclass
class Downward:
    """``bits[k]``: decisions from k * WORD on of each leaf's path, lowest first; ``whole``: natural logarithm of its training probability;
    ``child``: inner nodes on both sides of each inner node, -1 for leaves."""

    bits: np.ndarray
    whole: np.ndarray
    child: np.ndarray


@dataclass
class Tree:
    """``parent[x]`` and ``side[x]`` of each leaf and inner node (the root's parent is -1), depth of leaves, and of each inner node the
    training weight on both sides. Leaves are the words in order, then the end, then the escape."""

    parent: np.ndarray
    side: np.ndarray
    depth: np.ndarray
    below: np.ndarray  # (inner nodes, 2)
    leaves: int

    def __post_init__(self):
        self.ones = ((self.below[:, 1] + 0.4) / (self.below.sum(1) + 0.8)).astype(np.float32)  # probability of the second side
        self.stretched = np.log(self.ones / (1 - self.ones)).astype(np.float32)
        self.straight = np.log(np.stack([1 - self.ones, self.ones]))  # of either side

    @cached_property
    def downward(self) -> Downward:
        """The tree from the root down: made where texts are scored, and once there."""
        levels = _by_level(self.parent)
        bits = np.zeros((-(-len(levels) // WORD), len(self.parent)), np.int32)
        whole = np.zeros(len(self.parent))
        child = np.full((len(self.below), 2), -1, np.int32)
        for i, node in enumerate(levels):
            up, side = self.parent.take(node), self.side.take(node)
            for word in bits[: i // WORD + 1]:
                word[node] = word.take(up)
            bits[i // WORD, node] |= side.astype(np.int32) << np.int32(i % WORD)
            up -= self.leaves
            whole[node] = whole.take(up + self.leaves) + self.straight[side, up]
            child[up, side] = np.maximum(node - self.leaves, -1)
        return Downward(bits[:, : self.leaves].copy(), whole[: self.leaves].copy(), child)

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first decision of each leaf, node, bit): decisions from the root down, leaf after leaf."""
        size = self.depth[leaf]
        start = np.cumsum(size) - size
        node, bit = np.empty(int(size.sum()), np.int32), np.empty(int(size.sum()), np.uint8)
        at, place = leaf.astype(np.int64), start + size - 1
        open_ = np.flatnonzero(size)
        while len(open_):
            x = at[open_]
            node[place[open_]] = self.parent[x] - self.leaves
            bit[place[open_]] = self.side[x]
            at[open_] = self.parent[x]
            place[open_] -= 1
            open_ = open_[place[open_] >= start[open_]]
        return start, node, bit


def code_tree(counts: np.ndarray, classes: np.ndarray, end: float, escape: float) -> Tree:
    """A Huffman tree of the words of each class, and one above them of classes, end and escape."""
    n = len(counts)
    leaves = n + 2
    parent: dict[int, np.ndarray] = {}
    leaf_parent = np.full(leaves, -1, np.int64)
    inner: list[int] = []
    tops, weights = [n, n + 1], [max(end, 0.5), max(escape, 0.5)]
    for k in np.unique(classes).tolist() if n else []:
        words = np.flatnonzero(classes == k)
        up, above, root = huffman_parents(counts[words].astype(float), leaves + len(inner))
        leaf_parent[words] = up if len(words) > 1 else -1
        inner += above
        tops.append(root if len(words) > 1 else int(words[0]))
        weights.append(float(counts[words].sum()))
    up, above, _ = huffman_parents(np.array(weights), leaves + len(inner))
    every = np.concatenate([leaf_parent, np.array(inner, np.int64), np.array(above, np.int64)])
    every[tops] = up
    # a node's children lie before it
    weight = np.zeros(len(every))
    weight[:n], weight[n : n + 2] = counts, weights[:2]
    side = np.zeros(len(every), np.uint8)
    below = np.zeros((len(every) - leaves, 2))
    order = _by_level(every)
    seen = np.zeros(len(every), np.int64)
    for level in reversed(order):  # the deepest first
        p = every[level]
        first = np.argsort(p, kind="stable")
        level, p = level[first], p[first]
        second = np.zeros(len(level), bool)
        second[1:] = p[1:] == p[:-1]
        # children of one parent may lie at one level only, so both are here
        side[level] = second
        below[p - leaves, second.astype(np.int64)] = weight[level]
        np.add.at(weight, p, weight[level])
        seen[p] += 1
    depth = np.zeros(len(every), np.int64)
    for i, level in enumerate(order):
        depth[level] = i + 1
    return Tree(every.astype(np.int32), side, depth[:leaves].astype(np.int32), below.astype(np.float32), leaves)


def _by_level(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes of each level, from the children of the root down."""
    order = np.argsort(parent, kind="stable")
    bound = np.searchsorted(parent[order], np.arange(-1, len(parent) + 1))
    level, out = np.flatnonzero(parent == -1), []
    while True:
        size = bound[level + 2] - bound[level + 1]
        if not size.sum():
            return out
        start = np.repeat(bound[level + 1] - (np.cumsum(size) - size), size)
        level = order[start + np.arange(int(size.sum()))]
        out.append(level)


def _sorted(key: np.ndarray, index_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a stable order of non-negative keys, the keys in it): sorted together with their places where both fit into 63 bits."""
    if not len(key):
        return np.empty(0, np.int64), key
    if int(key.max()).bit_length() + index_bits <= 63:
        packed = key << np.int64(index_bits)
        packed |= np.arange(len(key))
        packed.sort()
        return packed & np.int64((1 << index_bits) - 1), packed >> np.int64(index_bits)
    order = np.argsort(key, kind="stable")
    return order, key[order]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, which one each key is, how often each occurs)."""
    order = np.argsort(key)
    ranked = key.take(order)
    new = np.ones(len(key), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    first = np.flatnonzero(new)
    which = np.empty(len(key), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return ranked.take(first), order.take(first), which, np.diff(np.append(first, len(key)))


def seen_before(key: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, zeros, ones) of the decisions whose key has occurred earlier, and what it was followed by."""
    index_bits = max(1, len(key).bit_length())
    if len(key) and int(key.max()).bit_length() + index_bits <= 62:  # the bit fits in too
        order = key << np.int64(index_bits + 1)
        order |= np.arange(0, 2 * len(key), 2)
        order |= bit
        order.sort()
        ranked, ones = order >> np.int64(index_bits + 1), (order & 1).astype(np.int32)
    else:
        order, ranked = _sorted(key, index_bits)
        ones = bit[order].astype(np.int32)
        order <<= 1
    again = np.zeros(len(key), bool)
    np.equal(ranked[1:], ranked[:-1], out=again[1:])
    first, at = np.flatnonzero(~again), np.flatnonzero(again)
    later = np.diff(np.append(first, len(key))) - 1  # decisions of each key after its first
    total = np.cumsum(ones, dtype=np.int32)
    total -= ones
    one = total.take(at) - np.repeat(total.take(first), later)
    return (order.take(at) >> 1) & np.int64((1 << index_bits) - 1), (at - np.repeat(first, later)).astype(np.int32) - one, one


def _inner_ids(*columns: np.ndarray) -> np.ndarray:
    """Small ids of distinct rows; -1 where a row occurs once."""
    key = columns[0]
    for c in columns[1:]:
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    _, _, which, n = distinct(key)
    return np.where(n > 1, np.arange(len(n)), -1).take(which)


def turn_of(place: np.ndarray) -> np.ndarray:
    """The turn of each token by its place in the document."""
    out, base = np.asarray(place).copy(), 0
    for (first, size), following in zip(TURNS, (*TURNS[1:], None), strict=True):
        late = place >= first
        out[late] = base + (place[late] - first) // size
        if following is not None:
            base += (following[0] - first) // size
    return out


def first_token(turn: int) -> int:
    """The first token of a turn."""
    for (first, size), following in zip(TURNS, (*TURNS[1:], None), strict=True):
        if following is None or turn < (following[0] - first) // size:
            return first + turn * size
        turn -= (following[0] - first) // size
    raise AssertionError


class Descent:
    """Tokens that go down the tree together, by what they have in common: ``token`` in groups, in order within a group; ``start``,
    ``size`` and ``node`` of the groups. All of a group are at one node, and a level splits each group in two, as a stable partition, for which the
    earlier decisions of a group are counted anyway. A token that is alone has nothing before it any more, and is left out."""

    def __init__(self, group: np.ndarray, child: np.ndarray):
        """``group`` of each token, -1: none; ``child`` of :class:`Downward`."""
        token = np.flatnonzero(group >= 0)
        order, ranked = _sorted(group.take(token), max(1, len(token).bit_length()))
        self.token = token.take(order).astype(np.int32)
        first = np.ones(len(ranked), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
        self.start = np.flatnonzero(first).astype(np.int32)
        self.size = np.diff(self.start, append=np.int32(len(ranked)))
        self.child, self.node = child, np.full(len(self.size), len(child) - 1, np.int32)  # the root is the last
        self._keep(np.repeat(self.size > 1, self.size), self.size > 1)

    def _keep(self, tokens: np.ndarray, groups: np.ndarray) -> None:
        self.token = self.token.take(np.flatnonzero(tokens))
        self.size, self.node = self.size.compress(groups), self.node.compress(groups)
        self.start = np.cumsum(self.size, dtype=np.int32)
        self.start -= self.size

    def step(self, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(token, bit, zeros, ones, group) of the decisions at this level that have others of their group before them, and of each group
        a token and the zeros and ones among these decisions; then goes on. ``bits``: what each token decides from here on, lowest first."""
        token, size, n = self.token, self.size, len(self.token)
        bit = bits.take(token)
        bit &= np.int32(1)
        group = np.repeat(np.arange(len(size), dtype=np.int32), size)
        ones = np.cumsum(bit, dtype=np.int32)
        ones -= bit
        begin = ones.take(self.start)
        total = np.append(begin[1:], ones[-1] + bit[-1]) - begin  # ones of each group
        index = np.arange(n, dtype=np.int32)
        ones -= begin.take(group)
        second = self.start + size - total
        # zeros of a group come first, then its ones
        zeros = index - ones
        to = second.take(group)
        to += ones
        to -= zeros
        to *= bit
        to += zeros
        zeros -= self.start.take(group)
        later = np.ones(n, bool)
        later[self.start] = False
        later = np.flatnonzero(later)
        begin = bit.take(self.start)
        heads = token.take(self.start), size - total - (1 - begin), total - begin
        found = *(x.take(later) for x in (token, bit, zeros, ones, group)), heads
        moved = np.empty_like(token)
        moved[to] = token
        self.token = moved
        halves = np.stack([size - total, total], 1).ravel()
        self.size, self.node = halves, self.child.take(self.node, axis=0).ravel()
        stay = (halves > 1) & (self.node >= 0)  # a half whose node is a leaf ends here
        self._keep(np.repeat(stay, halves), stay)
        return found


def _against(zeros: np.ndarray, ones: np.ndarray, prior: float, expected: np.ndarray, base: np.ndarray) -> np.ndarray:
    """What counts with a prior of the training's probability say beyond it, stretched."""
    s = np.float32(prior)
    weight = expected * s
    one = ones.astype(np.float32)
    zero = zeros.astype(np.float32)
    one += weight
    zero += s
    zero -= weight
    one /= zero
    np.log(one, out=one)
    one -= base
    return one


def document_logs(tree: Tree, leaf: np.ndarray, doc: np.ndarray, key: np.ndarray, n_docs: int) -> np.ndarray:
    """Natural logarithm of the probability of each document's tokens (leaf, doc in order, key: hash of the word)."""
    if not len(leaf):
        return np.zeros(n_docs)
    first = np.searchsorted(doc, np.arange(n_docs))
    place = np.arange(len(doc)) - first[doc]
    before = np.concatenate(([START_KEY], key[:-1]))
    before[place == 0] = START_KEY
    earlier = np.concatenate(([START_KEY, START_KEY], key[:-2]))[: len(key)]
    earlier[place <= 1] = START_KEY
    down = tree.downward
    # a node that the document has not met has only the training counts below it: a token's path is taken whole, and what was met is
    # taken out again
    out = np.bincount(doc, weights=down.whole.take(leaf), minlength=n_docs)
    # tokens by steps: all documents' tokens of one turn, the long documents first; a document's own stay in order
    salt = doc.astype(np.uint64)
    groups = [doc, _inner_ids(salt, before), _inner_ids(salt, before, earlier)]
    rank = np.empty(n_docs, np.int64)
    rank[np.argsort(-np.bincount(doc, minlength=n_docs), kind="stable")] = np.arange(n_docs)
    order, unit = _sorted(turn_of(place) * n_docs + rank[doc], max(1, len(doc).bit_length()))
    leaf, doc = leaf.take(order), doc.take(order)
    depth = tree.depth.take(leaf)
    offset = np.cumsum(depth, dtype=np.int64)
    decisions = int(offset[-1])
    offset -= depth
    index_bits = max(1, decisions.bit_length())
    offset += (unit * GATES) << np.int64(index_bits)  # a token's first decision, below its step's number
    # decisions level by level: a document's own at the node, by rising context
    x, bit, steps = np.zeros((decisions, INPUTS), np.float32), np.empty(decisions, np.float32), np.empty(decisions, np.int64)
    slot = np.empty(len(depth), np.int32)
    descents = [Descent(g.take(order), down.child) for g in groups]
    n, level = 0, 0
    while len(descents[0].token):
        if not level % WORD:
            bits = down.bits[level // WORD].take(leaf)
        node = descents[0].node
        token, way, zeros, ones, group, (one_of, all_zeros, all_ones) = descents[0].step(bits)
        rows = slice(n, n + len(token))
        base, likely = tree.stretched.take(node).take(group), tree.ones.take(node).take(group)
        x[rows, 0] = base
        x[rows, 1] = _against(zeros, ones, PRIOR[0], likely, base)
        bit[rows] = way
        sides = tree.straight.take(node, axis=1).astype(float)
        out -= np.bincount(doc.take(one_of), weights=all_zeros * sides[0] + all_ones * sides[1], minlength=n_docs)
        slot[token] = np.arange(len(token), dtype=np.int32)
        step = offset.take(token)
        step += level + (np.int64(min(level // 4, DEPTHS - 1)) << np.int64(index_bits))
        for k, descent in enumerate(descents[1:], 1):
            if len(descent.token):
                token, _, zeros, ones, *_ = descent.step(bits)
                to = slot.take(token)  # what has been decided after a context has been decided at the node
                x[rows.start + to, 1 + k] = _against(zeros, ones, PRIOR[k], likely.take(to), base.take(to))
                step[to] += np.int64(DEPTHS << index_bits)  # after the two previous words it is after the one as well
        steps[rows] = step
        bits >>= np.int32(1)
        n, level = rows.stop, level + 1
    steps = steps[:n]
    where = np.empty(decisions, np.int32)
    inside = np.int64((1 << index_bits) - 1)
    where[steps & inside] = np.arange(n, dtype=np.int32)
    steps.sort()
    rows = where.take(steps & inside)
    steps >>= np.int64(index_bits)
    run, p = _advance(x, bit, rows, steps, n_docs)
    return out + np.bincount(run // GATES, weights=p, minlength=n_docs)[rank]


def _advance(x: np.ndarray, bit: np.ndarray, rows: np.ndarray, step: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document and gate in one number, natural logarithm of the probability) of each run of decisions of one step; ``rows`` are the
    places of decisions in ``x`` and ``bit`` by ``step``, which rises, and is a decision's turn, document and gate in one number."""
    if not len(step):
        return np.empty(0, np.int64), np.empty(0)
    weights = np.tile(WEIGHTS.astype(np.float32), (n_docs * GATES, 1))
    centers = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
    refined = np.tile(centers.astype(np.float32), n_docs * GATES)
    p = np.empty(len(rows), np.float32)
    cells = n_docs * GATES  # of one turn
    new = np.ones(len(step), bool)
    np.not_equal(step[1:], step[:-1], out=new[1:])
    runs = np.flatnonzero(new)
    run_step = step.take(runs)
    run_cells = run_step % cells
    length = np.diff(runs, append=len(step))
    run_bounds = np.searchsorted(run_step, np.arange(int(step[-1]) // cells + 2) * cells)
    bounds = np.append(runs, len(step)).take(run_bounds).tolist()
    run_bounds = run_bounds.tolist()
    scale, half, one, low, high = np.float32((BUCKETS - 1) / 16), np.float32(0.5), np.float32(1), np.float32(-7.99), np.float32(7.99)
    shift = np.float32(8) * scale + half
    base = np.repeat((run_cells * BUCKETS).astype(np.int32), length)
    for t in range(len(bounds) - 1):
        i, j, u, v = bounds[t], bounds[t + 1], run_bounds[t], run_bounds[t + 1]
        if i == j:
            continue
        xs, b, cell = x.take(rows[i:j], axis=0), bit.take(rows[i:j]), run_cells[u:v]
        now = weights.take(cell, axis=0)
        mixed = np.einsum("ij,ij->i", now.repeat(length[u:v], axis=0), xs)
        np.maximum(mixed, low, out=mixed)
        np.minimum(mixed, high, out=mixed)
        plain = np.negative(mixed)
        np.exp(plain, out=plain)
        plain += one
        np.divide(one, plain, out=plain)
        mixed *= scale
        mixed += shift
        near = mixed.astype(np.int32)
        near += base[i:j]
        mapped = refined.take(near)
        chance = p[i:j]  # of what was decided
        np.add(plain, mapped, out=chance)
        chance *= half
        chance -= one
        chance += b
        np.abs(chance, out=chance)
        np.subtract(b, plain, out=plain)
        plain *= np.float32(max(LEAST_RATE, RATE / (1 + first_token(t) / SETTLING)))
        slope = plain.repeat(INPUTS).reshape(-1, INPUTS)
        slope *= xs
        now += np.add.reduceat(slope, runs[u:v] - i, axis=0)
        weights[cell] = now
        refined[near] = mapped + np.float32(MAP_RATE) * (b - mapped)
    np.maximum(p, np.float32(1e-5), out=p)
    np.log(p, out=p)
    return run_cells, np.add.reduceat(p, runs, dtype=np.float64)
