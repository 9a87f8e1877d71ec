"""Operators of loomgraph.llm against brute force, SQL, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat, context_mixing, host_rules, mixing, partenum, queries, sharding, token_scan, toxicity, vptree, word_mixer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, host string"


def words(text):
    return (text or "").encode().split()


def tricky(spark):
    """Nulls, empty and white texts, ties, repeated rows, one long text, clashing extra columns."""
    rnd = random.Random(4)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) + str(rnd.randrange(50)) for _ in range(20_000))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one two", "en", "b"), (5, "one two", "en", "b"), (5, "one two", "en", "b"), (6, base, "en", "a"), (7, base + " tail", "en", "a"), (8, base.upper(), "en", "c"), (9, long, "en", "a"), (10, "x y \x1c z <|endoftext|> #$%", "en", "b"), (None, "no id", "en", "a"), (11, "a\nb\na\n\nb\n" * 5, "en", "c")]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 7, "h") for i, t, l, s in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v))
    return sorted(map(tuple, df.astype(object).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert canon(queries.queries()[name](spark, SF).toPandas()) == canon(con.execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["op3_extendible_sharding", "op4_fair_queue_mixing", "op7_separator_scan", "op8_host_rules"])
def test_sql_on_tricky_rows(spark, tmp_path, name):
    tricky(spark).filter("doc_id is not null").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert canon(queries.queries()[name](spark, str(tmp_path)).toPandas()) == canon(con.execute(queries.oracle_sql()[name]).df())


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()
    assert (scored.predicted == scored.toxic).mean() > 0.93
    caught = scored[scored.toxic == 1].predicted.mean()
    assert caught > 0.6 and scored[scored.predicted == 1].toxic.mean() > 0.85  # recall and precision
    assert set(scored.doc_id) == {i for i in scored.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(6, 0), (9, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.classify(tricky(spark), labels).count() == 13
    assert toxicity.classify(tricky(spark), labels.limit(0)).filter("score <> 0").count() == 0
    assert toxicity.classify(empty(spark), labels).count() == 0


def unigram(rows):
    counts, total = collections.Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            w = [x.lower() for x in words(t)] + ["end"]
            counts.update(w)
            total += len(w)
    return counts, total


@pytest.mark.parametrize("bits", [22, 6])
def test_context_mixing_base(spark, bits):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(tricky(spark).filter("doc_id is not null").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = [(r[0], r[1]) for r in docs.collect()]
    counts, total = unigram(rows)
    got = collections.defaultdict(list)
    for r in context_mixing.score(docs, share_bits=bits).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        w = [x.lower() for x in words(t)] + ["end"]
        r = got[i][0]
        base = sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert context_mixing.score(empty(spark)).count() == 0


def test_every_rare_count_enters_the_score():
    """Of words outside the tree each count moves the probability; all words and what is left to spelling add up to one."""
    scale = context_mixing.Scale(1000, 100, 10, 40.0, 40.0 - (20 - 0.5 * 8))
    n = np.array([1, 2, 3, 1, 4, 5, 3, 1])  # the words outside the tree: 20 tokens
    logs = context_mixing.escape_logs(np.full(8, -1e3), n, np.arange(8), np.ones(8), np.zeros(8), scale)
    assert np.exp(logs).sum() + scale.novel / scale.escaped == pytest.approx(1)
    assert len(set(logs.round(9))) == len(set(n.tolist()))


def brute_logs(tree, documents):
    """The online mixer, one document, token and decision at a time."""
    wm, out = word_mixer, []
    for tokens in documents:
        weights = np.tile(wm.WEIGHTS.astype(float), (wm.GATES, 1))
        refined = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, wm.BUCKETS))), (wm.GATES, 1))
        seen, total, last = collections.defaultdict(lambda: [0, 0]), 0.0, (None, None)
        turns = wm.turn_of(np.arange(len(tokens))).tolist()
        slopes, moves = np.zeros_like(weights), {}
        for t, (leaf, key) in enumerate(tokens):
            if t and turns[t] != turns[t - 1]:
                weights += slopes
                for place, value in moves.items():
                    refined[place] = value
                slopes, moves = np.zeros_like(weights), {}
            _, nodes, bits = tree.paths(np.array([leaf]))
            rate = max(wm.LEAST_RATE, wm.RATE / (1 + wm.first_token(turns[t]) / wm.SETTLING))
            for depth, (node, bit) in enumerate(zip(nodes.tolist(), bits.tolist(), strict=True)):
                zero, one = tree.below[node] + 0.4
                p = one / (zero + one)
                x, order = [math.log(p / (1 - p))], 0
                for k, context in enumerate(((), last[1:], last)):
                    h = seen[node, k, context]
                    x.append(math.log((h[1] + wm.PRIOR[k] * p) / (h[0] + wm.PRIOR[k] * (1 - p))) - x[0] if sum(h) else 0.0)
                    order = k + 1 if sum(h) else order
                if not order:
                    total += math.log(p if bit else 1 - p)
                    continue
                gate = (order - 1) * wm.DEPTHS + min(depth // 4, wm.DEPTHS - 1)
                mixed = min(max(float(weights[gate] @ x), -7.99), 7.99)
                plain = 1 / (1 + math.exp(-mixed))
                at = int((mixed + 8) * (wm.BUCKETS - 1) / 16 + 0.5)
                p = (plain + refined[gate, at]) / 2
                total += math.log(p if bit else 1 - p)
                slopes[gate] += rate * (bit - plain) * np.array(x)
                moves[gate, at] = refined[gate, at] + wm.MAP_RATE * (bit - refined[gate, at])
            for node, bit in zip(nodes.tolist(), bits.tolist(), strict=True):
                for k, context in enumerate(((), last[1:], last)):
                    seen[node, k, context][bit] += 1
            last = (last[1], key)
        out.append(total)
    return out


def test_online_mixer_is_the_brute_force_one():
    rng = np.random.default_rng(5)
    counts = rng.integers(2, 400, 60)
    tree = word_mixer.code_tree(counts, rng.integers(0, 3, 60), 30.0, 12.0)
    documents = [[(int(x), 1000 + int(x)) for x in np.minimum(rng.geometric(0.08, n), 62) - 1] for n in (1, 3, 40, 900, 0, 120)]
    documents.append(documents[3][:50] * 3)
    flat = [(d, *x) for d, tokens in enumerate(documents) for x in tokens]
    doc, leaf, key = (np.array(c) for c in zip(*flat, strict=True))
    got = word_mixer.document_logs(tree, leaf, doc, key.astype(np.uint64), len(documents))
    want = [x if tokens else 0.0 for x, tokens in zip(brute_logs(tree, documents), documents, strict=True)]
    assert got == pytest.approx(want, rel=2e-4)
    assert got[6] > 3 * word_mixer.document_logs(tree, leaf[doc == 3][:50], np.zeros(50, int), key[doc == 3][:50].astype(np.uint64), 1)[0]  # repeats are learned


def test_code_tree_is_a_huffman_code():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 1000, 300)
    tree = word_mixer.code_tree(counts, np.zeros(300, int), 50.0, 70.0)  # one class, beside which the end and the escape lie
    assert (0.5 ** tree.depth.astype(float)).sum() == pytest.approx(1)
    weight = np.append(counts, [50, 70]) / (counts.sum() + 120)
    assert (weight * tree.depth).sum() < -(weight * np.log2(weight)).sum() + 1.1
    start, node, bit = tree.paths(np.arange(302))
    assert len({tuple(zip(node[a : a + d], bit[a : a + d], strict=True)) for a, d in zip(start, tree.depth, strict=True)}) == 302
    assert tree.below.sum(1).max() == pytest.approx(counts.sum() + 120)
    for n in (0, 1, 2):
        small = word_mixer.code_tree(counts[:n], np.zeros(n, int), 1.0, 1.0)
        assert (0.5 ** small.depth.astype(float)).sum() == pytest.approx(1)


def test_held_out_texts_beat_the_base(spark):
    got = context_mixing.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").toPandas()
    assert (got.score > got.base_score).mean() > 0.6 and got.score.sum() > got.base_score.sum()


def test_levels_of_a_tree_count_what_was_seen_before():
    """All decisions met, with their counts, without a sort of all decisions; tokens that are alone in their group are not carried on."""
    rng = np.random.default_rng(7)
    counts = rng.integers(1, 1 << 20, 3000)
    tree = word_mixer.code_tree(counts, rng.integers(0, 3, 3000), 30.0, 12.0)
    doc = np.sort(rng.integers(0, 40, 5000))
    leaf = np.minimum(rng.geometric(0.004, 5000), len(counts) + 2) - 1
    unique, _, which, _ = word_mixer.distinct(leaf)
    start, node, bit = tree.paths(unique)
    depth_of = tree.depth[unique]
    depth, offset = depth_of[which], np.cumsum(depth_of[which]) - depth_of[which]
    assert int(depth.max()) > 8
    at = np.arange(int(depth.sum())) + np.repeat(start[which] - offset, depth)
    want = set(zip(*(x.tolist() for x in word_mixer.seen_before(np.repeat(doc, depth) * len(tree.below) + node[at], bit[at])), strict=True))
    down = tree.downward
    assert down.whole[unique] == pytest.approx([sum(math.log(1 - tree.ones[n] if not b else tree.ones[n]) for n, b in zip(node[i : i + d], bit[i : i + d], strict=True)) for i, d in zip(start, depth_of, strict=True)], rel=1e-4)
    got, carried, descent = set(), 0, word_mixer.Descent(doc, down.child)
    for level in range(int(depth.max())):
        if not level % word_mixer.WORD:
            bits = down.bits[level // word_mixer.WORD].take(leaf)
        carried += len(descent.token)
        if len(descent.token):
            token, way, zeros, ones, _, _ = descent.step(bits)
            got |= set(zip((offset[token] + level).tolist(), zeros.tolist(), ones.tolist(), strict=True))
            assert (way == bit[start[which[token]] + level]).all()
        bits >>= np.int32(1)
    assert got == want and not len(descent.token)
    assert carried < 0.9 * len(at)


def test_paths_of_a_deep_tree():
    """Weights that double make a path longer than one number holds."""
    tree = word_mixer.code_tree(np.array([1 << i for i in range(45)]), np.zeros(45, int), 1.0, 1.0)
    down, (start, _, bit) = tree.downward, tree.paths(np.arange(tree.leaves))
    assert len(down.bits) == 2 and tree.depth.max() > 40
    for leaf, (i, d) in enumerate(zip(start.tolist(), tree.depth.tolist(), strict=True)):
        assert [int(down.bits[k // word_mixer.WORD, leaf]) >> k % word_mixer.WORD & 1 for k in range(d)] == bit[i : i + d].tolist()


def test_rows_between_scoring_and_mixing_are_narrow(spark):
    """A word outside the tree travels as four values, whatever a document's sums are; documents may spread over batches."""
    text = " ".join(f"w{i} w{i} w{i % 7}" for i in range(60))
    docs = spark.createDataFrame([(None if i == 3 else i, text if i % 2 else None) for i in range(9)], "doc_id long, text string").coalesce(1)
    rows = context_mixing._rows(docs, 7, 2)
    counts = context_mixing.materialize(context_mixing.token_counts(rows))
    model, tables = context_mixing.learn(counts, 1)
    found = context_mixing.materialize(context_mixing.scored(rows, model, tables))
    assert found.dtypes == [("at", "bigint"), ("word", "bigint"), ("spelled", "float"), ("more", "binary")]
    assert found.filter("word is null").count() == 9 and found.filter("word is not null").count() > 200
    results, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for records in (before, 3):
        spark.conf.set(name, records)
        results.append(sorted(map(tuple, context_mixing.mixed(found, counts.filter("kind = 0"), model.scale).collect()), key=lambda r: (r[0] is None, r)))
    spark.conf.set(name, before)
    assert len(results[0]) == 9 and results[0][-1][0] is None
    for a, b in zip(*results, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_letters_kept_by_a_task_are_those_worked_out():
    codes = context_mixing.huffman_codes(np.ones((256, 256), np.int64))
    rng = np.random.default_rng(3)
    tables = [np.ascontiguousarray(rng.integers(0, 40, (1 << context_mixing.TABLE_BITS, 2)), np.float32) for _ in context_mixing.ORDERS]
    mixer = context_mixing.Mixer(codes, tables, np.tile(context_mixing._START, (context_mixing.GATES, 1)), np.tile(context_mixing._CENTERS, (context_mixing.GATES, 1)))
    mixer.known = np.full(context_mixing.KNOWN, -1, np.int64), np.zeros(context_mixing.KNOWN)
    for _ in range(3):
        data = rng.integers(97, 105, 400).astype(np.uint8)
        _, gram = context_mixing.grams(data, np.arange(0, 400, 8), np.arange(8, 401, 8))
        assert mixer.known_logs(gram).tolist() == mixer.logs(gram).tolist()
    assert (mixer.known[0] >= 0).sum() > 300


def test_context_mixing_by_any_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = (sorted((r["doc_id"], r["score"]) for r in context_mixing.score(docs.repartition(n, "doc_id")).collect()) for n in (1, 7))
    assert [x[0] for x in one] == [x[0] for x in many]
    assert [x[1] for x in one] == pytest.approx([x[1] for x in many], rel=1e-9)


def test_context_tables_weigh_occurrences(spark):
    """Tables of one text are those of its words repeated: the order-1 slots of "aab" three times and "b" once."""
    docs = spark.createDataFrame([(1, "aab b AAB"), (3, "aab")], "doc_id long, text string")
    counts = context_mixing.materialize(context_mixing.token_counts(context_mixing._rows(docs, 10**6, 10**6)))
    pairs = np.zeros((256, 256), np.int64)
    codes = context_mixing.huffman_codes(pairs)
    first = context_mixing.context_counts(context_mixing.letter_counts(counts.filter("kind = 0")), codes, [16, 20, 20, 20]).collect()
    total = sum(np.frombuffer(r["payload"], np.float32).sum() for r in first)
    assert total == len(context_mixing.ORDERS) * sum(n * sum(codes[1][a * 256 + b] for a, b in zip(b" " + w, w + b" ", strict=True)) for w, n in ((b"aab", 3), (b"b", 1)))


def test_mixing_weights_are_fitted_on_every_decision(spark):
    """The fit over a table of words is that over all of them at hand, each as often as it occurs, and lowers the loss."""
    rnd = random.Random(8)
    vocabulary = [("".join(rnd.choice("abcde") for _ in range(1 + i % 9)).encode() + str(i).encode(), 1 + i % 4) for i in range(500)]
    codes = context_mixing.huffman_codes(np.ones((256, 256), np.int64))
    tables = [np.ascontiguousarray(np.random.default_rng(k).integers(0, 40, (1 << context_mixing.TABLE_BITS, 2)), np.float32) for k in range(len(context_mixing.ORDERS))]
    words = spark.createDataFrame([(bytearray(w), n) for w, n in vocabulary], "letters binary, n long").repartition(5)
    over = context_mixing.over_letters(context_mixing.letter_counts(words), spark.sparkContext.broadcast((codes, tables)))
    weights, refined = context_mixing.fit(over)
    mixer = context_mixing.fit_mixer(codes, [t.T for t in tables], [w for w, n in vocabulary for _ in range(n)])
    assert np.allclose(weights, mixer.weights, rtol=1e-6, atol=1e-9) and np.allclose(refined, mixer.refined, rtol=1e-6)
    start = np.tile(context_mixing._START, (context_mixing.GATES, 1))
    assert over("slopes", weights)[:, 0].sum() < over("slopes", start)[:, 0].sum()
    assert over("outcomes", weights)[:, 0].sum() == sum(n * sum(codes[1][a * 256 + b] for a, b in zip(b" " + w, w + b" ", strict=True)) for w, n in vocabulary)


def test_context_tables_grow_with_contexts(spark):
    rnd = random.Random(6)
    codes = context_mixing.huffman_codes(np.ones((256, 256), np.int64))
    sizes = []
    for n in (100, 6000):
        some = [bytes(rnd.randrange(97, 123) for _ in range(8)) for _ in range(n)]
        words = spark.createDataFrame([(bytearray(w), 1) for w in some], "letters binary, n long")
        bits = context_mixing.table_bits(context_mixing.letter_counts(words), codes, 12)
        end = np.cumsum([len(w) for w in some])
        _, _, slots = context_mixing.decisions(*context_mixing.letters(np.frombuffer(b"".join(some), np.uint8), end - 8, end), codes, [16, 60, 60, 60])
        assert all((1 << b) >= 1.6 * len(np.unique(s)) for b, s in zip(bits[1:], slots[1:], strict=True))
        sizes.append(bits[3])
    assert sizes[0] + 4 <= sizes[1]


def test_spelling_is_a_distribution():
    """Probabilities of all one- and two-letter words over a small alphabet add up to less than one, with none lost to bits."""
    pairs = np.zeros((256, 256), np.int64)
    pairs[32, 97], pairs[97, 98], pairs[98, 32], pairs[97, 32] = 9, 4, 6, 5
    tables = [np.zeros((2, 1 << context_mixing.TABLE_BITS), np.int64) for _ in context_mixing.ORDERS]
    mixer = context_mixing.fit_mixer(context_mixing.huffman_codes(pairs), tables, [b"ab", b"a", b"ba"])
    every = [bytes([x]) for x in range(256) if x != 32]
    data = np.frombuffer(b"".join(every), np.uint8)
    end = np.arange(1, len(every) + 1)
    assert 0 < np.exp(mixer.bits(data, end - 1, end)).sum() < 1


def test_sharding_limits_and_repeats(spark):
    same = spark.createDataFrame([(1, "x" * 50)] * 400 + [(i, "y" * (i % 90)) for i in range(600)] + [(9999, "z" * 5000)], "doc_id long, text string")
    got = sharding.assign_shards(same, 1000).toPandas()
    assert len(got) == 1001 and got.groupby("shard").n_bytes.sum().equals(got.groupby("shard").shard_bytes.first())
    assert (got[~got.oversized].shard_bytes <= 1000).all() and (got[got.oversized].shard_docs == 1).all()
    shards = sorted(set(got.shard))
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    assert sharding.assign_shards(empty(spark), 10).count() == 0


def test_mixing_targets_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (mixing.mix(docs).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b) and (a.taken <= 2 * a["size"]).all()
    total = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert (abs(total.taken - total.target) <= 2 * total.largest).all()
    assert a.groupby("source").target.first().sum() == pytest.approx(1.5 * a["size"].sum())
    assert mixing.mix(empty(spark)).count() == 0


def vectors(spark, n=1500, dim=12):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(n)]
    rows += [(n + i, [1.0] * dim) for i in range(60)] + [(5, [0.5] * dim), (None, [1.0] * dim), (4000, None), (4001, [0.0] * dim), (4002, [float("nan")] * dim), (4003, [1.0, None] + [1.0] * (dim - 2)), (4020, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("shard_rows", [8192, 300])
def test_vantage_points_exact_at_factor_one(spark, shard_rows):
    table = vectors(spark)
    rows = [(r[0], np.array(r[1], float)) for r in table.collect() if r[0] is not None and r[1] is not None and None not in r[1]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    got = collections.defaultdict(list)
    for r in vptree.nearest(table, factor=1.0, shard_rows=shard_rows, query_rows=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for at, (i, v) in enumerate(rows):
        if i % 20 == 0:
            best = sorted(((-float(v @ w), j) for k, (j, w) in enumerate(rows) if k != at and len(w) == len(v)))[:20]
            assert [j for _, j, _ in sorted(got[i])] == [j for _, j in best]
            assert np.allclose([s for _, _, s in sorted(got[i])], [-s for s, _ in best], atol=1e-9)
    assert vptree.nearest(table.limit(0)).count() == 0


def test_default_factor_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact, fast = ({(r["query_id"], r["vec_id"]) for r in vptree.nearest(table, factor=f, shard_rows=500).collect()} for f in (1.0, 1.1))
    assert len(exact & fast) / len(exact) >= 0.9


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def near_copies():
    rnd = random.Random(9)
    out, vocabulary = [], [f"t{i}" for i in range(4000)]
    passage = [rnd.choice(vocabulary) for _ in range(55)]
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 30, 45, 80, 150, 400):
        for _ in range(3):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 4, max(1, size // 60), max(1, size // 40)):
                w = list(base)
                for _ in range(edits):
                    at = rnd.randrange(len(w) + 1)
                    w[at : at + rnd.randrange(2)] = [rnd.choice(vocabulary)] * rnd.randrange(2)
                out.append(" ".join(w))
    out += [" ".join([*passage, *(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 40)))]) for _ in range(120)]
    group = [rnd.choice(vocabulary) for _ in range(120)]
    out += [" ".join([*group[:at], rnd.choice(vocabulary), *group[at + 1 :]]) for at in (rnd.randrange(120) for _ in range(150))]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("wide", "held"), [(2048, 65_536), (24, 3)])
def test_partenum_loses_no_link(spark, monkeypatch, wide, held):
    monkeypatch.setattr(partenum, "WIDE", wide)
    monkeypatch.setattr(partenum, "HELD", held)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(docs).collect())
    assert got == brute_components(rows)


def test_partenum_edges(spark):
    docs = tricky(spark).filter("doc_id is not null")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(docs).collect())
    want = [(d, n, c if n else d) for d, n, c in brute_components(rows)]
    assert got == want
    assert partenum.near_duplicates(empty(spark)).count() == 0


def test_partenum_links_rows_without_id(spark):
    base = [f"n{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (7, " ".join([*base, "tail"])), (None, " ".join(base[::-1])), (None, " ".join([*base[::-1], "one"])), (9, " ".join([*base[::-1], "one", "two"])), (3, "not like these at all")]
    got = partenum.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == [(0, 56, 7), (0, 56, 9), (0, 57, 9), (3, 1, 3), (7, 57, 7), (9, 58, 9)]


def test_partenum_compares_a_repeated_row_once(spark):
    text = " ".join(f"r{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text)] * 3 + [(None, text + " x")] * 2 + [(2, text + " x y")], "doc_id long, text string")
    classes = partenum.materialize(partenum.set_classes(docs))
    sets = partenum.class_sets(docs, classes, classes.select("fp")).collect()
    assert sorted(r["size"] for r in sets) == [36, 37, 38]
    assert {r["component_id"] for r in partenum.near_duplicates(docs).collect()} == {1}


def test_token_scan_over_binary_files(spark, tmp_path):
    lengths = [3, 0, 0, 7, 1, 12, 5]
    ids = [x for n in lengths for x in [*range(1, n + 1), 50256]] + [5, 6]
    (tmp_path / "a.bin").write_bytes(struct.pack(f"<{len(ids)}H", *ids))
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = token_scan.read_token_files(spark, str(tmp_path), 2, block_tokens=4)
    ranged = token_scan.read_token_files(spark, str(tmp_path), 2, block_tokens=4, whole_bytes=0)
    assert sorted((r["block"], bytes(r["payload"])) for r in ranged.collect()) == sorted((r["block"], bytes(r["payload"])) for r in blocks.collect())
    summaries = token_scan.scan_blocks(blocks, 50256, 2)
    for width in (1024, 2):
        got = sorted((r["ordinal"], r["n_tokens"]) for r in token_scan.document_lengths(summaries, width).collect())
        assert [n for _, n in got] == [*lengths, 2] and [i for i, _ in got] == list(range(8))
    assert token_scan.count_document_tokens(empty(spark)).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_scan.count_document_tokens(tricky(spark)).collect()) == sorted((r["doc_id"] or 0, len((r["text"] or "").encode())) for r in tricky(spark).collect())


def test_host_rules_edges(spark):
    got = host_rules.judge_documents(tricky(spark)).toPandas()
    assert len(got) == 13 and got.kept.notna().all()
    assert host_rules.judge_documents(empty(spark)).count() == 0
    bad = spark.createDataFrame([(i, "x", "bad") for i in range(50)] + [(100 + i, " ".join(f"u{j}x{i}" for j in range(30)), "bad" if i < 3 else "good") for i in range(60)], "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in host_rules.judge_documents(bad).collect()}
    assert not kept[100] and all(kept[100 + i] for i in range(3, 60))


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rnd = random.Random(2)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [r["text"] or "" for r in tricky(spark).collect()]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 3000, "ab" * 2000, "I'm we'll 'S", "  a   b\n\n"] + ["".join(chr(rnd.choice([32, 10, 97, 233, 0x4E00, 0x1F600, 39, 48, 0x300, 0x1C, 0x85, 0x2028])) for _ in range(500))]
    got = {r["doc_id"]: r for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(empty(spark), queries.tokenizer_path()).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 2, "bob", "hé"), (1, None, "ann", None), (2, 0, "system", "alone"), (3, 0, None, "who")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for parts in (1, 5):
        got = chat.rotate_perspectives(c, partitions=parts).toPandas()
        assert set(zip(got.conv_id, got.perspective, strict=True)) == {(1, "ann"), (1, "bob"), (3, "unknown")}
        for (_, view), g in got.groupby(["conv_id", "perspective"]):
            g = g.sort_values("position")
            text = "".join(g.rendered)
            for r in g.itertuples():
                assert text[r.char_start : r.char_end] == r.rendered
                assert (r.role == "assistant") == (r.speaker == view)
                trained = text[r.mask_start : r.mask_end]
                assert trained == (r.rendered.split("\n", 1)[1][:-1] if r.role == "assistant" else "")
    assert chat.rotate_perspectives(c.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, "/root/testdata/sf0.01"))
        if name == "mixing":
            assert set(out.select("doc_id").distinct().toPandas().doc_id) <= set(docs.toPandas().doc_id)
        elif name != "bpe":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            if name == "near_duplicates":
                rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
                assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in brute_components(rows)})
        else:
            assert out.count() == docs.count()
        docs = out
    none = docs_like = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none if none is not None else docs_like, "/root/testdata/sf0.01")
    assert none.count() == 0

def test_pipeline_judges_each_row(spark):
    """Null, shared and repeated ids, clashing columns: every row by its own content, in every stage."""
    import corpus_pipeline

    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(900)) for _ in range(n))
    different = [text(60) for _ in range(4)]
    rows = [(1, different[0]), (1, different[1]), (None, different[2]), (None, different[3]), (2, different[0] + " tail"), (None, different[2] + " tail"), (7, different[1]), (7, different[1]), (7, "too short"), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key long, label string, n_words int")
    by_name = dict(corpus_pipeline.STAGES)
    labels = "/root/testdata/sf0.001"
    found = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    every = sorted((i or 0, t or "") for i, t in rows)
    assert found(by_name["toxicity"](spark, docs, labels)) == every
    long = [x for x in every if len(x[1].split()) >= 20]
    assert found(by_name["quality"](spark, docs, labels)) == long
    near = by_name["near_duplicates"](spark, docs, labels)
    assert near.columns == corpus_pipeline.COLUMNS
    kept = found(near)
    stays = different[2] if (0, different[2]) in kept else different[2] + " tail"  # the one whose text hashes lower
    assert kept == sorted([(0, ""), (0, different[3]), (0, stays), (1, different[0]), (1, different[1]), (7, "too short"), (8, "")])
    mixed = by_name["mixing"](spark, docs, labels)
    times = collections.Counter(found(mixed))
    asked = mixing.mix(docs).filter("taken > 0").collect()
    assert sum(times.values()) == sum(r["taken"] // r["size"] for r in asked) and set(times) <= set(every)
    assert by_name["bpe"](spark, docs, labels).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), labels).count() == 0


def test_host_verdict_changes_for_a_named_host(spark):
    """The hosts of the given table are alike and none is rejected; with half of src7's texts cut short, that one alone is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = host_rules.host_verdicts(host_rules.text_metrics(docs))
    assert plain.filter("host_rejected").count() == 0 and plain.count() > 5
    worse = docs.withColumn("text", F.when((F.col("source") == "src7") & (F.floor(F.col("doc_id") / 20) % 2 == 0), F.substring("text", 1, 30)).otherwise(F.col("text")))
    assert [r["host"] for r in host_rules.host_verdicts(host_rules.text_metrics(worse)).filter("host_rejected").collect()] == ["src7"]
    judged = host_rules.judge_documents(worse).join(worse.select("doc_id", "source"), "doc_id")
    assert judged.filter("source = 'src7' and kept").count() == 0 and judged.filter("source = 'src7' and not base_failed").count() > 0
    assert judged.filter("source <> 'src7' and kept = base_failed").count() == 0


def test_mixing_cut_in_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs, bins=b, last_rows=n).collect()) for b, n in ((1024, 20_000), (3, 2)))
    assert one == many
