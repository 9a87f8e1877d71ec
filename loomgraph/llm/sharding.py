"""Extendible hashing: shards are hash prefixes, and only an oversized one takes another bit. DataFrame operations only.

The directory comes from byte totals of fine hash cells, not from a loop over buckets: totals of every prefix of every depth
are one aggregation; a shard is a prefix that fits while its parent does not. Cells that do not fit at the finest depth go to
another round with more bits, and only their rows with them.

Edge cases: a null text has 0 bytes; a document larger than the limit is a shard of its own (oversized = true); rows that are
the same in id and text have the same hash and, once its bits are used up, are told apart by a row number of the written table; an empty
table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

HASH_BITS = 60
ROUND_BITS = 12


def _hash60(*columns: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, HASH_BITS // 4), 16, 10).cast("long")


def _bits(value: Column, width: Column) -> Column:
    return F.lpad(F.bin(value), width, F.lit("0"))


def assign_shards(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """doc_id, shard (the prefix as a bit string), depth, n_bytes, shard_bytes, shard_docs, oversized."""
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be at least 1")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), text).alias("hash"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    n, total = rows.agg(F.count("*"), F.sum("n_bytes")).first()
    open_ = rows.withColumn("second", _hash60(F.col("row").cast("string"))).withColumn("path", F.lit(""))
    if not n:
        return open_.select("doc_id", F.col("path").alias("shard"), F.lit(0).alias("depth"), "n_bytes", F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"), F.lit(False).alias("oversized"))
    done: list[DataFrame] = []
    used, bits = 0, min(24, max(4, math.ceil(math.log2(max(1, total / limit_bytes))) + 4))
    while True:
        shift = HASH_BITS - used % HASH_BITS - bits
        word = F.col("hash") if used < HASH_BITS else F.col("second")
        cell = F.shiftright(word, shift).bitwiseAND(F.lit((1 << bits) - 1))
        celled = open_.withColumn("cell", cell)
        cells = celled.groupBy("path", "cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        node = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda d: F.struct(d.alias("depth"), F.call_function("shiftright", F.col("cell"), F.lit(bits) - d).alias("prefix"))))
        nodes = cells.select("path", "bytes", "docs", node.alias("node")).groupBy("path", "node.depth", "node.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        nodes = materialize(nodes.withColumn("fits", (F.col("bytes") <= limit_bytes) | (F.col("docs") == 1)))
        parents = nodes.filter("not fits").select("path", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        tops = nodes.filter("depth = 0")
        below = nodes.filter("depth > 0").withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["path", "depth", "parent"]).drop("parent")
        edge = tops.unionByName(below).filter(F.col("fits") | (F.col("depth") == bits))
        span = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits) - F.col("depth"))
        leaves = edge.withColumn("low", F.col("prefix") * span).withColumn("cell", F.explode(F.sequence(F.col("low"), F.col("low") + span - 1)))
        leaves = leaves.select("path", "cell", F.when(F.col("depth") == 0, F.lit("")).otherwise(_bits(F.col("prefix"), F.col("depth"))).alias("tail"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), "fits")
        mapped = celled.join(leaves, ["path", "cell"])
        shard = F.concat("path", "tail")
        used += bits
        over = edge.filter("not fits").limit(1).count() > 0
        final = mapped.filter("fits") if over and used < 2 * HASH_BITS else mapped
        done.append(final.select("doc_id", shard.alias("shard"), F.length(shard).alias("depth"), "n_bytes", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit_bytes).alias("oversized")))
        if not over or used >= 2 * HASH_BITS:
            break
        open_ = materialize(mapped.filter("not fits").select("doc_id", "n_bytes", "hash", "second", shard.alias("path")))
        bits = min(ROUND_BITS, HASH_BITS - used % HASH_BITS)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
