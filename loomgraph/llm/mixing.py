"""Weighted fair queueing: mixes sources towards target weights. DataFrame operations only.

Every document is queued once per epoch in a shuffled order of its source. Its virtual finish time is the source's running
total of words divided by the source's target. The queue is ordered by finish time over all sources and cut at the budget.

Edge cases: a null or empty text has size 0 and is never taken; a very long text is one entry as any other, never cut; a null source
is a source of its own, last in order; rows with a null or shared doc_id are told apart by their text, and repeated rows are queued
each; an empty table gives an empty result; ties of finish time go by source, shuffle key and document; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KEY_BITS = 60


def shuffle_key(seed: int, *columns: str) -> Column:
    """60 bits of MD5, a key that any engine can reproduce."""
    joined = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    return F.conv(F.substring(F.md5(joined), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeat: float) -> DataFrame:
    """One row per source: rank by code point (null last), weight, size, and the target by water-filling.

    Sources sorted by cap / weight fill first. With k sources at their cap, the level is what is left of the budget divided by
    the weight that is left; the right k is the first whose level leaves the next source below its cap. The table has one row
    per source, so its two ordered windows run in one task on as many rows as there are sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    ranked = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(repeat)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    final = leveled.withColumn("water", F.max_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), -F.col("cap") / F.col("weight"))).over(everything))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return final.withColumn("target", target).select("source", "source_rank", "source_size", "source_docs", "target")


def _key(seed: int) -> Column:
    return shuffle_key(seed, "doc_id", "text")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, repeat: int = 2, seed: int = 17, rows_per_bucket: int = 2000, bins: int = 1024, last_rows: int = 20_000) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source, key): the words that the mix takes of each document.

    No source is summed in one task: a source's shuffled queue is cut into buckets by the leading bits of the shuffle key, as
    many as the table's rows ask for; bucket totals give each bucket's offset. The global cut is found in passes: each divides the
    range of finish times that holds it into ``bins``, until that has ``last_rows`` at most, which are ordered.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _key(seed).alias("key")))
    targets = materialize(source_targets(sizes, weights, share, repeat))
    n, budget = targets.agg(F.sum("source_docs"), F.sum("target")).first()
    zero = F.lit(0).cast("long")
    if not n:
        return sizes.select("doc_id", "size", zero.alias("source_size"), F.lit(0.0).alias("target"), zero.alias("taken"), "source", "key")
    bits = max(0, math.ceil(math.log2(max(1, n / rows_per_bucket))))
    queued = sizes.withColumn("bucket", F.shiftright("key", KEY_BITS - bits) if bits else zero)
    totals = queued.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    queued = queued.withColumn("running", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(within))
    queued = queued.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    side = targets.withColumnRenamed("source", "t_source").drop("source_docs")
    queued = queued.join(F.broadcast(side) if targets.count() <= 100_000 else side, F.col("source").eqNullSafe(F.col("t_source")))

    def finish(epoch: int) -> Column:
        cumulative = F.col("before") + F.col("running") + F.lit(epoch) * F.col("source_size")
        return F.when(F.col("target") > 0, cumulative / F.col("target")).otherwise(F.lit(0.0))

    def order(epoch: int) -> Column:
        return F.struct(finish(epoch).alias("finish"), F.col("source_rank").alias("source_rank"), F.col("key").alias("key"), F.col("doc_id").alias("doc_id"), F.col("place").alias("place"), F.lit(epoch).alias("epoch"))

    queued = materialize(queued.select("doc_id", "source", "size", "source_size", "target", "source_rank", "key", "place", "before", "running"))
    entries = queued.filter("size > 0").select("size", F.explode(F.array(*(order(e) for e in range(repeat)))).alias("entry"))
    time = F.col("entry.finish")
    words, rows, low, high = entries.agg(F.sum("size"), F.count("*"), F.min(time), F.max(time)).first()
    if not rows or words <= budget:
        return queued.select("doc_id", "size", "source_size", "target", (F.lit(repeat) * F.col("size")).cast("long").alias("taken"), "source", "key")
    upto = 0
    while rows > last_rows and low < high:
        place = F.least(F.floor((time - F.lit(low)) * F.lit(bins / (high - low))), F.lit(bins - 1))
        found = entries.filter(time.between(low, high)).groupBy(place.alias("bin")).agg(F.sum("size"), F.count("*"), F.min(time), F.max(time))
        for _, words, rows, low, high in sorted(found.collect()):  # noqa: B007 - at most ``bins`` rows, up to the one of the cut
            if upto + words > budget:
                break
            upto += words
    inside = entries.filter(time.between(low, high)).withColumn("upto", F.lit(upto) + F.sum("size").over(Window.orderBy("entry")))
    last = inside.filter(F.col("upto") <= budget).agg(F.max("entry").alias("last")).first()[0]
    if last is None:
        accepted = [finish(e) < low for e in range(repeat)]
    else:
        cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["source_rank"]).alias("source_rank"), F.lit(last["key"]).alias("key"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["place"]).alias("place"), F.lit(last["epoch"]).alias("epoch"))
        accepted = [order(e) <= cut for e in range(repeat)]
    taken = sum((F.when(a, F.col("size")).otherwise(F.lit(0)) for a in accepted), F.lit(0))
    return queued.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "key")


def mixed_rows(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    A row is told by its doc_id, source and text, so that rows with a null or shared doc_id are taken each as the mix says; rows that
    are equal in all three stand for each other.
    """
    taken = mix(docs, seed=seed).filter("taken > 0").groupBy("doc_id", "source", "key").agg(F.sum(F.floor(F.col("taken") / F.col("size"))).cast("int").alias("__times"), F.count("*").alias("__rows"))
    taken = materialize(taken.withColumnsRenamed({"doc_id": "__t_id", "source": "__t_source", "key": "__t_key"}))
    side = F.broadcast(taken) if taken.count() <= 500_000 else taken  # five values a row; a larger table is a shuffled join
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__key": _key(seed)})
    same = (F.col("__key") == F.col("__t_key")) & F.col("__id").eqNullSafe(F.col("__t_id")) & F.col("__source").eqNullSafe(F.col("__t_source"))
    found = keyed.join(side, same)
    if not taken.filter("__rows > 1").isEmpty():
        found = found.filter("__rows = 1").unionByName(found.filter("__rows > 1").dropDuplicates(["__key", "__id", "__source"]))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)
