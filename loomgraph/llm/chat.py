"""Multi-party perspective rotation: each participant's view of a conversation, with that speaker as the assistant.

For each participant every message is rendered once: the participant's own as ``assistant`` with its content and end mark
trained on, all others as users with their names, speakers in ``fixed`` (system) under their own role. A view is a sequence of
message rows with character spans, so no conversation, however long, has to fit in one task or cell; the texts joined in order
of position are the view.

Edge cases: a null text is an empty message; a null role is the speaker "unknown"; a null turn comes last; ties of turn go by
speaker and text, and rows that are the same in all of these are separate messages; a conversation of fixed speakers only has
no view; messages of any length are rendered whole; other columns are not read; an empty table gives an empty result. A text that
holds the marks of a turn itself is rendered as it is: spans and masks, not marks, say where a turn ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def rotate_perspectives(conversations: DataFrame, fixed: tuple[str, ...] = ("system",), partitions: int | None = None) -> DataFrame:
    """conv_id, perspective, position, speaker, role, rendered, char_start, char_end, mask_start, mask_end.

    Spans count characters within the view; the mask span is where the loss applies (empty: start = end). Positions and spans
    are prefix sums over a range partitioning by conversation and turn: sums within each range partition, offsets from its
    totals. One conversation that holds most rows spreads over many partitions.
    """
    spark = conversations.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "speaker", "text", "row"]
    c = c.withColumn("row", F.monotonically_increasing_id())
    c = materialize(c.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    # lengths of a message as its own speaker's view, as another's, and under a fixed role
    head_self, head_fixed = F.lit("<|im_start|>assistant\n"), F.concat(F.lit("<|im_start|>"), F.col("speaker"), F.lit("\n"))
    head_other = F.concat(F.lit("<|im_start|>user name="), F.col("speaker"), F.lit("\n"))
    is_fixed = F.col("speaker").isin(*fixed) if fixed else F.lit(False)
    common = F.when(is_fixed, head_fixed).otherwise(head_other)
    end, gap = F.lit("<|im_end|>"), F.lit("\n")
    plain = F.length("text") + F.length(end) + F.length(gap)
    c = c.withColumns({"as_other": (F.length(common) + plain).cast("long"), "as_self": (F.length(head_self) + plain).cast("long"), "one": F.lit(1).cast("long"), "is_fixed": is_fixed})
    # per conversation and partition: totals for all, and the correction for each speaker's own messages
    local = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text", "row").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    c = c.withColumns({"p_rows": F.coalesce(F.sum("one").over(local), zero), "p_chars": F.coalesce(F.sum("as_other").over(local), zero)})
    totals = c.groupBy("conv_id", "part").agg(F.sum("one").alias("t_rows"), F.sum("as_other").alias("t_chars"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("conv_id").alias("o_conv"), F.col("part").alias("o_part"), F.coalesce(F.sum("t_rows").over(earlier), zero).alias("o_rows"), F.coalesce(F.sum("t_chars").over(earlier), zero).alias("o_chars"))
    speakers = c.filter(~F.col("is_fixed")).groupBy("conv_id", "speaker").agg(F.count("*").alias("messages"))
    views = speakers.groupBy("conv_id").agg(F.sort_array(F.collect_set("speaker")).alias("views"))
    c = c.join(offsets, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part")))
    c = c.join(views.withColumnRenamed("conv_id", "v_conv"), F.col("conv_id").eqNullSafe(F.col("v_conv")))
    c = c.select("conv_id", "part", "turn", "speaker", "text", "row", "is_fixed", "as_other", "as_self", (F.col("p_rows") + F.col("o_rows")).alias("position"), (F.col("p_chars") + F.col("o_chars")).alias("chars"), F.explode("views").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    c = c.withColumn("own", own).withColumn("gain", F.when(own, F.col("as_self") - F.col("as_other")).otherwise(zero))
    # the view's own messages differ in length: the same two-level sum over their gains
    view_local = Window.partitionBy("conv_id", "perspective", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    gains = c.filter("own").groupBy("conv_id", "perspective", "part").agg(F.sum("gain").alias("t_gain"))
    seen = c.select("conv_id", "perspective", "part").distinct().join(gains.withColumnsRenamed({"conv_id": "g_conv", "perspective": "g_view", "part": "g_part"}), F.col("conv_id").eqNullSafe(F.col("g_conv")) & (F.col("perspective") == F.col("g_view")) & (F.col("part") == F.col("g_part")), "left")
    view_before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.select(F.col("conv_id").alias("s_conv"), F.col("perspective").alias("s_view"), F.col("part").alias("s_part"), F.coalesce(F.sum("t_gain").over(view_before), zero).alias("o_gain"))
    c = c.withColumn("p_gain", F.coalesce(F.sum("gain").over(view_local), zero))
    c = c.join(seen, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("perspective") == F.col("s_view")) & (F.col("part") == F.col("s_part")))
    head = F.when(F.col("own"), head_self).when(F.col("is_fixed"), head_fixed).otherwise(head_other)
    start = F.col("chars") + F.col("p_gain") + F.col("o_gain")
    role = F.when(F.col("own"), F.lit("assistant")).when(F.col("is_fixed"), F.col("speaker")).otherwise(F.lit("user"))
    body = start + F.length(head)
    return c.select(
        "conv_id", "perspective", "position", "speaker", role.alias("role"), F.concat(head, "text", end, gap).alias("rendered"), start.alias("char_start"), (start + F.when(F.col("own"), F.col("as_self")).otherwise(F.col("as_other"))).alias("char_end"),
        F.when(F.col("own"), body).otherwise(start).alias("mask_start"), F.when(F.col("own"), body + F.length("text") + F.length(end)).otherwise(start).alias("mask_end"),
    )
