"""Token counts of flat, unindexed token files: find the end-of-document ids, then stitch documents across blocks.

A token file is a run of fixed-width ids; each document ends with the end id. Blocks of a file are scanned independently (one
vectorised comparison); a prefix scan over block summaries, in two levels, gives each block the number of documents and the
open document's tokens before it.

Edge cases: an empty document counts 0 tokens; ids after a file's last end id are a last document of their own; a block without
an end id only carries; empty files and tables give no rows; a null text is an empty document; rows with a null or shared doc_id, and
repeated rows, are documents each; texts and files of any length are counted whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import materialize

BYTE_END = 0xFF  # no byte of UTF-8 text; the end id of files that hold bytes as ids
BLOCKS = "file string, block long, payload binary"


def read_token_files(spark: SparkSession, path: str, id_bytes: int, block_tokens: int = 1 << 20, whole_bytes: int = 128 << 20) -> DataFrame:
    """Blocks of binary token files (one file, or a folder of them).

    Files of at most ``whole_bytes`` come through Spark's own reader, one a task. Larger ones, of any size, are read by byte range, a
    block a row, through Arrow's file systems; these have to reach the files (local or mounted paths, hdfs, s3, gs).
    """

    def checked(name: str, size: int) -> None:
        if size % id_bytes:
            raise ValueError(f"{name}: {size} bytes are no whole number of {id_bytes}-byte ids")

    def row(name: str, block: int, payload: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["file", "block", "payload"])

    step = block_tokens * id_bytes

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                view = content.as_buffer()
                checked(name, view.size)
                for k in range(0, view.size, step):
                    yield row(name, k // step, view.slice(k, min(step, view.size - k)).to_pybytes())

    def ranged(batches):
        for batch in batches:
            for name, size, k in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "block")), strict=True):
                checked(name, size)
                files, inner = fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
                with files.open_input_file(inner) as f:
                    yield row(name, k, f.read_at(min(step, size - k * step), k * step))

    found = spark.read.format("binaryFile").load(path)
    small = found.filter(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(tk.lean(cut), BLOCKS)
    large = found.filter(F.col("length") > whole_bytes).select("path", "length")  # no contents: names and sizes only
    blocks = large.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))))
    return small.unionByName(blocks.repartition("path", "block").mapInArrow(tk.lean(ranged), BLOCKS))


def byte_token_blocks(docs: DataFrame, block_tokens: int = 1 << 20) -> DataFrame:
    """Documents as flat byte-id files, one per input partition: rows of BLOCKS, and the names of a file's documents in order
    (``first``, ``doc_ids``), kept apart from the ids as a manifest."""

    def write(batches):
        file, block, ordinal, held, size = str(TaskContext.get().partitionId()), 0, 0, [], 0
        end = np.array([BYTE_END], np.uint8)

        def row(payload=None, first=None, ids=None, number=None):
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([payload], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "payload", "first", "doc_ids"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for i in range(0, len(names), 10_000):
                yield row(first=ordinal + i, ids=names[i : i + 10_000])
            ordinal += len(names)
            data, offset = tk.raw(batch.column("text"))
            for d in range(len(names)):
                for piece in (data[offset[d] : offset[d + 1]], end):
                    while len(piece):
                        part, piece = piece[: block_tokens - size], piece[block_tokens - size :]
                        held.append(part)
                        size += len(part)
                        if size == block_tokens:
                            yield row(np.concatenate(held).tobytes(), number=block)
                            block, held, size = block + 1, [], 0
        if size:
            yield row(np.concatenate(held).tobytes(), number=block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.lean(write), f"{BLOCKS}, first long, doc_ids array<long>")


def scan_blocks(blocks: DataFrame, end_id: int, id_bytes: int) -> DataFrame:
    """One summary per block: its tokens, its end ids, the tokens before the first and after the last, and the lengths between."""

    def scan(batches):
        for batch in batches:
            for file, block, payload in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                ids = np.frombuffer(payload.as_buffer(), f"<u{id_bytes}")
                ends = np.flatnonzero(ids == end_id)
                head, tail = (int(ends[0]), len(ids) - int(ends[-1]) - 1) if len(ends) else (0, 0)
                columns = [[file], [block], [len(ids)], [len(ends)], [head], [tail]]
                types = [pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array([np.diff(ends) - 1], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ends", "head", "tail", "between"])

    return blocks.select("file", "block", "payload").mapInArrow(tk.lean(scan), "file string, block long, tokens long, ends long, head long, tail long, between array<long>")


def document_lengths(summaries: DataFrame, blocks_per_group: int = 1024) -> DataFrame:
    """file, ordinal (from 0), n_tokens of every document.

    The scan's monoid is (end ids, tokens since the last end id). Groups of consecutive blocks are reduced first, so that
    not even one file that holds most of the data meets in one task.
    """
    b = summaries.withColumn("part", F.floor(F.col("block") / blocks_per_group)).withColumn("open", F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("tokens")))
    in_part = Window.partitionBy("file", "part").orderBy("block")
    before = in_part.rowsBetween(Window.unboundedPreceding, -1)

    def carry(ends: str, size: str, open_: str, order, reach):
        """Tokens since the last end id before a row: the sum of whole rows after it, and that row's own rest."""
        total = F.coalesce(F.sum(size).over(reach), F.lit(0))
        at = F.max(F.when(F.col(ends) > 0, F.struct(F.col("_upto").alias("upto"), F.col(open_).alias("rest")))).over(reach)
        return F.when(at.isNull(), total).otherwise(total - at["upto"] + at["rest"])

    b = b.withColumn("_upto", F.sum("tokens").over(in_part))
    b = b.withColumns({"ends_before": F.coalesce(F.sum("ends").over(before), F.lit(0)), "carried": carry("ends", "tokens", "open", in_part, before)})
    closed = F.max(F.when(F.col("ends") > 0, F.struct("block", F.col("_upto").alias("upto"), F.col("tail").alias("rest"))))
    parts = b.groupBy("file", "part").agg(F.sum("ends").alias("p_ends"), F.sum("tokens").alias("p_tokens"), closed.alias("closed"), F.max("block").alias("p_last"))
    parts = parts.withColumn("p_open", F.when(F.col("closed").isNull(), F.col("p_tokens")).otherwise(F.col("p_tokens") - F.col("closed.upto") + F.col("closed.rest")))
    over = Window.partitionBy("file").orderBy("part")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_upto", F.sum("p_tokens").over(over)).withColumn("last_of_file", F.lead("part").over(over).isNull())
    parts = parts.select("file", "part", "p_last", "last_of_file", F.coalesce(F.sum("p_ends").over(earlier), F.lit(0)).alias("p_before"), carry("p_ends", "p_tokens", "p_open", over, earlier).alias("p_carried"))
    b = b.join(parts, ["file", "part"]).withColumn("carry", F.col("carried") + F.when(F.col("ends_before") == 0, F.col("p_carried")).otherwise(F.lit(0)))
    first = F.when(F.col("ends") > 0, F.array(F.col("carry") + F.col("head"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tokens"))
    last = F.when(F.col("last_of_file") & (F.col("block") == F.col("p_last")) & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>"))
    return b.select("file", (F.col("p_before") + F.col("ends_before")).alias("base"), F.posexplode(F.concat(first, "between", last)).alias("pos", "n_tokens")).select("file", (F.col("base") + F.col("pos")).alias("ordinal"), "n_tokens")


def count_tokens(blocks: DataFrame, end_id: int, id_bytes: int) -> DataFrame:
    """file, ordinal, n_tokens for token files given as blocks."""
    return document_lengths(materialize(scan_blocks(blocks, end_id, id_bytes)))


def count_document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, file, ordinal, n_tokens: documents written as flat byte-id files, whose counts come from the scan alone."""
    written = materialize(byte_token_blocks(docs))
    counted = count_tokens(written.filter("payload is not null"), BYTE_END, 1)
    named = written.filter("doc_ids is not null").select("file", "first", F.posexplode("doc_ids").alias("pos", "doc_id")).select("file", (F.col("first") + F.col("pos")).alias("ordinal"), "doc_id")
    return named.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
