"""Token counts of documents in flat, unindexed token files.

A token file is a run of ids in which every document ends with a separator id; it is read in
blocks of a fixed number of ids. Each block is searched for separators by itself, and a prefix
scan over the blocks' summaries stitches the documents that cross block boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfglass.llm import wordtokens
from shelfglass.llm.registry import query, read
from shelfglass.staging import stage

#: Ids in a block; blocks in a group of the prefix scan.
BLOCK_IDS, GROUP_BLOCKS = 1 << 17, 1 << 10


def read_flat_files(spark: SparkSession, path: str, *, width: int = 2,
                    block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (file, block, ids) of binary files of little-endian ids, ``width`` bytes each."""
    size = block_ids * width
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    at = F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / size).cast("long")))
    return files.select(F.col("path").alias("file"), "content", at.alias("block")).select(
        "file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"),
                                     F.lit(size)).alias("ids"))


def write_token_blocks(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                       block_ids: int = BLOCK_IDS, path: str = wordtokens.VOCABULARY,
                       separator: int = 49407) -> DataFrame:
    """Tokenize ``docs`` into one token file per partition, staged in blocks.

    Columns: file, block, ids (16 bits each), first (documents that end before this block), keys
    (those that end in it). The last two are the writer's list; counting does not read them.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = wordtokens.tokenizer(path, plain=True).encode
        end, size = np.array([separator], "<u2").tobytes(), block_ids * 2
        file, block, first = TaskContext.get().partitionId(), 0, 0
        buffer, ends = bytearray(), []

        def cut(upto: int) -> pa.RecordBatch:
            nonlocal block, first, buffer, ends
            done = sum(at <= upto for at, _ in ends)
            out = pa.RecordBatch.from_arrays([
                pa.array([file], pa.int64()), pa.array([block], pa.int64()),
                pa.array([bytes(buffer[:upto])], pa.binary()), pa.array([first], pa.int64()),
                pa.array([[k for _, k in ends[:done]]], pa.list_(key_type))],
                ["file", "block", "ids", "first", "keys"])
            block, first = block + 1, first + done
            buffer, ends = buffer[upto:], [(at - upto, k) for at, k in ends[done:]]
            return out

        for batch in wordtokens.parts(batches, 1, wordtokens.GATHER_BYTES):
            key_type = batch.column(0).type
            for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                buffer += ids.astype("<u2").tobytes() + end
                ends.append((len(buffer), k))
                while len(buffer) >= size:
                    yield cut(size)
        if buffer:
            yield cut(len(buffer))

    return stage(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
                 .mapInArrow(wordtokens.frugal(run), "file bigint, block bigint, ids binary, "
                                                     f"first bigint, keys array<{kind}>"), "tokens",
                 small_batches=True)


def _search(blocks: DataFrame, separator: int, width: int) -> DataFrame:
    """Per block: its length, and the positions of its separators."""
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for raw in batch.column(2).to_pylist():
                ids = np.frombuffer(raw or b"", f"<u{width}")
                found.append(np.flatnonzero(ids == separator).astype(np.int32))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                pa.array(found, pa.list_(pa.int32()))], ["file", "block", "size", "at"])

    return blocks.select("file", F.col("block").cast("long").alias("block"), "ids").mapInArrow(
        run, f"file {kind}, block bigint, size bigint, at array<int>")


def count_tokens(blocks: DataFrame, *, separator: int, width: int = 2,
                 block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (file, block, ids) to one row per document: file, document, start, n_tokens, ended.

    ``document`` numbers a file's documents from 0, ``start`` is the position of its first id,
    and ``n_tokens`` leaves the separator out. Ids after a file's last separator are a document
    with ``ended`` false; two separators in a row hold an empty one. All blocks of a file but its
    last hold ``block_ids`` ids; null ids are an empty block; an empty table gives no rows.
    The scan has two levels, so no task orders more than ``GROUP_BLOCKS`` summaries of a file, or
    the totals of their groups.
    """
    group = F.floor(F.col("block") / GROUP_BLOCKS)
    here = stage(_search(blocks, separator, width), "separators").withColumn("group", group)
    here = here.withColumns({
        "n": F.size("at").cast("long"), "base": F.col("block") * block_ids,
        "last": F.col("block") * block_ids + F.try_element_at("at", F.lit(-1))})

    def before(*keys, order):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1)

    totals = here.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    by_group = before("file", order="group")
    totals = totals.select("file", "group", F.sum("n").over(by_group).alias("n_groups"),
                           F.max("last").over(by_group).alias("last_groups"))
    in_group = before("file", "group", order="block")
    placed = here.withColumns({"n_blocks": F.sum("n").over(in_group),
                               "last_blocks": F.max("last").over(in_group)}).join(
        totals, ["file", "group"])
    first = F.coalesce("n_groups", F.lit(0)) + F.coalesce("n_blocks", F.lit(0))
    previous = F.coalesce("last_blocks", "last_groups", F.lit(-1))
    documents = placed.select(
        "file", first.alias("first"), previous.alias("previous"), "base", "at",
        F.posexplode("at").alias("pos", "sep")).select(
        "file", (F.col("first") + F.col("pos")).alias("document"),
        F.when(F.col("pos") == 0, F.col("previous")).otherwise(
            F.col("base") + F.expr("try_element_at(at, pos)")).alias("previous"),
        (F.col("base") + F.col("sep")).alias("end")).select(
        "file", "document", (F.col("previous") + 1).alias("start"),
        (F.col("end") - F.col("previous") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    open_ends = here.groupBy("file").agg(
        F.sum("n").alias("document"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"),
        F.max(F.col("base") + F.col("size")).alias("end")).filter("end > start").select(
        "file", "document", "start", (F.col("end") - F.col("start")).alias("n_tokens"),
        F.lit(False).alias("ended"))
    return documents.unionByName(open_ends)


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """Tokens of every document, counted in the flat files that its ids were written to."""
    written = write_token_blocks(read(spark, sf_dir, "documents"))
    counts = count_tokens(written, separator=49407)
    keys = written.select("file", "first", F.posexplode("keys").alias("pos", "doc_id")).select(
        "file", (F.col("first") + F.col("pos")).alias("document"), "doc_id")
    return counts.join(keys, ["file", "document"]).select(
        "doc_id", "file", "document", "start", "n_tokens")
