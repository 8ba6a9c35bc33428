"""Mixing sources to target weights, dealt to output shards by a splitting tree.

Each source is cut into blocks by a hash of its rows, about ``block_words`` words each, and the
blocks are permuted. A source's target asks for whole passes over it, then for the first blocks of
the permutation, and for some rows of one more block; where those leave room, the rest goes on to
the blocks that follow. A large row is a block by itself. That gives an exact quota of block copies
for every source. A binary tree splits the quotas among the output shards: at every node the left
half's share is drawn from the multivariate hypergeometric law, as if all copies had been shuffled
together. A shard then draws its copies from the permutations, disjoint from all others, and
shuffles them locally.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfglass.llm.prefix import running_sums
from shelfglass.llm.registry import query, read
from shelfglass.staging import stage

#: Weights of the sources in order, repeating; words asked for, and most passes over a source.
WEIGHTS, SHARE, MOST_PASSES = (5, 2, 1), 1.5, 2
#: Words of a block and of an output shard; blocks (or shards) that one task orders.
BLOCK_WORDS, SHARD_WORDS, GROUP = 1 << 16, 1 << 22, 1 << 10
#: A row of more than this part of a block's words is a block by itself.
LARGE_PART = 8
SEED = 17


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to id, weight and target: water filling, level by level of size per
    weight. One row per source is ordered in one task; rows are never."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("id", (F.row_number().over(named) - 1).cast("long"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.col("id") % len(weights) + 1).cast("int"))
    out = out.withColumns({"weight": weight, "room": F.col("source_size") * float(most)})
    every = Window.partitionBy(F.lit(0))
    filled = every.orderBy(F.col("room") / F.col("weight"), "id").rowsBetween(
        Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    out = out.withColumn("level", (
        share * F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(filled), none)) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), none)))
    level = F.min(F.when(F.col("room") / F.col("weight") > F.col("level"),
                         F.struct((F.col("room") / F.col("weight")).alias("at"), "id", "level"))
                  ).over(every)["level"]
    return out.withColumn("target", F.least("room", F.coalesce(level, F.lit(float("inf"))) *
                                            F.col("weight"))).select(
        "source", "id", "source_size", "target")


def split_quotas(quotas: np.ndarray, shards: int, first: int, last: int, seed: int
                 ) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, quotas) of shards ``first`` to ``last`` (exclusive) of the splitting tree.

    Every node draws with its own seed, so any task finds the same numbers for a node.
    """
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b <= first or a >= last:
            continue
        if b - a == 1:
            yield a, have
            continue
        half = (a + b) // 2
        take = int(have.sum()) * (half - a) // (b - a)
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(
            have, take, method="marginals")
        todo += [(half, b, have - left), (a, half, left)]


def _shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(id, quota) to (id, shard, quota). A task holds one number per source, for a run of shards."""
    vector = quotas.agg(F.sort_array(F.collect_list(F.struct("id", "quota"))).alias("all"))
    runs = quotas.sparkSession.range(0, shards, GROUP).withColumnRenamed("id", "first")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first, every in zip(part["first"], part["all"], strict=True):
                ids = np.array([x["id"] for x in every], np.int64)
                have = np.array([x["quota"] for x in every], np.int64)
                for shard, quota in split_quotas(have, shards, first,
                                                 min(shards, first + GROUP), seed):
                    yield pd.DataFrame({"id": ids, "shard": shard, "quota": quota})

    return runs.crossJoin(vector).mapInPandas(run, "id long, shard long, quota long").filter(
        "quota > 0")


def _fill(part: pd.DataFrame) -> pd.DataFrame:
    """Rows of a source's cut block that fit into what is left.

    They are taken in hash order; then, while that comes nearer, a row taken gives way to a larger
    one that was not.
    """
    part = part.sort_values(["hash", "size"], kind="stable")
    left, words = float(part["left"].iloc[0]), part["words"].to_numpy()
    taken = np.zeros(len(part), bool)
    for i, w in enumerate(words.tolist()):
        if w <= left:
            taken[i] = True
            left -= w
    while taken.any() and not taken.all():
        own, other = np.flatnonzero(taken), np.flatnonzero(~taken)
        other = other[np.argsort(words[other], kind="stable")]
        best = np.searchsorted(words[other], words[own] + left, side="right") - 1
        gain = np.where(best >= 0, words[other[np.maximum(best, 0)]] - words[own], 0)
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        taken[own[k]], taken[other[best[k]]] = False, True
        left -= gain[k]
    return part.loc[taken, ["id", "hash", "size", "words"]]


def _fill_targets(rows: DataFrame, sources: DataFrame, blocks: DataFrame
                  ) -> tuple[DataFrame, DataFrame]:
    """(id, block, extra, cut): blocks taken once more, whole or in part, and (id, hash, size): the
    rows taken of the latter.

    In every round a source takes the next blocks of its permutation up to one that does not fit,
    and the rows of that one that do. What is left goes on to the next round. Blocks whose smallest
    row does not fit are passed over. A round takes a row or passes a block, so rounds end; they
    end when no row that is left out fits.
    """
    left = sources.select("id", (F.col("target") - F.col("passes") * F.col("source_size")).alias(
        "left"), F.lit(None).cast("long").alias("at"), (F.col("source_size") == 0).alias("empty"))
    fits = (F.col("at").isNull() | (F.col("turn") > F.col("at"))) & (F.col("least") <= F.col("left"))
    # Blocks without words go along on the way to the first cut.
    wordless = F.col("at").isNull() & F.col("least").isNull() & (
        (F.col("left") > 0) | F.col("empty"))
    whole = F.col("before") + F.col("words") <= F.col("left")
    cut = ~whole & (F.col("before") <= F.col("left"))
    rounds, filled = [], []
    while True:
        todo = running_sums(blocks.join(left, "id").filter(fits | wordless), ["id"], "group", "turn",
                            {"before": "words"})
        step = stage(todo.filter(whole | cut).select(
            "id", "block", "turn", whole.alias("extra"), cut.alias("cut"),
            (F.col("left") - F.col("before")).alias("left")), "round")
        last = step.filter("cut").select("id", "block", "left", "turn")
        opened = rows.filter("size > 0").join(last.select("id", "block", "left"), ["id", "block"])
        own = stage(opened.groupBy("id", "hash", "size", "left").agg(F.sum("size").alias("words"))
                    .groupBy("id").applyInPandas(_fill, "id long, hash long, size long, words long"),
                    "cuts")
        rounds.append(step.select("id", "block", "extra", "cut"))
        filled.append(own.select("id", "hash", "size"))
        left = stage(last.join(own.groupBy("id").agg(F.sum("words").alias("words")), "id", "left")
                     .select("id", (F.col("left") - F.coalesce("words", F.lit(0))).alias("left"),
                             F.col("turn").alias("at"), F.lit(False).alias("empty")), "left")
        if blocks.join(left, "id").filter(fits).isEmpty():
            return reduce(DataFrame.unionByName, rounds), reduce(DataFrame.unionByName, filled)


def plan(sized: DataFrame, *, weights=WEIGHTS, share=SHARE, most=MOST_PASSES,
         block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED):
    """From (source, size, hash) rows: the sources, the blocks with their copies and shards, and
    the rows taken of cut blocks."""
    sources = stage(_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")),
                             weights, share, most), "sources")
    sources = sources.withColumns({
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"),
        "passes": F.when(F.col("source_size") > 0, F.floor(
            F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
        "large": F.lit(block_words // LARGE_PART).cast("long")})
    rows = in_blocks(sized, sources)
    turn = F.xxhash64(F.lit(seed + 1), "id", "block")
    blocks = stage(rows.groupBy("id", "block", "blocks", "passes").agg(
        F.sum("size").alias("words"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
        .withColumns({"turn": turn, "group": F.floor(
            (turn / float(2**64) + 0.5) * F.ceil(F.col("blocks") / GROUP))}).drop("blocks"), "blocks")
    taken, cuts = _fill_targets(rows, sources, blocks)
    more = (F.col("extra") | F.col("cut")).cast("long")
    blocks = blocks.join(taken, ["id", "block"], "left").na.fill(
        False, ["extra", "cut"]).withColumns({"one": F.lit(1).cast("long"), "more": more})
    blocks = stage(running_sums(blocks, ["id"], "group", "turn", {
        "rank": "one", "more_rank": "more"}).select(
        "id", "block", "passes", "rank", "more_rank", "more", "extra", "cut"), "ranked")

    # Whole passes come first, then the blocks taken once more. Ranks run over the blocks that
    # hold rows; a hash may leave others empty.
    held = blocks.groupBy("id").agg(F.count(F.lit(1)).alias("held"))
    copies = blocks.join(held, "id").withColumn("n", F.col("passes") + F.col("more")).filter(
        "n > 0").select("id", "block", "passes", "held", "rank", "more_rank",
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    copies = copies.withColumn("index", (F.col("copy") - 1) * F.col("held") + F.when(
        F.col("copy") > F.col("passes"), F.col("more_rank")).otherwise(F.col("rank")))
    wanted = sources.agg(F.sum("target")).first()[0] or 0
    shards = max(1, int(np.ceil(wanted / shard_words)))
    drawn = _shard_quotas(copies.groupBy("id").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    drawn = running_sums(drawn.withColumn("group", F.floor(F.col("shard") / GROUP)), ["id"], "group",
                         "shard", {"first": "quota"})
    places = drawn.select("id", "shard", F.explode(F.sequence(
        "first", F.col("first") + F.col("quota") - 1)).alias("index"))
    # Quotas count the copies there are, and indexes run without gaps.
    placed = copies.join(places, ["id", "index"]).groupBy("id", "block").agg(
        F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("places"))
    blocks = stage(blocks.join(placed, ["id", "block"], "left"), "dealt")
    return sources, blocks, cuts


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (source, size, hash, …) with their source's columns and their block, a negative one
    for a large row."""
    named = sources.withColumnRenamed("source", "_source")
    alone = -1 - F.col("hash").bitwiseAND(F.lit((1 << 63) - 1))
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "block", F.when(F.col("size") > F.col("large"), alone).otherwise(
            F.pmod(F.shiftright("hash", 3), F.col("blocks"))))


def _chosen(rows: DataFrame, sources: DataFrame, blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with target, copies and the shards of the copies."""
    found = in_blocks(rows, sources).join(
        blocks.select("id", "block", "extra", "cut", "places"), ["id", "block"], "left").join(
        cuts.withColumn("_in_cut", F.lit(True)), ["id", "hash", "size"], "left")
    copies = F.col("passes") + (F.coalesce("extra", F.lit(False)) | (
        F.coalesce("cut", F.lit(False)) & F.coalesce("_in_cut", F.lit(False)))).cast("long")
    return found.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(
        F.col("passes") + F.coalesce("extra", F.lit(False)).cast("long"))).withColumn(
        "shards", F.slice(F.transform("places", lambda p: p["shard"]), F.lit(1),
                          F.col("copies").cast("int")))


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                       word_count(body).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(key), body).alias("hash"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
        **settings) -> DataFrame:
    """One row per row of ``docs``: key, size, source_size, target, copies, taken, shards.

    ``copies`` says how often the mix takes the row, ``shards`` where. A null source is a source
    of its own, the last one. Null and empty texts have size 0 and go with the whole passes and
    blocks. Repeated rows share their fate and are counted each; equal hashes go by size. A row is
    taken at most ``most`` times, whole each time; a source's taken words stay below its target,
    by less than the smallest row with words (with its repeats) that the last pass leaves out.
    Everything follows from hashes and seeds, so reruns agree. An empty table gives no rows; other columns are not read.
    """
    sized = stage(_sized(docs, key, text, source, settings.get("seed", SEED)), "sized")
    rows = _chosen(sized, *plan(sized, **settings))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", "copies",
                       (F.col("size") * F.col("copies")).alias("taken"), "shards")


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
          **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of
    ``docs``; a shard's rows lie together, in an order shuffled by a hash."""
    seed = settings.get("seed", SEED)
    sized = stage(_sized(docs, key, text, source, seed), "sized")
    body = F.col(text).cast("string")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                         F.col(source).alias("source"), word_count(body).alias("size"),
                         F.xxhash64(F.lit(seed), F.col(key), body).alias("hash"))
    rows = _chosen(packed, *plan(sized, **settings)).select(
        "row", "hash", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed + 2), "hash", "copy")
    return rows.withColumn("order", order).repartitionByRange("shard", "order").sortWithinPartitions(
        "shard", "order", "copy").select("row.*")


@query("op3_source_mix")
def op3_source_mix(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")
