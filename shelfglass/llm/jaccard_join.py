"""Documents that share most of their word shingles, joined exactly by T-occurrence search.

Two sets link when their Jaccard similarity reaches a threshold, so they share at least T
shingles, T growing with their sizes. Following DivideSkip, a set's T - 1 most frequent shingles
(its longest inverted lists) are set aside: a partner must occur on one of the other, short lists.

1. All texts are read once for their sets' sizes and hashes, and for the frequent shingles.
2. Short lists are cut where the sizes of their sets leave a gap that no link bridges. Sets on the
   same stretch of a list belong to a group named after the smallest one; most lists of similar
   sets name the same group, and two sets that link meet in at least one.
3. Groups are cut into blocks, and every pair of blocks is searched in a task: each set's short
   lists are merged and counted, and the long ones are probed by binary search for the candidates
   left (or merged too, where that is cheaper), until the overlap with all candidates is known.
   Two sets that share several groups are looked at in one only, that of the smallest name.
4. A pair of blocks gives one row per set: its links there, and a member of its component there.

Copies are one set throughout. No pair is ever a row, and nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfglass.llm.registry import query, read
from shelfglass.llm.shingles import SLICE_BYTES, set_hash, shingle_sets
from shelfglass.llm.slots import slot, slots_of
from shelfglass.llm.wordtokens import frugal, parts
from shelfglass.operators.components import component_labels
from shelfglass.operators.joins import null_safe_join
from shelfglass.staging import stage

#: Similarity, in hundredths.
PERCENT = 75
#: Frequent shingles known to all tasks, shingles that are counted together in a task, and postings
#: of a bucket of short lists.
FREQUENT, COUNTED_SHINGLES, BUCKET_POSTINGS = 1 << 18, 1_000_000, 1 << 18
#: Sets of a block in a small group; blocks that a group is cut into before blocks grow; sets and
#: shingles of a block at most; shingles of the blocks that one task searches.
BLOCK_SETS, FEW_BLOCKS, MOST_SETS, MOST_SHINGLES, TASK_SHINGLES = 256, 16, 2048, 500_000, 100_000


def required(sizes, percent: int):
    """The least overlap of a set of that size with any set it links with."""
    return -(-sizes * percent // 100)


def _read_sets(docs: DataFrame) -> DataFrame:
    """Rows of keys, sizes and hashes of sets, and rows of the shingles that occur twice or more in
    a stretch of the input, with their counts."""
    kind = docs.schema["key"].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, key_type = [], 0, None

        def row(keys, others, sizes, nodes, shingles, counts):
            return pa.RecordBatch.from_arrays([
                pa.array([keys], pa.list_(key_type)),
                *(pa.array([x], longs) for x in (others, sizes, nodes, shingles, counts))],
                ["keys", "others", "sizes", "nodes", "shingles", "counts"])

        def repeated():
            every = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            counts = np.diff(np.r_[first, len(every)])
            often = counts > 1
            return row([], [], [], [], every[first[often]].view(np.int64), counts[often])

        for part in parts(batches, 2, SLICE_BYTES):
            key_type = part.column(0).type
            sets = list(shingle_sets(part.column(2)))
            yield row(part.column(0).to_pylist(), part.column(1).to_pylist(), [len(s) for s in sets],
                      [set_hash(s) if len(s) else None for s in sets], [], [])
            held += sets
            total += sum(map(len, sets))
            if total > COUNTED_SHINGLES:
                yield repeated()
                held, total = [], 0
        if total:
            yield repeated()

    return stage(docs.select("key", "other", "text").mapInArrow(
        frugal(run), f"keys array<{kind}>, others array<bigint>, sizes array<bigint>, "
                     "nodes array<bigint>, shingles array<bigint>, counts array<bigint>"), "sets",
                 small_batches=True)


def _frequent(read_sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the rank of their frequency (more is higher).

    They only order the lists, so which ones are known changes no result.
    """
    rows = read_sets.select(F.explode(F.arrays_zip("shingles", "counts")).alias("x")).groupBy(
        F.col("x.shingles").alias("shingle")).agg(F.sum("x.counts").alias("n")).filter(
        "n >= 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    # As Arrow: as rows they would fill the driver with objects.
    found = stage(rows, "frequent").toArrow()
    shingles = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["n"].to_numpy().astype(np.float64)[order]


def short_lists(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int
                ) -> np.ndarray:
    """All shingles of a set but the T - 1 most frequent; equal frequencies go by hash."""
    keep = len(tokens) - int(required(len(tokens), percent)) + 1
    known, counts = frequent
    rank = np.zeros(len(tokens))
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        hit = known[at] == tokens
        rank[hit] = counts[at[hit]]
    return tokens[np.lexsort((tokens, rank))[:keep]]


def _meetings(docs: DataFrame, frequent, percent: int, postings: int) -> DataFrame:
    """(node, center): the groups that sets meet in, from the merged short lists.

    Let t be the first shingle that two linked sets share, in the order of the lists. All they
    share comes after it, so t stands early enough in both, and in the smaller one among so few
    that only such sets may lead a stretch.
    """
    bits = max(6, math.ceil(math.log2(max(1, postings / BUCKET_POSTINGS))))
    shift = np.uint64(64 - bits)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 0, SLICE_BYTES):
            seen, tokens, nodes, sizes = set(), [], [], []
            for s in shingle_sets(part.column(0)):
                node = set_hash(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    tokens.append(short_lists(s, frequent, percent))
                    nodes.append(np.full(len(tokens[-1]), node))
                    size = np.full(len(tokens[-1]), -len(s), np.int32)
                    size[:len(s) + 1 + (-2 * percent * len(s)) // (100 + percent)] *= -1
                    sizes.append(size)
            if not tokens:
                continue
            t, v, n = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
            order = np.argsort(t, kind="stable")
            t, v, n = t[order], v[order], n[order]
            cuts = np.searchsorted(t >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
            full = [(i, x, y) for i, (x, y) in enumerate(zip(
                cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in full], pa.int64()),
                *(pa.array([z[x:y].tobytes() for _, x, y in full], pa.binary())
                  for z in (t, v, n))], ["bucket", "t", "v", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.frombuffer(x.as_buffer(), k) for x in batch.column(c)]
                for batch in batches
                for c, k in (("t", np.uint64), ("v", np.int64), ("n", np.int32))]
        t, v, n = (np.concatenate([x for some in held[i::3] for x in some]) for i in range(3))
        held.clear()
        leads, n = n > 0, np.abs(n).astype(np.int64)
        order = np.lexsort((v, n, t))
        t, v, n, leads = t[order], v[order], n[order], leads[order]
        once = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])]
        t, v, n, leads = t[once], v[once], n[once], leads[once]
        # The last set up to here, on the same list, that may be the smaller of a pair.
        at = np.arange(len(t))
        lead = np.maximum.accumulate(np.where(leads, at, -1))
        led = (lead >= 0) & (t[lead] == t) & (100 * n[lead] >= percent * n)
        t, v, n = t[led], v[led], n[led]
        on = (t[1:] == t[:-1]) & (100 * n[:-1] >= percent * n[1:])
        start = np.maximum.accumulate(np.where(np.r_[True, ~on][:len(t)], np.arange(len(t)), 0))
        several = np.bincount(start, minlength=len(t))[start] > 1
        pairs = np.unique(np.c_[v[several], v[start[several]]], axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["node", "center"])

    return docs.select("text").mapInArrow(
        frugal(post), "bucket bigint, t binary, v binary, n binary").groupBy("bucket").applyInArrow(
        meet, "node bigint, center bigint").distinct()


class Lists:
    """Inverted lists of the sets of a block: for each shingle, the numbers of its sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        self.tokens = tokens[first]
        self.bounds = np.r_[first, len(tokens)]

    def _merged(self, lists: np.ndarray) -> np.ndarray:
        """Occurrences of every set on the lists."""
        first, n = self.bounds[lists], self.bounds[lists + 1] - self.bounds[lists]
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def linked(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets that link with the one of ``tokens``."""
        least = int(required(len(tokens), percent))
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        lists = at[self.tokens[at] == tokens]
        if len(lists) < least:
            return np.empty(0, np.int64)
        n = self.bounds[lists + 1] - self.bounds[lists]
        lists = lists[np.argsort(n, kind="stable")]
        n = np.sort(n)
        # Set aside the lists that hold many of the block's sets, at most T - 1 of them.
        aside = min(least - 1, int((n > max(4, len(self.sizes) // 8)).sum()))
        short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
        counts = self._merged(short)
        found = np.flatnonzero(counts >= least - aside)
        if not len(found):
            return found
        if len(found) * aside * 64 < n[len(lists) - aside:].sum():
            overlap = counts[found]
            for k in long.tolist():
                members = self.owner[self.bounds[k]:self.bounds[k + 1]]
                where = np.minimum(np.searchsorted(members, found), len(members) - 1)
                overlap = overlap + (members[where] == found)
        else:
            overlap = (counts + self._merged(long))[found] if aside else counts[found]
        union = len(tokens) + self.sizes[found] - overlap
        return found[100 * overlap >= percent * union]


def search_block(left: list[np.ndarray], left_copies: np.ndarray, right: list[np.ndarray] | None,
                 right_copies: np.ndarray | None, percent: int, seen=None
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Links of the sets of two blocks with each other (of one block, if ``right`` is None).

    Per set of ``left``, then of ``right``: the copies of the sets it links with, and the number
    of a set of its component. ``seen(i)`` tells which sets of the other block the i-th set of
    ``left`` meets elsewhere.
    """
    same = right is None
    lists = Lists(left if same else right)
    first = 0 if same else len(left)
    copies = left_copies if same else np.r_[left_copies, right_copies]
    label, links = np.arange(len(copies)), np.zeros(len(copies), np.int64)
    for i, tokens in enumerate(left):
        met = lists.linked(tokens, percent)
        if seen is not None and len(met):
            met = met[~seen(i)[met]]
        met = met + first
        met = met[met != i]
        if not len(met):
            continue
        links[i] += copies[met].sum()
        if not same:
            links[met] += copies[i]
        for other in np.unique(label[met]):
            if other != label[i]:
                label[label == other] = label[i]
    return links, label


def _seen_elsewhere(center: int, left: list, right: list):
    """Which sets of ``right`` share a group of a smaller name with a set of ``left``."""
    among: dict[int, np.ndarray] = {}
    for j, centers in enumerate(right):
        for c in centers:
            if c < center:
                among.setdefault(c, np.zeros(len(right), bool))[j] = True
    none = np.zeros(len(right), bool)

    def seen(i: int) -> np.ndarray:
        shared = [among[c] for c in left[i] if c in among]
        return np.logical_or.reduce(shared) if shared else none

    return seen


def _members(nodes: DataFrame, meetings: DataFrame) -> DataFrame:
    """(node, key, other, n, copies, centers, center, home, blocks, block): sets of groups, in blocks
    by hash. Groups with the same ``home`` are searched in one task: those of one block that overlap,
    as far as their smallest centers tell, while they hold a block's shingles together."""
    own = meetings.groupBy("node").agg(F.sort_array(F.collect_set("center")).alias("centers"))
    members = own.join(nodes, "node").withColumn("center", F.explode("centers"))
    sizes = members.groupBy("center").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"),
        F.min(F.element_at("centers", 1)).alias("home"))
    few = F.least(F.ceil(F.col("sets") / BLOCK_SETS), F.lit(FEW_BLOCKS))
    blocks = F.greatest(few, F.ceil(F.col("sets") / MOST_SETS),
                        F.ceil(F.col("total") / MOST_SHINGLES))
    sizes = sizes.withColumn("blocks", blocks.cast("int"))
    homes = sizes.filter("blocks = 1").groupBy("home").agg(F.sum("total").alias("held"))
    together = (F.col("blocks") == 1) & (F.col("held") <= MOST_SHINGLES)
    sizes = sizes.join(homes, "home", "left").select(
        "center", "blocks", F.when(together, F.col("home")).otherwise(F.col("center")).alias("home"))
    return members.join(sizes, "center").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _sendings(members: DataFrame, tasks: int) -> DataFrame:
    """(key, other, node, copies, centers, task, cells): the pairs of blocks (center, low, high) that a
    set takes part in, by the task that searches them; its text goes to a task once."""
    cells = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    return cells.select(
        "key", "other", "node", "copies", "centers",
        F.pmod(F.xxhash64("home", low, high), F.lit(tasks)).alias("task"),
        F.struct("center", low.alias("low"), high.alias("high"),
                 (F.col("block") <= F.col("with")).alias("left")).alias("cell")).repartition(
        "key", "other").groupBy("key", "other", "node", "task").agg(
        F.first("copies").alias("copies"), F.first("centers").alias("centers"),
        F.collect_list("cell").alias("cells"))


def _packed(docs: DataFrame) -> DataFrame:
    """(key, other, packed, length): each text by itself in a zstd frame, and its bytes. Texts are
    shuffled twice from here, and zstd leaves two thirds of what the shuffle's own codec does."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for part in parts(batches, 2, SLICE_BYTES):
            raw = [t or b"" for t in part.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1),
                pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary()),
                pa.array(list(map(len, raw)), pa.int64())], ["key", "other", "packed", "length"])

    return docs.select("key", "other", "text").mapInArrow(
        frugal(run), f"key {kind}, other bigint, packed binary, length bigint")


def _unpacked(packed: pa.ChunkedArray, length: pa.ChunkedArray) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(t, n, asbytes=True) for t, n in zip(
        packed.to_pylist(), length.to_pylist(), strict=True)], pa.large_binary()).cast(
        pa.large_string())


def _searched(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, links, other): what every pair of blocks of a group finds."""
    total = members.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    tasks = max(64, math.ceil(total / TASK_SHINGLES))
    own = _sendings(members, tasks).groupBy("key", "other").agg(
        F.collect_list(F.struct("node", "copies", "centers", "task", "cells")).alias("m"))
    names = ["key", "other"]  # a null key is found by the hash of its text
    held = slots_of(members, *map(F.col, names))
    # Not by broadcast: a plan counts one element for each of the arrays.
    asked = docs.join(held, slot(*map(F.col, names)) == F.col("slot"), "left_semi")
    texts = null_safe_join(_packed(asked), own.hint("merge"), names).select(
        "packed", "length", F.explode("m").alias("m")).select("packed", "length", "m.*")

    def search(part: pa.Table) -> pa.Table:
        sets = list(shingle_sets(_unpacked(part["packed"], part["length"])))
        node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        centers, groups = part["centers"].to_pylist(), {}
        # A key may come with several texts, and a text twice; a set belongs to a group once.
        for i, cells in enumerate(part["cells"].to_pylist()):
            if set_hash(sets[i]) == node[i]:
                for c in cells:
                    groups.setdefault((c["center"], c["low"], c["high"]), {})[node[i]] = (
                        i, c["left"])
        out = []
        for (center, low, high), mine in groups.items():
            left = [i for i, is_left in mine.values() if is_left]
            right = [i for i, is_left in mine.values() if not is_left]
            alone = low == high
            if not left or not (right or alone):
                continue
            other = left if alone else right
            seen = _seen_elsewhere(center, [centers[i] for i in left],
                                   [centers[i] for i in other])
            links, label = search_block(
                [sets[i] for i in left], copies[left], None if alone else [sets[i] for i in right],
                None if alone else copies[right], percent, seen)
            nodes = node[left if alone else left + right]
            out.append(np.c_[nodes, links, nodes[label]])
        found = np.concatenate(out) if out else np.empty((0, 3), np.int64)
        return pa.table(list(found.T), names=["node", "links", "other"])

    return texts.groupBy("task").applyInArrow(search, "node bigint, links bigint, other bigint")


def link_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                   percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, n_links.

    Documents link when ``100 * intersection >= percent * union`` of their sets of five-word
    shingles; ``component_id`` is the smallest key reachable by links, ``n_links`` the number of
    other rows linked. A text with fewer than five words has its whole sequence as one shingle. A
    null text, or one without words, has an empty set and links with nothing, not even another
    such row. Repeated rows link with each other; a null key links by its text and is never the
    smallest; other columns are not read. An empty table gives no rows. ``percent`` is 1 to 100.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn(
        "other", F.when(F.col("key").isNull(), F.xxhash64("text")).otherwise(0))
    sets = _read_sets(docs)
    rows = sets.select(F.explode(F.arrays_zip("keys", "others", "sizes", "nodes")).alias("x")).select(
        F.col("x.keys").alias("key"), F.col("x.others").alias("other"), F.col("x.sizes").alias("n"), F.col("x.nodes").alias("node"))
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "other"))
    nodes = stage(rows.filter("n > 0").groupBy("node").agg(
        first.alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")).select(
        "node", "first.key", "first.other", "n", "copies"), "nodes")
    postings = nodes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    meetings = stage(_meetings(docs, _frequent(sets), percent, postings), "meetings", small_batches=True)
    members = stage(_members(nodes, meetings), "members")
    found = stage(_searched(docs, members, percent), "links", small_batches=True)
    joined = component_labels(found.filter("node <> other").select(
        F.col("node").alias("u"), F.col("other").alias("v")), [])
    smallest = nodes.join(joined, "node").groupBy("label").agg(F.min("key").alias("component_id"))
    per_node = nodes.select("node", "copies", "key").join(
        joined.join(smallest, "label").select("node", "component_id"), "node", "left").join(
        found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").select(
        "node", F.coalesce("component_id", "key").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(stage(per_node, "found"), "node", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    return link_documents(read(spark, sf_dir, "documents"))
