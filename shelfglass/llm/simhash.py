"""SimHash fingerprints of texts, and search of fingerprints within a Hamming radius.

A text's terms are its pairs of neighbouring words, as often as they occur. Every term's hash
votes on each bit of the fingerprint: one for a set bit, minus one otherwise; the sign of the sum
decides. Fingerprints within a radius are found by block tables: the bits are cut into blocks, and
two fingerprints that differ in few bits differ in very few on some block. They meet in an equi-join
with all values so near to a query's block. Only DataFrame functions are used.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfglass.llm.registry import query, read
from shelfglass.operators.joins import join_prepared
from shelfglass.staging import stage

BITS = 128
#: Ids that one window orders together, and such groups that the next level orders.
GROUP_IDS, GROUP_GROUPS = 64, 1024
#: Hamming radius, at which most texts of a shingle Jaccard of 0.75 are found (see the README), and
#: blocks of the search.
RADIUS, BLOCKS = 20, 7

_PAIR = 0x0000000100000001  # the lowest bits of two 32-bit counters


def terms(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words; of the word itself where there is only one."""
    found = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(found), lambda w: F.when(
        F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)),
                                  lambda a, b: F.xxhash64(a, b))).otherwise(
        F.transform(w, lambda a: F.xxhash64(a))))[0]


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, high, low): the 128 bits of the fingerprint of each row's text, as two longs.

    ``keys`` identify a row. Each pair of bits 32 apart is counted in one long, so 64 sums hold
    the votes; they are combined in the task that reads the text. A bit is set if more than half
    of the terms set it; a text without words has none set.
    """
    votes = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("h0")).withColumn(
        "h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0")))
    counted = votes.groupBy(*keys).agg(F.count("h0").alias("n"), *(
        F.sum(F.shiftrightunsigned(f"h{half}", k).bitwiseAND(F.lit(_PAIR))).alias(f"s{half}_{k}")
        for half in (0, 1) for k in range(32)))

    def word(half: int) -> Column:
        sums = F.array(*(F.col(f"s{half}_{k}") for k in range(32)))
        low = F.aggregate(F.reverse(sums), F.lit(0).cast("long"), lambda acc, s: F.shiftleft(
            acc, 1).bitwiseOR(((s.bitwiseAND(F.lit(0xFFFFFFFF)) * 2) > F.col("n")).cast("long")))
        high = F.aggregate(F.reverse(sums), F.lit(0).cast("long"), lambda acc, s: F.shiftleft(
            acc, 1).bitwiseOR(((F.shiftrightunsigned(s, 32) * 2) > F.col("n")).cast("long")))
        return F.coalesce(F.shiftleft(high, 32).bitwiseOR(low), F.lit(0).cast("long"))

    return counted.select(*keys, word(1).alias("high"), word(0).alias("low"))


def as_text(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(a_high: Column, a_low: Column, b_high: Column, b_low: Column) -> Column:
    return F.bit_count(a_high.bitwiseXOR(b_high)) + F.bit_count(a_low.bitwiseXOR(b_low))


def likeness(a_high: Column, a_low: Column, b_high: Column, b_low: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(a_high, a_low, b_high, b_low) / float(BITS)


def _block(high: Column, low: Column, start: int, end: int) -> Column:
    """Bits ``start`` to ``end`` (exclusive) of the fingerprint, counted from the lowest."""
    parts = []
    for word, first in ((low, 0), (high, 64)):
        a, b = max(start - first, 0), min(end - first, 64)
        if a < b:
            bits = F.shiftrightunsigned(word, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
            parts.append(F.shiftleft(bits, first + a - start))
    return parts[0] if len(parts) == 1 else parts[0].bitwiseOR(parts[1])


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS,
                  blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query_high, query_low, high, low) of distinct fingerprints within ``radius``.

    The bits are cut into blocks, whose allowances plus one add up to ``radius + 1``; so two such
    fingerprints differ on some block in no more bits than its allowance. Each print stands in a
    table per block, and a query looks there for every value within the allowance. Both sides are
    made distinct first; of the tables that find a pair, the first one gives it. A query becomes
    hundreds of values, which no plan foresees: they are made in all tasks and never broadcast.
    """
    if not 3 <= blocks <= 16:
        raise ValueError("blocks must be 3 to 16")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    cut = [(t, a, b, (radius + 1 + t) // blocks - 1) for t, (a, b) in enumerate(
        zip(edges, edges[1:], strict=False))]
    cut = [x for x in cut if x[3] >= 0]

    def keyed(t: int, bits: Column) -> Column:
        return bits.bitwiseXOR(F.lit(t << 64 - 4) if t < 8 else F.lit((t << 64 - 4) - (1 << 64)))

    def changes(width: int, most: int) -> Column:
        return F.array(*(F.lit(sum(1 << k for k in c)).cast("long") for n in range(most + 1)
                         for c in combinations(range(width), n)))

    def probes(t: int, a: int, b: int, most: int) -> Column:
        key = keyed(t, _block(F.col("query_high"), F.col("query_low"), a, b))
        return F.transform(changes(b - a, most), lambda change: key.bitwiseXOR(change))

    asked = queries.select(F.col("high").alias("query_high"), F.col("low").alias(
        "query_low")).distinct()
    tables = prints.select("high", "low").distinct().select("high", "low", F.explode(F.array(*(
        keyed(t, _block(F.col("high"), F.col("low"), a, b)) for t, a, b, _ in cut))).alias("bits"))
    pair = F.col("query_high"), F.col("query_low"), F.col("high"), F.col("low")
    differing = (pair[0].bitwiseXOR(pair[2]), pair[1].bitwiseXOR(pair[3]))
    first = F.coalesce(*(F.when(F.bit_count(_block(*differing, a, b)) <= most, F.lit(t))
                         for t, a, b, most in cut))

    def probed(rows: DataFrame) -> DataFrame:
        return rows.select("query_high", "query_low", F.explode(F.concat(*(
            probes(*x) for x in cut))).alias("bits"))

    return join_prepared(asked, probed, tables, "bits").filter(
        (distance(*pair) <= radius)
        & (first == F.shiftrightunsigned("bits", 64 - 4))).select(*pair)


def with_next_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, place, ghost, id, text, next_text): every row with the next row's text, by id.

    Ids are dealt to buckets of ``GROUP_IDS`` values. The first row of a bucket is copied to the
    bucket before (the very first to the last one), marked as a ghost, so that a window over each
    bucket sees all it needs. The list of buckets is ordered in two levels.
    """
    bucket = F.coalesce(F.floor(F.col("id") / GROUP_IDS), F.lit(-(1 << 62))).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn(
        "bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.min("id").alias("first")).withColumn(
        "group", F.floor(F.col("bucket") / GROUP_GROUPS))
    groups = firsts.groupBy("group").agg(F.max("bucket").alias("last")).withColumn(
        "every", F.lit(0))
    order = Window.partitionBy("every").orderBy("group")
    groups = groups.select("group", F.coalesce(
        F.lag("last").over(order), F.max("last").over(Window.partitionBy("every"))).alias("last"))
    links = stage(firsts.withColumn("before", F.lag("bucket").over(
        Window.partitionBy("group").orderBy("bucket"))).join(groups, "group").select(
        "bucket", "first", F.coalesce("before", "last").alias("before")), "links")
    copies = F.when(F.col("id").eqNullSafe(F.col("first")), F.array(
        F.struct("bucket", F.lit(False).alias("ghost")),
        F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost")))).otherwise(
        F.array(F.struct("bucket", F.lit(False).alias("ghost"))))
    placed = rows.join(links, "bucket").select("id", "text", F.explode(copies).alias("at")).select(
        "at.bucket", "at.ghost", "id", "text")
    # Equal texts have equal hashes, and the hash is cheaper to sort by than the text.
    order = Window.partitionBy("bucket").orderBy("ghost", "id", F.xxhash64("text"), "text")
    return placed.select("bucket", F.row_number().over(order).alias("place"), "ghost", "id", "text",
                         F.lead("text").over(order).alias("next_text"))


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    """Fingerprints of every text, of its edited text, and their likeness; and for every 20th
    document (by id) the number of other documents within the Hamming radius of its print."""
    rows = with_next_text(read(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), tail))
    both = F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("which"), "text"))).otherwise(
        F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("which"), edited.alias("text"))))
    texts = rows.select("bucket", "place", "ghost", "id", F.explode(both).alias("t")).select(
        "bucket", "place", "ghost", "id", "t.which", "t.text",
        F.length("t.text").cast("long").alias("n_chars"),
        F.when(F.col("t.which") == 1, F.sha2(F.col("t.text"), 256)).alias("sha"))
    keys = ["bucket", "place", "ghost", "id", "which", "n_chars", "sha"]
    prints = fingerprints(texts, keys, "text").groupBy("bucket", "place").agg(*(
        F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{c}_{w}") for w in (0, 1)
        for c in ("high", "low", "n_chars", "sha")), F.max("ghost").alias("ghost"),
        F.max("id").alias("id"))
    order = Window.partitionBy("bucket").orderBy("place")
    prints = stage(prints.withColumns({
        "next_high": F.lead("high_0").over(order), "next_low": F.lead("low_0").over(order)}).filter(
        "NOT ghost").select("id", "n_chars_0", "sha_1", "high_0", "low_0", "high_1", "low_1",
                            "next_high", "next_low"), "prints")
    sizes = prints.groupBy(F.col("high_0").alias("high"), F.col("low_0").alias("low")).agg(
        F.count(F.lit(1)).alias("copies"))
    asked = prints.filter("id % 20 = 0").select(F.col("high_0").alias("high"),
                                                F.col("low_0").alias("low"))
    near = within_radius(asked, sizes).join(sizes, ["high", "low"]).groupBy(
        F.col("query_high").alias("high_0"), F.col("query_low").alias("low_0")).agg(
        (F.sum("copies") - 1).alias("others"))
    me = (F.col("high_0"), F.col("low_0"))
    return prints.join(near, ["high_0", "low_0"], "left").select(
        F.col("id").alias("doc_id"), F.col("n_chars_0").alias("n_chars"),
        F.col("sha_1").alias("edited_sha256"), as_text(*me).alias("fingerprint"),
        as_text(F.col("high_1"), F.col("low_1")).alias("edited_fingerprint"),
        likeness(*me, F.col("high_1"), F.col("low_1")).alias("near_edited"),
        likeness(*me, F.col("next_high"), F.col("next_low")).alias("near_next"),
        F.when(F.col("id") % 20 == 0, F.col("others")).alias("n_near"))
