"""Similarity scores in 0..100 as Column expressions.

Each text score has two halves: features computed once per row of either side before the join,
and a pair expression over the two feature columns after it. A product joined to thousands of
offers is therefore tokenised once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfglass.functions import text as T

# Default price limits in percent, default status thresholds, status texts.
PRICE_DEFAULTS = {"margin": 25.0, "margin_low_limit": 10.0, "margin_upper_limit": 10.0}
THRESHOLD_DEFAULTS = {"matched": 85.0, "review": 70.0}
BULK_THRESHOLDS = {"matched": 89.0, "review": 70.0}
MATCHED, REVIEW, NOT_MATCHED = "Matched", "Review", "Not Matched"

# Smoothed idf of a gram found in one of two texts, ln(3/2) + 1; in both it is 1.
SINGLE_IDF = math.log(1.5) + 1.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


# --- SKU -------------------------------------------------------------------------------------

def sku_features(sku: Column) -> Column:
    """Struct of list entries and the distinct components of each entry."""
    return let(
        T.sku_items(sku),
        lambda items: F.struct(
            items.alias("items"),
            F.transform(items, lambda s: F.array_distinct(T.sku_components(s))).alias("parts"),
        ),
    )


def _shared_share(a: Column, b: Column) -> Column:
    letters = lambda parts: F.length(F.array_join(parts, ""))
    share = letters(F.array_intersect(a, b)) / letters(a) * 100.0
    return F.when((F.size(a) > 0) & (F.size(b) > 0), share).otherwise(0.0)


def sku_score(a: Column, b: Column) -> Column:
    """100 when the lists share an entry, else the best share of a's letters found in b.

    A list without entries has no components either, so the score is 0 then.
    """
    best = F.array_max(
        F.transform(
            a["parts"],
            lambda pa: F.array_max(F.transform(b["parts"], lambda pb: _shared_share(pa, pb))),
        )
    )
    return F.coalesce(F.when(F.arrays_overlap(a["items"], b["items"]), 100.0).otherwise(best),
                      F.lit(0.0))


# --- URL -------------------------------------------------------------------------------------

def url_features(url_text: Column) -> Column:
    return F.array_distinct(T.words(F.coalesce(url_text.cast("string"), F.lit(""))))


def url_score(a: Column, b: Column) -> Column:
    """Jaccard share of the two word sets."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / either * 100.0).otherwise(0.0)


# --- price -----------------------------------------------------------------------------------

def price_config(overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Defaults with overrides; a key that is not a known limit is an error."""
    unknown = set(overrides or {}) - set(PRICE_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown price settings: {sorted(unknown)}")
    return {**PRICE_DEFAULTS, **{k: float(v) for k, v in (overrides or {}).items()}}


def price_features(price: Column) -> Column:
    return price.cast("string").try_cast("double")


def price_score(own: Column, other: Column, config: dict[str, float] | None = None) -> Column:
    """Closeness of ``other`` to the price with margin, inside a window around it."""
    limits = price_config(config)
    target = own + own * (limits["margin"] / 100)
    low = target - own * (limits["margin_low_limit"] / 100)
    high = target + own * (limits["margin_upper_limit"] / 100)

    def side(distance: Column, width: Column) -> Column:
        exact = F.when(distance == 0, 100.0).otherwise(0.0)
        inside = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - distance / width) * 100))
        return F.when(width == 0, exact).otherwise(inside)

    return (
        F.when(own.isNull() | other.isNull(), 0.0)
        .when((own <= 0) | (other <= 0) | F.isnan(own) | F.isnan(other), 0.0)
        .when((other < low) | (other > high), 0.0)
        .when(other <= target, side(target - other, target - low))
        .otherwise(side(other - target, high - target))
    )


# --- character grams -------------------------------------------------------------------------

def gram_features(value: Column) -> Column:
    """Struct of the distinct grams, hashed and sorted, those that repeat with their counts, sorted,
    and Σ count².

    Texts whose normalised form is shorter than two characters get no grams. Repeats stand next to
    each other in the sorted grams, so one pass finds where their runs end, and the cost is n log n
    in the length of the text. Grams are 64-bit hashes, on which set operations are compiled, as is
    ``sort_array``; ``array_sort`` calls a comparator expression for every comparison.
    """
    def sorted_grams(text: Column) -> Column:
        hashed = F.transform(T.text_grams(text), lambda g: F.xxhash64(g))
        no_grams = F.array().cast("array<bigint>")
        return F.when(F.length(text) >= 2, F.sort_array(hashed)).otherwise(no_grams)

    def runs(extra: Column) -> Column:
        """(gram, n) of a sorted list of the second and later occurrences."""
        last = F.size(extra) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (
            F.get(extra, i) != F.get(extra, i + 1)))
        return let(ends, lambda ends: F.transform(ends, lambda p, j: F.struct(
            F.get(extra, p).alias("gram"),
            (p - F.coalesce(F.get(ends, j - 1), F.lit(-1)) + 1).cast("bigint").alias("n"))))

    def counted(grams: Column) -> Column:
        extra = F.filter(grams, lambda g, i: g == F.get(grams, i + 1))
        none = F.array().cast("array<struct<gram:bigint,n:bigint>>")

        def summary(distinct: Column, again: Column) -> Column:
            square = F.aggregate(again, F.size(distinct).cast("bigint"),
                                 lambda acc, r: acc + r["n"] * r["n"] - 1)
            return F.struct(distinct.alias("grams"), again.alias("again"), square.alias("square"))

        repeated = let(extra, lambda e: F.when(F.size(e) > 0, runs(e)).otherwise(none))
        return let(F.array_distinct(grams), lambda distinct: let(
            repeated, lambda again: summary(distinct, again)))

    text = T.normalize_text(F.coalesce(value.cast("string"), F.lit("")))
    return let(let(text, sorted_grams), counted)


def _merged(a: Column, b: Column, value: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``value`` of the counts of the grams that two run-length lists share: in the merged
    list they stand next to each other."""
    def neighbours(both: Column) -> Column:
        each = F.zip_with(both, F.slice(both, F.lit(2), F.size(both)), lambda x, y: F.when(
            x["gram"] == y["gram"], value(x["n"], y["n"])).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda acc, v: acc + v)

    zero = F.lit(0).cast("bigint")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), let(
        F.sort_array(F.concat(a, b)), neighbours)).otherwise(zero)


def gram_score(a: Column, b: Column) -> Column:
    """Cosine of the two tf-idf gram vectors, the idf fitted on just these two texts.

    With common grams weighted 1 and others κ, |a|² = κ²·Σt² + (1−κ²)·Σ_common t². Every common gram
    counts 1 at first; grams that repeat on a side add what is more, found by merging sorted
    run-length lists, so a pair costs no more than sorting its repeated grams.
    """
    kappa = SINGLE_IDF * SINGLE_IDF

    def marks(side: Column, grams: Column) -> Column:
        """Repeated grams of a side that the other one has, with a count of 0: the smaller entry."""
        shared = F.array_intersect(side["again"]["gram"], grams)
        return F.transform(shared, lambda g: F.struct(
            g.alias("gram"), F.lit(0).cast("bigint").alias("n")))

    def cosine(size: Column) -> Column:
        def with_marks(in_a: Column, in_b: Column) -> Column:
            more = lambda side, m: _merged(side["again"], m, lambda zero, n: n - 1)
            surplus = lambda side, m: _merged(
                side["again"], m, lambda zero, n: n * n - 1)
            dot = size + more(a, in_a) + more(b, in_b) + _merged(
                a["again"], b["again"], lambda n, m: (n - 1) * (m - 1))
            norm = lambda side, m: side["square"] * kappa + (
                size + surplus(side, m)) * (1 - kappa)
            return dot * 100.0 / F.sqrt(norm(a, in_a) * norm(b, in_b))

        return F.when(size > 0, let(marks(a, b["grams"]), lambda in_a: let(
            marks(b, a["grams"]), lambda in_b: with_marks(in_a, in_b)))).otherwise(0.0)

    return let(F.size(F.array_intersect(a["grams"], b["grams"])), cosine)


# --- registry --------------------------------------------------------------------------------

class Score:
    """A pair score: features per side, then an expression over the two feature columns."""

    def __init__(self, name: str, features: Callable[[Column], Column],
                 pair: Callable[..., Column], uses_price_config: bool = False):
        self.name = name
        self.features = features
        self.pair = pair
        self.uses_price_config = uses_price_config


SKU = Score("sku", sku_features, sku_score)
URL = Score("url", url_features, url_score)
PRICE = Score("price", price_features, price_score, uses_price_config=True)
GRAMS = Score("grams", gram_features, gram_score)

# (algorithm, data type) -> score. A missing algorithm name is skipped by the pair scorer.
REGISTRY: dict[tuple[str, str], Score] = {}


def register(algorithm: str, string: Score, url: Score, number: Score) -> None:
    """Add or replace an algorithm; the three scores serve the three attribute data types."""
    REGISTRY[(algorithm, "string")] = string
    REGISTRY[(algorithm, "url")] = url
    REGISTRY[(algorithm, "number")] = number


register("tfidf", GRAMS, GRAMS, GRAMS)
register("sku", SKU, SKU, SKU)
register("price", PRICE, PRICE, PRICE)
register("url", URL, URL, URL)
register("custom", SKU, URL, PRICE)
register("tfidf_price", GRAMS, GRAMS, PRICE)


def algorithm(name: str, data_type: str) -> Score | None:
    kind = data_type if data_type in ("number", "url") else "string"
    return REGISTRY.get((name, kind))


def match_status(score: Column, thresholds: dict[str, float] | None = None) -> Column:
    """Matched, Review or Not Matched; a missing or zero threshold means its default."""
    given = thresholds or {}
    matched = given.get("matched") or THRESHOLD_DEFAULTS["matched"]
    review = given.get("review") or THRESHOLD_DEFAULTS["review"]
    return (
        F.when(score >= matched, MATCHED).when(score >= review, REVIEW).otherwise(NOT_MATCHED)
    )
