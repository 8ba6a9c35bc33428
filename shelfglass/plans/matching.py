"""Own products against competitor offers: pair scores, summaries, saved scores, decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.functions import scores as S
from shelfglass.functions.predicates import all_of, any_of
from shelfglass.functions.text import comparable_url
from shelfglass.operators.joins import join_prepared
from shelfglass.operators.keyed import (
    apply_updates, delete_keys, marked, merge, set_where, with_new_ids,
)
from shelfglass.plans.products import field_values
from shelfglass.staging import stage


@dataclass(frozen=True)
class Attribute:
    attribute_id: int
    name: str
    weight: float
    competitor_attribute: str
    data_type: str = "string"


@dataclass(frozen=True)
class MatchConfig:
    """Scoring set-up. ``grouping`` lets own attributes that share a competitor attribute compete;
    ``perfect`` lifts a pair with one full group score to 100; ``zero_rule`` drops a pair whose
    every attribute scores 0; ``digits`` None leaves totals unrounded."""

    attributes: tuple[Attribute, ...]
    algorithms: tuple[str, ...] = ("tfidf",)
    selected: tuple[str, ...] | None = None
    weights: Mapping[str, float] | None = None
    thresholds: Mapping[str, float] | None = None
    prices: Mapping[str, float] | None = None
    grouping: bool = True
    perfect: bool = True
    zero_rule: bool = True
    digits: int | None = 2
    known: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        # Algorithms without a registered score are skipped.
        object.__setattr__(self, "known", tuple(
            a for a in self.algorithms if S.algorithm(a, "string")))
        S.price_config(dict(self.prices or {}))

    def chosen(self) -> list[Attribute]:
        return [a for a in self.attributes if self.selected is None or a.name in self.selected]

    def weight(self, attribute: Attribute) -> float:
        if self.weights is None:
            return attribute.weight
        return float(self.weights.get(attribute.name, 0))

    def groups(self) -> list[list[Attribute]]:
        """Chosen attributes by competitor attribute, or each on its own."""
        if not self.grouping:
            return [[a] for a in self.chosen()]
        found: dict[str, list[Attribute]] = {}
        for a in self.chosen():
            found.setdefault(a.competitor_attribute or a.name, []).append(a)
        return list(found.values())


def config_from(attributes: DataFrame, **options) -> MatchConfig:
    """Set-up from the attribute table (a handful of rows): weights, limits and thresholds."""
    rows = attributes.orderBy("attribute_id").collect()
    of = lambda kind: [r for r in rows if r.attribute_type == kind]
    scoring = tuple(Attribute(r.attribute_id, r.attribute_name, float(r.default_weightage),
                              r.competitor_attribute, r.data_type) for r in of("default"))
    defaults = {"prices": {r.attribute_name: float(r.default_weightage) for r in of("price")},
                "thresholds": {r.attribute_name: float(r.default_weightage)
                               for r in of("status")}}
    return MatchConfig(attributes=scoring, **{**defaults, **options})


def bulk(config: MatchConfig) -> MatchConfig:
    """Bulk preset: fixed thresholds, no override for full scores, unrounded totals."""
    return replace(config, thresholds=S.BULK_THRESHOLDS, perfect=False, zero_rule=False,
                   digits=None)


def ungrouped(config: MatchConfig) -> MatchConfig:
    """Every attribute counts by itself, without overrides."""
    return replace(config, grouping=False, perfect=False, zero_rule=False)


# --- inputs ----------------------------------------------------------------------------------

def selected_products(products: DataFrame, brands=None, categories=None, types=None,
                      product_ids: Sequence | DataFrame | None = None) -> DataFrame:
    """Restricted products; product ids replace the other restrictions."""
    if isinstance(product_ids, DataFrame):
        return products.join(product_ids, "product_id", "left_semi")
    if product_ids:
        return products.filter(F.col("product_id").isin(list(product_ids)))
    return products.filter(all_of(any_of(brands, "brand"), any_of(categories, "category"),
                                  any_of(types, "product_type")))


def product_inputs(products: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Ids, descriptions and scoring attributes; missing texts are empty, URLs comparable."""
    texts = [c for c in ("name", "brand", "category", "product_type") if c in products.columns]
    extra = [F.col("url").alias("url_display")] if "url" in attributes else []
    return products.select(
        "product_id", "system_product_id",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts], *extra,
        *[_input(products, a).alias(a) for a in attributes])


def _input(frame: DataFrame, name: str) -> Column:
    if name not in frame.columns:
        return F.lit("")
    value = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return comparable_url(value) if name == "url" else value


def competitor_inputs(competitors: DataFrame, products: DataFrame, attributes: Sequence[str]
                      ) -> DataFrame:
    """Offers of the given products only, attributes as competitor_<attribute>."""
    own = competitors.join(products, "system_product_id", "left_semi")
    extra = [F.col("url").alias("competitor_url_display")] if "url" in attributes else []
    return own.select(
        "system_product_id", "competitor_product_id", "competitor_id", *extra,
        *[_input(competitors, a).alias(f"competitor_{a}") for a in attributes])


# --- pair scores -----------------------------------------------------------------------------

def _needs(config: MatchConfig) -> tuple[dict, dict]:
    """Feature columns per side: name -> (source column, score)."""
    own, other = {}, {}
    for a in config.attributes:
        for name in config.known:
            score = S.algorithm(name, a.data_type)
            own[f"_p_{a.name}_{score.name}"] = (a.name, score)
            other[f"_c_{a.competitor_attribute}_{score.name}"] = (
                f"competitor_{a.competitor_attribute}", score)
    return own, other


def _with_features(frame: DataFrame, needs: dict) -> DataFrame:
    columns = {k: s.features(F.col(c) if c in frame.columns else F.lit("").cast("string"))
               for k, (c, s) in needs.items()}
    return frame.withColumns(columns)


def pair_scores(products: DataFrame, competitors: DataFrame, config: MatchConfig) -> DataFrame:
    """Every product x its own offers with <attribute>_<algorithm>, final_score and status.

    Text features of a product are computed once, before the join. Those of an offer are computed
    behind it: an offer belongs to one product, and so the shuffle carries its short texts instead of
    token lists. The join key is the product, so there is no cross product.
    """
    own, other = _needs(config)
    pairs = join_prepared(products, lambda rows: _with_features(rows, own), competitors,
                          "system_product_id")
    return add_scores(_with_features(pairs, other), config).drop(*own, *other)


def add_scores(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    prices = dict(config.prices or {})

    def raw(a: Attribute, algorithm: str) -> Column:
        score = S.algorithm(algorithm, a.data_type)
        mine = F.col(f"_p_{a.name}_{score.name}")
        theirs = F.col(f"_c_{a.competitor_attribute}_{score.name}")
        if score.uses_price_config:
            return score.pair(mine, theirs, prices)
        return score.pair(mine, theirs)

    names = {a.name: [f"{a.name}_{g}" for g in config.known] for a in config.attributes}
    scored = pairs.withColumns({f"{a.name}_{g}": raw(a, g)
                                for a in config.attributes for g in config.known})

    def average(a: Attribute) -> Column:
        columns = [F.col(c) for c in names[a.name]]
        return reduce(add, columns) / len(columns) if columns else F.lit(0.0)

    best = [average(g[0]) if len(g) == 1 else F.greatest(*[average(a) for a in g])
            for g in config.groups()]
    weights = [config.weight(g[0]) for g in config.groups()]
    total = sum(weights)
    weighted = reduce(add, [b * w for b, w in zip(best, weights, strict=True)], F.lit(0.0))
    final = weighted / total if total > 0 else F.lit(0.0)
    if config.perfect and best:
        final = F.when(reduce(lambda x, y: x | y, [b >= 100.0 for b in best]), 100.0
                       ).otherwise(final)
    every = [F.col(c) for columns in names.values() for c in columns]
    if config.zero_rule and every:
        final = F.when(reduce(lambda x, y: x & y, [c == 0 for c in every]), 0.0).otherwise(final)
    if config.digits is not None:
        final = F.round(final, config.digits)
        rounded = {c: F.round(c, config.digits) for columns in names.values() for c in columns}
    else:
        rounded = {}
    scored = scored.withColumn("final_score", final).withColumns(rounded)
    return scored.withColumn("status", S.match_status(
        F.col("final_score"), dict(config.thresholds or {})))


def attribute_average(attribute: Attribute, config: MatchConfig) -> Column:
    columns = [F.col(f"{attribute.name}_{g}") for g in config.known]
    return F.round(reduce(add, columns) / len(columns), 2) if columns else F.lit(0.0)


def run_pairs(products: DataFrame, competitors: DataFrame, config: MatchConfig, **filters
              ) -> DataFrame:
    """Selection -> inputs -> pair scores."""
    names = [a.name for a in config.attributes]
    other = sorted({a.competitor_attribute for a in config.attributes if a.competitor_attribute})
    chosen = product_inputs(selected_products(products, **filters), names)
    return pair_scores(chosen, competitor_inputs(competitors, chosen, other), config)


# --- summaries -------------------------------------------------------------------------------

def match_summary(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """Per product: best score, offers, first values by offer id, counts per status."""
    texts = [c for c in ("sku", "part_number", "brand", "category", "product_type", "name")
             if c in pairs.columns]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("competitor_product_id"))).alias(c)
             for c in texts]
    status = F.col("status")
    summary = pairs.groupBy("system_product_id").agg(
        F.max("final_score").alias("max_score"), F.count("final_score").alias("total_items"),
        *first, F.count_if(status == S.MATCHED).alias("matched_count"),
        F.count_if(status == S.REVIEW).alias("review_count"),
        F.count_if(status == S.NOT_MATCHED).alias("not_matched_count"))
    return summary.withColumn("status", S.match_status(
        F.col("max_score"), dict(config.thresholds or {}))).withColumn(
        "max_score", F.coalesce(F.round("max_score", 2), F.lit(0.0)))


def match_statistics(summary: DataFrame) -> DataFrame:
    status = F.col("status")
    return summary.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status == S.MATCHED).alias("matched"),
        F.count_if(status == S.REVIEW).alias("review"),
        F.count_if(status == S.NOT_MATCHED).alias("not_matched"))


def best_offers(pairs: DataFrame) -> DataFrame:
    """Best offer per product; the lowest offer id wins a tie."""
    rank = F.struct(F.col("final_score"), -F.col("competitor_product_id"))
    best = F.max_by(F.struct("competitor_product_id", "final_score", "status"), rank)
    return pairs.groupBy("system_product_id").agg(best.alias("b")).select(
        "system_product_id", "b.competitor_product_id", "b.final_score", "b.status")


def with_offers(products: DataFrame, competitors: DataFrame) -> DataFrame:
    return products.join(competitors, "system_product_id", "left_semi")


def filter_options(products: DataFrame, competitors: DataFrame, scores: DataFrame, brands=None,
                   categories=None) -> DataFrame:
    """Products with offers per brand, category and type: complete, partial or none scored."""
    scored = scores.filter(F.col("total_score").isNotNull()).select(
        "system_product_id").distinct().withColumn("_scored", F.lit(True))
    rows = with_offers(products, competitors).join(scored, "system_product_id", "left")
    by_brand, by_category = any_of(brands, "brand"), any_of(categories, "category")
    filled = {f: F.col(f) != "" for f in ("brand", "category", "product_type")}
    chosen = {"brand": filled["brand"], "category": all_of(by_brand, filled["category"]),
              "product_type": all_of(by_brand, by_category, filled["product_type"])}
    # Each product counts once for a value, however many rows it has.
    per_product = field_values(rows.select("product_id", "_scored", *filled), chosen).groupBy(
        "field", "value", "product_id").agg(F.max("_scored").alias("_scored"))
    n, done = F.col("total_count"), F.col("scored_count")
    return per_product.groupBy("field", "value").agg(
        F.count("product_id").alias("total_count"),
        F.count(F.when(F.col("_scored"), F.col("product_id"))).alias("scored_count")).select(
        "field", "value", "total_count", "scored_count",
        F.when((done == n) & (done > 0), "complete").when(done > 0, "partial")
        .otherwise("none").alias("status"))


def count_with_offers(products: DataFrame, competitors: DataFrame, **filters) -> DataFrame:
    return with_offers(selected_products(products, **filters), competitors).agg(
        F.countDistinct("product_id").alias("count"))


# Histogram labels in order.
SCORE_RANGES = [f"{i}-{i + 10}" for i in range(0, 100, 10)]


def score_distribution(products: DataFrame, scores: DataFrame, statuses=None, **filters
                       ) -> DataFrame:
    """Scores per ten points; the top range takes 90 and above as well as unscored rows."""
    rows = scores.join(selected_products(products, **filters), "system_product_id", "left_semi")
    if statuses:
        rows = rows.filter(F.col("score_status").isin(list(statuses)))
    s = F.col("total_score")
    position = F.when(s < 10, 0).when(s < 90, F.floor(s / 10).cast("int")).otherwise(9)
    counted = rows.groupBy(position.alias("position")).agg(
        F.countDistinct("score_id").alias("_n"))
    ranges = products.sparkSession.createDataFrame(
        list(enumerate(SCORE_RANGES)), "position int, range string")
    return ranges.join(counted, "position", "left").select(
        "position", "range", F.coalesce("_n", F.lit(0)).alias("count")).orderBy("position")


# --- saved scores ----------------------------------------------------------------------------

def top_scores(products: DataFrame, scores: DataFrame, competitors: DataFrame, statuses=None,
               **filters) -> DataFrame:
    """Per product the best saved score, its status and offer, and the number of offers."""
    rank = F.struct("total_score", -F.col("competitor_product_id"))
    best = scores.filter(F.col("total_score").isNotNull()).groupBy("system_product_id").agg(
        F.max_by(F.struct("total_score", "score_status", "competitor_product_id"), rank
                 ).alias("b")).select(
        "system_product_id", F.col("b.total_score").alias("max_score"),
        F.col("b.score_status").alias("status"),
        F.col("b.competitor_product_id").alias("top_competitor_product_id"))
    offers = competitors.groupBy("system_product_id").agg(
        F.count(F.lit(1)).alias("competitor_count"))
    shop = competitors.select(F.col("competitor_product_id").alias("top_competitor_product_id"),
                              F.col("competitor_id").alias("top_competitor_id"))
    rows = (
        selected_products(products, **filters).join(best, "system_product_id", "left")
        .join(offers, "system_product_id", "left")
        .join(shop, "top_competitor_product_id", "left")
        .withColumn("competitor_count", F.coalesce("competitor_count", F.lit(0))))
    return rows.filter(F.col("status").isin(list(statuses))) if statuses else rows


def comparison(competitors: DataFrame, scores: DataFrame, score_attributes: DataFrame,
               attributes: DataFrame, names: Sequence[str], product: DataFrame | None = None,
               chosen: DataFrame | None = None, limit: int | None = None,
               after: int | None = None) -> DataFrame:
    """Offers with saved totals and one <attribute>_score column per attribute name.

    ``product`` restricts to its offers; ``limit`` is the page size of the dialog, in offer order,
    and a page begins after the offer id ``after``, so pages reach all offers.
    ``chosen`` (system_product_id, chosen_competitor_id, review_status) marks the selected offer.
    """
    rows = competitors
    if after is not None:
        rows = rows.filter(F.col("competitor_product_id") > after)
    if product is not None:
        rows = rows.join(product, "system_product_id", "left_semi")
        score_attributes = score_attributes.join(product, "system_product_id", "left_semi")
    key = ["system_product_id", "competitor_product_id"]
    labelled = score_attributes.join(
        attributes.select("attribute_id", "attribute_name"), "attribute_id")
    spread = labelled.groupBy(*key).agg(*[
        F.max_by(F.when(F.col("attribute_name") == n, F.col("score")),
                 F.when(F.col("attribute_name") == n, F.col("score_attribute_id"))
                 ).alias(f"{n}_score") for n in names])
    totals = scores.select(*key, F.col("total_score").alias("score"),
                           F.col("score_status").alias("status"))
    out = rows.join(totals, key, "left").join(spread, key, "left")
    if chosen is not None:
        out = out.join(chosen, "system_product_id", "left")
        mine = F.coalesce(F.col("chosen_competitor_id") == F.col("competitor_product_id"),
                          F.lit(False))
        out = out.withColumn("is_matched", mine).withColumn(
            "review_status", F.when(mine, F.col("review_status")).otherwise(0)
        ).drop("chosen_competitor_id")
    return out.orderBy("competitor_product_id").limit(limit) if limit else out


def saved_next_to(pairs: DataFrame, scores: DataFrame, score_attributes: DataFrame,
                  config: MatchConfig) -> DataFrame:
    """Fresh pair scores with per-attribute averages and the saved totals and parts."""
    key = ["system_product_id", "competitor_product_id"]
    parts = score_attributes.groupBy("score_id").agg(*[
        F.max_by(F.when(F.col("attribute_id") == a.attribute_id, F.col("score")),
                 F.when(F.col("attribute_id") == a.attribute_id, F.col("score_attribute_id"))
                 ).alias(f"saved_{a.name}") for a in config.attributes])
    saved = scores.join(parts, "score_id", "left").select(
        *key, F.col("total_score").alias("saved_score"),
        F.col("score_status").alias("saved_status"),
        *[f"saved_{a.name}" for a in config.attributes])
    fresh = pairs.withColumns({f"{a.name}_score": attribute_average(a, config)
                               for a in config.attributes})
    return fresh.join(saved, key, "left")


def scored_products(products: DataFrame, scores: DataFrame, score_attributes: DataFrame,
                    algorithm: str, **filters) -> DataFrame:
    """Products that have attribute scores of an algorithm."""
    with_parts = scores.join(
        score_attributes.filter(F.col("algorithm_id") == algorithm), "score_id", "left_semi")
    return selected_products(products, **filters).join(
        with_parts, "system_product_id", "left_semi").select("system_product_id").distinct()


def delete_scores(table: DataFrame, products: DataFrame, **filters) -> DataFrame:
    """Scores (or attribute scores) without those of the selected products; no filter, none left."""
    if not any(filters.values()):
        return table.limit(0)
    return delete_keys(table, selected_products(products, **filters), "system_product_id")


def score_rows(pairs: DataFrame, algorithm: str) -> DataFrame:
    """Pairs as rows of the score table."""
    return pairs.select("system_product_id", "competitor_product_id",
                        F.lit(algorithm).alias("algorithm_id"),
                        F.col("final_score").alias("total_score"),
                        F.col("status").alias("score_status"))


def score_attribute_rows(pairs: DataFrame, config: MatchConfig, algorithm: str,
                         per_algorithm: bool = False) -> DataFrame:
    """Pairs as rows of the attribute score table: the average over algorithms, or each."""
    if per_algorithm:
        entries = [(a.attribute_id, g, F.col(f"{a.name}_{g}"))
                   for a in config.chosen() for g in config.known]
    else:
        entries = [(a.attribute_id, algorithm, attribute_average(a, config))
                   for a in config.chosen()]
    return _spread(pairs, entries)


def scored_once(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """The keys and scores of pairs, staged: scores and parts are saved from one run of the scoring."""
    parts = [f"{a.name}_{g}" for a in config.attributes for g in config.known]
    return stage(pairs.select("system_product_id", "competitor_product_id", *parts, "final_score",
                              "status"), "pairs")


def group_score_rows(pairs: DataFrame, config: MatchConfig, algorithm: str) -> DataFrame:
    """Best score per competitor attribute, stored under the first attribute of the group."""
    def average(a: Attribute) -> Column:
        return reduce(add, [F.col(f"{a.name}_{g}") for g in config.known]) / len(config.known)

    entries = [(g[0].attribute_id, algorithm,
                average(g[0]) if len(g) == 1 else F.greatest(*[average(a) for a in g]))
               for g in config.groups()]
    return _spread(pairs, entries)


def _spread(pairs: DataFrame, entries: Sequence[tuple[int, str, Column]]) -> DataFrame:
    parts = F.explode(F.array(*[
        F.struct(F.lit(i).alias("attribute_id"), F.lit(g).alias("algorithm_id"),
                 c.cast("double").alias("score")) for i, g, c in entries]))
    return pairs.select("system_product_id", "competitor_product_id", parts.alias("e")).select(
        "system_product_id", "competitor_product_id", "e.*")


def save_scores(scores: DataFrame, score_attributes: DataFrame, new_scores: DataFrame,
                new_attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One score per pair, the latest algorithm wins; parts per pair, attribute and algorithm.

    New scores get ids after the greatest present one, in the order of their pairs, and new parts
    the id of their pair's score and ids of their own, so that later steps find them by id.
    """
    key = ["system_product_id", "competitor_product_id"]
    part_key = [*key, "attribute_id", "algorithm_id"]
    saved = _merged_with_ids(scores, new_scores, key, None, "score_id", key)
    ids = saved.select(*key, "score_id")
    parts = new_attributes.drop("score_id").join(ids, key)
    saved_parts = _merged_with_ids(score_attributes, parts, part_key, ["score"],
                                   "score_attribute_id", part_key)
    return saved, saved_parts


def _merged_with_ids(base: DataFrame, rows: DataFrame, key: Sequence[str],
                     columns: Sequence[str] | None, id_column: str, order: Sequence[str]
                     ) -> DataFrame:
    """``merge``, the inserted rows with new ids; staged, since ids must not change. Rows that were
    there are written once, in the merged table."""
    merged = stage(merge(base, rows, key, columns, flag="_change"), "merged")
    fresh = stage(with_new_ids(merged.filter("_change = 'inserted'"), base, id_column, order), "saved")
    return merged.filter("_change <> 'inserted'").unionByName(fresh).drop("_change")


def save_matches(products: DataFrame, scores: DataFrame, score_attributes: DataFrame,
                 pairs: DataFrame, config: MatchConfig, algorithm: str, stamp: Column,
                 asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store a matching run whole: products with their best offer, scores and attribute scores.

    ``asked`` (system_product_id): the products that were scored again; their earlier choice is
    cleared first, also where no pair was found.
    """
    if asked is not None:
        products = reset_review(products, asked.select(
            F.col("system_product_id")), "system_product_id")
    pairs = scored_once(pairs, config)
    saved, parts = save_scores(scores, score_attributes, score_rows(pairs, algorithm),
                               score_attribute_rows(pairs, config, algorithm))
    return choose_best(products, pairs, stamp), saved, parts


def save_bulk(products: DataFrame, scores: DataFrame, score_attributes: DataFrame,
              pairs: DataFrame, config: MatchConfig, algorithm: str, **filters
              ) -> tuple[DataFrame, DataFrame]:
    """Replace the scores of the products that ``filters`` select by those of a bulk run; without a
    filter, all scores.

    ``pairs`` come from ``run_pairs`` under ``bulk(config)``; parts are the best per group. Parts of
    deleted scores go with them; new scores and parts get ids.
    """
    kept = delete_scores(scores, products, **filters)
    kept_parts = delete_scores(score_attributes, products, **filters)
    key = ["system_product_id", "competitor_product_id"]
    pairs = scored_once(pairs, config)
    new = stage(with_new_ids(score_rows(pairs, algorithm), scores, "score_id", key), "saved")
    rows = group_score_rows(pairs, config, algorithm).join(new.select(*key, "score_id"), key)
    parts = with_new_ids(rows, score_attributes, "score_attribute_id", [*key, "attribute_id"])
    return (kept.unionByName(new, allowMissingColumns=True),
            kept_parts.unionByName(parts, allowMissingColumns=True))


def recalculated(scores: DataFrame, score_attributes: DataFrame, attributes: DataFrame,
                 weights: Mapping[str, float], algorithm: str,
                 thresholds: Mapping[str, float] | None = None, names: Sequence[str] | None = None,
                 products: DataFrame | None = None) -> DataFrame:
    """New totals from stored attribute scores under new weights: score id, total, status.

    Groups, full-score override and zero rule play no part here.
    """
    used = {n: float(w) for n, w in weights.items() if names is None or n in names}
    weight = scores.sparkSession.createDataFrame(
        list(used.items()) or [("", 0.0)], "attribute_name string, _weight double").join(
        attributes.select("attribute_id", "attribute_name"), "attribute_name")
    parts = score_attributes.filter(F.col("algorithm_id") == algorithm)
    rows = scores if products is None else scores.join(products, "system_product_id", "left_semi")
    # Pre-aggregated per score, then joined: a score has one row per attribute.
    sums = parts.join(weight.select("attribute_id", "_weight"), "attribute_id", "left").groupBy(
        "score_id").agg(
        F.sum(F.when(F.col("score").isNotNull(), F.col("score") * F.col("_weight"))).alias("_sum"),
        F.sum(F.when(F.col("score").isNotNull(), F.col("_weight"))).alias("_total"))
    total = F.when(F.col("_total") > 0, F.round(F.col("_sum") / F.col("_total"), 2)).otherwise(0.0)
    given = {"matched": (thresholds or {}).get("matched", 85),
             "review": (thresholds or {}).get("review", 70)}
    return rows.select("score_id", "system_product_id", "competitor_product_id").join(
        sums, "score_id").select(
        "score_id", "system_product_id", "competitor_product_id",
        F.lit(algorithm).alias("algorithm_id"), total.alias("total_score")
    ).withColumn("score_status", S.match_status(F.col("total_score"), given))


def apply_recalculation(scores: DataFrame, new: DataFrame) -> DataFrame:
    return apply_updates(scores, new.select("score_id", "algorithm_id", "total_score",
                                            "score_status"), ["score_id"], unique=True)


# --- decisions -------------------------------------------------------------------------------

def reset_review(products: DataFrame, ids: DataFrame, key: str = "product_id") -> DataFrame:
    """Clear the chosen offer of products about to be scored again."""
    hit = marked(products, ids, [key], "_hit")
    return set_where(hit, F.col("_hit"), {
        "review_status": 0, "competitor_product_id": None, "matched_date": None}).drop("_hit")


def choose_best(products: DataFrame, pairs: DataFrame, stamp: Column) -> DataFrame:
    """Store each product's best offer, unless its best score is not above -1."""
    best = best_offers(pairs).select("system_product_id", "competitor_product_id",
                                     stamp.alias("matched_date"))
    return apply_updates(products, best, ["system_product_id"], unique=True)


def store_choices(products: DataFrame, choices: DataFrame, stamp: Column) -> DataFrame:
    """Store chosen offers (system_product_id, competitor_product_id) with the date; of several for
    a product the greatest offer id counts."""
    picks = choices.groupBy("system_product_id").agg(
        F.max("competitor_product_id").alias("competitor_product_id"))
    return apply_updates(products, picks.withColumn("matched_date", stamp), ["system_product_id"],
                         unique=True)


# Review decisions and their stored numbers.
DECISIONS = {"pending": 0, "approved": 1, "rejected": 2}


def apply_decisions(products: DataFrame, competitors: DataFrame, decisions: DataFrame,
                    stamp: Column) -> DataFrame:
    """Review decisions (competitor_product_id, decision) of any number of offers.

    Approved and rejected store offer and date; anything else only sets the product to pending.
    Of several decisions for a product the latest by ``decided_at`` counts, where given, then an
    approval, then a rejection, then the greatest offer id; offers that do not exist change nothing.
    """
    rank = F.when(F.col("decision") == "approved", 2).when(
        F.col("decision") == "rejected", 1).otherwise(0)
    order = F.struct(*([F.col("decided_at")] if "decided_at" in decisions.columns else []), rank,
                     F.col("competitor_product_id"))
    of_product = decisions.join(
        competitors.select("competitor_product_id", "system_product_id"), "competitor_product_id"
    ).groupBy("system_product_id").agg(F.max_by(
        F.struct("competitor_product_id", "decision"), order).alias("_last")).select(
        "system_product_id", "_last.*")
    status = F.lit(DECISIONS["pending"])
    for name in ("approved", "rejected"):
        status = F.when(F.col("decision") == name, DECISIONS[name]).otherwise(status)
    decided = F.col("decision").isin("approved", "rejected")
    base = apply_updates(products, of_product.select(
        "system_product_id", status.alias("review_status")), ["system_product_id"], unique=True)
    return apply_updates(base, of_product.filter(decided).select(
        "system_product_id", "competitor_product_id", stamp.alias("matched_date")),
        ["system_product_id"], unique=True)


# --- configuration ---------------------------------------------------------------------------

def attributes_of_type(attributes: DataFrame, kind: str | None = None) -> DataFrame:
    rows = attributes if kind is None else attributes.filter(F.col("attribute_type") == kind)
    return rows.orderBy("attribute_id")


def attributes_by_type(attributes: DataFrame) -> DataFrame:
    """Per type its attribute options; the table holds a handful of rows."""
    option = F.struct("attribute_id", F.col("attribute_name").alias("value"),
                      F.upper("attribute_name").alias("label"),
                      F.col("default_weightage").alias("weight"), "competitor_attribute",
                      "data_type")
    return attributes.groupBy("attribute_type").agg(
        F.array_sort(F.collect_list(option)).alias("options"))


def update_configuration(configuration: DataFrame, attributes: DataFrame, algorithm: str,
                         values: Mapping[str, float]) -> DataFrame:
    """Store a value per (algorithm, attribute) for the attribute names that exist."""
    from shelfglass.operators.keyed import upsert

    rows = attributes.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in values.items()],
        "attribute_name string, attribute_value double").join(
        attributes.select("attribute_name", "attribute_id"), "attribute_name").select(
        F.lit(algorithm).alias("algorithm_id"), "attribute_id", "attribute_value")
    return upsert(configuration, rows, ["algorithm_id", "attribute_id"])


def latest_algorithm(scores: DataFrame) -> DataFrame:
    """Algorithm of the newest score, 'custom' when there is none."""
    return scores.agg(F.coalesce(
        F.max_by("algorithm_id", F.when(F.col("algorithm_id").isNotNull(),
                                        F.struct("created_at", "score_id"))),
        F.lit("custom")).alias("latest_algorithm"))


def algorithm_weights(scores: DataFrame, attributes: DataFrame,
                      configuration: DataFrame | None = None) -> DataFrame:
    """Weights of the newest algorithm: configured ones, else the defaults."""
    latest = latest_algorithm(scores)
    scoring = attributes.filter("attribute_type = 'default'").crossJoin(latest)  # one row
    if configuration is not None:
        own = configuration.withColumnRenamed("algorithm_id", "latest_algorithm")
        scoring = scoring.join(own, ["latest_algorithm", "attribute_id"], "left")
        weight = F.coalesce("attribute_value", "default_weightage")
    else:
        weight = F.col("default_weightage")
    return scoring.select("latest_algorithm", "attribute_name", weight.alias("weight"),
                          "competitor_attribute")
