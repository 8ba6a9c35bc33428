import math
import time

import pytest
from pyspark.sql import functions as F

from shelfglass.functions import scores as S
from shelfglass.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("https://www.Shop.com/A_b  C-1!", "shop/a b c-1".replace("/", " ")),
    ("  Tab\tand\nline ", "tab and line"), ("x.com.org", "x"),
])
def test_normalize_text(spark, raw, want):
    assert value(spark, T.normalize_text(lit(raw))) == want


def test_url_texts(spark):
    url = lit("https://www.shop.com/products/Red_Chair-42/item.html?ref=1")
    assert value(spark, T.url_path_text(url)) == "products red chair 42 item"
    assert value(spark, T.product_tokens(url)) == ["chair-42", "red"]
    assert value(spark, T.comparable_url(url)) == "red chair"
    assert value(spark, T.comparable_url(lit(None))) == ""
    assert value(spark, T.product_tokens(lit("http://h.net/p/ab12/xy/abc"))) == ["ab12", "abc"]


def sku(spark, a, b):
    return value(spark, S.sku_score(S.sku_features(lit(a)), S.sku_features(lit(b))))


def test_sku_score_worked_examples(spark):
    assert sku(spark, "ab-12", "ab-99") == 50.0
    assert sku(spark, "AB-12; zz", "q; ab-12 ") == 100.0
    assert sku(spark, None, "a") == sku(spark, "a", None) == sku(spark, ";;", "a") == 0.0
    assert sku(spark, "ab", "ab-99") == 100.0 and sku(spark, "ab-99", "ab") == 50.0


def price(spark, p, q, **limits):
    return value(spark, S.price_score(S.price_features(lit(p)), S.price_features(lit(q)), limits))


def test_price_score_worked_examples(spark):
    assert price(spark, "100", "120") == 50.0
    assert price(spark, "100", "125") == 100.0
    assert price(spark, "100", "136") == price(spark, "100", "x") == price(spark, "0", "5") == 0.0
    assert price(spark, "100", "125", margin_low_limit=0) == 100.0
    assert price(spark, "100", "124", margin_low_limit=0) == 0.0
    with pytest.raises(ValueError, match="margin_diff"):
        S.price_config({"margin_diff": 3})


def test_url_score_is_symmetric(spark):
    score = lambda a, b: value(spark, S.url_score(S.url_features(lit(a)), S.url_features(lit(b))))
    assert score("red chair 42", "red table") == score("red table", "red chair 42") == 25.0
    assert score("", "a") == 0.0


def brute_cosine(a, b):
    """Gram vectors with idf fitted on two texts, written out longhand."""
    def grams(text):
        counts = {}
        for word in text.split():
            padded = f" {word} "
            for n in (2, 3, 4):
                for i in range(len(padded) - n + 1):
                    g = padded[i:i + n]
                    counts[g] = counts.get(g, 0) + 1
        return counts

    x, y = grams(a), grams(b)
    idf = {g: math.log(3 / (1 + (g in x) + (g in y))) + 1 for g in {*x, *y}}
    norm = lambda v: math.sqrt(sum((c * idf[g]) ** 2 for g, c in v.items()))
    dot = sum(x[g] * y[g] * idf[g] ** 2 for g in x if g in y)
    return 100 * dot / (norm(x) * norm(y))


@pytest.mark.parametrize("a, b", [
    ("ab c", "ab c"), ("banana bananas", "banana anan"), ("ab-12 x", "ab-99 y"), ("aaaaaa", "aaa"),
    ("red chair 42 red", "chair red 24"),
])
def test_gram_score_equals_longhand_cosine(spark, a, b):
    got = value(spark, S.gram_score(S.gram_features(lit(a)), S.gram_features(lit(b))))
    assert got == pytest.approx(brute_cosine(a, b), abs=1e-9)


def test_gram_windows_and_guard(spark):
    assert sorted(value(spark, T.text_grams(lit("ab c")))) == sorted(
        [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
    assert value(spark, S.gram_score(S.gram_features(lit("a")), S.gram_features(lit("a")))) == 0.0
    assert value(spark, S.gram_score(S.gram_features(lit("ab")), S.gram_features(lit("xy")))) == 0.0


def test_match_status_defaults(spark):
    assert value(spark, S.match_status(F.lit(85.0))) == S.MATCHED
    assert value(spark, S.match_status(F.lit(86.0), S.BULK_THRESHOLDS)) == S.REVIEW
    assert value(spark, S.match_status(F.lit(84.9), {"matched": 0})) == S.REVIEW
    assert value(spark, S.match_status(F.lit(None).cast("double"))) == S.NOT_MATCHED


def test_algorithms_can_be_added(spark):
    exact = S.Score("exact", lambda c: c, lambda a, b: F.when(a == b, 100.0).otherwise(0.0))
    S.register("exact", exact, exact, exact)
    try:
        assert S.algorithm("exact", "string") is exact
    finally:
        for kind in ("string", "url", "number"):
            del S.REGISTRY[("exact", kind)]
    assert S.algorithm("exact", "string") is None


def test_gram_score_of_long_repetitive_texts(spark):
    """Counts by definition, on texts of many repeats; ten times the words cost about ten times."""
    from collections import Counter

    def grams(text):
        return Counter(p[i:i + n] for w in text.split() for p in [f" {w} "] for n in range(2, min(4, len(p)) + 1)
                       for i in range(len(p) - n + 1))

    def expected(a, b):
        x, y = grams(a), grams(b)
        one = S.SINGLE_IDF
        weight = lambda g: 1.0 if g in x and g in y else one
        dot = sum(x[g] * y[g] for g in x if g in y)
        norm = lambda c: sum((n * weight(g)) ** 2 for g, n in c.items()) ** 0.5
        return 100 * dot / norm(x) / norm(y)

    def made(words, step):
        return " ".join(f"w{i * step % 997} red blue{i % 13}" for i in range(words // 3))

    took = {}
    for words in (300, 2_000, 20_000):
        a, b = made(words, 1), made(words, 7) + " other words here"
        start = time.time()
        got = value(spark, S.gram_score(S.gram_features(lit(a)), S.gram_features(lit(b))))
        took[words] = time.time() - start
        assert got == pytest.approx(expected(a, b), rel=1e-9)
    assert took[20_000] < 30 * max(took[2_000], 0.2)


def test_sides_with_grams_are_shuffled_not_broadcast(spark):
    """Before it runs, a plan counts one element for an array, so token lists looked small enough."""
    from shelfglass.operators.joins import join_prepared

    own = spark.createDataFrame([(1, "ab-1"), (2, None)], "k long, sku string")
    offers = spark.createDataFrame([(1, 7), (1, 8), (3, 9)], "k long, offer long")
    joined = join_prepared(
        own, lambda rows: rows.select("k", S.gram_features(F.col("sku")).alias("a")), offers, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r.offer for r in joined.collect()) == [7, 8]


def test_grams_of_words_and_odd_blanks(spark):
    def by_word(text):
        return sorted(f" {w} "[i:i + n] for w in text.split() for n in (2, 3, 4)
                      for i in range(len(w) + 3 - n))

    for text in ("", " ", "a", "a b", "ab  c", "\tring 12-x\n", "größe 𝄞x"):
        assert sorted(value(spark, T.text_grams(lit(text)))) == by_word(text), text
