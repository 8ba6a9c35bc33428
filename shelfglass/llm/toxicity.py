"""Toxicity of documents by maximum-scoring segments over token log-odds.

1. Tokens of a bounded sample of toxic documents, and their first letters, are candidates of the
   lexicon.
2. Their document counts in the whole corpus are the Dirichlet prior of their log-odds between
   toxic and clean sample documents. A token scores the lower confidence bound of its log-odds
   where that is clearly positive; any other token costs the (negative) log-odds of the rest.
3. One linear scan per document (Ruzzo and Tompa) finds all maximal scoring segments.
4. Segments are rated against chance by the extreme-value law E = K n exp(-lambda S), whose
   parameters come from clean documents, and a document's evidence, the sum of -ln E over its
   significant segments, is mapped to a probability on labelled rows the lexicon has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfglass.llm.registry import query, read
from shelfglass.llm.wordtokens import frugal, parts
from shelfglass.staging import stage

#: Bounds of the fit: labelled rows for the lexicon and for the calibration, lexicon candidates.
LEXICON_ROWS, CALIBRATION_ROWS, MOST_TERMS = 40_000, 20_000, 1 << 16
#: Weight of the corpus prior, in documents; standard deviations taken off the log-odds; the
#: least score of a term and toxic documents it occurs in; the largest significant E-value.
PRIOR_DOCS, DEVIATIONS, LEAST_SCORE, LEAST_DOCS, MOST_E = 50.0, 1.96, 1.0, 3, 0.5
#: Letters of the prefixes that stand for all words beginning with them.
PREFIXES = (4, 5)
#: Entries of the cache of word scores of a worker.
_MOST_WORDS = 100_000
#: Bytes of text that a worker takes up at a time.
_PART_BYTES = 4_000_000

_words = re.compile(r"\w+").findall


def features(word: str) -> list[str]:
    """The word, and its prefixes marked with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class _Scores(dict):
    """Word to the best score of its features; None without one."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float | None:
        found = [self.terms[f] for f in features(word) if f in self.terms]
        if len(self) > _MOST_WORDS:
            self.clear()
        best = self[word] = max(found, default=None)
        return best


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def maximal_segments(places: list[int], scores: list[float], rest: float
                     ) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of a token sequence.

    ``places`` are the positions of the tokens with a score of their own, all positive; every
    other token scores ``rest`` < 0. One pass, each segment is merged at most once.
    """
    found: list[list] = []  # start, end, cumulative score before start, after end
    total, at = 0.0, 0
    for p, s in zip(places, scores, strict=True):
        before = total + rest * (p - at)
        total, at = before + s, p + 1
        new = [p, p + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r in found]


@dataclass(frozen=True)
class Lexicon:
    terms: dict[str, float]
    rest: float
    decay: float  # lambda of the extreme-value law


def _decay(scores: np.ndarray, rate: np.ndarray, rest: float) -> float:
    """The positive root of sum(p exp(x s)) = 1 over the clean distribution of scores."""
    if not len(scores):
        return 1.0
    rate = rate / max(1.0, rate.sum() * 1.25)
    excess = lambda x: float(rate @ np.exp(x * scores) + (1 - rate.sum()) * np.exp(x * rest)) - 1
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    if excess(low) > 0:
        return 1e-3
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _toxic_terms(toxic: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0, _PART_BYTES):
            counts: Counter = Counter()
            for t in batch.column(0).to_pylist():
                counts.update({f for w in set(_words((t or "").lower())) for f in features(w)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["term", "n"])

    return toxic.select("text").mapInArrow(frugal(run), "term string, n bigint").groupBy("term").agg(
        F.sum("n").alias("n"))


def _corpus_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with each candidate (by its number; -1: documents, -2: tokens of clean ones)."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, clean = np.zeros(len(terms) + 1, np.int64), np.zeros(len(terms) + 1, np.int64)
        docs_n = clean_n = tokens = clean_tokens = 0
        for batch in parts(batches, 0, _PART_BYTES):
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                strict=True):
                words = _words((t or "").lower())
                seen = {f for w in set(words) for f in features(w)}
                ids = np.array(list(set(map(number.get, seen, repeat(len(terms))))), np.int64)
                every[ids] += 1
                docs_n, tokens = docs_n + 1, tokens + len(words)
                if toxic == 0:
                    clean[ids] += 1
                    clean_n, clean_tokens = clean_n + 1, clean_tokens + len(words)
        seen = np.flatnonzero(every[:-1])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[seen, -1, -2]), pa.array(np.r_[every[seen], docs_n, tokens]),
            pa.array(np.r_[clean[seen], clean_n, clean_tokens])], ["term", "n_all", "n_clean"])

    return docs.select("text", "toxic").mapInArrow(
        frugal(run), "term bigint, n_all bigint, n_clean bigint").groupBy("term").agg(
        F.sum("n_all").alias("n_all"), F.sum("n_clean").alias("n_clean"))


def fit_lexicon(docs: DataFrame, sample: DataFrame) -> Lexicon:
    """Token log-odds from ``docs`` (id, text) and the bounded ``sample`` (id, toxic)."""
    sample = F.broadcast(sample)  # at most LEXICON_ROWS rows, see sampled()
    found = _toxic_terms(docs.join(sample.filter("toxic = 1"), "id")).filter(
        F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "term").limit(MOST_TERMS).collect()
    terms, toxic = [r["term"] for r in found], np.array([r["n"] for r in found], float)
    counted = _corpus_counts(docs.join(sample, "id", "left"), terms).toArrow()
    counts = {i: n for i, *n in zip(*(counted[c].to_pylist() for c in ("term", "n_all", "n_clean")),
                                    strict=True)}
    n_all, n_clean = counts.get(-1, (0, 0))
    tokens_all, clean_tokens = counts.get(-2, (0, 0))
    n_toxic = sample.filter("toxic = 1").count()
    if not terms or not n_clean or not n_toxic:
        return Lexicon({}, -0.01, 1.0)
    every, clean = (np.array([counts.get(i, (0, 0))[k] for i in range(len(terms))], float)
                    for k in (0, 1))
    prior = PRIOR_DOCS * (every + 0.5) / (n_all + 1.0)

    def odds(y, n):
        return np.log((y + prior) / np.maximum(n + PRIOR_DOCS - y - prior, 0.5))

    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    delta -= DEVIATIONS * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    keep = delta >= LEAST_SCORE
    # The rest of the tokens: their share of a toxic and of a clean document of mean length.
    length = max(1.0, clean_tokens / n_clean)
    share = [1 - min(0.9, x[keep].sum() / n / length) for x, n in ((toxic, n_toxic),
                                                                   (clean, n_clean))]
    rate = (clean[keep] + prior[keep]) / (n_clean + PRIOR_DOCS) / length
    # Clean text must drift down, or segments would grow without end.
    rest = min(-0.005, float(np.log(share[0] / share[1])), -2 * float(rate @ delta[keep]))
    return Lexicon({t: float(d) for t, d, k in zip(terms, delta, keep, strict=True) if k}, rest,
                   _decay(delta[keep], rate, rest))


def find_segments(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(id, text, …) to (id, n_tokens, segments array<start, end, score>), in token positions."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        known, names = _Scores(lexicon.terms), ("start", "end", "score")
        for batch in parts(batches, 1, _PART_BYTES):
            sizes, segments = [], []
            for t in batch.column(1).to_pylist():
                words = _words((t or "").lower())
                scores = list(map(known.__getitem__, words))
                places = [i for i, s in enumerate(scores) if s is not None]
                sizes.append(len(words))
                segments.append([dict(zip(names, x, strict=True)) for x in maximal_segments(
                    places, [scores[i] for i in places], lexicon.rest)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(segments, pa.list_(item))], ["id", "n_tokens", "segments"])

    return docs.select("id", "text").mapInArrow(
        frugal(run), f"id {kind}, n_tokens bigint, "
             "segments array<struct<start:bigint,end:bigint,score:double>>")


def evidence(lexicon: Lexicon, log_k: float):
    """Sum of -ln E over the segments with an E-value of at most ``MOST_E``."""
    def bits(s):
        return F.lit(lexicon.decay) * s["score"] - F.lit(log_k) - F.ln(
            F.greatest(F.col("n_tokens"), F.lit(1)))

    return F.aggregate(F.filter("segments", lambda s: bits(s) >= F.lit(-float(np.log(MOST_E)))),
                       F.lit(0.0), lambda total, s: total + bits(s))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a weak ridge."""
    if not len(y) or y.min() == y.max():
        return 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)))
    scale = max(1e-9, x.std())
    w, a = np.zeros(2), np.c_[x / scale, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * len(y) * np.array([w[0], 0]) * 1e-2
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-5 * len(y), 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if abs(step).max() < 1e-9:
            break
    return float(max(0.0, w[0]) / scale), float(w[1])


def sampled(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``labels`` (id, …), chosen by a hash of the id."""
    n = labels.count()
    if n <= most:
        return labels
    share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return labels.filter(share < 0.95 * most / n).limit(most)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted, n_tokens, segments.

    ``labels`` (key, toxic) teach from rows outside fold 0 only, and at most ``LEXICON_ROWS``
    (folds 1 to 3) and ``CALIBRATION_ROWS`` (fold 4) of them; a null label teaches nothing, and
    of several labels of a key the largest counts. A null or empty text has no segments and gets
    the score of no evidence; repeated rows are scored each; without labels of both classes all
    scores are equal and below 0.5; other columns are not read. Texts are scanned in three
    passes; the driver sees the sample's counts and the lexicon, never the corpus.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(key).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = stage(known.withColumn("fold", fold("id")).filter("fold <> 0"), "labels")
    sample = stage(sampled(known.filter("fold <> 4"), LEXICON_ROWS), "sample").drop("fold")
    lexicon = fit_lexicon(docs, sample)
    found = stage(find_segments(docs, lexicon), "segments")

    held = F.broadcast(sampled(known.filter("fold = 4"), CALIBRATION_ROWS).drop("fold"))
    seen = found.join(held, "id")
    # K: the rate, per clean token, of segments at least as good as the weakest term.
    least = min(lexicon.terms.values(), default=1.0)
    clean = seen.filter("toxic = 0").agg(
        F.sum(F.size(F.filter("segments", lambda s: s["score"] >= least))).alias("n"),
        F.sum("n_tokens").alias("tokens")).first()
    log_k = float(np.log(((clean["n"] or 0) + 0.5) / ((clean["tokens"] or 0) + 1.0))
                  + lexicon.decay * least)
    rows = seen.select(evidence(lexicon, log_k).alias("x"), "toxic").toArrow()
    slope, shift = logistic(*(rows[c].to_numpy().astype(float) for c in ("x", "toxic")))
    if not slope:
        shift = min(shift, -0.01)
    score = 1 / (1 + F.exp(-(F.lit(slope) * evidence(lexicon, log_k) + F.lit(shift))))
    return found.withColumn("score", score).select(
        F.col("id").alias(key), (fold("id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "segments")


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))
