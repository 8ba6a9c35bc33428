"""Quality of documents by co-training two views.

One classifier sees the text's content (words and characters), the other the page's metadata
(language, source, length, layout). Both learn from a bounded sample of labelled rows; then, round
by round, each labels the rows of an unlabelled pool it is most sure of, for the other to learn
from. Their log-odds are calibrated and combined on labelled rows that neither has seen, and all
documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfglass.llm.registry import query, read
from shelfglass.llm.toxicity import fold, sampled
from shelfglass.staging import stage

#: Bounds of the fit: labelled rows to learn and to calibrate from, rows of the pool.
LABELLED_ROWS, CALIBRATION_ROWS, POOL_ROWS = 20_000, 20_000, 20_000
#: Rounds, and pool rows that a classifier labels in a round, of the probability asked for.
ROUNDS, PER_ROUND, SURE = 5, 1000, 0.99
#: Hash buckets of language and source.
LANGUAGES, SOURCES = 8, 32
RIDGE = 1.0


def content(text: str) -> list[float]:
    """Text view: of words their number, variety, repetition and length; of characters the shares
    of classes. Squares let a straight boundary bend."""
    raw, words = text.encode("utf-8", "replace"), text.split()
    n, size = len(words), max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    marks = np.r_[seen[33:48], seen[58:65], seen[91:97], seen[123:127]]
    found = [np.log1p(n) / 10, len(set(words)) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n),
             min(50.0, len(text) / max(1, n)) / 10, seen[65:91].sum(), seen[48:58].sum(), marks.sum(),
             marks.max(), seen[9:33].sum(), seen[128:].sum()]
    return found + [x * x for x in found]


def metadata(text: str, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Page view: length and layout, and hashed language and source (bucket 0: none)."""
    lines = text.split("\n")
    blank = sum(not line.strip() for line in lines)
    given = n_chars if n_chars is not None else len(text)
    found = [np.log1p(max(0, given)) / 10, np.log1p(len(lines)) / 10,
             np.log1p(len(text) / len(lines)) / 10, blank / len(lines),
             len(text.encode("utf-8", "replace")) / max(1, len(text)) - 1]
    for value, buckets in ((lang, LANGUAGES), (source, SOURCES)):
        hot = [0.0] * buckets
        hot[0 if value is None else 1 + xxhash.xxh64_intdigest(value) % (buckets - 1)] = 1.0
        found += hot
    return found


def _views(docs: DataFrame) -> DataFrame:
    """(id, content, metadata) of every row, in one pass over the texts."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang, source, n_chars = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
            text = [t or "" for t in text]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([content(t) for t in text], pa.list_(pa.float64())),
                pa.array([metadata(*x) for x in zip(text, lang, source, n_chars, strict=True)],
                         pa.list_(pa.float64()))], ["id", "content", "metadata"])

    return stage(docs.mapInArrow(
        run, f"id {kind}, content array<double>, metadata array<double>"), "views")


class Logistic:
    """Ridge logistic regression on standardized columns, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._columns(x)
        self.weights = np.zeros(a.shape[1])
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.weights[-1] = np.log(share / (1 - share))
        if y.min() == y.max():
            return self
        penalty = np.r_[np.full(a.shape[1] - 1, ridge), 1e-6]

        def loss(w: np.ndarray) -> float:
            z = a @ w
            return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w))

        best = loss(self.weights)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ self.weights, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty),
                                   a.T @ (p - y) + penalty * self.weights)
            size = 1.0
            while size > 1e-6 and (now := loss(self.weights - size * step)) > best:
                size /= 2
            if size <= 1e-6 or best - now < 1e-7 * (1 + abs(best)):
                break
            self.weights, best = self.weights - size * step, now
        return self

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.scale, -10, 10), np.ones(len(x))]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._columns(x) @ self.weights, -30, 30)


def cotrain(views: list[np.ndarray], labels: np.ndarray, pool: list[np.ndarray],
            rounds: int = ROUNDS, per_round: int = PER_ROUND) -> list[Logistic]:
    """One classifier per view, after exchanging their surest labels over the pool."""
    have = [(v, labels) for v in views]
    open_rows = np.arange(len(pool[0]))
    models = [Logistic().fit(*h) for h in have]
    share = labels.mean()
    sure = np.log(SURE / (1 - SURE))
    for _ in range(rounds):
        given = []
        for k in (0, 1):
            odds = models[k].log_odds(pool[k][open_rows])
            order = np.argsort(odds, kind="stable")
            low = order[:int(np.ceil(per_round * (1 - share)))]
            high = order[::-1][:int(np.ceil(per_round * share))]
            low, high = low[odds[low] <= -sure], high[odds[high] >= sure]
            given.append((np.r_[low, high], np.r_[np.zeros(len(low)), np.ones(len(high))]))
        if not any(len(rows) for rows, _ in given):
            break
        for k, (rows, y) in enumerate(given):
            x = pool[1 - k][open_rows[rows]]
            have[1 - k] = np.r_[have[1 - k][0], x], np.r_[have[1 - k][1], y]
        used = np.unique(np.concatenate([rows for rows, _ in given]))
        open_rows = np.delete(open_rows, used)
        models = [Logistic().fit(*h) for h in have]
        if not len(open_rows):
            break
    return models


def score_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
                  lang: str = "lang", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score (0 to 1), predicted.

    ``labels`` (key, quality) teach from rows outside fold 0 only: at most ``LABELLED_ROWS`` of
    folds 1 to 3, and ``CALIBRATION_ROWS`` of fold 4 to calibrate by; the pool is a sample of at
    most ``POOL_ROWS`` rows without a label. A null label teaches nothing, and of several labels
    of a key the largest counts. Null texts count as empty; null metadata have values of their
    own; repeated rows are scored each. Without labels every score is 0.5; with one class only,
    scores follow its share. Texts are read once; the driver sees the samples, never the corpus.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"),
                       F.col(lang).cast("string").alias("lang"),
                       F.col(source).cast("string").alias("source"),
                       F.col(n_chars).cast("long").alias("n_chars"))
    views = _views(docs)
    known = stage(labels.select(F.col(key).alias("id"), F.col("quality").cast("int").alias("y")).filter(
        "id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).withColumn(
        "fold", fold("id")), "labels")

    def collected(rows: DataFrame, most: int) -> tuple[list[np.ndarray], np.ndarray]:
        got = rows.limit(2 * most).toPandas()
        return ([np.array(got[c].tolist(), float) for c in ("content", "metadata")],
                got["y"].to_numpy(float))

    def labelled(folds: str, most: int):
        sample = sampled(known.filter(folds), most).drop("fold")
        return collected(views.join(F.broadcast(sample), "id"), most)

    learn, y = labelled("fold IN (1, 2, 3)", LABELLED_ROWS)
    calibrate, y_cal = labelled("fold = 4", CALIBRATION_ROWS)
    if not len(y):
        learn, y, calibrate, y_cal = calibrate, y_cal, learn, y
    held = fold("id") == 0
    if not len(y):
        return views.select(F.col("id").alias(key), held.alias("held_out"), F.lit(0.5).alias("score"),
                            F.lit(1).alias("predicted"))
    pool, _ = collected(sampled(views.join(known.select("id"), "id", "left_anti"), POOL_ROWS)
                        .withColumn("y", F.lit(0)), POOL_ROWS)
    models = cotrain(learn, y, pool) if len(pool[0]) else [Logistic().fit(v, y) for v in learn]
    by, y_by = (calibrate, y_cal) if len(y_cal) else (learn, y)
    # Calibrate each view, then weigh the two calibrated log-odds.
    own = [Logistic().fit(m.log_odds(v)[:, None], y_by) for m, v in zip(models, by, strict=True)]

    def odds(parts: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([c.log_odds(m.log_odds(v)[:, None])
                                for c, m, v in zip(own, models, parts, strict=True)])

    joint = Logistic().fit(odds(by), y_by)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = [np.array(batch.column(i).to_pylist()) for i in (1, 2)]
            score = 1 / (1 + np.exp(-joint.log_odds(odds(parts))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return views.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(key), held.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_quality")
def op9_quality(spark, sf_dir):
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
