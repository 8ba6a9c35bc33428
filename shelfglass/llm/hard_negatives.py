"""Hard negatives: rows of another label that score just below an anchor's positives.

Scores are exact integer inner products, computed in a residue number system (``residues``). Rows
and anchors are dealt to groups of bounded size by a hash, every group of anchors meets every group
of rows in one task, and a task hands on only the few best of each anchor, so that a window over
them selects the final ones. The positives come first; their scores give the bands that a second
product searches for negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfglass.llm.registry import query, read
from shelfglass.llm.residues import MOST_SCORE, Residues, primes_for, product
from shelfglass.staging import parallelism, stage

#: Rows and anchors that meet in one task, and the rows of each that are multiplied at a time.
TASK_ROWS, TASK_ANCHORS = 1 << 16, 1 << 15
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 256
_LEAST = np.iinfo(np.int64).min


def _vectors(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(no, id, label, dim, raw, norm) of the distinct rows that take part, numbered; ``raw`` holds
    the scaled components as 32-bit integers."""
    v = F.col("vec")
    usable = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
                         F.col(vector).cast("array<double>").alias("vec")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            ends, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            scaled = np.floor(256.0 * flat)
            raw, dims, norms = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                x = scaled[a:b]
                norms.append(float(x @ x))
                if norms[-1] > MOST_SCORE:
                    raise ValueError("scores do not fit a long: scale the vectors down")
                dims.append(b - a)
                raw.append(x.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()),
                 pa.array(raw, pa.binary()), pa.array(norms, pa.float64())],
                ["id", "label", "dim", "raw", "norm"])

    found = usable.mapInArrow(
        packed, "id bigint, label bigint, dim int, raw binary, norm double").dropDuplicates()
    return found.withColumn("no", F.monotonically_increasing_id())


def _matrix(table: pa.Table) -> np.ndarray:
    raw = b"".join(table.column("raw").to_pylist())
    return np.frombuffer(raw, "<i4").reshape(table.num_rows, -1)


def _best(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, most: int
          ) -> tuple[np.ndarray, np.ndarray]:
    """Positions (row, column) of each row's ``most`` best fitting scores, ties by smaller id."""
    held = np.where(fits, scores, _LEAST)
    if held.shape[1] > most:
        least = np.partition(held, held.shape[1] - most, axis=1)[:, held.shape[1] - most]
        fits = fits & (held >= least[:, None])
    i, j = np.nonzero(fits)
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    kept = np.arange(len(i)) - first < most
    return i[kept], j[kept]


def _blocks(n: int, size: int) -> Iterator[slice]:
    return (slice(a, min(a + size, n)) for a in range(0, n, size))


def _positives(anchors: pa.Table, rows: pa.Table, primes: list[int], most: int
               ) -> Iterator[dict[str, np.ndarray]]:
    """The best rows of an anchor's own label, other ids only, label by label."""
    a_label, r_label = anchors["label"].to_numpy(), rows["label"].to_numpy()
    for one in np.intersect1d(a_label, r_label):
        mine = anchors.filter(pa.array(a_label == one))
        near = rows.filter(pa.array(r_label == one))
        left, right = Residues(_matrix(mine), primes), Residues(_matrix(near), primes)
        a_no, a_id = mine["no"].to_numpy(), mine["id"].to_numpy()
        r_no, r_id = near["no"].to_numpy(), near["id"].to_numpy()
        for a in _blocks(len(a_no), BLOCK_ANCHORS):
            for b in _blocks(len(r_no), BLOCK_ROWS):
                scores = product(left, a, right, b)
                i, j = _best(scores, a_id[a, None] != r_id[None, b], r_id[b], most)
                yield {"anchor": a_no[a][i], "row": r_no[b][j], "row_id": r_id[b][j],
                       "score": scores[i, j]}


def _negatives(anchors: pa.Table, rows: pa.Table, primes: list[int], most: int
               ) -> Iterator[dict[str, np.ndarray]]:
    """The best rows of other labels within the band of each of an anchor's positives."""
    left, right = Residues(_matrix(anchors), primes), Residues(_matrix(rows), primes)
    a_no, a_label = anchors["no"].to_numpy(), anchors["label"].to_numpy()
    r_id, r_label = rows["id"].to_numpy(), rows["label"].to_numpy()
    for a in _blocks(len(a_no), BLOCK_ANCHORS):
        asked = anchors["bands"].slice(a.start, a.stop - a.start).to_pylist()
        for b in _blocks(len(r_id), BLOCK_ROWS):
            scores = product(left, a, right, b)
            other = a_label[a, None] != r_label[None, b]
            for t in range(max(map(len, asked))):
                has = np.array([len(x) > t for x in asked])
                low = np.array([x[t]["low"] if len(x) > t else 1 for x in asked])
                high = np.array([x[t]["high"] if len(x) > t else 0 for x in asked])
                place = np.array([x[t]["place"] if len(x) > t else 0 for x in asked])
                fits = other & has[:, None] & (scores >= low[:, None]) & (scores <= high[:, None])
                i, j = _best(scores, fits, r_id[b], most)
                yield {"anchor": a_no[a][i], "place": place[i], "negative_id": r_id[b][j],
                       "negative_score": scores[i, j]}


def _products(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, task, schema: str
              ) -> DataFrame:
    """``task(anchors, rows)`` for every group of anchors with every group of rows."""
    spark = rows.sparkSession
    row_groups = max(parallelism(spark), math.ceil(n_rows / TASK_ROWS))
    anchor_groups = math.ceil(n_anchors / TASK_ANCHORS)

    def dealt(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        fresh = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides read one table
        return fresh.withColumn(own, F.pmod(F.xxhash64("no"), F.lit(groups))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<bigint>")))

    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if left.num_rows and right.num_rows:
            for found in task(left, right):
                for held, c in zip(out, names, strict=True):
                    held.append(found[c])
        return pa.table([np.concatenate(h or [np.zeros(0)]).astype(np.int64) for h in out],
                        names=names)

    keys = ["dim", "row_group", "anchor_group"]
    left = dealt(anchors, "anchor_group", anchor_groups, "row_group", row_groups)
    right = dealt(rows, "row_group", row_groups, "anchor_group", anchor_groups)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def mine(rows: DataFrame, anchors: Column, *, key: str = "vec_id", vector: str = "embedding",
         label: Column | str = "label", positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its ``positives`` highest scoring rows of its label with other ids.
    For each, the first ``negatives`` rows of other labels that score from half to 95 % of the
    positive, highest first, ties by smaller id; ``rank`` counts those returned from 1. A score is
    the exact inner product of the components floor(256 x). ``anchors`` is a condition on the
    column ``id``.

    Rows with a null id or label, a null vector or a null or non-finite component take no part.
    Rows that repeat id, label and vector count once; one id with several vectors or labels stands
    for as many rows. Vectors of another length are neither positive nor negative; empty vectors
    score 0 with each other. Empty tables, and anchors without positives, give no rows. Scores
    beyond 2^52 raise an error. A task holds at most about ``TASK_ROWS`` rows and ``TASK_ANCHORS``
    anchors; no row is left out of a product.
    """
    label = F.col(label) if isinstance(label, str) else label
    every = stage(_vectors(rows, key, vector, label), "vectors")
    asked = every.filter(anchors)
    n, norm = every.agg(F.count(F.lit(1)), F.max("norm")).first()
    n_anchors = asked.count()
    shown = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, " \
            "positive_score bigint, negative_score bigint"
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], shown)
    primes = primes_for(int(norm))  # no score exceeds the largest squared norm
    plain = every.select("no", "id", "label", "dim", "raw")

    near = _products(
        asked.select(plain.columns), plain, n_anchors, n,
        lambda a, r: _positives(a, r, primes, positives),
        "anchor bigint, row bigint, row_id bigint, score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "row_id", "row")
    near = stage(near.withColumn("place", F.row_number().over(order).cast("bigint")).filter(
        F.col("place") <= positives), "positives")

    # Half a score rounded up, and 95 % of it rounded down, without overflow.
    low = F.expr("(score + pmod(score, 2)) div 2").alias("low")
    high = F.expr("(score - pmod(score, 100)) div 100 * 95 + pmod(score, 100) * 95 div 100")
    bands = near.groupBy("anchor").agg(
        F.collect_list(F.struct("place", low, high.alias("high"))).alias("bands"))
    with_bands = asked.select(plain.columns).join(
        bands.withColumnRenamed("anchor", "no"), "no").select(*plain.columns, "bands")
    found = _products(
        with_bands, plain, n_anchors, n, lambda a, r: _negatives(a, r, primes, negatives),
        "anchor bigint, place bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = near.join(asked.select(F.col("no").alias("anchor"), F.col("id").alias("anchor_id")),
                      "anchor").select("anchor", "place", "anchor_id",
                                       F.col("row_id").alias("positive_id"),
                                       F.col("score").alias("positive_score"))
    return best.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id,
  p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op13_hard_negatives", ORACLE)
def op13_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.expr("id % 50 = 0"), label=label)
