"""A cleaned, mixed and packed corpus from the documents table, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before has kept. ``run``
writes each stage's rows as Parquet to the shared folder and reads them again for the next. Stages
that hand texts to Python workers leave the session's Arrow batches at 4 MB, since their results are
lazy: whoever writes them plans the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfglass.llm import jaccard_join, line_chunks, mixing, packing, toxicity
from shelfglass.llm.registry import read
from shelfglass.staging import SMALL_BATCHES, stage


def _small_batches(spark: SparkSession) -> None:
    for name, value in SMALL_BATCHES.items():
        spark.conf.set(name, value)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the id or, where it is null, a number beyond all ids made of the text,
    so that such a row is judged, and dropped, like any other."""
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62))
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), own))


def _keeping(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows without the keys that ``gone`` (_key) lists."""
    return keyed.join(gone, "_key", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not mark; an id any of whose texts is marked goes,
    and a row without an id goes with its text. Null and empty texts stay."""
    _small_batches(spark)
    keyed = _keyed(docs)
    labels = read(spark, sf_dir, "labels").withColumn("_key", F.col("doc_id").cast("long"))
    scores = toxicity.score_toxicity(keyed, labels, key="_key")
    bad = stage(scores.filter("predicted = 1").select("_key").distinct(), "toxic")
    return _keeping(keyed, bad).drop("_key")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that stand elsewhere first; n_chars follows."""
    clean = line_chunks.drop_repeats(docs).drop("n_removed")
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows without an id
    come after all others. A row that repeats id and text goes; different texts under one id are
    parts of one document. Texts without words are no duplicates of each other."""
    _small_batches(spark)
    keyed = _keyed(docs)
    found = stage(jaccard_join.link_documents(keyed, key="_key").select("_key", "component_id"),
                  "groups")
    gone = stage(found.filter("component_id <> _key").select("_key").distinct(), "copies")
    again = stage(found.filter("component_id = _key").groupBy("_key").count().filter(
        "count > 1").select("_key"), "again")
    kept = _keeping(keyed, gone)
    once = kept.join(again, "_key", "left_semi").dropDuplicates(["_key", "text"])
    return _keeping(kept, again).unionByName(once).drop("_key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights: documents as often as the mix takes them. A null source
    is a source of its own, a null text has size 0 and fills nothing."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in training sequences; a null or empty text is its end mark."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_passages),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens, hashes and fitted scores are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
