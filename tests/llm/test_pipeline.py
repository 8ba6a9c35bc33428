from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from conftest_llm import ODD
from test_duplicates import brute_clean, brute_links
from test_models_and_search import corpus
from test_tokens_and_packing import ids_of

import corpus_pipeline
from shelfglass.llm import mixing


def test_stages_against_brute_force(spark, make_docs, tmp_path):
    rows, labels = corpus(240)
    copies = [(1000 + k, t + f" tail {k % 3}", s) for k, t, s in rows[:30]]
    lines = [(2000 + k, "\n".join(f"line {i} of the shared passage" for i in range(9)) + f"\nown {k}",
              None) for k in range(6)]
    docs = make_docs(rows + copies + lines + [(3000 + k, t) for k, t in ODD if k]
                     ).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, t) for k, _, t in labels], "doc_id long, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    sf_dir, kept, current = str(tmp_path), [], docs
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, current, sf_dir)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        current = spark.read.parquet(path)
        kept.append([(r["doc_id"], r["text"]) for r in current.collect()] if name != "packing"
                    else current.collect())
        assert name == "packing" or current.columns == docs.columns
    start = [(r["doc_id"], r["text"]) for r in docs.collect()]
    toxic = {k for k, _ in start if k < 1000 and k % 7 == 0 or 1000 <= k < 2000 and k % 1000 % 7 == 0}
    assert Counter(kept[0]) == Counter((k, t) for k, t in start if k not in toxic)

    texts = {(k, t) for k, t in kept[0] if t and k not in (3007, 3008)}
    clean = brute_clean(texts)
    assert {k: t for k, t in kept[1] if k in clean} == clean
    assert len(kept[1]) == len(kept[0])

    groups = {k: c for k, _, c, _ in brute_links(kept[1])}
    assert Counter(k for k, _ in kept[2]) == Counter(
        k for k, c in Counter(k for k, _ in kept[1]).items() if groups[k] == k
        for _ in range(1 if k == 3007 else c))

    third = spark.read.parquet(str(tmp_path / "near_duplicates"))
    copies = defaultdict(int)
    for r in mixing.mix(third).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(k for k, _ in kept[3]) == +Counter(copies)

    tokens = Counter()
    for r in kept[4]:
        tokens[r["doc_id"]] += len(r["ids"]) // 4
    want = Counter()
    for k, t in kept[3]:
        want[k] += len(ids_of(t)) + 1
    assert tokens == want
    assert sum(len(np.frombuffer(r["ids"], "<u4")) for r in kept[4]) == sum(want.values())


def test_rows_without_an_id_are_judged(spark, make_docs, tmp_path):
    rows, labels = corpus(240)
    toxic = next(t for k, t, _ in rows if k % 7 == 0 and k % 5 and "scoundrel" in t)
    text = " ".join(f"n{i}" for i in range(60))
    docs = make_docs(rows + [(None, toxic), (None, toxic + " vermin scoundrel"), (5000, text), (None, text + " x"),
                             (None, "a clean text of its own, without an id")]
                     ).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(k, t) for k, _, t in labels], "doc_id long, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    left = [r["text"] for r in clean.filter("doc_id IS NULL").collect()]
    assert sorted(left) == sorted([text + " x", "a clean text of its own, without an id"])
    once = corpus_pipeline.drop_near_duplicates(spark, clean, str(tmp_path))
    assert once.columns == docs.columns
    assert [r["text"] for r in once.filter("doc_id IS NULL").collect()] == [
        "a clean text of its own, without an id"]
    assert once.filter("doc_id = 5000").count() == 1


def test_empty_tables(spark, make_docs, tmp_path):
    docs = make_docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_packing_hands_small_batches_to_workers(spark, make_docs, monkeypatch):
    """The stage's result is lazy, so the session of whoever writes it must keep its batches small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(docs):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])
        return docs.select("text").mapInArrow(run, "n bigint")

    texts = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 3700) AS text")
    monkeypatch.setattr(corpus_pipeline.packing, "pack", sizes)
    try:
        rows = corpus_pipeline.pack_sequences(spark, texts, "").collect()
        assert max(r.n for r in rows) < 6_000_000 and len(rows) >= 4
    finally:
        spark.conf.set(name, before)
