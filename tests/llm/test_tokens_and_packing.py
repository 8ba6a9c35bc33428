import os
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import LONG, ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfglass.llm import packing, token_counts, wordtokens
from shelfglass.staging import stage


def ids_of(text, plain=False):
    t = Tokenizer.from_file(wordtokens.VOCABULARY)
    t.encode_special_tokens = plain
    return t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB cé.,'\n\t!5_İΣ“\x1c²<|>", max_size=30), max_size=6))
def test_words_encode_like_texts(texts):
    tok = wordtokens.tokenizer()
    got = [x.tolist() for x in tok.encode(pa.array(texts, pa.string()))]
    assert got == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_stops_after_letters_that_end_in_a_mark():
    tok = wordtokens.tokenizer()
    texts = [f"{c}{stop}" for c in "İ\u0958\u09df\u0a36\u0a5e\u0b5c\u0f69\ufb1d\ufb4eéд" for stop in (". ", ",\nx")]
    got = [x.tolist() for x in tok.encode(pa.array(texts))]
    assert got == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_do_not_change_ids(monkeypatch):
    texts = pa.array([t for _, t in ODD] * 2, pa.string())
    whole = [x.tolist() for x in wordtokens.tokenizer().encode(texts)]
    monkeypatch.setattr(wordtokens, "SLICE_BYTES", 10)
    monkeypatch.setattr(wordtokens, "GATHER_BYTES", 5)
    assert [x.tolist() for x in wordtokens.tokenizer().encode(texts)] == whole


def test_packing_places_every_id_once(odd):
    rows = packing.pack(odd, length=64).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        n = len(r["ids"]) // 4
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], n))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    whole = defaultdict(list)
    for k, t in ODD:
        whole[k] += [*ids_of(t), 1]
    for k, want in whole.items():
        got = [x for _, part in sorted(pieces[k]) for x in part]
        assert sorted(got) == sorted(want) if k in (7, 8) else got == want


def test_packing_an_empty_table(make_docs):
    assert packing.pack(make_docs([])).collect() == []


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    along = cells[np.argsort(keys)]
    assert (abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_token_counts_of_written_files(odd):
    blocks = token_counts.write_token_blocks(odd, block_ids=16)
    assert blocks.count() > 100
    rows = token_counts.count_tokens(blocks, separator=49407, block_ids=16).collect()
    assert all(r["ended"] for r in rows)
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(ids_of(t, True)) for _, t in ODD)


@pytest.mark.parametrize("block_ids", [1, 3, 7, 1000])
def test_separators_across_blocks(spark, tmp_path, monkeypatch, block_ids):
    monkeypatch.setattr(token_counts, "GROUP_BLOCKS", 2)
    files = {"a": [5, 6, 0, 0, 7, 0, 8, 9, 9], "b": [0], "c": [1, 2, 3], "d": []}
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    blocks = token_counts.read_flat_files(spark, str(tmp_path), block_ids=block_ids)
    rows = token_counts.count_tokens(blocks, separator=0, block_ids=block_ids).collect()
    got = sorted((r["file"][-5], r["document"], r["start"], r["n_tokens"], r["ended"]) for r in rows)
    assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, True),
                   ("a", 3, 6, 3, False), ("b", 0, 0, 0, True), ("c", 0, 0, 3, False)]


def test_token_counts_of_an_empty_table(make_docs):
    blocks = token_counts.write_token_blocks(make_docs([]))
    assert token_counts.count_tokens(blocks, separator=49407).collect() == []


def test_long_text_is_whole():
    assert len(ids_of(LONG)) == len(next(wordtokens.tokenizer().encode(pa.array([LONG]))))


def test_a_worker_holds_little_text_and_starts_no_threads(spark, monkeypatch):
    """Batches of texts of 40 kB stay near 4 MB, and the tokenizer runs in the task's own thread."""
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")

    def sizes(batches):
        wordtokens.tokenizer(plain=True)
        on = os.environ["TOKENIZERS_PARALLELISM"]
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([on])], ["n", "on"])

    texts = spark.range(0, 400, 1, 1).select(F.expr("repeat('some words ', 3700)").alias("text"))
    rows = stage(texts.mapInArrow(sizes, "n bigint, on string"), small_batches=True).collect()
    assert max(r.n for r in rows) < 6_000_000 and len(rows) >= 4
    assert {r.on for r in rows} == {"false"}


def test_staging_leaves_no_shuffle_files(spark):
    """A table once written needs its shuffles no more; they would wait for the driver's garbage
    collection, as would their blocks' records there."""
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(f.getName().startswith("shuffle_") for f in (
            found.apply(i) for found in [manager.getAllFiles()] for i in range(found.length())))

    before = files()
    stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before


def test_plain_words_are_encoded_as_one_text():
    """A call of the tokenizer for thousands of plain words, not one text a word; same ids."""
    words = [f"{a}{b}{end}" for a in ("the", "ñu", "straße", "zq") for b in ("xo", "ing", "")
             for end in ("", ".", "&&&", "#-", "=>", "_x", "7", "'s", "<b", "É")]
    made = wordtokens.WordTokenizer()
    asked = []
    real = made.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **kw)

    made.tokenizer = Counted()
    got = [np.frombuffer(raw, np.uint32).tolist() for raw in made._ids(words)]
    assert got == [real.encode(w, add_special_tokens=False).ids for w in words]
    plain = sum(w.endswith(("_x", "7", "'s", "<b", "É")) for w in words)
    assert len(asked) == plain + 1
    made.ends[:] = False  # a vocabulary that splits otherwise is asked word by word
    made.forget()
    assert [np.frombuffer(raw, np.uint32).tolist() for raw in made._ids(words)] == got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=[chr(c) for c in range(33, 256)], min_size=1, max_size=5), unique=True, max_size=20))
def test_words_of_any_marks_encode_alone_and_together(words):
    made = wordtokens.tokenizer()
    made.forget()
    got = [np.frombuffer(raw, np.uint32).tolist() for raw in made._ids(words)]
    assert got == [made.tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_remembered_words_are_bounded_and_go_with_the_task(monkeypatch):
    monkeypatch.setattr(wordtokens, "KNOWN_WORDS", 50)
    made = wordtokens.tokenizer()
    made.forget()
    for k in range(20):
        made._ids([f"w{k}x{i}" for i in range(40)] + ["always"])
    assert "always" in made.known and len(made.known) + len(made.older) <= 2 * (50 + 41)
    wordtokens.give_back()
    assert not made.known and not made.older
