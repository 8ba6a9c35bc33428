import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from shelfglass.llm import jaccard_join, line_chunks, simhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    up, links = list(range(len(rows))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            up[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least[root(i)], k) if x is not None), default=None)
    return Counter((k, len(sets[i]), least[root(i)], links[i]) for i, (k, _) in enumerate(rows))


def near_copies(seed, groups, copies):
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(30)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
            if rng.random() < 0.5:
                words += passage
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_join_equals_brute_force(make_docs, monkeypatch, small):
    if small:  # many blocks in every group
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
        monkeypatch.setattr(jaccard_join, "MOST_SETS", 3)
    rows = ODD + [(100 + k, t) for k, t in near_copies(3, 25, 12)]
    got = jaccard_join.link_documents(make_docs(rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_links(rows)


def test_rows_without_an_id_keep_their_links(make_docs):
    text = " ".join(f"n{i}" for i in range(60))
    rows = [(None, text), (None, text + " more"), (7, text + " other"), (None, "far " * 3 + text[:90]),
            (None, text + " more"), (None, " ".join(f"m{i}" for i in range(60))),
            (None, " ".join(f"m{i}" for i in range(59)))]
    got = Counter(tuple(r) for r in jaccard_join.link_documents(make_docs(rows)).collect())
    assert got == brute_links(rows)
    assert sum(n for (_, _, c, _), n in got.items() if c == 7) == 4


@pytest.mark.parametrize("kind", ["int", "smallint", "double", "decimal(20,0)", "string"])
def test_join_takes_keys_of_any_type(spark, make_docs, kind):
    text = " ".join(f"n{i}" for i in range(60))
    docs = make_docs([(1, text), (2, text + " x"), (3, "alone")])
    docs = docs.withColumn("doc_id", docs["doc_id"].cast(kind))
    got = {str(int(float(r["doc_id"]))): str(int(float(r["component_id"])))
           for r in jaccard_join.link_documents(docs).collect()}
    assert got == {"1": "1", "2": "1", "3": "3"}


def test_join_of_an_empty_table(make_docs):
    assert jaccard_join.link_documents(make_docs([])).collect() == []


def test_a_text_goes_to_a_task_once(spark):
    """Groups that overlap share a home, and the copies of a set's key in them one row per task."""
    nodes = spark.createDataFrame([(i, i * 10, 0, 50, 1) for i in (1, 2, 3, 4, 8, 9)],
                                  "node long, key long, other long, n long, copies long")
    meetings = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (2, 2), (3, 2), (3, 3), (4, 3),
                                      (8, 8), (9, 8)], "node long, center long")
    members = jaccard_join._members(nodes, meetings)
    rows = jaccard_join._sendings(members, 1 << 40).collect()
    cells = [(r.node, c.center, c.low, c.high, c.left) for r in rows for c in r.cells]
    assert sorted(cells) == sorted((m.node, m.center, 0, 0, True) for m in meetings.collect())
    assert Counter(r.node for r in rows) == {1: 1, 2: 1, 3: 1, 4: 1, 8: 1, 9: 1}
    assert len({r.task for r in rows}) == 2


def test_packed_texts_are_smaller_and_whole(make_docs):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(600))
    docs = make_docs([(1, text), (2, None), (None, "é ΣΣ"), (4, "")]).select(
        F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("other"), "text")
    rows = jaccard_join._packed(docs).toArrow()
    back = jaccard_join._unpacked(rows["packed"], rows["length"]).to_pylist()
    assert dict(zip(rows["key"].to_pylist(), back, strict=True)) == {
        1: text, 2: "", None: "é ΣΣ", 4: ""}
    assert max(map(len, rows["packed"].to_pylist())) < 0.6 * len(text)


def test_texts_are_not_joined_by_broadcast(spark, make_docs, monkeypatch):
    plans = []
    real = jaccard_join.stage

    def kept(df, label="stage", **settings):
        if label == "links":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, label, **settings)

    monkeypatch.setattr(jaccard_join, "stage", kept)
    text = " ".join(f"w{i}" for i in range(40))
    jaccard_join.link_documents(make_docs([(1, text), (2, text + " end")])).collect()
    assert "strategy=merge" in plans[0]


def test_binary_probe_and_merge_agree():
    rng = np.random.default_rng(1)
    common = np.arange(40, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(100, 10**6, 6).astype(np.uint64)])
            for _ in range(80)]
    sets += [np.unique(rng.integers(0, 10**6, 45).astype(np.uint64)) for _ in range(200)]
    lists = jaccard_join.Lists(sets)
    for s in sets:
        want = [j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o))
                >= 75 * len(np.union1d(s, o))]
        assert lists.linked(s, 75).tolist() == want


def brute_clean(rows):
    """Line chunks by loops, from the definition."""
    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)

    def long(line):
        return len(line.encode().split()) >= line_chunks.LONG_WORDS

    def cut(text):
        lines, out = text.split("\n"), [[]]
        for i, line in enumerate(lines):
            out[-1].append(line)
            if i + 1 < len(lines):
                after = lines[i + 1]
                if long(line) or long(after) or (
                        h(line) * 31 + h(after)) % line_chunks.MEAN_LINES == 0:
                    out.append([])
        return ["\n".join(c) for c in out]

    seen, clean = set(), {}
    for k, text in sorted(rows):
        kept = []
        for c in cut(text):
            counts = sum(bool(x.encode().split()) for x in c.split("\n")) >= 2 or any(
                map(long, c.split("\n")))
            if not (counts and c in seen):
                kept.append(c)
            if counts:
                seen.add(c)
        clean[k] = "\n".join(kept)
    return clean


def test_line_chunks_equal_brute_force(make_docs):
    rng = random.Random(5)
    short = [f"line {i} of some words" for i in range(40)]
    paragraph = " ".join(f"q{i}" for i in range(60))
    rows = []
    for k in range(60):
        a = rng.randrange(30)
        lines = [f"own {k} {i}" for i in range(rng.randrange(4))] + short[a:a + rng.randrange(12)]
        lines += rng.choice([[], [paragraph], ["", ""], ["x\x01y\x02", "\x02a"]]) + [f"end {k}"]
        rows.append((k, "\n".join(lines)))
    got = {r["doc_id"]: r["text"] for r in line_chunks.drop_repeats(make_docs(rows)).collect()}
    want = brute_clean(rows)
    assert got == want
    assert sum(paragraph in t for t in got.values()) == 1


def test_line_chunks_of_odd_rows(odd, make_docs):
    out = line_chunks.drop_repeats(odd)
    assert out.columns == [*odd.columns, "n_removed"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(ODD)
    assert line_chunks.drop_repeats(make_docs([])).collect() == []


def test_fingerprints_equal_votes(spark, make_docs):
    docs = make_docs([r for r in ODD if r[1] and r[0]]).select("doc_id", "text").distinct()
    terms = {(r["doc_id"], r["text"]): r["t"] for r in docs.select(
        "doc_id", "text", simhash.terms(F.col("text")).alias("t")).collect()}
    low = spark.createDataFrame([(x,) for t in terms.values() for x in t] or [(0,)], "h long").select(
        "h", F.xxhash64("h").alias("g")).distinct().collect()
    second = {r["h"]: r["g"] for r in low}
    for r in simhash.fingerprints(docs, ["doc_id", "text"], "text").collect():
        mine = terms[r["doc_id"], r["text"]]
        for got, hashes in ((r["low"], mine), (r["high"], [second[x] for x in mine])):
            bits = sum(1 << b for b in range(64)
                       if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))
            assert got & (2**64 - 1) == bits


def test_radius_search_equals_brute_force(spark):
    rng = random.Random(2)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(20)]
    prints = set(base)
    for h, l in base:
        for _ in range(10):
            for _ in range(rng.randrange(1, 9)):
                b = rng.randrange(128)
                h, l = (h ^ 1 << b - 64, l) if b >= 64 else (h, l ^ 1 << b)
            prints.add((h, l))
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in p) for p in prints]
    frame = spark.createDataFrame(signed + signed[:5], "high long, low long")
    got = {tuple(r) for r in simhash.within_radius(frame, frame, radius=6).collect()}
    mask = (1 << 64) - 1
    want = {(*a, *b) for a in signed for b in signed
            if sum(bin((x ^ y) & mask).count("1") for x, y in zip(a, b, strict=True)) <= 6}
    assert got == want


@pytest.mark.parametrize("radius,blocks", [(simhash.RADIUS, simhash.BLOCKS), (3, 6), (9, 11)])
def test_radius_search_finds_each_pair_once(spark, radius, blocks):
    rng = random.Random(8)
    base = [rng.getrandbits(128) for _ in range(12)]
    prints = {x ^ sum(1 << b for b in rng.sample(range(128), n)) for x in base for n in range(25)}
    prints |= {base[0] ^ ((1 << n) - 1) << 50 for n in range(25)} | {0, (1 << 128) - 1}
    signed = {x: tuple(w - (1 << 64) if w >> 63 else w for w in (x >> 64, x & (1 << 64) - 1))
              for x in prints}
    frame = spark.createDataFrame(list(signed.values()), "high long, low long")
    got = Counter(tuple(r) for r in simhash.within_radius(frame, frame, radius, blocks).collect())
    assert got == Counter((*signed[a], *signed[b]) for a in prints for b in prints
                          if (a ^ b).bit_count() <= radius)


def test_probes_are_made_in_all_tasks_and_not_broadcast(spark):
    """Few prints are small to a plan, the values they are probed with are not."""
    prints = spark.range(2000).select(F.xxhash64("id").alias("high"),
                                      F.xxhash64("id", F.lit(1)).alias("low"))
    found = simhash.within_radius(prints.filter("high % 10 = 0"), prints)
    assert found.count() == prints.filter("high % 10 = 0").count()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [bits" in plan and "BroadcastExchange" not in plan
    dealt = plan[:plan.index("REPARTITION_BY_NUM")].splitlines()[-3:]
    assert "Generate explode(concat" in dealt[0] and "AQEShuffleRead" not in "".join(dealt)


def test_near_count_reaches_a_jaccard_of_three_quarters(spark, make_docs, tmp_path):
    rng = random.Random(9)
    rows = []
    for k in range(0, 400, 20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((k, " ".join(words)))
        for at in (40, 90, 120, 160):
            words[at] = f"other{k}"
        rows.append((k + 1, " ".join(words)))
    assert all(len(shingle_set(a) & shingle_set(b)) >= 0.75 * len(shingle_set(a) | shingle_set(b))
               for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["n_near"] for r in simhash.op4_simhash(spark, str(tmp_path)).collect()
           if r["doc_id"] % 20 == 0]
    assert sum(n >= 1 for n in got) >= 0.9 * len(got)


def test_next_text_by_id(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_GROUPS", 2)
    rows = [(k, f"t{k}") for k in (-500, -3, 0, 1, 63, 64, 700, 10_000, 10_001, 999_999)]
    got = {r["id"]: r["next_text"] for r in
           simhash.with_next_text(make_docs(rows), "doc_id", "text").collect() if not r["ghost"]}
    assert got == {a: t for (a, _), (_, t) in zip(rows, rows[1:] + rows[:1], strict=True)}
    one = simhash.with_next_text(make_docs([(5, None)]), "doc_id", "text").filter("NOT ghost")
    assert [(r["text"], r["next_text"]) for r in one.collect()] == [("", "")]


def test_simhash_query_on_odd_rows(spark, odd, make_docs, tmp_path):
    for name, docs, n in (("odd", odd, len(ODD)), ("none", make_docs([]), 0)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = simhash.op4_simhash(spark, str(tmp_path / name)).collect()
        assert len(rows) == n
        same = {r["fingerprint"] for r in rows if r["doc_id"] in (6, 7)}
        assert len(same) <= 1
