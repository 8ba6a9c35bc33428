import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfglass.llm import mixing, secret_scan, trigrams

PARTS = ["password", "PassWD = ", "api_key", "token: ", "secret\"='", "AKIA", "ABCDEFGH1234567890",
         "deadbeefdeadbeef", "0123456789abcdef", " ", "\n", "é", "ghp_" + "a1" * 20, "xoxb-1234567890",
         "=", "x" * 12, "-----BEGIN RSA PRIVATE KEY-----", "ſecret=aaaaaaaaaaaaaa"]


def brute(text):
    """Every rule on the whole text, without an index."""
    spans = []
    for k, r in enumerate(secret_scan.RULES):
        flags = re.ASCII | (re.IGNORECASE if r.ignore_case else 0)
        for m in re.finditer(r.pattern, text or "", flags):
            if len(m.group(r.group)) >= r.least:
                spans.append((m.start(), k, m.end()))
    return [(secret_scan.RULES[k].kind, a, b) for a, k, b in sorted(spans)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8).map("".join), max_size=5))
def test_shards_equal_full_scans(texts):
    found = secret_scan._spans(texts, secret_scan.RULES)
    assert [[(s["kind"], s["start"], s["end"]) for s in x] for x in found] == [brute(t) for t in texts]


@pytest.mark.parametrize("pattern,text", [
    ("abcd+", "xABCDDx"), ("(foo|bar)baz", "barbaz"), ("a?bcde", "bcde"), ("[xy]123z", "y123z"),
    ("(ab){2}cd", "ababcd"), ("q.*longer", "q longer"), ("(?:one|two|[0-9]+)", "7")])
def test_queries_hold_for_every_match(pattern, text):
    query = trigrams.derive(pattern)
    index = trigrams.TrigramIndex([text.encode(), b"zz"], sorted(trigrams.trigrams_of(query)))
    assert 0 in index.candidates(query)
    assert query is True or 1 not in index.candidates(query)


def test_scan_of_odd_rows(odd, make_docs):
    rows = secret_scan.digest(secret_scan.scan(odd)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(k) for k, _ in ODD)
    assert all(r["spans"] == "" for r in rows)
    assert secret_scan.scan(make_docs([])).collect() == []


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water filling by repeated resharing."""
    weight = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, out, todo = share * sum(sizes.values()), {}, set(sizes)
    while todo:
        level = left / sum(weight[s] for s in todo)
        full = {s for s in todo if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in todo}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        todo -= full
    return out


def mix_rows(n=400):
    rng = np.random.default_rng(4)
    names = ["b", "a", None, "c", "é", "Z"]
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), names[0 if k % 3 == 0 else k % 6])
            for k in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "none"), (5, rows[5][1], rows[5][2])]


def test_mix_meets_targets(make_docs):
    rows, settings_ = mix_rows(), {"block_words": 300, "shard_words": 1000}
    docs = make_docs(rows)
    first = mixing.mix(docs, **settings_).collect()
    assert len(first) == len(rows)
    source = {k: s for k, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in first:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert len(r["shards"] or []) == r["copies"]
    want = targets(sizes)
    for r in first:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
    for s, t in want.items():
        assert t - 30 <= taken[s] <= t + 1e-6
    again = mixing.mix(docs.repartition(7), **settings_).collect()
    key = lambda r: (r["doc_id"], r["taken"], str(r["shards"]))
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_mixed_rows_are_the_plan(make_docs):
    docs = make_docs(mix_rows(120))
    plan = Counter()
    for r in mixing.mix(docs, block_words=300, shard_words=1000).collect():
        plan[r["doc_id"]] += r["copies"]
    out = mixing.mixed(docs, block_words=300, shard_words=1000)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +plan


def test_every_planned_copy_has_a_shard(make_docs):
    """Texts larger than a block leave most of their source's blocks empty."""
    rows = [(k, " ".join(["w"] * 1000), "a") for k in range(5)]
    rows += [(10 + k, " ".join(["w"] * 50), "b") for k in range(200)]
    docs, settings_ = make_docs(rows), {"block_words": 100, "shard_words": 900}
    plan = Counter()
    for r in mixing.mix(docs, **settings_).collect():
        assert len(r["shards"] or []) == r["copies"]
        plan[r["doc_id"]] += r["copies"]
    assert max(plan[k] for k in range(5)) == 2
    assert Counter(r["doc_id"] for r in mixing.mixed(docs, **settings_).collect()) == +plan


def test_a_large_text_that_does_not_fit_leaves_its_room_to_others(make_docs):
    rows = [(1000 * s, " ".join(["w"] * (600 + 100 * s)), f"s{s}") for s in range(10)]
    rows += [(1000 * s + k, " ".join(["w"] * (5 + k % 16)), f"s{s}")
             for s in range(10) for k in range(1, 100)]
    docs = make_docs(rows)
    short, out = {}, defaultdict(list)
    for r in mixing.mix(docs, weights=(1, 2), block_words=200, shard_words=900).collect():
        s = r["doc_id"] // 1000
        short[s] = short.get(s, r["target"]) - r["taken"]
        assert len(r["shards"] or []) == r["copies"] <= 2
        out[s].append((r["copies"], r["size"]))
    for s, words in short.items():
        most = max(n for n, _ in out[s])
        smallest = min((w for n, w in out[s] if n < most), default=1)
        assert -1e-6 <= words < smallest


def test_splitting_tree_deals_every_block_once():
    quotas = np.array([100, 0, 7, 33])
    every = dict(mixing.split_quotas(quotas, 6, 0, 6, seed=1))
    assert (sum(every.values()) == quotas).all()
    assert max(q.sum() for q in every.values()) - min(q.sum() for q in every.values()) <= 2
    part = dict(mixing.split_quotas(quotas, 6, 2, 4, seed=1))
    assert all((part[s] == every[s]).all() for s in (2, 3)) and set(part) == {2, 3}


def test_mix_of_odd_and_empty_tables(odd, make_docs):
    assert len(mixing.mix(odd).collect()) == len(ODD)
    assert mixing.mix(make_docs([])).collect() == []
    assert mixing.mix(make_docs([(1, None), (2, "")])).count() == 2
