import re
import zlib
from collections import Counter

from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfglass.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, noise, letters=6, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            if noise:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % noise == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
            if len(run) >= letters:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def brute_variants(counts, factor=5):
    holes = {}
    for w in counts:
        for i in range(len(w) + 1):
            holes.setdefault(w[:i] + w[i + 1:], set()).add(w)
    near = {w: {o for i in range(len(w) + 1) for o in holes[w[:i] + w[i + 1:]] if one_edit(w, o)}
            for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
            for r in df.collect()}


def made_rows():
    """Frequent words with rare misspellings of one and two steps, anagrams and accents."""
    base = ["banana", "bananas", "elephant", "élephant", "category", "listen", "silent", "tinsel",
            "abcdefgh", "accommodate", "aaaaaaa", "aaaaaa"]
    text = []
    for i, w in enumerate(base):
        text += [w.upper() if i % 2 else w] * (900 - 40 * i)
        text += [w[:3] + w[4:]] * 30 + [w[:2] + "x" + w[3:]] * (6 + i) + [w + "s"] * 25
        text += [w + "sx"] * 5
    return [(k, " ".join(text[k::7]) + ".") for k in range(7)]


def test_matches_brute_force(spark, make_docs):
    rows = made_rows()
    for noise in (None, 13):
        got = spelling.spelling_variants(make_docs(rows), noise=noise)
        want = brute_variants(brute_counts(rows, noise))
        assert got.count() == len(want)
        assert rows_of(got) == want
        assert any(f is not None and r not in (f, w) for w, f, r, *_ in want)  # a chain of forms


def test_blocks_and_parts_change_nothing(spark, make_docs):
    docs = make_docs(made_rows())
    words = spelling.word_counts(docs, "doc_id", "text", 6, 5)
    want = rows_of(spelling.variants(words))
    assert rows_of(spelling.variants(words, parts=3, block=2)) == want
    assert rows_of(spelling.variants(words, parts=7, block=1)) == want


def test_odd_rows(spark, odd, make_docs):
    plain = [(k, t) for k, t, *_ in ODD]
    got = spelling.spelling_variants(odd, least=1, letters=1, noise=3)
    assert rows_of(got) == brute_variants(brute_counts(plain, 3, letters=1, least=1))
    assert spelling.spelling_variants(make_docs([])).count() == 0
    assert spelling.spelling_variants(make_docs([(1, None), (None, "")])).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("abÀÿ", min_size=6, max_size=8), min_size=1, max_size=40))
def test_near_pairs_by_definition(spark, words):
    words = sorted(set(words))
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(df, block=3).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = spelling.op12_spelling_variants(spark, sf)
    assert rows_of(got) == brute_variants(brute_counts([tuple(r) for r in rows], spelling.NOISE))
    assert got.filter(F.col("form").isNotNull()).count() > 0
