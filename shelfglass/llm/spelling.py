"""Spelling variants of a corpus' words, found by PartEnum signatures.

A word's multiset of letters is a binary vector: its dimensions are (letter, occurrence). One
inserted or deleted letter changes one dimension, one replaced letter two, so near words lie within
a Hamming distance of two, words of equal length at exactly two and others at one. The dimensions
are dealt to parts; two vectors that differ in k dimensions agree on all parts but k. Every choice
of k parts to leave out gives a signature, the letters in the other parts, and near words share one
of them exactly: they meet in an equi-join, which keeps only the pairs that one edit turns into each
other.

Words are counted with map-side combine, a signature that many words share is cut into blocks that
meet in pairs, and only verified pairs become rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.llm.registry import query, read
from shelfglass.staging import stage

# The letters of a run, once A-Z are lower-cased.
_LETTERS = "a-zÀ-ÿ"
_NO_LETTER = re.compile(f"[^{_LETTERS}]")
#: The fewest letters and occurrences of a word.
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: Characters of a text that are cut into runs at a time, and words that a task counts at a time.
PIECE_CHARS, HELD_WORDS = 1_000_000, 200_000
#: A word's form occurs so many times as often.
FORM_FACTOR = 5
#: One run in so many loses a letter in the registered query, to have variants to find.
NOISE = 199
#: Words of one block of a signature.
BLOCK_WORDS = 512


# --- counting --------------------------------------------------------------------------------

def _pieces(text: str) -> Iterator[str]:
    """A text in stretches of about ``PIECE_CHARS`` that end between runs."""
    start = 0
    while start < len(text):
        gap = _NO_LETTER.search(text, start + PIECE_CHARS)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def shortened(runs: list[str], start: int, noise: int) -> dict[str, str]:
    """Runs that lose the letter that their hash names, since ``noise`` divides it, with what is
    left; ``start`` is the hash of what comes before a run."""
    every = list(set(runs))
    hashes = np.fromiter(map(zlib.crc32, map(str.encode, every), repeat(start)), np.uint32, len(every))
    found = {}
    for i in np.flatnonzero(hashes % noise == 0).tolist():
        at = int(hashes[i]) % len(every[i])
        found[every[i]] = every[i][:at] + every[i][at + 1:]
    return found


def word_counts(docs: DataFrame, key: str, text: str, letters: int, least: int,
                noise: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``letters`` letters that occur ``least`` times.

    Words are the runs with A-Z lower-cased; with ``noise`` a run loses the letter that the crc32 of
    ``<key>:<run>`` names if ``noise`` divides it, a null key being empty. Counts are combined in
    the task, at most ``HELD_WORDS`` words at a time, before the shuffle.
    """
    runs = re.compile(f"[{_LETTERS}]{{{letters},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            words = [w for w, n in held.items() if n]
            counts = pa.array([held[w] for w in words], pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), counts], ["word", "n"])

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not raw.is_valid:
                    continue
                start = zlib.crc32(f"{'' if own is None else own}:".encode())
                # On bytes, lower() changes the letters A-Z alone.
                for piece in _pieces(raw.as_py().lower().decode("utf-8", "replace")):
                    found = runs.findall(piece)
                    held.update(found)
                    less = shortened(found, start, noise) if noise else {}
                    for run, n in Counter(filter(less.__contains__, found)).items():
                        held[run] -= n
                        if len(less[run]) >= letters:
                            held[less[run]] += n
                if len(held) > HELD_WORDS:
                    yield rows()
        yield rows()

    parts = docs.select(F.col(key).cast("string"), F.col(text).cast("binary")).mapInArrow(
        counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- signatures --------------------------------------------------------------------------------

def letter_counts(words: DataFrame) -> dict[str, int]:
    """Occurrences of each letter; at most as many rows as the alphabet has letters."""
    rows = words.select(F.explode(F.split("word", "")).alias("letter")).filter(
        "letter <> ''").groupBy("letter").count().collect()
    return {r["letter"]: r["count"] for r in rows}


def letter_parts(counts: dict[str, int], parts: int) -> dict[str, int]:
    """The part of each letter, so that parts hold about equally many occurrences."""
    load, dealt = [0] * parts, {}
    for letter in sorted(counts, key=lambda c: (-counts[c], c)):
        part = min(range(parts), key=lambda p: (load[p], p))
        dealt[letter] = part
        load[part] += counts[letter]
    return dealt


def signatures(words: DataFrame, dealt: dict[str, int], parts: int, left_out: int) -> DataFrame:
    """(word, size, sig) with one signature for every choice of parts left out: its number and the
    letters of the other parts, sorted, so that their order in the word does not matter."""
    def letters(part: int) -> Column:
        others = "".join(c for c, p in dealt.items() if p != part)
        kept = F.translate("word", others, "")
        return F.xxhash64(F.array_sort(F.split(kept, "")))

    in_parts = words.select("word", *[letters(p).alias(f"p{p}") for p in range(parts)])
    every = F.array(*[
        F.xxhash64(F.lit(i), *[f"p{p}" for p in range(parts) if p not in out])
        for i, out in enumerate(combinations(range(parts), left_out))])
    return in_parts.select("word", F.length("word").alias("size"), F.explode(every).alias("sig"))


def _meeting(left: DataFrame, right: DataFrame, once: Column, block: int) -> DataFrame:
    """(a, b) of the words of both sides (word, sig, tag) one edit apart that share a signature and
    tag; ``tag`` is the length of the shorter word, whose first or last half is untouched."""
    crowded = right.groupBy("sig", "tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    crowded = stage(crowded.select("sig", "tag", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
                    "crowded")
    half = F.floor(F.col("tag") / 2).cast("int")

    def placed(side: DataFrame, s: str, own: str, other: str) -> DataFrame:
        blocks = F.coalesce("blocks", F.lit(1))
        rows = side.join(crowded, ["sig", "tag"], "left").select(
            "word", "sig", "tag", F.hash(F.left("word", half)).alias("head"),
            F.hash(F.right("word", half)).alias("tail"),
            F.pmod(F.xxhash64("word"), blocks).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias(other))
        return rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns])

    a, b = placed(left, "a", "row", "column"), placed(right, "b", "column", "row")
    meet = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("sig", "tag", "row", "column")]
    half_kept = (F.col("a_head") == F.col("b_head")) | (F.col("a_tail") == F.col("b_tail"))
    one_edit = F.levenshtein("a_word", "b_word", 1) == 1
    return a.join(b, [*meet, once, half_kept, one_edit]).select(
        F.col("a_word").alias("a"), F.col("b_word").alias("b"))


def near_pairs(words: DataFrame, parts: int | None = None, block: int = BLOCK_WORDS) -> DataFrame:
    """(a, b) of all words (word) that one inserted, deleted or replaced letter turns into each
    other, each pair once.

    Words of equal length meet in signatures without two of ``parts`` parts, words whose lengths
    differ by one in signatures without one of ``parts - 2``. More parts mean more signatures and
    fewer words that share one without being near; by default there is a part more for ten times the
    words. A signature of more than ``block`` words is cut into blocks, and each of its words goes to
    its own block's pairs with all blocks, so that no task meets more than about ``block`` words with
    as many, and nothing is left out.
    """
    parts = parts or max(4, len(str(words.count())) - 1)
    apart_parts = max(2, parts - 2)
    counts = letter_counts(words)
    even = stage(signatures(words, letter_parts(counts, parts), parts, 2).select(
        "word", "sig", F.col("size").alias("tag")), "signatures")
    odd = stage(signatures(words, letter_parts(counts, apart_parts), apart_parts, 1), "signatures")
    equal = _meeting(even, even, F.col("a_word") < F.col("b_word"), block)
    apart = _meeting(odd.select("word", "sig", F.col("size").alias("tag")),
                     odd.select("word", "sig", (F.col("size") - 1).alias("tag")), F.lit(True), block)
    return equal.unionByName(apart).distinct()


# --- forms -------------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to. Counts grow along forms, so
    there is no circle; every round doubles the steps taken."""
    at = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stage(at.join(ahead, "root").select(
            "word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
            "roots")
        at = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, *, factor: int = FORM_FACTOR, parts: int | None = None,
             block: int = BLOCK_WORDS) -> DataFrame:
    """Words (word, n) with their near words: (word, form, root, n, n_near, form_n).

    ``form`` is the near word of the largest n, ties by the smallest in code-point order, if its n
    is at least ``factor`` times the word's; ``root`` is reached by following forms, the word itself
    without any. ``n_near`` counts all near words. Words are distinct and not null. An empty table
    gives none.
    """
    words = stage(words.select("word", "n"), "words")
    pairs = stage(near_pairs(words.select("word"), parts, block), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = named.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= F.col("n") * factor
    judged = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n")), "judged")
    return judged.join(roots(judged), "word").select(
        "word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                      letters: int = LEAST_LETTERS, least: int = LEAST_COUNT,
                      noise: int | None = None) -> DataFrame:
    """Variants among all words of the texts, maximal runs of Latin letters with A-Z lower-cased.

    Words of at least ``letters`` code points that occur at least ``least`` times overall take part;
    nothing else is left out. ``noise`` deletes a letter from one run in so many, see ``word_counts``.
    Null and empty texts hold no words; every row counts, repeated ones too; a null key is an empty
    one for the noise; further columns are ignored, and an empty table gives no rows.
    """
    return variants(word_counts(docs, key, text, letters, least, noise))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(read(spark, sf_dir, "documents"), noise=NOISE)
