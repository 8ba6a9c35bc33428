"""Token ids of texts, word by word, for tokenizers that split at white space and drop it.

Ids of a text are those of its words in order, so a slice of texts is cut into words, every
distinct word is encoded once, and the ids are gathered for all words at a time. Plain words are
encoded as one text, which costs half of what texts of their own do, and cut behind the ids that
end a token of the tokenizer's splitter.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of text that are cut into words together (a longer text is a slice by itself), distinct
#: words encoded at a time, words met lately whose ids a worker remembers (and as many from before
#: them), and bytes of text whose ids are gathered at a time.
SLICE_BYTES, WORDS_AT_ONCE, KNOWN_WORDS, GATHER_BYTES = 1_000_000, 4_000, 50_000, 2_000_000

# Texts that keep their capitals: lowering letters from U+0130 on may depend on their neighbours,
# and special tokens begin with "<".
_KEEPS_CASE = "[<İ-\U0010ffff]"
# A stop or comma after neither letter nor digit is part of a longer token; so it is after a letter
# that the tokenizer takes apart into a letter and a mark.
_APART = "İ\u0958-\u095f\u09dc-\u09df\u0a33\u0a36\u0a59-\u0a5e\u0b5c\u0b5d\u0f43-\u0f69\ufb1d-\ufb4e"
_JOINED = rf"(?:[^\pL\pN\s]|[{_APART}])[.,][ \n]"
# Letters that stay as they are, then marks: one token of the splitter each. Without the apostrophe,
# which may begin a short form, and "<", which may begin a special token.
_PLAIN = re.compile("([a-zß-öø-ÿ]*)([!-&(-/:;=-@[-`{-~]*)")


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most ``most`` bytes, or of one text."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most ``most`` bytes, or of one row; memory that Arrow keeps
    for later goes back to the system at the end, since a worker may stay idle beside others."""
    for batch in batches:
        for a, b in slices(batch.column(column), most):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return memory that Python, Arrow and the C library keep for later, and drop remembered words: a
    worker stays idle beside others when its task has ended."""
    for made in _made.values():
        made.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU C library
    if trim is not None:
        trim(0)


def frugal(run):
    """A function over batches that gives its memory back once it has ended."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def copied(texts: pa.Array, start: int, end: int) -> pa.Array:
    """A run of texts in memory of its own: ``ascii_lower`` reads the wrong bytes of a slice."""
    return pc.fill_null(texts.take(pa.array(np.arange(start, end))).cast(pa.large_string()), "")


def _words(texts: pa.Array) -> pa.LargeListArray:
    """Words of each text, lower-cased where that is safe; a stop or comma after a letter or digit
    and before a space is a word of its own. Other white space stays inside a word, where the
    tokenizer itself splits."""
    texts = pc.if_else(pc.match_substring_regex(texts, _KEEPS_CASE), texts, pc.utf8_lower(texts))
    joined = pc.match_substring_regex(texts, _JOINED)
    texts = pc.replace_substring(texts, "\n", " ")
    apart = pc.replace_substring(pc.replace_substring(texts, ". ", " . "), ", ", " , ")
    return pc.split_pattern(pc.if_else(joined, texts, apart), " ")


class WordTokenizer:
    """The same ids as ``Tokenizer.encode`` without added special tokens. ``plain`` treats the
    strings of special tokens as text."""

    def __init__(self, path: str = VOCABULARY, *, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _one_by_one(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def _together(self, words: list[str], tokens: list[int]) -> Iterator[bytes]:
        """Ids of plain words of so many tokens each, cut from those of one text."""
        ids = np.array(self.tokenizer.encode_batch_fast(
            [" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        cuts = np.cumsum(tokens)
        if len(ends) != cuts[-1]:  # the vocabulary splits words in another way
            yield from self._one_by_one(words)
            return
        raw, start = ids.tobytes(), 0
        for end in ((ends[cuts - 1] + 1) * 4).tolist():
            yield raw[start:end]
            start = end

    def _learn(self, words: list[str]) -> None:
        plain, tokens, other = [], [], []
        for w in words:
            parts = _PLAIN.fullmatch(w) if len(self.ends) and w else None
            if parts:
                plain.append(w)
                tokens.append(bool(parts[1]) + bool(parts[2]))
            else:
                other.append(w)
        if plain:
            self.known.update(zip(plain, self._together(plain, tokens), strict=True))
        self.known.update(zip(other, self._one_by_one(other), strict=True))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those a worker has met lately are remembered."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        new = []
        for w in words:
            if w not in self.known:
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    self.known[w] = ids
        for a in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[a:a + WORDS_AT_ONCE])
        return [self.known[w] for w in words]

    def forget(self) -> None:
        """Drop the remembered words."""
        self.known, self.older = {}, {}

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, 32 bits each; a null text counts as empty."""
        for a, b in slices(texts, SLICE_BYTES):
            yield from self._slice(copied(texts, a, b))

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words = _words(texts)
        bounds = words.offsets.to_numpy()
        found = words.flatten().dictionary_encode()
        index, known = found.indices.to_numpy(), found.dictionary
        raw = self._ids(known.to_pylist())
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids = np.frombuffer(b"".join(raw), np.uint32)
        first = np.cumsum(sizes) - sizes
        bounds = bounds - bounds[0]
        for a, b in slices(texts, GATHER_BYTES):
            here = index[bounds[a]:bounds[b]]
            counts = sizes[here]
            ends = np.cumsum(counts)
            at = np.repeat(first[here] - (ends - counts), counts)
            at += np.arange(len(at))
            out = ids[at]
            cuts = np.r_[0, ends][bounds[a:b + 1] - bounds[a]]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield out[x:y]


_made: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str = VOCABULARY, *, plain: bool = False) -> WordTokenizer:
    """One tokenizer for each Python worker, without threads of its own: Spark runs a task for each
    core, and every further thread keeps memory that the worker does not give back."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, plain) not in _made:
        _made[path, plain] = WordTokenizer(path, plain=plain)
    return _made[path, plain]
