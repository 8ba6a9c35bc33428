"""Word shingles of texts as hashed sets, for joins on overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from shelfglass.llm.wordtokens import copied, slices

#: Words of a shingle; bytes of text that are cut into words together.
WIDTH, SLICE_BYTES = 5, 4_000_000
# Odd multipliers for the places of a shingle, drawn once.
_PLACES = np.random.default_rng(5).integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) \
    + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit sums over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles.

    A-Z are lower-cased; words are runs of anything but the space and the characters 9 to 13. A
    text of fewer words than a shingle has its whole sequence as one; without words, or null, the
    set is empty.
    """
    for a, b in slices(texts, SLICE_BYTES):
        words = pc.ascii_split_whitespace(pc.ascii_lower(copied(texts, a, b)))
        bounds = words.offsets.to_numpy()
        found = words.flatten().dictionary_encode()
        index = found.indices.to_numpy()
        known = found.dictionary.cast(pa.large_binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        empty = np.array([not w for w in known], bool)
        bounds = bounds - bounds[0]
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            here = index[x:y]
            if len(here) and (empty[here[0]] or empty[here[-1]]):
                here = here[~empty[here]]
            h, n = hashes[here], len(here)
            if n >= WIDTH:
                sums = h[:n - WIDTH + 1] * _PLACES[0]
                for k in range(1, WIDTH):
                    sums += h[k:n - WIDTH + 1 + k] * _PLACES[k]
                yield np.unique(_mixed(sums))
            elif n:
                yield _mixed((h * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64)
                             + np.uint64(n))
            else:
                yield np.empty(0, np.uint64)


def set_hash(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a set, and of its size."""
    h = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))
    return h - (1 << 64) if h >= 1 << 63 else h
