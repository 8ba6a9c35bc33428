"""Exact integer matrix products in a residue number system.

Each factor is reduced modulo a few primes so small that a float32 product of the residues holds
exact integers; the products are put together again by Chinese remaindering, sign included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Components multiplied before the sums are reduced again.
DEPTH = 64
#: A float32 holds all integers up to 2^24; one bit is left for the reduction itself.
_EXACT = 1 << 23
#: With scores up to here the product of the primes, at most 2^10 times larger, fits a long.
MOST_SCORE = 1 << 52


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def primes_for(bound: int) -> list[int]:
    """The largest usable primes whose product exceeds twice ``bound``, so that every integer from
    -bound to bound has its own residues."""
    if bound > MOST_SCORE:
        raise ValueError("scores do not fit a long: scale the vectors down")
    top = 2 * int((_EXACT // DEPTH) ** 0.5) + 1
    found, product = [], 1
    for p in range(top, 2, -1):
        if product > 2 * bound:
            break
        if _is_prime(p):
            found.append(p)
            product *= p
    return found


def _reduced(values: np.ndarray, prime: int) -> np.ndarray:
    """Float32 residues of float32 integers below 2^23, about half the prime at most."""
    return values - np.float32(prime) * np.rint(values * np.float32(1 / prime))


class Residues:
    """A matrix of integers as float32 residue matrices, one for each prime."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.primes = primes
        whole = matrix.astype(np.int64)
        self.parts = []
        for p in primes:
            rest = np.mod(whole, p)
            rest[rest > p // 2] -= p
            self.parts.append(rest.astype(np.float32))

    def rows(self, start: int, end: int) -> Iterator[np.ndarray]:
        for part in self.parts:
            yield part[start:end]


def product(left: Residues, a: slice, right: Residues, b: slice) -> np.ndarray:
    """Exact int64 inner products of the rows ``a`` of one matrix with the rows ``b`` of another."""
    found, modulus = None, 1
    for p, x, y in zip(left.primes, left.rows(a.start, a.stop), right.rows(b.start, b.stop),
                       strict=True):
        rest = np.zeros((len(x), len(y)), np.float32)
        for d in range(0, x.shape[1], DEPTH):
            rest = _reduced(rest + _reduced(x[:, d:d + DEPTH] @ y[:, d:d + DEPTH].T, p), p)
        rest = rest.astype(np.int64)
        if found is None:
            found = np.mod(rest, p)
        else:
            digit = np.mod((rest - found % p) * pow(modulus, -1, p), p)
            found += digit * modulus
        modulus *= p
    if found is None:
        return np.zeros((a.stop - a.start, b.stop - b.start), np.int64)
    found[found > modulus // 2] -= modulus
    return found
