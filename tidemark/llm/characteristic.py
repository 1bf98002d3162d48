"""Exact characteristic polynomials of integer matrices, their real roots, and vectors of their null spaces.

The polynomial is computed modulo many primes, each by reduction to Hessenberg
form, and put together by Chinese remainders. Roots are isolated with exact
integers: all roots of a covariance are real, and for such a polynomial the
changes of sign after a shift by t count the roots beyond t, with their
multiplicity. Vectors come from inverse iteration in decimal arithmetic of many
digits, so a double holds all of its digits rightly.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb

import numpy as np

#: Bits to which roots are narrowed, in proportion to their size; closer ones share a space. Digits of the vectors' arithmetic.
ROOT_BITS, DIGITS = 110, 90


def is_prime(n: int) -> bool:
    """Exact below 3e9."""
    if n < 4:
        return n > 1
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return n % 2 == 1 and all(pow(b, odd, n) in (1, n - 1) or any(pow(b, odd << i, n) == n - 1 for i in range(twos)) for b in (2, 3, 5, 7) if b % n)


def enough_primes(bound: int) -> list[int]:
    """Primes below 2^31 whose product is more than twice ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def coefficient_bound(trace: int, size: int) -> int:
    """No coefficient is larger, for a matrix without negative eigenvalues."""
    each = trace // max(size, 1) + 1
    return max(comb(size, k) * each**k for k in range(size + 1))


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime below 2^31, the constant one first."""
    h = (matrix % p).astype(np.int64)
    n = len(h)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    # The polynomial of each leading block, from those of the smaller ones.
    of = np.zeros((n + 1, n + 1), np.int64)
    of[0, 0] = 1
    for k in range(1, n + 1):
        of[k, 1:] = of[k - 1, :-1]
        of[k] = (of[k] - h[k - 1, k - 1] * of[k - 1] % p) % p
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            of[k] = (of[k] - int(h[i - 1, k - 1]) * product % p * of[i - 1] % p) % p
    return of[n]


def from_remainders(remainders: list[tuple[int, list[int]]]) -> list[int]:
    """The integers of least size with the given remainders (prime, remainder of each)."""
    out, modulus = [0] * len(remainders[0][1]), 1
    for p, found in remainders:
        back = pow(modulus % p, -1, p)
        out = [c + modulus * ((int(r) - c) * back % p) for c, r in zip(out, found, strict=True)]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in out]


class RealRoots:
    """The positive roots of an integer polynomial that has only real, no negative ones."""

    def __init__(self, coefficients: list[int]):
        zeros = next(i for i, c in enumerate(coefficients) if c)
        self.c = coefficients[zeros:]
        self.degree = len(self.c) - 1

    def _scaled(self, bits: int) -> list[int]:
        """Coefficients, highest first, of the polynomial in units of 2^-bits, made integers."""
        return [c << (bits * i) for i, c in enumerate(reversed(self.c))]

    def beyond(self, at: int, bits: int) -> int:
        """Roots larger than at / 2^bits, by the changes of sign of the polynomial shifted there."""
        c = self._scaled(bits)
        for last in range(len(c) - 1, 0, -1):
            for i in range(1, last + 1):
                c[i] += at * c[i - 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, at: int, bits: int) -> int:
        value = 0
        for c in self._scaled(bits):
            value = value * at + c
        return (value > 0) - (value < 0)

    def largest(self, k: int) -> list[tuple[Fraction, int]]:
        """(root, multiplicity) from the largest on, until k are found; roots that agree in ``ROOT_BITS`` bits count as one."""
        out: list[tuple[Fraction, int]] = []
        if not self.degree:
            return out
        top = max(1, -self.c[-2] // self.c[-1] + 1).bit_length()  # all roots are positive, so none is beyond their sum
        # Intervals (at, at + 1] / 2^bits with the numbers of roots beyond their ends; wider ones than 1 have negative bits.
        todo = [(0, -top, self.degree, 0)]
        while todo and sum(m for _, m in out) < k:
            at, bits, low, high = todo.pop()
            if low == high:
                continue
            if low - high == 1:
                out.append((self._narrowed(at, bits, high), 1))
            elif at >> ROOT_BITS:
                out.append((_half(2 * at + 1, bits + 1), low - high))
            else:
                middle = self.beyond(*_whole(2 * at + 1, bits + 1))
                todo += [(2 * at, bits + 1, low, middle), (2 * at + 1, bits + 1, middle, high)]
        return out

    def _narrowed(self, at: int, bits: int, high: int) -> Fraction:
        """The only root in (at, at + 1] / 2^bits, by halving; ``high`` roots are beyond."""
        past = (-1) ** high * (1 if self.c[-1] > 0 else -1)
        while not at >> ROOT_BITS:
            at, bits = 2 * at, bits + 1
            found = self.sign(*_whole(at + 1, bits))
            if found == 0:
                return _half(at + 1, bits)
            at += found != past
        return _half(2 * at + 1, bits + 1)


def _whole(at: int, bits: int) -> tuple[int, int]:
    return (at, bits) if bits >= 0 else (at << -bits, 0)


def _half(at: int, bits: int) -> Fraction:
    at, bits = _whole(at, bits)
    return Fraction(at, 1 << bits)


def null_vectors(matrix: np.ndarray, root: Fraction, count: int, rounds: int = 12) -> np.ndarray:
    """``count`` orthonormal vectors of a symmetric integer matrix's space of a root, as rows, by inverse iteration.

    The largest entry of a vector is positive.
    """
    n = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS + len(str(abs(root.numerator) // root.denominator + 1))
        value = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(int(x)) for x in row] for row in matrix], object)
        shifted = a - np.diag([value] * n) if n > 1 else a - value
        tiny = value * Decimal(10) ** -(context.prec - 5)
        order, lower = list(range(n)), shifted.reshape(n, n).copy()
        for k in range(n):
            pivot = k + int(np.argmax(np.abs(lower[k:, k])))
            if pivot != k:
                lower[[k, pivot]] = lower[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if abs(lower[k, k]) < tiny:
                lower[k, k] = tiny
            lower[k + 1 :, k] = lower[k + 1 :, k] / lower[k, k]
            lower[k + 1 :, k + 1 :] -= lower[k + 1 :, k, None] * lower[k, k + 1 :]
        start = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 20, (count, n))
        vectors = _orthonormal(np.array([[Decimal(int(x)) for x in row] for row in start], object).reshape(count, n))
        for _ in range(rounds):
            before, solved = vectors, []
            for v in vectors:
                x = v[order].copy()
                for k in range(n):
                    x[k + 1 :] -= lower[k + 1 :, k] * x[k]
                for k in range(n - 1, -1, -1):
                    x[k] = x[k] / lower[k, k]
                    x[:k] -= lower[:k, k] * x[k]
                solved.append(x)
            vectors = _orthonormal(np.array(solved, object).reshape(count, n))
            # Within its space a set of vectors may turn; what counts is that the space stays.
            rest = vectors - (vectors @ before.T) @ before
            if max(abs(x) for x in rest.ravel()) < Decimal(10) ** -30:
                break
        out = vectors.astype(float)
    return out * np.sign(out[np.arange(count), np.abs(out).argmax(1)])[:, None]


def _orthonormal(vectors: np.ndarray) -> np.ndarray:
    out: list[np.ndarray] = []
    for v in vectors:
        v = v / max(abs(x) for x in v)
        for _ in range(2):
            for u in out:
                v = v - u * (v @ u)
        out.append(v / (v @ v).sqrt())
    return np.array(out, object)
