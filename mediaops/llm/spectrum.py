"""Leading eigenpairs of a symmetric matrix by spectrum slicing."""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + 17**0.5) / 8
_EPS = float(np.finfo(float).eps)
#: Eigenvalues below this many rounding errors of the largest one cannot be told from zero to four digits.
_NOISE = 1e4


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than ``shift``: the positive part of the inertia of ``matrix - shift * I``.

    By Sylvester's law the pivots of a symmetric factorization LDL' have the signs of the eigenvalues. Pivots are
    single entries or blocks of two, chosen by size (Bunch and Kaufman), so the count is stable for any shift.
    """
    a = matrix - shift * np.eye(len(matrix))
    n, k, found = len(a), 0, 0
    while k < n:
        pivot, step = abs(a[k, k]), 1
        if k + 1 < n:
            column = np.abs(a[k + 1:, k])
            r = int(column.argmax()) + k + 1
            most = column[r - k - 1]
            if pivot < _ALPHA * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                other = row.max()
                if pivot * other < _ALPHA * most * most:
                    step = 1 if abs(a[r, r]) >= _ALPHA * other else 2
                    to = k + step - 1
                    if to != r:
                        a[[to, r], k:] = a[[r, to], k:]
                        a[k:, [to, r]] = a[k:, [r, to]]
        if step == 1:
            d, column = a[k, k], a[k + 1:, k].copy()
            if d:
                a[k + 1:, k + 1:] -= np.outer(column, column / d)
            found += d > 0
        else:
            block, columns = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2].copy()
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[1, 0], block[0, 0]]]) / det
            a[k + 2:, k + 2:] -= columns @ inverse @ columns.T
            found += 1 if det < 0 else 2 * (block[0, 0] > 0)
        k += step
    return int(found)


class _Slices:
    """Counts at shifts tried so far, between which eigenvalues are looked for."""

    def __init__(self, matrix: np.ndarray) -> None:
        self._matrix = matrix
        self.norm = float(np.abs(matrix).sum(axis=1).max())
        self._counts = {-1.5 * self.norm: len(matrix), 1.5 * self.norm: 0}

    def count(self, shift: float) -> int:
        if shift not in self._counts:
            self._counts[shift] = above(self._matrix, shift)
        return self._counts[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The closest shifts known with the k-th largest eigenvalue between them."""
        return (max(s for s, c in self._counts.items() if c >= k), min(s for s, c in self._counts.items() if c < k))


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray, norm: float) -> np.ndarray:
    for _ in range(60):
        try:
            y = np.linalg.solve(matrix - shift * np.eye(len(matrix)), x)
            if np.isfinite(y).all():
                return y
        except np.linalg.LinAlgError:
            pass
        shift += 4 * _EPS * norm
    return x


def _quotient_iteration(matrix: np.ndarray, shift: float, found: np.ndarray, start: np.ndarray, norm: float) -> tuple[float, np.ndarray]:
    """Inverse iteration at ``shift``, then with Rayleigh quotients as shifts; orthogonal to ``found``."""
    x, best, least = start, (shift, start), np.inf
    for turn in range(12):
        x = _solve(matrix, shift, x, norm)
        for _ in range(2):
            x = x - found @ (found.T @ x)
            x = x / np.linalg.norm(x)
        quotient = float(x @ matrix @ x)
        rest = float(np.linalg.norm(matrix @ x - quotient * x))
        if rest < least:
            best, least = (quotient, x), rest
        elif turn > 3:
            break
        if turn:
            shift = quotient
    return best


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), the ``most`` largest by falling value, without those that are zero.

    Inertia counts of shifted matrices bisect the axis until an interval holds one eigenvalue; iteration with
    Rayleigh quotients starts from its middle and must end in it. Counts on both sides of the value then
    certify its number; where they do not, the interval is cut further. Eigenvalues that no shift
    separates in doubles share an interval: of their space an orthonormal basis is taken.
    """
    n = len(matrix)
    values, vectors = np.zeros(0), np.zeros((n, 0))
    if not n or not np.abs(matrix).max():
        return values, vectors
    slices = _Slices(matrix)
    norm, k = slices.norm, 1
    close = 8 * _EPS * norm
    seeded = np.random.Generator(np.random.PCG64(n))
    while k <= min(most, n):
        low, high = slices.around(k)
        alone = slices.count(low) == k and slices.count(high) == k - 1
        middle = (low + high) / 2
        if alone and high - low < norm / 4:
            value, x = _quotient_iteration(matrix, middle, vectors, seeded.standard_normal(n), norm)
            certain = slices.count(value - close) >= k and slices.count(value + close) < k
            if certain or high - low <= close:
                values, vectors, k = np.append(values, value), np.column_stack([vectors, x]), k + 1
                continue
        elif high - low <= close:
            size = min(slices.count(low), most) - k + 1
            basis = seeded.standard_normal((n, size))
            for _ in range(4):
                basis = _solve(matrix, middle, basis, norm)
                for _ in range(2):
                    basis = np.linalg.qr(basis - vectors @ (vectors.T @ basis))[0]
            inner = np.linalg.eigh(basis.T @ matrix @ basis)
            values = np.append(values, inner[0][::-1])
            vectors, k = np.column_stack([vectors, basis @ inner[1][:, ::-1]]), k + size
            continue
        if middle in (low, high):
            raise ArithmeticError("an eigenvalue cannot be numbered")
        slices.count(middle)
    real = values > _NOISE * n * _EPS * values[0]
    return values[real], vectors[:, real]
