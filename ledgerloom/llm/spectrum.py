"""Leading eigenvalues of a symmetric matrix by spectrum slicing, and their eigenvectors.

The matrix minus a shift is factored as L D Lᵀ; by Sylvester's law D has as many positive blocks as
the matrix has eigenvalues above the shift. Such counts halve an interval until one eigenvalue is alone in it. Rayleigh
quotient iteration then converges cubically, and counts on both sides of the result certify its number. Eigenvalues
that no count can tell apart share an interval; their vectors are found one after another, each orthogonal to all before it.
"""

from __future__ import annotations

import numpy as np

_PIVOT = (1 + 17 ** 0.5) / 8
_EPS = np.finfo(float).eps


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above the shift: the positive part of D, with pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0
    while k < n:
        below = np.abs(a[k + 1:, k])
        largest = below.max(initial=0.0)
        r = k + 1 + int(below.argmax()) if len(below) else k
        two = False
        if abs(a[k, k]) < _PIVOT * largest:
            others = np.abs(a[k:, r])
            others[r - k] = 0
            if abs(a[k, k]) * others.max() < _PIVOT * largest ** 2:
                two = abs(a[r, r]) < _PIVOT * others.max()
                _swap(a, k + two, r)
        if two:
            d, rest = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            determinant = d[0, 0] * d[1, 1] - d[0, 1] ** 2
            positive += 1 if determinant < 0 else 2 * int(d[0, 0] + d[1, 1] > 0)
            inverse = np.array([[d[1, 1], -d[0, 1]], [-d[0, 1], d[0, 0]]]) / determinant
            a[k + 2:, k + 2:] -= rest @ inverse @ rest.T
            k += 2
        else:
            if a[k, k] != 0:
                positive += int(a[k, k] > 0)
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k] / a[k, k], a[k + 1:, k])
            k += 1
    return positive


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


def _orthogonal(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
    return x / np.linalg.norm(x)


def _solved(matrix: np.ndarray, shift: float, x: np.ndarray, norm: float) -> np.ndarray:
    identity = np.eye(len(matrix))
    try:
        return np.linalg.solve(matrix - shift * identity, x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(matrix - (shift + 2 * _EPS * norm) * identity, x)


def leading(matrix: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues in falling order and their unit eigenvectors as rows."""
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    least = 4 * n * _EPS * norm  # what rounding can move an eigenvalue by
    counts: dict[float, int] = {-norm - least: n, norm + least: 0}
    random = np.random.default_rng(seed)
    values, vectors = [], []

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    for number in range(1, min(k, n) + 1):
        low = max(s for s, c in counts.items() if c >= number)
        high = min(s for s, c in counts.items() if c < number)

        def halve() -> None:
            nonlocal low, high
            middle = (low + high) / 2
            if above(middle) >= number:
                low = middle
            else:
                high = middle

        while True:
            while above(low) - above(high) > 1 and high - low > least:
                halve()
            shift = (low + high) / 2
            x = _orthogonal(random.standard_normal(n), vectors)
            for _ in range(3):  # at one shift, to leave the neighbours behind
                x = _orthogonal(_solved(matrix, shift, x, norm), vectors)
            residual = np.inf
            for _ in range(30):
                value = float(x @ matrix @ x)
                rest = float(np.linalg.norm(matrix @ x - value * x))
                if rest <= _EPS * norm or rest >= residual and rest <= least:
                    break
                residual = rest
                x = _orthogonal(_solved(matrix, value, x, norm), vectors)
            value = float(x @ matrix @ x)
            certified = above(value - least) >= number > above(value + least)
            if rest <= least and certified or high - low <= least:
                break
            halve()
        values.append(value)
        vectors.append(x)
    return np.array(values), np.array(vectors).reshape(-1, n)
