"""Leading eigenpairs of a symmetric matrix by spectrum slicing. The matrix is as wide as a vector has entries, whatever the rows.

The numbers of positive and negative pivots of an LDLᵀ factorisation of ``a - shift`` are those of the eigenvalues above and below
the shift (Sylvester). Bisection on that count isolates the j-th largest eigenvalue; inverse iteration from the middle of its
interval gives a first vector, and Rayleigh quotient iteration takes it on with cubic convergence. At the end counts just below and
just above the quotient certify that it is the j-th. Eigenvalues that no count can part at double precision are taken as
one cluster, and their vectors are kept orthogonal to those found before.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Fixed value: the growth bound of partial diagonal pivoting.
ALPHA = (1 + 17**0.5) / 8
#: Rayleigh quotient steps from one start; cubic convergence needs three or four.
STEPS = 12


def positive_count(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` lie above ``shift``: LDLᵀ with pivots of one row or two, as an indefinite matrix needs."""
    m = a - shift * np.eye(len(a))
    count, n = 0, len(m)
    tiny = EPS * max(np.abs(a).max(initial=0.0), abs(shift), np.finfo(float).tiny)
    while n > 0:
        diagonal = np.abs(np.diagonal(m))
        r = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diagonal(m)))
        largest = off.max(initial=0.0)
        if diagonal[r] >= ALPHA * largest:
            pivot = m[r, r]
            if abs(pivot) <= tiny:  # all that is left is zero at this precision: no eigenvalue above
                return count
            count += pivot > 0
            keep = np.arange(n) != r
            column = m[keep, r]
            m = m[np.ix_(keep, keep)] - np.outer(column, column) / pivot
            n -= 1
        else:  # two rows whose 2 x 2 block has one positive and one negative eigenvalue
            p, q = divmod(int(off.argmax()), n)
            count += 1
            keep = (np.arange(n) != p) & (np.arange(n) != q)
            columns = m[np.ix_(keep, [p, q])]
            block = m[np.ix_([p, q], [p, q])]
            m = m[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
            m = (m + m.T) / 2
            n -= 2
    return count


def _solve(a: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    """A vector along (a - shift)⁻¹ v; a shift that is an eigenvalue is moved by a rounding error."""
    for step in (0.0, 1.0, -1.0, 2.0):
        try:
            x = np.linalg.solve(a - (shift + step * EPS * scale) * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x / np.linalg.norm(x)
    return v


def _against(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues that are positive beyond rounding, falling, and their unit vectors as columns."""
    n = len(a)
    scale = float(np.abs(a).sum(axis=1).max(initial=0.0))
    resolution = 8 * n * EPS * scale
    if scale == 0:
        return np.empty(0), np.empty((n, 0))
    k = min(k, positive_count(a, resolution))
    radius = np.abs(a).sum(axis=1) - np.abs(np.diagonal(a))
    top = float((np.diagonal(a) + radius).max()) + resolution
    counts: dict[float, int] = {top: 0, resolution: positive_count(a, resolution)}
    rng = np.random.default_rng(1)
    values: list[float] = []
    vectors: list[np.ndarray] = []

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = positive_count(a, shift)
        return counts[shift]

    for j in range(1, k + 1):
        low = max(s for s, c in counts.items() if c >= j)
        high = min(s for s, c in counts.items() if c < j)

        def halve() -> None:
            nonlocal low, high
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= j else (low, middle)

        while high - low > resolution and not (above(low) == j and above(high) == j - 1):
            halve()
        while True:
            v = _against(rng.standard_normal(n), vectors)
            for _ in range(2):
                v = _against(_solve(a, (low + high) / 2, v, scale), vectors)
            value, rest, last = float(v @ a @ v), np.inf, np.inf
            for _ in range(STEPS):
                rest = float(np.linalg.norm(a @ v - value * v))
                if rest <= resolution and rest >= last / 2:  # at rounding error
                    break
                last = rest
                v = _against(_solve(a, value, v, scale), vectors)
                value = float(v @ a @ v)
            # Counts on both sides certify the number; a quotient that went to a neighbour starts again from a narrower interval.
            certified = rest <= resolution and above(value - 2 * resolution) >= j > above(value + 2 * resolution)
            if certified or high - low <= resolution:
                break
            halve()
        values.append(value)
        vectors.append(v)
    order = np.argsort(-np.array(values), kind="stable")  # within a cluster quotients may differ by rounding
    return np.array(values)[order], np.array(vectors).reshape(-1, n).T[:, order]
