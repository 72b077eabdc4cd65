"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST).

Inertia counts (signs of the pivots of V - s I) bracket the wanted eigenvalues and set interval ends in the widest gaps
near them. For each interval a subspace is filtered by Gauss quadrature of the resolvent (z I - V)^-1 on an ellipse around the
interval, Rayleigh-Ritz extracts eigenpairs from it, and this repeats until residuals no longer shrink. An interval is
done only if as many Ritz values lie in it as the counts at its ends say; otherwise the subspace is widened. The matrix
is as wide as the vectors, so all this is small beside the pass that made it.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Growth bound of pivots: 1 x 1 and 2 x 2 pivots grow alike (fixed value of the diagonal pivoting method).
PIVOT = (1 + 17**0.5) / 8
NODES, ITERATIONS, HALVINGS = 8, 24, 60
#: Gaps up to this share of the largest eigenvalue's bound are not told apart when interval ends are set.
SAME = 1e-8


def above(v: np.ndarray, s: float) -> int:
    """Eigenvalues greater than s: positive pivots of V - s I, eliminated with 1 x 1 and 2 x 2 diagonal pivots."""
    a = v - s * np.eye(len(v))
    count = 0
    while len(a):
        n, low = len(a), np.tril(np.abs(a), -1)
        d = np.abs(np.diag(a))
        i = int(d.argmax())
        q, p = divmod(int(low.argmax()), n)
        if d[i] == 0 and low[q, p] == 0:
            break  # nothing left but zeros, which are not above
        take = [i] if d[i] >= PIVOT * low[q, p] else [p, q]
        rest = np.setdiff1d(np.arange(n), take)
        head = a[np.ix_(take, take)]
        count += int(head[0, 0] > 0) if len(take) == 1 else 1  # a 2 x 2 pivot has one positive and one negative value
        side = a[np.ix_(rest, take)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(head, side.T)
        a = (a + a.T) / 2
    return count


def brackets(v: np.ndarray, want: int, high: float) -> list[tuple[float, float]]:
    """(low, high) around each of the `want` largest eigenvalues, by bisection on counts."""
    out = []
    seen = {0.0: above(v, 0.0), high: 0}
    for k in range(1, want + 1):
        lo = max((s for s, c in seen.items() if c >= k), default=-high)
        hi = min(s for s, c in seen.items() if c < k and s > lo)
        for _ in range(HALVINGS):
            if hi - lo <= 1e-9 * abs(hi) or hi - lo <= 4 * EPS * high:
                break
            mid = (lo + hi) / 2
            seen[mid] = above(v, mid)
            lo, hi = (mid, hi) if seen[mid] >= k else (lo, mid)
        out.append((lo, hi))
    return out


def intervals(v: np.ndarray, want: int, high: float) -> list[tuple[float, float, int]]:
    """(low, high, count) intervals that together hold at least the `want` largest eigenvalues, ends in wide gaps."""
    n, more = len(v), want
    while True:
        more = min(n, 2 * more + 4)
        found = brackets(v, more, high)
        middle = [(a + b) / 2 for a, b in found]
        gaps = [middle[k - 1] - middle[k] for k in range(want, more)]
        if more == n or max(gaps) > SAME * high:
            break
    if gaps and max(gaps) > SAME * high:
        last = want + int(np.argmax(gaps))
        floor = (found[last - 1][0] + found[last][1]) / 2
    else:  # no gap at all below the wanted ones: everything
        last, floor = n, -high
    top = min(high, found[0][1] + max(found[0][1] - floor, SAME * high) / 2)
    # a wide spread is cut, so that small eigenvalues are not judged by the size of large ones
    cuts = [k for k in range(1, last) if middle[k - 1] > 100 * max(middle[k], 0) and middle[k - 1] - middle[k] > SAME * high]
    ends = [top, *((found[k - 1][0] + found[k][1]) / 2 for k in cuts), floor]
    return [(b, a, (above(v, b) if b > -high else n) - above(v, a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def filtered(v: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """The quadrature of the resolvent on the upper half of an ellipse around [low, high], applied to y."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius, flat = (low + high) / 2, (high - low) / 2, 0.5
    out = np.zeros_like(y)
    for t, w in zip(nodes, weights, strict=True):
        angle = -np.pi / 2 * (t - 1)
        z = centre + radius * (np.cos(angle) + 1j * flat * np.sin(angle))
        step = radius * (flat * np.cos(angle) + 1j * np.sin(angle))
        out += w / 2 * (step * np.linalg.solve(z * np.eye(len(v)) - v, y.astype(complex))).real
    return out


def eigenpairs(v: np.ndarray, low: float, high: float, count: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs in (low, high]."""
    n = len(v)
    rng = np.random.default_rng(13)
    size = min(n, max(count + 2, int(1.5 * count)))
    while True:
        y, best = rng.standard_normal((n, size)), (np.inf, None, None)
        for _ in range(ITERATIONS):
            q, _ = np.linalg.qr(filtered(v, y, low, high))
            e, w = np.linalg.eigh(q.T @ v @ q)
            y = q @ w
            inside = (e > low) & (e <= high)
            if inside.sum() == count:
                worst = np.linalg.norm(v @ y[:, inside] - y[:, inside] * e[inside], axis=0).max(initial=0.0)
                if worst >= best[0] / 2 and best[0] <= 1e3 * n * EPS * scale:
                    return best[1:]
                if worst < best[0]:
                    best = worst, e[inside], y[:, inside]
        if best[0] <= 1e-10 * scale:
            return best[1:]
        if size == n:
            raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but not all were found")
        size = min(n, 2 * size)


def largest(v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `want` largest eigenvalues, falling, and their unit vectors as columns; those that rounding cannot tell from zero are left out."""
    want = min(want, len(v))
    high = 1.01 * float(np.abs(v).sum(1).max(initial=0.0))  # beyond every eigenvalue
    if want == 0 or high == 0 or above(v, 0.0) == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    parts = [eigenpairs(v, *interval, high) for interval in intervals(v, want, high) if interval[2]]
    e, u = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], 1)
    order = np.argsort(-e, kind="stable")[:want]
    order = order[e[order] > 8 * len(v) * EPS * high]
    return e[order], u[:, order]
