"""Singular values and right singular vectors of a small square matrix, by qd algorithms.

Householder reflections make the matrix bidiagonal; dqds (differential quotients and
differences with shifts) gives the squares of its singular values to high relative
accuracy; a twisted factorisation at each of them gives its vector.  Vectors of values that
lie close together are made orthogonal to each other and turned by Jacobi rotations until
the matrix maps them to orthogonal ones.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny
#: Values closer than this, relatively, are treated together.
_CLOSE = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The unit vector u and a: x minus 2u(ux) is (a, 0, ..., 0)."""
    length = float(np.linalg.norm(x))
    if length == 0.0:
        return np.zeros_like(x), 0.0
    a = -math.copysign(length, x[0])
    u = x.copy()
    u[0] -= a
    return u / np.linalg.norm(u), a


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of a square matrix U B V'."""
    m = matrix.astype(float).copy()
    d = len(m)
    v = np.eye(d)
    a, b = np.zeros(d), np.zeros(max(d - 1, 0))
    for k in range(d):
        u, a[k] = _reflector(m[k:, k])
        m[k:, k + 1 :] -= 2 * np.outer(u, u @ m[k:, k + 1 :])
        if k + 1 < d:
            u, b[k] = _reflector(m[k, k + 1 :])
            m[k + 1 :, k + 1 :] -= 2 * np.outer(m[k + 1 :, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return a, b, v


def _lower_bound(q: list[float], e: list[float]) -> float:
    """Below all squared singular values, by the circles of Gershgorin."""
    sides = [0.0, *(math.sqrt(x * y) for x, y in zip(q, e, strict=False)), 0.0]
    upper = [0.0, *e]
    rows = [q[k] + upper[k] - sides[k] - sides[k + 1] for k in range(len(q))]
    return min(rows) * (1 - 16 * _EPS)


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list, list, bool]:
    """One dqds step: the new q and e, and whether all of q is positive."""
    new_q, new_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return q, e, False
        sum_ = d + e[k]
        if sum_ == 0.0:
            # A value of nought: what follows is untouched by it.
            new_q.append(0.0)
            new_e.append(0.0)
            d = q[k + 1] - shift
            continue
        ratio = q[k + 1] / sum_
        new_q.append(sum_)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    new_q.append(d)
    return new_q, new_e, d >= 0


def _least_of_two(x: float, y: float, e: float) -> tuple[float, float]:
    """Squared singular values of the 2 by 2 matrix with q = x, y."""
    sum_ = x + y + e
    root = math.sqrt(max((x - y + e) ** 2 + 4 * e * y, 0.0))
    high = (sum_ + root) / 2
    return (x * (y / high) if high else 0.0), high


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling."""
    found: list[float] = []
    todo = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    small = _EPS**2
    while todo:
        q, e, moved = todo.pop()
        if len(q) > 2 and 1.5 * q[0] < q[-1]:
            q, e = q[::-1], e[::-1]
        for _ in range(100 + 50 * len(q)):
            if len(q) == 1:
                found.append(moved + q[0])
                q = []
                break
            cut = next(
                (k for k in range(len(e) - 1, -1, -1) if e[k] <= small * (moved + q[k])
                 or e[k] <= small * (moved + q[k + 1])),
                None,
            )
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 2:
                low, high = _least_of_two(q[0], q[1], e[0])
                found += [moved + low, moved + high]
                q = []
                break
            shift = min(_least_of_two(q[-2], q[-1], e[-1])[0], min(q)) * (1 - 4 * _EPS)
            bound: float | None = _lower_bound(q, e)
            while True:
                new_q, new_e, good = _transform(q, e, shift)
                if good:
                    break
                # Too far: a bound first, then less, in the end not at all, which always works.
                if bound is not None and 0 < bound < shift:
                    shift, bound = bound, None
                else:
                    shift = shift / 4 if shift > 1e-8 * (moved + _TINY) else 0.0
            q, e, moved = new_q, new_e, moved + shift
        if q:
            raise ArithmeticError("dqds did not converge")
    return np.array(sorted(found, reverse=True))


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Unit vector of B'B near ``value`` and by how much the value is off.

    The factorisations from the top and from the bottom meet where the
    remainder is least.
    """
    n = len(a)
    q, e, ab = a * a, b * b, a[:-1] * b
    least = _EPS * max(float(q.max(initial=0.0)), float(e.max(initial=0.0)), _TINY) * 1e-3

    def kept(x: float) -> float:
        return x if abs(x) > least * _EPS else math.copysign(least * _EPS, x)

    top, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        d = kept(s[k] + q[k])
        top[k] = ab[k] / d
        s[k + 1] = e[k] * (s[k] / d) - value
    low, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        d = kept(e[k] + p[k + 1])
        low[k] = ab[k] / d
        p[k] = p[k + 1] * (q[k] / d) - value
    rest = s + p + value
    r = int(np.argmin(np.abs(rest)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -top[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -low[k] * z[k]
    size = float(z @ z)
    return z / math.sqrt(size), float(rest[r]) / size


def _times(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    out = a[:, None] * z
    out[:-1] += b[:, None] * z[1:]
    return out


def _separate(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Vectors of close values: orthogonal, and mapped by B to orthogonal ones."""
    rng = np.random.default_rng(1)
    basis: list[np.ndarray] = []
    for vector in z.T:
        for _ in range(50):
            for _ in range(2):
                for other in basis:
                    vector = vector - other * (other @ vector)
            length = float(np.linalg.norm(vector))
            if length > 0.1:
                break
            # This direction is there already: another within the values' own space.
            mixed = z @ rng.standard_normal(z.shape[1])
            value = float(np.mean(np.sum(_times(a, b, z) ** 2, axis=0)))
            vector = _inverse(a, b, value, rng.standard_normal(len(a)) + mixed, basis)
        basis.append(vector / np.linalg.norm(vector))
    out = np.array(basis).T
    for _ in range(30):
        image, turned = _times(a, b, out), 0.0
        for i in range(out.shape[1]):
            for j in range(i + 1, out.shape[1]):
                x, y = image[:, i], image[:, j]
                xx, yy, xy = float(x @ x), float(y @ y), float(x @ y)
                if abs(xy) <= 4 * _EPS * math.sqrt(xx * yy):
                    continue
                turned += abs(xy)
                t = (yy - xx) / (2 * xy)
                t = math.copysign(1.0, t) / (abs(t) + math.hypot(1.0, t))
                c = 1 / math.hypot(1.0, t)
                s = c * t
                for m in (image, out):
                    x, y = m[:, i].copy(), m[:, j].copy()
                    m[:, i], m[:, j] = c * x - s * y, s * x + c * y
        if turned == 0.0:
            break
    return out


def _inverse(
    a: np.ndarray, b: np.ndarray, value: float, start: np.ndarray, basis: list[np.ndarray]
) -> np.ndarray:
    """A few steps of inverse iteration off ``basis``, by the factors from the top."""
    n = len(a)
    q, e, ab = a * a, b * b, a[:-1] * b
    least = _EPS * max(float(q.max()), _TINY)
    d, low, s = np.zeros(n), np.zeros(n - 1), -value
    for k in range(n):
        d[k] = s + q[k]
        if abs(d[k]) < least:
            d[k] = least
        if k < n - 1:
            low[k] = ab[k] / d[k]
            s = e[k] * (s / d[k]) - value
    z = start
    for _ in range(4):
        for other in basis:
            z = z - other * (other @ z)
        z = z / np.linalg.norm(z)
        for k in range(n - 1):
            z[k + 1] -= low[k] * z[k]
        z = z / d
        for k in range(n - 2, -1, -1):
            z[k] -= low[k] * z[k + 1]
    return z / np.linalg.norm(z)


def _block_vectors(a: np.ndarray, b: np.ndarray, wanted: float) -> list[tuple[float, np.ndarray]]:
    """(value, vector) of an undivided bidiagonal block, for values over ``wanted``."""
    if len(a) == 1:
        return [(float(a[0] ** 2), np.ones(1))]
    values = [v for v in dqds(a, b) if v > wanted]
    out: list[tuple[float, np.ndarray]] = []
    k = 0
    while k < len(values):
        end = k + 1
        while end < len(values) and values[end - 1] - values[end] <= _CLOSE * values[end - 1]:
            end += 1
        vectors = []
        for value in values[k:end]:
            vector, off = twisted(a, b, value)
            # A step or two towards the value itself, where the neighbours are far.
            for _ in range(2):
                if end > k + 1 or abs(off) > 1e-10 * value:
                    break
                vector, off = twisted(a, b, value + off)
            vectors.append(vector)
        group = np.array(vectors).T
        if end > k + 1:
            group = _separate(a, b, group)
        out += [
            (float(np.sum(_times(a, b, group[:, j : j + 1]) ** 2)), group[:, j])
            for j in range(end - k)
        ]
        k = end
    return out


def right_vectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Squares of the ``count`` largest singular values, their right vectors as columns,
    and the sum of all squares.

    Values that are nought within rounding are nought, with vectors of nought.
    """
    d = len(matrix)
    values, vectors = np.zeros(count), np.zeros((d, count))
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0.0:
        return values, vectors, 0.0
    a, b, v = bidiagonalise(matrix / size)
    total = float(np.sum(a * a) + np.sum(b * b))
    floor = (8 * d * _EPS) ** 2 * total
    # Superdiagonal entries within rounding divide the matrix into blocks of their own.
    b = np.where(np.abs(b) <= _EPS * math.sqrt(total) * 0.5, 0.0, b)
    found: list[tuple[float, int, np.ndarray]] = []
    cuts = [0, *(int(k) + 1 for k in np.flatnonzero(b == 0.0)), d]
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        for value, vector in _block_vectors(a[first:end], b[first : end - 1], floor):
            if value > floor:
                found.append((value, first, vector))
    found.sort(key=lambda f: (-f[0], f[1]))
    for k, (value, first, vector) in enumerate(found[:count]):
        values[k] = value * size * size
        full = v[:, first : first + len(vector)] @ vector
        vectors[:, k] = full / np.linalg.norm(full)
    return values, vectors, total * size * size
