"""Shared areas of many pairs of convex polygons at once, in numpy (arrays of n x points x 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs that one step takes; where one side is a parallelogram, as many as its few arrays keep near.
STEP, FRAMED = 1 << 15, 1 << 12
#: A part of a parallelogram that is measured more closely, and how far from its place its fourth corner may be (as a share of the area).
FAINT, SKEW = 1e-6, 1e-12
#: Keeps 0 / 0 at the limit; far below any length or slope.
TINY = 1e-200


def as_quads(column: pa.Array) -> np.ndarray:
    """A column of arrays of four [x, y] points as n x 4 x 2."""
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), 4, 2)


def signed_areas(p: np.ndarray) -> np.ndarray:
    q = np.roll(p, -1, axis=1)
    return (p[:, :, 0] * q[:, :, 1] - q[:, :, 0] * p[:, :, 1]).sum(axis=1) / 2


def boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p.min(axis=1), p.max(axis=1)


def _cut(x: np.ndarray, y: np.ndarray, n: np.ndarray, ax, ay, bx, by) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of each polygon (points x pairs, the first n count) lies to the left of its line from a to b."""
    side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    most = len(x)
    out_x, out_y, at = np.zeros((most + 2, x.shape[1])), np.zeros((most + 2, x.shape[1])), np.zeros(x.shape[1], np.int64)
    for i in range(most):
        more = i + 1 < n
        k = min(i + 1, most - 1)
        s, t = side[i], np.where(more, side[k], side[0])
        then = t >= 0
        live = i < n
        meet = np.flatnonzero(live & ((s >= 0) != then))
        nx, ny = np.where(more, x[k], x[0]), np.where(more, y[k], y[0])
        f = s[meet] / (s[meet] - t[meet])
        out_x[at[meet], meet] = x[i, meet] + f * (nx[meet] - x[i, meet])
        out_y[at[meet], meet] = y[i, meet] + f * (ny[meet] - y[i, meet])
        at[meet] += 1
        keep = np.flatnonzero(live & then)
        out_x[at[keep], keep], out_y[at[keep], keep] = nx[keep], ny[keep]
        at[keep] += 1
    rows = max(1, int(at.max(initial=0)))
    return out_x[:rows], out_y[:rows], at


def _shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    q = np.where((signed_areas(q) >= 0)[:, None, None], q, q[:, ::-1])
    x, y, n = p[:, :, 0].T.copy(), p[:, :, 1].T.copy(), np.full(len(p), p.shape[1])
    for i in range(q.shape[1]):
        j = (i + 1) % q.shape[1]
        x, y, n = _cut(x, y, n, q[:, i, 0], q[:, i, 1], q[:, j, 0], q[:, j, 1])
    total = np.zeros(len(p))
    for i in range(len(x)):
        more, k = i + 1 < n, min(i + 1, len(x) - 1)
        total += np.where(i < n, x[i] * np.where(more, y[k], y[0]) - np.where(more, x[k], x[0]) * y[i], 0.0)
    return np.abs(total) / 2


def _frames(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each quad's corner, the map that makes a unit square of it, and its area (7 x n); which quads are parallelograms."""
    if q.shape[1] != 4:
        return np.zeros((7, len(q))), np.zeros(len(q), bool)
    corner, u, v = q[:, 0], q[:, 1] - q[:, 0], q[:, 3] - q[:, 0]
    area = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    off = np.abs(q[:, 2] - q[:, 1] - v).max(axis=1) * (np.abs(u).max(axis=1) + np.abs(v).max(axis=1))
    with np.errstate(all="ignore"):
        frames = np.stack([*corner.T, v[:, 1] / area, -v[:, 0] / area, -u[:, 1] / area, u[:, 0] / area, np.abs(area)])
        return frames, (off <= SKEW * np.abs(area)) & np.isfinite(frames).all(axis=0)


def _within(p: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """The area of polygons (points x 2 x pairs) within parallelograms (7 x pairs).

    In its frame the parallelogram is the unit square. There the area is the sum over the polygon's sides of the way
    along x within the square, times the mean height above it, cut to 0 and 1.
    """
    x, y = p[:, 0] - frame[0], p[:, 1] - frame[1]
    s, t = np.empty((len(p) + 1, len(frame[0]))), np.empty((len(p) + 1, len(frame[0])))
    np.multiply(x, frame[2], out=s[:-1])
    s[:-1] += y * frame[3]
    np.multiply(x, frame[4], out=t[:-1])
    t[:-1] += y * frame[5]
    s[-1], t[-1] = s[0], t[0]
    held = np.minimum(np.maximum(s, 0), 1)
    way = held[1:] - held[:-1]
    slope = s[1:] - s[:-1]
    slope += TINY
    np.divide(t[1:] - t[:-1], slope, out=slope)
    held -= s
    a = held[:-1] * slope  # heights where the side's part within 0 and 1 along x begins and ends
    a += t[:-1]
    slope *= held[1:]
    b = slope
    b += t[1:]
    rise = b - a
    rise += TINY
    low, high = np.minimum(np.maximum(a, 0), 1), np.minimum(np.maximum(b, 0), 1)
    np.maximum(a, 1, out=a)
    np.maximum(b, 1, out=b)
    b -= a  # the part of the rise above 1 counts whole, that between by its mean
    mean = (high - low) * (high + low)
    mean *= 0.5
    mean += b
    low *= TINY
    mean += low
    mean /= rise
    mean *= way
    out = np.abs(mean.sum(axis=0))
    out *= frame[6]
    return out


def shared_areas(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, faint: bool = True) -> np.ndarray:
    """The area that p[i] and q[j] share, for each of the pairs; polygons may go round either way.

    Pairs with a parallelogram are measured in its frame, the others cut side by side. So are those whose part of it is
    below ``FAINT``, to tell a little from nothing; not so without ``faint``, where only larger parts matter.
    """
    out, left = np.zeros(len(i)), np.ones(len(i), bool)
    for one, two, k, m in ((p, q, i, j), (q, p, j, i)):
        if not left.any():
            return out
        frames, fits = _frames(two)
        corners, todo = np.ascontiguousarray(one.transpose(1, 2, 0)), np.flatnonzero(left & fits[m])
        for at in range(0, len(todo), FRAMED):
            step = todo[at : at + FRAMED]
            frame = frames.take(m[step], axis=1)
            out[step] = _within(corners.take(k[step], axis=2), frame)
            left[step] = faint & (out[step] <= FAINT * frame[6])
    left = np.flatnonzero(left)
    for at in range(0, len(left), STEP):
        step = left[at : at + STEP]
        out[step] = _shared(p[i[step]], q[j[step]])
    return out
