"""Whitening by a bidiagonal qd solver.

1. Spark sums the integer vectors exactly. Every task centres its rows as (n*x - S) / n, from integers, and
   reduces them blockwise by QR to one triangle R; triangles meet in groups until one is left. No row
   reaches the driver, only that triangle, as wide as a vector.
2. Householder reflections from both sides bring R to an upper bidiagonal B; those from the right, W, stay.
3. dqds finds the squared singular values of B, smallest first. Shifts come from the last two rows or from
   Newton's bound; a shift that turns out too large is undone, so all values keep their relative accuracy.
4. Twisted factorisations of B'B - s give the vectors: the stationary transform from the top and the
   progressive one from the bottom meet where the remainder is smallest. Values that lie close together
   get a factorisation of their own, shifted beside them, in which they lie apart; what cannot be told apart
   even then spans one space, and an orthonormal basis of it is as good as any other.
5. W brings the vectors back. With e = s / n they are the eigenvectors and eigenvalues of the covariance.

Products of rows are never formed, so small eigenvalues are not lost in the squares of large ones.

Defined cases: vectors that are null or empty or hold null or non-finite entries are left out, and so are
vectors of another length than most have (of equally frequent lengths the smaller counts). Components whose
eigenvalue is rounding error of the largest do not exist. Repeated rows and ids are rows of their own; no
usable vectors, or vectors that are all equal, give no rows. Other columns are not looked at. An entry whose
integer has more than 53 bits counts as not finite; a ``deviation`` beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(float).eps
LEVELS = (256, 16, 1)  # groups in which triangles, or moments, meet
CLOSE = 1e-3  # relative gap below which values count as close


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``key, x``: floor(scale * c) + shift of every entry, of usable vectors."""
    v = F.col(f"`{vector}`")
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < 2.0**52, F.lit(False)))
    x = F.transform(v, lambda c: (F.floor(c.cast("double") * scale) + shift).cast("long"))
    return df.where(v.isNotNull() & (F.size(v) > 0) & sound).select(F.col(f"`{key}`").alias("key"), x.alias("x"))


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose vectors have the commonest length, and that length."""
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = most.d if most else 0
    return rows.where(F.size("x") == width), width


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("x"))
        if len(column):
            yield column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _together(parts: DataFrame, fold) -> DataFrame:
    """Rows of ``at, m``, one per task, brought together in three levels until one is left."""
    for groups in LEVELS:
        parts = parts.withColumn("at", F.col("at") % groups).groupBy("at").applyInArrow(fold, "at long, m array<double>")
    return parts


class Mean(NamedTuple):
    """S / n per dimension as an integer and a rest: S = n * base + rest, 0 <= rest < n."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; only the last step rounds."""
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n*x - S)^2 per row; null beyond a long."""
        if ((self.n * self.centred(x)) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
            return pa.array(((self.n * (x - self.base) - self.rest) ** 2).sum(axis=1))
        exact = ((self.n * (x - self.base).astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([d if d < 2**63 else None for d in exact], pa.int64())


def exact_mean(rows: DataFrame, width: int) -> Mean | None:
    """From integer sums of every dimension, in two halves that cannot overflow."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches, width):
            low, high = (x & 0xFFFFF).sum(axis=0), (x >> 20).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"n": [len(x)] * width, "dim": np.arange(width), "low": low, "high": high})

    parts = rows.select("x").mapInArrow(tally, "n long, dim long, low long, high long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), wide("low"), wide("high")).orderBy("dim").collect()
    if not found:
        return None
    n, sums = found[0].n, [int(r.low) + (int(r.high) << 20) for r in found]
    return Mean(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def triangle(rows: DataFrame, width: int, mean: Mean) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for x in _matrices(batches, width):
            for start in range(0, len(x), 16 * width):
                r = np.linalg.qr(np.vstack([r, mean.centred(x[start : start + 16 * width])]), mode="r")
        if len(r):
            full = np.zeros((width, width))
            full[: len(r)] = r
            yield pa.RecordBatch.from_pydict({"m": [full.ravel()]})

    def fold(table: pa.Table) -> pa.Table:
        stacked = table.column("m").combine_chunks().flatten().to_numpy().reshape(-1, width)
        r = np.linalg.qr(stacked, mode="r")
        return pa.table({"at": table.column("at").slice(0, 1), "m": [r.ravel()]})

    parts = rows.select("x").mapInArrow(reduce, "m array<double>").select(F.spark_partition_id().cast("long").alias("at"), "m")
    last = _together(parts, fold).collect()
    stacked = np.vstack([np.array(r.m).reshape(width, width) for r in last])
    return np.linalg.qr(stacked, mode="r")


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, w)``: diagonals of B and the reflections from the right, R = U B W'."""
    a, n = r.copy(), len(r)
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        size = np.linalg.norm(x)
        if size == 0:
            return v
        v[0] += np.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _progressive(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step; None where the shift is above the smallest value."""
    n, d = len(q), q[0] - shift
    qq, ee = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        qq[i] = d + e[i]
        if not qq[i] > 0 or d < 0:
            return None
        t = q[i + 1] / qq[i]
        ee[i] = e[i] * t
        d = d * t - shift
    qq[-1] = d
    return (qq, ee) if d >= 0 else None


def _newton(q: list[float], e: list[float]) -> float:
    """One over the trace of the inverse: never above the smallest value."""
    total, d = 0.0, q[0]
    # dqd without a shift gives d_i = 1 / (inverse)_ii
    for i in range(len(q)):
        if d <= 0:
            return 0.0
        total += 1 / d
        if i < len(e):
            d = d * (q[i + 1] / (d + e[i]))
    return 1 / total


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal with diagonals ``a`` and ``b``, falling."""
    found: list[float] = []
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if scale == 0:
        return np.zeros(len(a))
    blocks = [([float(x) for x in (a / scale) ** 2], [float(x) for x in (b / scale) ** 2], 0.0)]
    tiny = np.finfo(float).tiny / EPS
    while blocks:
        q, e, sigma = blocks.pop()
        if len(q) == 1:
            found.append(q[0] + sigma)
            continue
        cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= max(EPS * EPS * (sigma + min(q[i], q[i + 1])), tiny)), None)
        if cut is not None:
            blocks += [(q[: cut + 1], e[:cut], sigma), (q[cut + 1 :], e[cut + 1 :], sigma)]
            continue
        # The smaller value of the last two rows of B'B is close once the last e is small.
        x, y, z = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
        half = (x - y) / 2
        last = y - z / (abs(half) + (half * half + z) ** 0.5) if half >= 0 else (x + y) / 2 - (half * half + z) ** 0.5
        floor = _newton(q, e) * (1 - 8 * EPS * len(q))
        for shift in (min(last, q[-1]) * (1 - 4 * EPS), floor, floor / 2, 0.0):
            step = _progressive(q, e, shift) if shift >= 0 else None
            if step:
                blocks.append((step[0], step[1], sigma + shift))
                break
        else:  # a zero on the diagonal: that value is zero, the last row takes it
            q = [max(v, 0.0) for v in q]
            step = _progressive([v if v > 0 else tiny for v in q], e, 0.0)
            blocks.append((step[0], step[1], sigma))
    return np.sort(np.maximum(found, 0))[::-1] * scale * scale


def _stationary(d: np.ndarray, l: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LDL' - shift = L+ D+ L+' and the remainders from the top."""
    n = len(d)
    dp, lp, s = np.empty(n), np.empty(n - 1), np.empty(n)
    s[0] = -shift
    for i in range(n - 1):
        dp[i] = s[i] + d[i] or EPS * abs(d[i]) or np.finfo(float).tiny
        lp[i] = l[i] * d[i] / dp[i]
        s[i + 1] = lp[i] * l[i] * s[i] - shift
    dp[-1] = s[-1] + d[-1]
    return dp, lp, s


def _from_below(d: np.ndarray, l: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """LDL' - shift = U- D- U-' : the multipliers and the remainders from the bottom."""
    n = len(d)
    um, p = np.empty(n - 1), np.empty(n)
    p[-1] = d[-1] - shift
    for i in range(n - 2, -1, -1):
        below = l[i] * l[i] * d[i] + p[i + 1] or EPS * abs(d[i]) or np.finfo(float).tiny
        t = d[i] / below
        um[i] = l[i] * t
        p[i] = p[i + 1] * t - shift
    return um, p


def _twisted(d: np.ndarray, l: np.ndarray, shift: float) -> np.ndarray:
    """The unit vector of LDL' for the value ``shift``."""
    _, lp, s = _stationary(d, l, shift)
    um, p = _from_below(d, l, shift)
    k = int(np.argmin(np.abs(s + p + shift)))
    z = np.zeros(len(d))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lp[i] * z[i + 1]
    for i in range(k, len(d) - 1):
        z[i + 1] = -um[i] * z[i]
    return z / np.linalg.norm(z)


def _below(d: np.ndarray, l: np.ndarray, shift: float) -> int:
    """How many values of LDL' lie below ``shift``."""
    return int((_stationary(d, l, shift)[0] < 0).sum())


def _bisected(d: np.ndarray, l: np.ndarray, rank: int, low: float, high: float) -> float:
    """The value of LDL' with ``rank`` smaller ones, between bounds that are widened first."""
    gap = max(high - low, EPS * max(abs(low), abs(high)))
    while _below(d, l, low) > rank:
        low, gap = low - gap, 2 * gap
    while _below(d, l, high) <= rank:
        high, gap = high + gap, 2 * gap
    while high - low > 2 * EPS * max(abs(low), abs(high)):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (low, middle) if _below(d, l, middle) > rank else (middle, high)
    return (low + high) / 2


def _vectors(d: np.ndarray, l: np.ndarray, values: np.ndarray, ranks: np.ndarray, depth: int = 0) -> np.ndarray:
    """Unit vectors of LDL' as columns for rising ``values``; ``ranks`` are their places among all."""
    out, start, n = np.empty((len(d), len(values))), 0, len(values)
    while start < n:
        end = start + 1
        while end < n and values[end] - values[end - 1] <= CLOSE * max(abs(values[end]), abs(values[end - 1])):
            end += 1
        group, places = values[start:end], ranks[start:end]
        if len(group) == 1 or depth == 4:
            out[:, start:end] = np.column_stack([_twisted(d, l, v) for v in group])
        else:
            # Beside the group its members are small numbers, far apart for their size.
            origin = group[0] - max(2 * EPS * abs(group[0]), (group[-1] - group[0]) / 8)
            dp, lp, _ = _stationary(d, l, origin)
            width = 4 * EPS * np.abs(group).max()
            local = [_bisected(dp, lp, int(r), v - origin - width, v - origin + width) for r, v in zip(places, group)]
            out[:, start:end] = _vectors(dp, lp, np.array(local), places, depth + 1)
        start = end
    return out


def components(r: np.ndarray, n: int, most: int = 32) -> tuple[np.ndarray, np.ndarray, float]:
    """``(e, v, trace)``: falling eigenvalues of R'R/n and unit vectors as columns, ``most`` at most."""
    a, b, w = bidiagonal(r)
    squares = squared_values(a, b)
    trace = float((r * r).sum()) / n
    keep = int((squares > len(a) * EPS * squares[0]).sum()) if len(squares) and squares[0] > 0 else 0
    if not keep:
        return np.zeros(0), np.zeros((len(a), 0)), trace
    vectors = np.zeros((len(a), len(a)))
    # Blocks between zeros of b stand alone; B'B = LDL' with d = a^2 and l = b / a in each.
    scale = squares[0] ** 0.5
    a = np.where(np.abs(a) < EPS * scale, EPS * scale, a)
    edges = [0, *[i + 1 for i in range(len(b)) if abs(b[i]) <= EPS * min(abs(a[i]), abs(a[i + 1]))], len(a)]
    values, columns = [], []
    for low, high in zip(edges, edges[1:]):
        aa, bb = a[low:high] / scale, b[low : high - 1] / scale
        if high - low == 1:
            block_values, block = aa * aa, np.ones((1, 1))
        else:
            block_values = squared_values(aa, bb)[::-1]
            block = _vectors(aa * aa, bb / aa[:-1], block_values, np.arange(high - low))
        for j in range(high - low):
            vector = np.zeros(len(a))
            vector[low:high] = block[:, j]
            values.append(block_values[j])
            columns.append(vector)
    order = np.argsort(-np.array(values), kind="stable")[: min(keep, most)]
    vectors = np.column_stack([columns[j] for j in order])
    # Checked: members of one space may still lean; Gram-Schmidt in falling order sets them upright.
    if np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() > 64 * EPS:
        q, upper = np.linalg.qr(vectors)
        vectors = q * np.sign(np.diag(upper))
    return np.array(values)[order] * scale * scale / n, w @ vectors, trace


def identity_error(rows: DataFrame, width: int, project) -> float:
    """Largest entry of the covariance of the projected rows less the identity."""

    def merged(one: tuple, two: tuple) -> tuple:
        n, gap = one[0] + two[0], two[1] - one[1]
        return n, one[1] + gap * two[0] / n, one[2] + two[2] + np.outer(gap, gap) * one[0] * two[0] / n

    def flat(moments: tuple) -> np.ndarray:
        return np.concatenate([[moments[0]], moments[1], moments[2].ravel()])

    def unflat(m: np.ndarray) -> tuple:
        k = int(((4 * len(m) - 3) ** 0.5 - 1) / 2)
        return m[0], m[1 : k + 1], m[k + 1 :].reshape(k, k)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, width):
            y = project(x)
            mean = y.mean(axis=0)
            part = (float(len(y)), mean, (y - mean).T @ (y - mean))
            total = part if total is None else merged(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": [flat(total)]})

    def fold(table: pa.Table) -> pa.Table:
        parts = [unflat(np.array(m)) for m in table.column("m").to_pylist()]
        total = parts[0]
        for part in parts[1:]:
            total = merged(total, part)
        return pa.table({"at": table.column("at").slice(0, 1), "m": [flat(total)]})

    parts = rows.select("x").mapInArrow(moments, "m array<double>").select(F.spark_partition_id().cast("long").alias("at"), "m")
    n, _, scatter = unflat(np.array(_together(parts, fold).first().m))
    return float(np.abs(scatter / n - np.eye(len(scatter))).max())


def whiten(rows: DataFrame, most: int = 32) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for ``key, x`` rows.

    ``rows`` is scanned five times and never shuffled.
    """
    schema = (
        f"key {rows.schema['key'].dataType.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    rows, width = fit_list(rows)
    mean = exact_mean(rows, width) if width else None
    e, v, trace = components(triangle(rows, width, mean), mean.n, most) if mean else (np.zeros(0), None, 0.0)
    if not len(e):
        return rows.sparkSession.createDataFrame([], schema)
    directions = v / np.sqrt(e)

    def project(x: np.ndarray) -> np.ndarray:
        return mean.centred(x) @ directions

    error, share, numbers = identity_error(rows, width, project), e / trace, np.arange(1, len(e) + 1, dtype=np.int32)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                deviation = mean.deviations(x)
                rows_, k = len(x), len(e)
                each = np.repeat(np.arange(rows_), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(each)),
                        pa.array(np.tile(numbers, rows_)),
                        pa.array(np.full(rows_ * k, mean.n, np.int64)),
                        deviation.take(pa.array(each)),
                        pa.array(project(x).ravel()),
                        pa.array(np.tile(share, rows_)),
                        pa.array(np.full(rows_ * k, error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(emit, schema)

