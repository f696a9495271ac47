"""Whitening of embeddings by a bidiagonal qd solver.

The centred rows are reduced to one triangle R by QR in blocks: a task folds its rows into one triangle, triangles are folded in a
tree. Householder reflections bring R to a bidiagonal B with the same singular values. dqds finds their squares without ever
forming a covariance, so small ones keep their accuracy. For each, a twisted factorisation of B'B less the value gives the direction,
which the reflections carry back to the dimensions of the rows.

Rows never move: they are read for the sums, for R, for the check of the result and for the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import small_batches
from .search import dense, finite

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Singular values below this share of the largest count as zero.
ZERO = 1e-11
#: Values nearer than this share of each other have their directions made orthogonal among themselves.
CLUSTER = 1e-3
EPS = np.finfo(float).eps
#: Partial results that a task of the first fold merges into one, whatever their number.
FOLDS = 32


# the solver, on the driver: its input is one triangle of the size of a vector squared


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with ``r = U B V'`` by Householder reflections from both sides."""
    a, d = np.array(r, dtype=float), r.shape[1]
    v = np.eye(d)

    def reflector(x):
        w = x.copy()
        norm = np.linalg.norm(x)
        if norm == 0.0:
            return None
        w[0] += norm if x[0] >= 0 else -norm
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2.0 * np.outer(w, w @ a[k:, k:])
        if k < d - 2 and (w := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One dqds transform: new q and e, the least of its d and whether it stayed positive."""
    n = len(q)
    d, least = q[0] - shift, q[0] - shift
    qq, ee = [0.0] * n, [0.0] * (n - 1)
    for k in range(n - 1):
        qq[k] = d + e[k]
        if d < 0.0 or qq[k] <= 0.0:
            return qq, ee, d, False
        t = q[k + 1] / qq[k]
        ee[k] = e[k] * t
        d = d * t - shift
        least = min(least, d)
    qq[-1] = d
    return qq, ee, least, d >= 0.0


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal with squared diagonal ``q`` and squared superdiagonal ``e``, falling.

    Values are found from the small end: the shift that all transforms add up to is the value once the last
    e vanishes beside it. A shift that goes too far is taken back; the transform without shift always holds.
    """
    out: list[float] = []
    top = float(max([*q, *e, 0.0]))
    tiny = max(top, 1e-300) * EPS * EPS * 1e-6
    blocks = [([float(x) for x in q], [float(x) for x in e], 0.0)]
    while blocks:
        q, e, total = blocks.pop()
        shift, least = 0.0, 0.0
        for _ in range(100 * len(q) + 1000):
            n = len(q)
            if n == 1:
                out.append(total + q[0])
                break
            small = [e[k] <= EPS * EPS * (total + min(q[k], q[k + 1])) or e[k] <= tiny for k in range(n - 1)]
            if any(small):
                cut = n - 2 - small[::-1].index(True)
                blocks.append((q[: cut + 1], e[:cut], total))
                q, e, shift, least = q[cut + 1 :], e[cut + 1 :], 0.0, 0.0
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]  # the small end comes last: the transposed block has the same values
                least = 0.0
            if n == 2:
                apart = 0.5 * (q[0] - q[1] + e[0])
                big = 0.5 * (q[0] + q[1] + e[0]) + (apart * apart + q[1] * e[0]) ** 0.5
                out += [total + big, total + q[0] * (q[1] / big)]
                break
            # the last d bounds the least value from above, and nears it as the last e fade
            tail = e[-1] / q[-2] if q[-2] > 0 else 1.0
            shift = max(0.0, least * (1.0 - min(tail, 1.0) ** 0.5) / (1.0 + tail)) if least > 0 else 0.0
            while True:
                qq, ee, d, held = _step(q, e, shift)
                if held:
                    break
                if shift <= top * EPS * EPS:
                    shift = 0.0
                    qq, ee, d, _ = _step(q, e, 0.0)
                    break
                shift *= 0.25
            q, e, least, total = qq, ee, d, total + shift
        else:
            raise ArithmeticError("dqds did not settle")
    return np.sort(np.array(out))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float, skip: int = 0) -> np.ndarray:
    """The direction of B'B that belongs to ``value``: stationary factors from above and progressive ones from below meet where the twist is least.

    ``skip`` takes the next best twist, for values that can't be told apart.
    """
    n = len(a)
    floor = max(float(np.max(a * a)), 1e-300) * EPS * 1e-3
    full = lambda x: x if abs(x) > floor * EPS else (-floor * EPS if x < 0 else floor * EPS)
    q = np.maximum(a * a, floor * EPS)
    up, low = np.zeros(n), np.zeros(n)
    lower, upper = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    off = b / np.sqrt(q[:-1]) * np.where(a[:-1] < 0, -1.0, 1.0) if n > 1 else np.zeros(0)
    s = -value
    for k in range(n - 1):
        up[k] = s
        d = full(q[k] + s)
        lower[k] = q[k] * off[k] / d
        s = lower[k] * off[k] * s - value
    up[-1] = s
    p = q[-1] - value
    for k in range(n - 2, -1, -1):
        low[k + 1] = p
        d = full(q[k] * off[k] ** 2 + p)
        upper[k] = q[k] * off[k] / d
        p = p * q[k] / d - value
    low[0] = p
    twist = np.abs(up + low + value)
    at = int(np.argsort(twist, kind="stable")[min(skip, n - 1)])
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -lower[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -upper[k] * z[k]
    return z / np.linalg.norm(z)


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit directions as columns, in the order of ``values``, which falls."""
    n, out = len(a), np.zeros((len(a), len(values)))
    parts = np.split(np.arange(n), [k + 1 for k in range(n - 1) if abs(b[k]) <= EPS * 0.5 * (abs(a[k]) + abs(a[k + 1]))])
    if len(parts) > 1:
        # independent blocks: each value goes to the block that has it
        own = [(value, p) for p in parts for value in dqds(a[p] ** 2, b[p[:-1]] ** 2)]
        made, taken = {}, {}
        for k, (value, p) in enumerate(sorted(own, key=lambda x: -x[0])[: len(values)]):
            taken.setdefault(p[0], []).append((k, value))
            made[p[0]] = p
        for first, p in made.items():
            out[np.ix_(p, [k for k, _ in taken[first]])] = directions(a[p], b[p[:-1]], np.array([v for _, v in taken[first]]))
        return out
    for k, value in enumerate(values):
        near = [j for j in range(k) if abs(values[j] - value) <= CLUSTER * abs(values[j])]
        for skip in range(n):
            z = _twisted(a, b, value, skip)
            for _ in range(2):
                for j in near:
                    z = z - out[:, j] * (out[:, j] @ z)
            if (norm := np.linalg.norm(z)) > 0.5 / (1 + len(near)) or skip == n - 1:
                break
        out[:, k] = z / norm
    return out


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values falling, directions as rows) of a triangle; signs make the largest entry positive."""
    a, b, v = bidiagonal(r)
    values = dqds(a * a, b * b)
    rows = (v @ directions(a, b, values[: min(most, len(values))])).T
    largest = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]
    return values, rows * np.where(largest < 0, -1.0, 1.0)[:, None]


# the passes over the rows


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x - S / n`` rounded once, and ``n * x - S`` exactly (Python's whole numbers where 64 bits may not do)."""
    whole, rest = sums // n, sums % n
    off = x - whole
    wide = n * (int(np.abs(off).max(initial=0)) + 1) >= 1 << 62
    exact = n * off.astype(object) - rest if wide else n * off - rest
    return off - rest / n, exact


def _fold(merge):
    """A function for mapInArrow that merges all states of a partition into one."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for row in batch.column(0):
                one = np.frombuffer(row.as_py())
                state = one if state is None else merge(state, one)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": [state.tobytes()]}, schema=pa.schema([("state", pa.binary())]))

    return fold


def _gather(df: DataFrame, start, merge) -> np.ndarray | None:
    """One state of all rows: each task makes one, a fixed number of tasks merge them, one merges those."""
    states = df.mapInArrow(start, "state binary")
    for tasks in (FOLDS, 1):
        states = states.repartition(tasks).mapInArrow(_fold(merge), "state binary")
    row = states.first()
    return np.frombuffer(row[0]) if row else None


def _triangle(d: int):
    """Triangles as states, merged by the QR of one upon the other."""
    from_state = lambda s: s.reshape(-1, d)
    return lambda x, y: np.ascontiguousarray(np.linalg.qr(np.concatenate([from_state(x), from_state(y)]), mode="r")).ravel()


def _moments(d: int):
    """(count, means, centred products) as states, merged without loss."""

    def merge(x, y):
        n, m = x[0], y[0]
        apart = y[1 : d + 1] - x[1 : d + 1]
        products = x[d + 1 :] + y[d + 1 :] + np.outer(apart, apart).ravel() * (n * m / (n + m))
        return np.concatenate([[n + m], x[1 : d + 1] + apart * (m / (n + m)), products])

    return merge


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each vector and component.

    Entries become x = ``floor(scale * c) + shift``. ``deviation`` is the sum of ``(n x - S)**2``, exact, null where it leaves 64 bits.
    ``whitened`` is the centred row on the component over the root of its variance; ``explained`` its share of the whole variance;
    ``identity_error`` how far the whitened rows' covariance is from the identity, measured on all of them.

    Vectors that are null or hold null or non-finite entries are dropped; shorter ones end in entries of 0 (x is ``shift``). Repeated
    rows and ids, null ids included, are rows of their own. Directions without variance (fewer rows than dimensions, one repeated
    row) have whitened null and explained 0, or null if there is no variance at all; they don't count in ``identity_error``, which is
    null if none is left. Fewer dimensions than ``components`` give that many. An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = df.where(finite(F.col(f"`{vector}`"))).select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v"))
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    d = d or 0
    out = f"vec_id {df.schema[vec_id].dataType.simpleString()}, deviation bigint, w array<double>"
    if not d:
        none = rows.select("vec_id", F.lit(1).alias("component"), F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"))
        return none.select("*", *[F.lit(None).cast("double").alias(c) for c in ("whitened", "explained", "identity_error")]).where(F.lit(False))

    def start_sums(batches):
        total = [0] * d
        for batch in batches:
            total = [x + int(y) for x, y in zip(total, dense(batch.column("v"), d).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"at": list(range(d)), "s": total}, schema=pa.schema([("at", pa.int32()), ("s", pa.int64())]))

    found = {r["at"]: r["s"] for r in rows.mapInArrow(start_sums, "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    # sums are of floor(scale * c); the shift is added to both sides, so that it never costs a digit
    sums = np.array([found[k] for k in range(d)], dtype=np.int64)

    def start_triangle(batches):
        r = None
        for batch in batches:
            x = _centred(dense(batch.column("v"), d), n, sums)[0]
            r = np.linalg.qr(x if r is None else np.concatenate([r, x]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_pydict({"state": [np.ascontiguousarray(r).tobytes()]}, schema=pa.schema([("state", pa.binary())]))

    r = _gather(rows, start_triangle, _triangle(d)).reshape(-1, d)
    r = np.concatenate([r, np.zeros((d - len(r), d))]) if len(r) < d else r
    values, axes = principal(r, components)
    variances, trace = values / n, float((r * r).sum() / n)
    alive = int((np.sqrt(variances[: len(axes)]) > ZERO * np.sqrt(variances[0])).sum()) if variances[0] > 0 else 0
    onto = (axes[:alive] / np.sqrt(variances[:alive])[:, None]).T.copy()

    def start_moments(batches):
        merge, state = _moments(alive), None
        for batch in batches:
            w = _centred(dense(batch.column("v"), d), n, sums)[0] @ onto
            if len(w):
                mean = w.mean(axis=0)
                one = np.concatenate([[float(len(w))], mean, ((w - mean).T @ (w - mean)).ravel()])
                state = one if state is None else merge(state, one)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"state": [state.tobytes()]}, schema=pa.schema([("state", pa.binary())]))

    error = None
    if alive:
        moments = _gather(rows, start_moments, _moments(alive))
        error = float(np.abs(moments[alive + 1 :].reshape(alive, alive) / moments[0] - np.eye(alive)).max())

    def project(batches):
        for batch in batches:
            x, exact = _centred(dense(batch.column("v"), d), n, sums)
            if exact.dtype != object and d * (int(np.abs(exact).max(initial=0)) + 1) ** 2 >= 1 << 63:
                exact = exact.astype(object)
            squares = [int(s) for s in (exact * exact).sum(axis=1)]
            w = np.full((len(x), len(axes)), np.nan)
            w[:, :alive] = x @ onto
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(axes)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()), lists], ["vec_id", "deviation", "w"])

    shares = [float(v / trace) if trace > 0 else None for v in variances[: len(axes)]]
    explained = F.array(*[F.lit(s).cast("double") for s in shares])
    placed = rows.mapInArrow(project, out).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return placed.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
