"""Embedding whitening by block Jacobi-Davidson.

The covariance V of the fit list (the distinct integer vectors) is never built. Its product with a few
directions is one pass over the list: each task centres its rows exactly (n*x - S are integers) and adds
up (x - S/n) ((x - S/n) . d). The driver holds vectors of the dimension only. Each outer step does
Rayleigh-Ritz in the search space, locks pairs whose residual has reached double precision, and extends
the space by corrections t of the projected equation (1-UU')(V-e)(1-UU') t = -r, solved roughly by MINRES;
the equations of all open pairs step together, so an inner step is one pass as well."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import cut, table

COMPONENTS, SCALE = 4, 256
INNER, OUTER = 10, 400  # MINRES steps a correction; outer steps before giving up
EPS = float(np.finfo(np.float64).eps)
FAN_IN = 256  # partial sums that reach the driver from one pass
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def passed(fit: DataFrame, partial, wide: bool = False) -> np.ndarray:
    """The sum over the tasks of what `partial` makes of their matrices, flat. One pass; with many tasks
    (wide) the partial sums are merged by other tasks before they reach the driver."""
    def summed(parts):
        total = None
        for part in parts:
            total = np.ravel(part) if total is None else total + np.ravel(part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["p"])

    def add(batches):
        yield from summed(partial(matrix_of(b.column(0))) for b in batches if b.num_rows)

    def merge(batches):
        yield from summed(p.values.to_numpy() for b in batches for p in b.column(0))

    sums = fit.select("x").mapInArrow(add, "p array<double>")
    if wide:
        sums = sums.repartition(FAN_IN).mapInArrow(merge, "p array<double>")
    return np.sum([r.values.to_numpy() for r in sums.toArrow().column("p")], axis=0)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n; n*x - S is worked out in integers wherever it fits into 64 bits."""
    if int(np.abs(x).max()) * n + max(map(abs, sums)) < 2 ** 63:
        return (x * n - np.array(sums)) / n
    return x - np.array([s / n for s in sums])


class Centred:
    """Products with the covariance of the fit list, one pass over it each."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int], wide: bool):
        self.fit, self.n, self.sums, self.dim, self.wide = fit, n, sums, len(sums), wide

    def over(self, of_centred) -> np.ndarray:
        """The sum of of_centred(centred rows) over the fit list, divided by n."""
        n, sums = self.n, self.sums
        return passed(self.fit, lambda x: of_centred(centred(x, n, sums)), self.wide) / n

    def product(self, d: np.ndarray) -> np.ndarray:
        return self.over(lambda c: c.T @ (c @ d)).reshape(self.dim, -1)

    def trace(self) -> float:
        return float(self.over(lambda c: np.square(c).sum())[0])


def off(basis: np.ndarray, t: np.ndarray) -> np.ndarray:
    """t without its parts along an orthonormal basis."""
    for _ in range(2):
        t = t - basis @ (basis.T @ t)
    return t


def corrections(op: Centred, fixed: np.ndarray, theta: np.ndarray, r: np.ndarray, steps: int) -> np.ndarray:
    """Rough solutions of the projected correction equations of several pairs, by MINRES side by side.
    fixed: orthonormal directions kept out of the solutions."""
    x = np.zeros_like(r)
    v0, v = np.zeros_like(r), off(fixed, -r)
    beta = np.linalg.norm(v, axis=0)
    eta, live = beta.copy(), beta > 0
    v = v / np.where(live, beta, 1)
    w0, w1 = np.zeros_like(r), np.zeros_like(r)
    c0, c1, s0, s1 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    start = np.abs(eta)
    for _ in range(steps):
        if not live.any():
            break
        av = off(fixed, op.product(v) - v * theta)
        alpha = (v * av).sum(0)
        nxt = off(fixed, av - v * alpha - v0 * beta)
        beta1 = np.linalg.norm(nxt, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        rho1, rho2, rho3 = np.hypot(delta, beta1), s1 * alpha + c0 * c1 * beta, s0 * beta
        rho1 = np.where(rho1 > 0, rho1, 1)
        c, s = delta / rho1, beta1 / rho1
        w = (v - w0 * rho3 - w1 * rho2) / rho1
        x = x + np.where(live, w * (c * eta), 0)
        eta = -s * eta
        live = live & (beta1 > EPS * np.abs(theta)) & (np.abs(eta) > 1e-4 * start)
        v0, v = v, np.where(live, nxt / np.where(beta1 > 0, beta1, 1), 0)
        w0, w1, c0, c1, s0, s1, beta = w1, w, c1, c, s1, s, beta1
    return off(fixed, x)


def extended(space: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The directions that t adds to an orthonormal basis, orthonormal."""
    new = np.empty((len(t), 0))
    for i in range(t.shape[1]):
        size = np.linalg.norm(t[:, i])
        d = off(np.hstack([space, new]), t[:, i:i + 1] / size) if size > 0 else t[:, i:i + 1]
        size = np.linalg.norm(d)
        if size > 1e-8:
            new = np.hstack([new, off(np.hstack([space, new]), d / size)])
            new[:, -1] /= np.linalg.norm(new[:, -1])
    return new


def leading_pairs(op: Centred, wanted: int, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of the greatest eigenvalues, falling."""
    dim = op.dim
    wanted = min(wanted, dim)
    most = min(dim, max(48, 8 * wanted))
    space = extended(np.empty((dim, 0)), np.random.default_rng(13).standard_normal((dim, min(dim, wanted + 2))))
    images = op.product(space)
    worst = np.inf
    for _ in range(OUTER):
        h = space.T @ images
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        u = space @ turn[:, :wanted]
        r = images @ turn[:, :wanted] - u * value[:wanted]
        size = np.linalg.norm(r, axis=0)
        open_ = np.flatnonzero(size > 4 * EPS * np.sqrt(dim) * max(value[0], 0))  # the others are locked
        full = space.shape[1] == dim
        if not len(open_) or (full and size.max() >= worst / 2):
            break  # with the whole space searched, what is left is the rounding of the products
        worst = size.max() if full else worst
        if space.shape[1] + len(open_) > most and most < dim:  # restart with the best of the space
            space, images = space @ turn[:, :2 * wanted], images @ turn[:, :2 * wanted]
        t = corrections(op, u, value[open_], r[:, open_], inner)
        new = extended(space, t)
        if not new.shape[1]:  # nothing new in the corrections: the residuals, then anything
            new = extended(space, r[:, open_])
        if not new.shape[1] and not full:
            new = extended(space, np.random.default_rng(space.shape[1]).standard_normal((dim, 1)))
        if new.shape[1]:
            space, images = np.hstack([space, new]), np.hstack([images, op.product(new)])
        else:
            images = op.product(space)
    else:
        raise ArithmeticError("residuals have not reached double precision")
    u = space @ turn[:, :wanted]
    u *= np.where(u[np.abs(u).argmax(0), np.arange(wanted)] < 0, -1, 1)
    return value[:wanted], u


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
             components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per input row that takes
    part and per component.

    Entries are floor(scale * c). Rows whose vector is null, empty or holds a null or non-finite entry take
    no part, nor do vectors of another length than the most frequent one (of equals, the longest). A null
    id is an id like any other; repeated rows are answered each and count once in the fit, as equal vectors
    do. Components without variance are left out, so one distinct vector or an empty table gives no row. A
    deviation beyond 64 bits is null. Other columns are not read."""
    c = F.col(vec_col).cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = cut(vectors.filter(F.col(vec_col).isNotNull()).filter(~bad & (F.size(c) > 0))
               .select(F.col(id_col).cast("long").alias("vec_id"),
                       F.transform(c, lambda x: F.floor(x * scale)).alias("x")), "whitening_rows")
    none = vectors.sparkSession.createDataFrame([], OUT)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return none
    dim = length["d"]
    rows = rows.filter(F.size("x") == dim)
    fit = cut(rows.select("x").distinct(), "fit_list")
    n, wide = fit.count(), fit.rdd.getNumPartitions() > FAN_IN
    # sums of the upper and the lower parts stay exact in doubles
    high, low = (passed(fit, f, wide) for f in (lambda x: (x >> 20).sum(0), lambda x: (x & 0xFFFFF).sum(0)))
    sums = [(int(a) << 20) + int(b) for a, b in zip(high, low, strict=True)]
    op = Centred(fit, n, sums, wide)
    trace = op.trace()
    values, u = leading_pairs(op, components) if trace > 0 else (np.empty(0), np.empty((dim, 0)))
    some = values > 1e-12 * trace
    values, u = values[some], u[:, some]
    if not len(values):
        return none
    root = np.sqrt(values)

    mean = op.over(lambda c: (c @ u / root).sum(0))
    cov = op.over(lambda c: (c @ u / root - mean).T @ (c @ u / root - mean)).reshape(len(root), -1)
    error = float(np.abs(cov - np.eye(len(root))).max())
    share = values / trace

    def answer(batches):
        k = len(root)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix_of(batch.column("x"))
            each = pa.array(np.repeat(np.arange(m), k))
            if (int(np.abs(x).max()) * n + max(map(abs, sums))) ** 2 * dim < 2 ** 63:
                dev = np.square(x * n - np.array(sums)).sum(1).tolist()
            else:
                dev = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
                dev = [v if v < 2 ** 63 else None for v in dev]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n)), pa.array(dev, pa.int64()).take(each),
                pa.array((centred(x, n, sums) @ u / root).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                [f.split()[0] for f in OUT.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(answer, OUT)


def op13_embedding_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))
