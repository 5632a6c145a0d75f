"""Multinomial softmax regression. Small models take Newton steps on the whole Hessian, others find them by conjugate
gradients; where there is no finite maximum, or a learning rate is given, accelerated gradient steps are taken."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import normal_cdf, normal_ppf
from tessera.operators.families import ModelError
from tessera.operators.fitting import INTERCEPT, check_names, number
from tessera.operators.gram import blocks, gathered, inverse, steps_over, summed
from tessera.operators.inference import SUMMARY, _level
from tessera.operators.steps import accelerated, newton_cg
from tessera.sources import free_prefix, table

#: Up to so many coefficients a Newton step has their Hessian summed; beyond, it is only multiplied by vectors.
WHOLE_HESSIAN = 300


def _sums(rows: RDD, beta: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient (classes x columns) and Hessian of the log-likelihood; the first class is the reference. ``rows``: blocks
    of (class, x..)."""
    c, d = beta.shape

    def part(block):
        k, x, p = _shared(block, beta, mean, sd)
        g, h = (np.eye(c)[k] - p).T @ x, np.zeros((c, d, c, d))
        for i in range(1, c):
            for j in range(i, c):
                h[i, :, j, :] = x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None])
                h[j, :, i, :] = h[i, :, j, :]
        return [g[1:].ravel(), h[1:, :, 1:, :].reshape((c - 1) * d, (c - 1) * d)]

    g, h = summed(rows, part)
    return g, h


def _shared(block: np.ndarray, beta: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, design rows and probabilities of a block."""
    x = np.hstack([np.ones((len(block), 1)), (block[:, 1:] - mean) / sd])
    eta = x @ beta.T
    p = np.exp(eta - eta.max(1, keepdims=True))
    return block[:, 0].astype(np.int64), x, p / p.sum(1, keepdims=True)


class _Softmax:
    """Complete rows as blocks, with what standardizes them; coefficients are those of all classes but the first."""

    def __init__(self, df: DataFrame, outcome: str, features: list[str]):
        own = free_prefix(df)
        label = F.col(f"{own}label")
        rows = df.select(F.col(outcome).cast("string").alias(f"{own}label"), *[number(df, c).alias(f"{own}x{i}") for i, c in enumerate(features)])
        complete = rows.dropna().select(f"{own}label").distinct()
        self.classes = sorted(r[0] for r in complete.collect())  # as many as the model has
        if len(self.classes) < 2:
            raise ModelError("the outcome needs at least 2 distinct classes")
        known = pa.table({f"{own}of": pa.array(self.classes, pa.string()), f"{own}k": pa.array(range(len(self.classes)), pa.int32())})
        placed = rows.join(df.sparkSession.createDataFrame(known), label == F.col(f"{own}of"))
        self.rows = blocks(placed, [F.col(f"{own}k").cast("double"), *[F.col(f"{own}x{i}") for i in range(len(features))]], complete=False).persist(StorageLevel.MEMORY_AND_DISK)
        total, count = summed(self.rows, lambda b: [b[:, 1:].sum(0), np.array([float(len(b))])])
        self.n = count[0]
        self.few = gathered(self.rows, self.n * (1 + len(features)))
        self.mean = mean = total / self.n
        spread = np.sqrt(summed(self.few, lambda b: [((b[:, 1:] - mean) ** 2).sum(0)])[0] / self.n)
        self.constant = spread <= 1e-14 * np.abs(mean)
        self.sd = np.where(self.constant, 1.0, spread)
        self.shape = len(self.classes), len(features) + 1
        self.free = np.tile(np.append(0.0, np.ones(len(features))), len(self.classes) - 1)
        self.active = np.tile(np.append(True, ~self.constant), len(self.classes) - 1)

    def __getstate__(self) -> dict:
        """Tasks get all but the rows."""
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "few")}

    def whole(self, flat: np.ndarray) -> np.ndarray:
        c, d = self.shape
        return np.vstack([np.zeros(d), (flat * self.active).reshape(c - 1, d)])

    def newton(self, rows, l1: float, l2: float, tol: float, max_iter: int) -> np.ndarray | None:
        """None where the steps do not settle, or the Hessian loses rank on the way: the classes are separated."""
        flat, n, rank, active = np.zeros(len(self.free)), self.n, None, self.active
        free = self.free[active]
        for _ in range(max_iter):
            g, h = _sums(rows, self.whole(flat), self.mean, self.sd)
            a = (h + n * l2 * np.diag(self.free))[np.ix_(active, active)]
            right = g[active] - n * l2 * free * flat[active]
            if not np.isfinite(a).all():
                return None
            values = np.linalg.eigvalsh(a)
            found = int((values > 1e-12 * max(values[-1], 1e-8 * n)).sum())
            rank = found if rank is None else rank
            if found < rank:
                return None
            new = flat.copy()
            if l1 > 0:
                new[active] = _soft_steps(a, a @ flat[active] + right, n * l1 * free, flat[active])
            else:
                inv = inverse(a) if found == len(a) else None
                new[active] = flat[active] + (np.linalg.pinv(a, rcond=1e-12, hermitian=True) if inv is None else inv) @ right
            if not np.isfinite(new).all():
                return None
            moved, flat = np.abs(new - flat).max(), new
            if moved < tol:
                return flat
        return None

    def _slope(self, rows, flat: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient of the mean log-likelihood, and the mean loss."""
        beta, mean, sd = self.whole(flat), self.mean, self.sd

        def part(block):
            k, x, p = _shared(block, beta, mean, sd)
            loss = -np.log(np.maximum(p[np.arange(len(k)), k], 1e-300)).sum()
            p[np.arange(len(k)), k] -= 1.0
            return [-(p.T @ x)[1:].ravel(), np.array([loss])]

        right, loss = summed(rows, part)
        return right / self.n * self.active, float(loss[0]) / self.n

    def conjugate(self, rows, l2: float, tol: float, max_iter: int) -> np.ndarray | None:
        free, mean, sd = self.free, self.mean, self.sd

        def evaluate(flat):
            right, loss = self._slope(rows, flat)
            return loss + l2 / 2 * (free * flat) @ flat, -right + l2 * free * flat

        def multiply(flat, v):
            beta, way = self.whole(flat), self.whole(v)

            def part(block):
                _, x, p = _shared(block, beta, mean, sd)
                along = x @ way.T
                bent = p * (along - (p * along).sum(1, keepdims=True))
                return [(bent.T @ x)[1:].ravel()]

            return summed(rows, part)[0] / self.n * self.active + l2 * free * v

        return newton_cg(evaluate, multiply, np.zeros(len(free)), tol, max_iter)

    def descent(self, rows, l1: float, l2: float, tol: float, max_iter: int, rate: float | None) -> np.ndarray:
        step = rate or 2 / (self.shape[1] + 2 * l2)
        return accelerated(lambda flat: (self._slope(rows, flat)[0], 1.0), np.zeros(len(self.free)), step, l1, l2, self.free, tol, max_iter)


def _soft_steps(a: np.ndarray, b: np.ndarray, cuts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Coordinate descent for x'ax / 2 - b'x + sum cuts |x|."""
    x = start.copy()
    for _ in range(200):
        old = x.copy()
        for j in range(len(x)):
            r = b[j] - a[j] @ x + a[j, j] * x[j]
            x[j] = np.sign(r) * max(abs(r) - cuts[j], 0) / a[j, j] if a[j, j] > 0 else 0.0
        if np.abs(x - old).max() < 1e-14:
            break
    return x


def fit(source, outcome: str, max_iter: int = 50000, learning_rate: float | None = None, tol: float = 1e-10, l2: float = 0.0, l1: float = 0.0) -> DataFrame:
    """The reference class is the smallest label as a string. Newton steps, where they settle within ``max_iter``, find the
    maximum (an L1 penalty is met by proximal ones). Otherwise, as for separated classes, which have none, and whenever
    ``learning_rate`` is given, at most ``max_iter`` accelerated gradient steps are taken from zero."""
    if not (l2 >= 0 and l1 >= 0):
        raise ModelError("l2 must be >= 0" if not l2 >= 0 else "l1 must be >= 0")
    df = table(source)
    features = sorted(c for c in df.columns if c != outcome)
    check_names(df, features)
    if not features:
        raise ModelError("no feature columns")
    data = _Softmax(df, outcome, features)
    try:
        flat = None
        if learning_rate is None and len(data.free) <= WHOLE_HESSIAN:
            flat = steps_over(data.few, lambda rows: data.newton(rows, l1, l2, tol, min(max_iter, 100)))
        elif learning_rate is None and l1 == 0:
            flat = steps_over(data.few, lambda rows: data.conjugate(rows, l2, tol, min(max_iter, 100)))
        if flat is None:
            flat = steps_over(data.few, lambda rows: data.descent(rows, l1, l2, tol, max_iter, learning_rate))
        beta = data.whole(flat)
        slopes = beta[:, 1:] / data.sd
        base = beta[:, 0] - slopes @ data.mean
        out = [(k, f, float(v) + 0.0) for k, b0, row in zip(data.classes, base, slopes, strict=True) for f, v in [(INTERCEPT, b0), *zip(features, row, strict=True)]]
        return df.sparkSession.createDataFrame(out, "class string, feature string, coefficient double")
    finally:
        data.rows.unpersist()


def _model(model) -> tuple[list[str], list[str], np.ndarray]:
    found = {(r["class"], r["feature"]): r["coefficient"] for r in table(model).collect()}
    classes, features = sorted({k for k, _ in found}), sorted({f for _, f in found} - {INTERCEPT})
    return classes, features, np.array([[found.get((k, f), 0.0) for f in (INTERCEPT, *features)] for k in classes])


def _shares(model, df: DataFrame) -> tuple[list[str], Column]:
    """Classes and the array of their probabilities, from predictors shifted by the largest."""
    classes, features, beta = _model(model)
    xs = [number(df, f, lenient=True) if f in df.columns else F.lit(None).cast("double") for f in features]
    etas = F.array(*[sum((float(b) * x for b, x in zip(row[1:], xs, strict=True)), F.lit(float(row[0]))) for row in beta])
    whole = F.transform(F.array(etas), lambda e: F.transform(e, lambda v: F.exp(v - F.array_max(e))))[0]
    return classes, F.transform(F.array(whole), lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda s, q: s + q)))[0]


def predict(model, source) -> DataFrame:
    df = table(source)
    if {c.lower() for c in df.columns} & {"pred", "probs"}:
        raise ModelError('the table already has a "pred" or "probs" column')
    classes, shares = _shares(model, df)
    names = F.array(*map(F.lit, classes))
    p = f"{free_prefix(df)}p"
    out = df.withColumn(p, shares)
    best = F.array_position(p, F.array_max(p))
    whole = ~F.exists(p, lambda v: v.isNull())
    return out.withColumns({"pred": F.when(whole, F.element_at(names, best.cast("int"))), "probs": F.map_from_arrays(names, F.col(p))}).drop(p)


def evaluate(model, source, outcome: str) -> DataFrame:
    """A label unknown to the model counts as wrong and has no part in the log loss."""
    df = table(source)
    classes, shares = _shares(model, df)
    rows = df.select(F.col(outcome).cast("string").alias("label"), shares.alias("p")).where("label is not null and not exists(p, v -> v is null)")
    names = F.array(*map(F.lit, classes))
    at = F.array_position(names, F.col("label")).cast("int")
    right = (F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")) == F.col("label")).cast("double")
    loss = F.when(at > 0, -F.log(F.greatest(F.get("p", at - 1), F.lit(1e-15))))
    out = rows.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(loss).alias("log_loss"))
    if not out.first()["n"]:
        raise ModelError("no rows with a non-NULL prediction and outcome")
    return out


def summary(model, source, outcome: str, conf_level: float = 0.95) -> DataFrame:
    """Inference for all classes but the reference. Rows without a label are left out; without rows there are no errors."""
    _level(conf_level)
    df = table(source)
    classes, features, beta = _model(model)
    xs = [number(df, f, lenient=True) if f in df.columns else F.lit(None).cast("double") for f in features]
    rows = blocks(df.where(F.col(outcome).isNotNull()), [F.lit(0.0), *xs], complete=False)
    try:
        cov = inverse(_sums(rows, beta - beta[0], np.zeros(len(features)), np.ones(len(features)))[1])
    except ModelError:  # no row to infer from
        cov = None
    crit, d = normal_ppf((1 + conf_level) / 2), len(features) + 1
    out = []
    for i in range(1, len(classes)):
        for j, name in enumerate((INTERCEPT, *features)):
            k, b = (i - 1) * d + j, float(beta[i, j])
            se = math.sqrt(cov[k, k]) if cov is not None and cov[k, k] > 0 else None
            z = b / se if se else None
            out.append((classes[i], name, b, se, z, None if z is None else 2 * normal_cdf(-abs(z)), None if se is None else b - crit * se, None if se is None else b + crit * se))
    return df.sparkSession.createDataFrame(out, f"class string, {SUMMARY}")
