"""Grids, k-fold cross-validation of all models at once, dispersion estimation and categorical encoding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import lgamma
from tessera.operators.families import ARRAYS, Family, ModelError, family
from tessera.operators.fitting import Design, quoted
from tessera.operators.gram import added, blocks, descend, gathered, inverse, summed
from tessera.operators.wide import encode_dummies, levels_of, text_columns
from tessera.sources import free_prefix, table, written


def reg_grid(low: float, high: float, n: int, log_spaced: bool = False) -> list[float]:
    if n < 2:
        return [float(low)]
    if log_spaced:
        return [math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (n - 1)) for i in range(n)]
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def refined(grid: list[float], best: float, n: int) -> list[float]:
    """``n`` points from the grid's neighbour below the best value to the one above."""
    if n < 2:
        raise ModelError("n_refine must be >= 2")
    values = sorted(set(grid))
    i = values.index(best)
    low, high = values[max(0, i - 1)], values[min(len(values) - 1, i + 1)]
    return [best] if low == high else reg_grid(low, high, n)


def _passes(rows: RDD, fams: list[Family], folds: list[int | None], beta: np.ndarray, grams: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For every model, over the rows outside its fold: the Gram matrix (if ``grams``), right-hand side, number of rows."""
    d = beta.shape[1]

    def part(block):
        y, fold = block[:, 0], block[:, 1]
        x = np.hstack([np.ones((len(y), 1)), block[:, 2:]])
        g, s, n = np.zeros((len(fams) if grams else 0, d, d)), np.zeros((len(fams), d)), np.zeros(len(fams))
        for m, (fam, out) in enumerate(zip(fams, folds, strict=True)):
            use = np.ones(len(y), bool) if out is None else fold != out
            xm = x[use]
            mu = fam.mean(xm @ beta[m], ARRAYS)
            if grams:
                g[m] = xm.T @ (xm * fam.information(mu, ARRAYS)[:, None])
            s[m], n[m] = xm.T @ fam.score(y[use], mu, ARRAYS), use.sum()
        return [g, s, n]

    return summed(rows, part)


class _Folds:
    """What one pass sums of each fold: its number of rows, the Gram matrix of (1, x), its products with the outcome, and
    the outcome's square. All training sums are the whole less a fold."""

    def __init__(self, rows: RDD, k: int, d: int):
        def part(block):
            v = np.column_stack([np.ones(len(block)), block[:, 2:], block[:, 0]])
            return [np.array([w.T @ w for w in (v[block[:, 1] == f] for f in range(k))])]

        (sums,) = summed(rows, part)
        self.gram, self.right, self.square, self.n = sums[:, :d, :d], sums[:, :d, d], sums[:, d, d], sums[:, 0, 0]

    def training(self, fold: int | None) -> tuple[np.ndarray, np.ndarray, float]:
        gram, right, n = self.gram.sum(0), self.right.sum(0), self.n.sum()
        return (gram, right, n) if fold is None else (gram - self.gram[fold], right - self.right[fold], n - self.n[fold])

    def path(self, fold: int, l1: list[float], l2: list[float], active: np.ndarray) -> np.ndarray:
        """Linear models of all rows outside a fold, one for each pair of penalties; each starts where the last ended, from
        the heaviest L1 penalty down."""
        gram, right, n = self.training(fold)
        beta, start = np.zeros((len(l1), len(right))), np.zeros(len(right))
        for m in sorted(range(len(l1)), key=lambda m: -l1[m]):
            a = gram + n * l2[m] * np.diag([0.0] + [1.0] * (len(right) - 1))
            if l1[m] > 0:
                beta[m] = np.where(active, descend(a, right, n * l1[m], start, 1000), 0.0)
            else:
                beta[m, active] = _solved(a[np.ix_(active, active)]) @ right[active]
            start = beta[m]
        return beta

    def losses(self, fold: int, beta: np.ndarray) -> np.ndarray:
        """Sums of squared residuals of the fold; NaN where too few digits are left."""
        lost = self.square[fold] - 2 * beta @ self.right[fold] + np.einsum("mi,ij,mj->m", beta, self.gram[fold], beta)
        return np.where(lost > 1e-6 * self.square[fold], lost, np.nan)


def _solved(part: np.ndarray) -> np.ndarray:
    inv = inverse(part)
    return np.linalg.pinv(part, rcond=1e-12, hermitian=True) if inv is None else inv


def _packed(rows: DataFrame, d: int) -> RDD:
    return blocks(rows, [F.col("y"), F.col("fold").cast("double"), *[F.col("x")[i] for i in range(d - 1)]])


def _solve(rows: DataFrame, fams: list[Family], folds: list, l1: list[float], l2: list[float], d: int, active: np.ndarray, tol: float, max_iter: int, rate: float | None = None) -> np.ndarray:
    """Reweighted least squares for all models at once; where any of them fails, descent for all."""
    beta = np.zeros((len(fams), d))
    free = np.array([0.0] + [1.0] * (d - 1))
    packed = _packed(rows, d).persist(StorageLevel.MEMORY_AND_DISK)
    few = gathered(packed, packed.map(lambda b: len(b[0]) / 8).sum())
    try:
        fixed = None
        if fams[0].name in ("linear", "gamma"):  # the weights never change: one Gram matrix a fold, whatever the grid
            sums = _Folds(few, 1 + max((f for f in folds if f is not None), default=0), d)
            training = {f: sums.training(f)[0] for f in set(folds)}
            fixed = [training[f] for f in folds]
        for _ in range(max_iter):
            new = np.zeros_like(beta)
            grams, rights, counts = _passes(few, fams, folds, beta, fixed is None)
            for m, (g, s, n) in enumerate(zip(grams if fixed is None else fixed, rights, counts, strict=True)):
                a, b = g + n * l2[m] * np.diag(free), g @ beta[m] + s
                if not (np.isfinite(a).all() and np.isfinite(b).all()):
                    return _descend(rows, fams, folds, l1, l2, active, tol, max_iter, rate)
                if l1[m] > 0:
                    new[m] = np.where(active, descend(a, b, n * l1[m], beta[m]), 0.0)
                else:
                    part = a[np.ix_(active, active)]
                    if fams[m].name == "logistic" and np.diag(part).max() < 1e-8 * n:
                        return _descend(rows, fams, folds, l1, l2, active, tol, max_iter, rate)
                    new[m, active] = _solved(part) @ b[active]
            if not np.isfinite(new).all() or np.abs(new).max() >= 1e100:
                return _descend(rows, fams, folds, l1, l2, active, tol, max_iter, rate)
            moved, beta = np.abs(new - beta).max(), new
            if moved < tol:
                break
        return beta
    finally:
        packed.unpersist()


def _descend(rows: DataFrame, fams: list[Family], folds: list, l1: list[float], l2: list[float], active: np.ndarray, tol: float, max_iter: int, rate: float | None) -> np.ndarray:
    """Accelerated proximal gradient descent for all models at once, one pass a step."""
    d, free = len(active), np.array([0.0] + [1.0] * (len(active) - 1))
    step = rate or (4 / (d + 4 * max(l2)) if fams[0].name == "logistic" else 1 / (d + max(l2)))
    packed = _packed(rows, d).persist(StorageLevel.MEMORY_AND_DISK)
    few = gathered(packed, packed.map(lambda b: len(b[0]) / 8).sum())
    beta = before = np.zeros((len(fams), d))
    try:
        for it in range(max_iter):
            look = beta + it / (it + 3) * (beta - before)

            def partial(found, look=look):
                total, peak = np.zeros((len(fams), d + 1)), np.ones(len(fams))
                for raw, width in found:
                    block = np.frombuffer(raw).reshape(-1, width)
                    y, fold = block[:, 0], block[:, 1]
                    x = np.hstack([np.ones((len(y), 1)), block[:, 2:]])
                    for m, (fam, out) in enumerate(zip(fams, folds, strict=True)):
                        use = np.ones(len(y), bool) if out is None else fold != out
                        mu = fam.mean(x[use] @ look[m], ARRAYS)
                        total[m] += np.append(x[use].T @ fam.score(y[use], mu, ARRAYS), use.sum())
                        if fam.log_link and use.any():
                            peak[m] = max(peak[m], fam.observed(y[use], mu, ARRAYS).max())
                yield total, peak

            total, peak = added(few.mapPartitions(partial))
            pace = (step / peak)[:, None]
            new = look + pace * (total[:, :d] / np.maximum(total[:, d:], 1) - np.array(l2)[:, None] * free * look)
            new = np.sign(new) * np.maximum(np.abs(new) - pace * np.array(l1)[:, None] * free, 0.0) * active
            moved, before, beta = np.abs(new - look).max(), beta, new
            if not np.isfinite(new).all():
                raise ModelError("did not converge: use larger penalties")
            if moved < tol:
                break
    finally:
        packed.unpersist()
    return beta


class _Prepared:
    """Complete rows with globally standardized features, the scaled outcome and the fold."""

    def __init__(self, source, outcome: str, fam: Family, k: int, order_by: str | None, fold_col: str | None):
        df = table(source)
        fold = f"{free_prefix(df)}fold"
        keyed = df.withColumnRenamed(fold_col, fold) if fold_col else numbered(df, order_by, fold, k)
        self.design = d = Design(keyed, outcome, fam, carry=fold)
        d.release()
        x = [F.col(f"x{i}") for i in range(len(d.features))]
        z = F.array(*[(c - float(m)) / float(s) for c, m, s in zip(x, d.mean, d.sd, strict=True)])
        scale = (F.col("y") - d.y_mean) / d.y_sd if fam.identity else F.col("y") / d.y_mean if fam.log_link else F.col("y")
        self.rows = d.rows.select(scale.alias("y"), F.col("carried").cast("int").alias("fold"), z.alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
        self.active = np.concatenate([[True], ~d.constant])


def numbered(df: DataFrame, order_by: str | None, name: str, k: int) -> DataFrame:
    """``df`` without the key and with the row's number modulo ``k`` as column ``name``. Rows are numbered by the key, null
    keys last, and equal keys by the hash of the whole row, so that only equal rows could change places; without a key in
    physical order. They are numbered within ranges, which are then counted up; a second evaluation could cut the ranges
    elsewhere, so both steps read what one job has written."""
    own = free_prefix(df)
    row, part = f"{own}row", f"{own}part"
    if order_by:
        order = [F.col(quoted(order_by)).asc_nulls_last(), F.xxhash64(*map(quoted, df.columns)), F.xxhash64(F.monotonically_increasing_id())]
        names = [f"{own}k{i}" for i in range(3)]
        df = df.withColumns(dict(zip(names[1:], order[1:], strict=True)))
        sort = [order[0], *names[1:]]
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort).drop(*names[1:])
    # ids rise within a partition and from one to the next
    rows = written(df.withColumn(row, F.monotonically_increasing_id()))
    in_part = F.shiftright(row, 33)
    sizes = sorted((r[part], r["n"]) for r in rows.groupBy(in_part.alias(part)).agg(F.count("*").alias("n")).collect())  # one row a partition
    starts = np.cumsum([0, *(n for _, n in sizes)])[:-1]
    known = pa.table({part: pa.array([p for p, _ in sizes], pa.int64()), f"{own}start": pa.array(starts, pa.int64())})
    placed = rows.join(rows.sparkSession.createDataFrame(known), in_part == F.col(part)) if sizes else rows.withColumn(f"{own}start", F.lit(0))
    number = F.col(f"{own}start") + F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (number % k).cast("int")).drop(row, part, f"{own}start", *([order_by] if order_by else []))


def cross_validate(sweep: str, source, outcome: str, family_name: str, grid: list[float], k: int = 5, max_iter: int = 20000, learning_rate: float | None = None, tol: float = 1e-8, order_by: str | None = None, fold_col: str | None = None) -> DataFrame:
    """(value, cv_deviance) for each grid point, in the grid's order. Rows are dealt to folds in the order of
    ``order_by`` or by ``fold_col``; without either, in physical order. Incomplete rows keep their number but are left out.
    Linear sweeps of penalties take one pass whatever the grid."""
    if family_name not in ("linear", "logistic", "poisson", "gamma", "tweedie", "nbinom"):
        raise ModelError(f"unsupported family {family_name!r}")
    if k < 2:
        raise ModelError("k must be >= 2")
    if not grid:
        raise ModelError("grid must be non-empty")
    if sweep in ("l1", "l2") and min(grid) < 0:
        raise ModelError(f"{sweep} grid values must be >= 0")
    swept = lambda g: family(family_name, power=g if sweep == "power" else None, alpha=g if sweep == "alpha" else None)
    fams = [swept(g) for g in grid]
    p = _Prepared(source, outcome, fams[0], k, order_by, fold_col)
    try:
        y_mean, y_sd = p.design.y_mean, p.design.y_sd
        models = [(g, f) for g in range(len(grid)) for f in range(k)]
        penalty = {s: [grid[g] if sweep == s else 0.0 for g, _ in models] for s in ("l1", "l2")}
        lost = _linear_losses(p, k, grid, sweep) if fams[0].identity else None
        if lost is None:
            inner = [fams[g].scaled(y_mean) for g, _ in models]
            beta = _solve(p.rows, inner, [f for _, f in models], penalty["l1"], penalty["l2"], len(p.active), p.active, tol, max_iter, learning_rate)

            def part(block):
                y, fold = block[:, 0], block[:, 1]
                x, total = np.hstack([np.ones((len(y), 1)), block[:, 2:]]), np.zeros(len(grid))
                for m, (g, f) in enumerate(models):
                    own = fold == f
                    mu = fams[g].mean(x[own] @ beta[m], ARRAYS)
                    if fams[g].identity:
                        total[g] += ((y[own] - mu) ** 2).sum() * y_sd**2
                    elif fams[g].log_link:
                        total[g] += fams[g].deviance(y[own] * y_mean, mu * y_mean, ARRAYS).sum()
                    else:
                        total[g] += fams[g].deviance(y[own], mu, ARRAYS).sum()
                return [total]

            lost = summed(_packed(p.rows, len(p.active)), part)[0]
        return table(source).sparkSession.createDataFrame([(float(g), float(v / p.design.n)) for g, v in zip(grid, lost, strict=True)], f"{sweep} double, cv_deviance double")
    finally:
        p.rows.unpersist()


def _linear_losses(p: _Prepared, k: int, grid: list[float], sweep: str) -> np.ndarray | None:
    """Squared errors of all linear models from the sums of one pass; None where they keep too few digits."""
    sums = _Folds(_packed(p.rows, len(p.active)), k, len(p.active))
    l1, l2 = ([v if sweep == s else 0.0 for v in grid] for s in ("l1", "l2"))
    lost = sum(sums.losses(f, sums.path(f, l1, l2, p.active)) for f in range(k) if sums.n[f])
    return lost * p.design.y_sd**2 if np.isfinite(lost).all() else None


def cross_validate_refine(sweep: str, source, outcome: str, family_name: str, grid: list[float], k: int = 5, n_refine: int = 10, *args, **options) -> DataFrame:
    """A second sweep around the best point of the first; of equal points the first in the grid is best."""
    first = cross_validate(sweep, source, outcome, family_name, grid, k, *args, **options).collect()
    best = min(first, key=lambda r: r["cv_deviance"])[sweep]
    return cross_validate(sweep, source, outcome, family_name, refined([float(g) for g in grid], best, n_refine), k, *args, **options)


def nbinom_dispersion(source, outcome: str, alpha_grid: list[float], max_iter: int = 20000, learning_rate: float | None = None, tol: float = 1e-8) -> DataFrame:
    """(alpha, loglik) of the negative binomial fit at each dispersion, by alpha; all fits share each pass."""
    if not alpha_grid:
        raise ModelError("alpha_grid must be non-empty")
    if min(alpha_grid) <= 0:
        raise ModelError("alpha (dispersion) must be > 0")
    d = Design(source, outcome, Family("nbinom", 1.0))
    try:
        rows = d.rows.select((F.col("y") / d.y_mean).alias("y"), F.lit(0).alias("fold"), F.array(*d.z).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
        active = np.concatenate([[True], ~d.constant])
        fams = [Family("nbinom", float(a)) for a in alpha_grid]
        beta = _solve(rows, [f.scaled(d.y_mean) for f in fams], [None] * len(fams), [0.0] * len(fams), [0.0] * len(fams), len(active), active, tol, max_iter, learning_rate)
        y = F.col("y")
        sums = []
        for a, b in zip(alpha_grid, beta, strict=True):
            eta = F.lit(float(b[0] + math.log(d.y_mean)))
            for v, z in zip(b[1:], d.z, strict=True):
                eta = eta + float(v) * z
            mu, r = F.exp(eta), 1.0 / a
            sums.append(F.sum(lgamma(y + r) - math.lgamma(r) - lgamma(y + 1.0) + r * F.log(r / (r + mu)) + y * F.log(mu / (r + mu))))
        found = d.rows.agg(*sums).first()
        rows.unpersist()
        return table(source).sparkSession.createDataFrame(sorted(zip(map(float, alpha_grid), map(float, found), strict=True)), "alpha double, loglik double")
    finally:
        d.release()


def nbinom_dispersion_refine(source, outcome: str, alpha_grid: list[float], n_refine: int = 10, *args, **options) -> DataFrame:
    best = max(nbinom_dispersion(source, outcome, alpha_grid, *args, **options).collect(), key=lambda r: r["loglik"])["alpha"]
    return nbinom_dispersion(source, outcome, refined([float(a) for a in alpha_grid], best, n_refine), *args, **options)


def dummy_encode_sql(name: str, outcome: str) -> str:
    """What ``encode_dummies`` does as SQL text over a table name."""
    df = table(name)
    levels = {c: vs[1:] for c, vs in levels_of(df, text_columns(df, [outcome])).items()}
    if not levels:
        return f"SELECT * FROM {name}"
    escape = lambda v: v.replace("\\", "\\\\").replace("'", "\\'")
    made = [f"CAST({quoted(c)} = '{escape(v)}' AS INT) AS {quoted(f'{c}_{v}')}" for c, vs in levels.items() for v in vs]
    return f"SELECT * EXCEPT ({', '.join(map(quoted, levels))}), {', '.join(made)} FROM {name}" if made else f"SELECT * EXCEPT ({', '.join(map(quoted, levels))}) FROM {name}"
