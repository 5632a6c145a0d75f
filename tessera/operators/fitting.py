"""Fitting by iteratively reweighted least squares on standardized columns; gradient descent where that fails."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import levels
from tessera.operators.families import COLUMNS, Family, ModelError
from tessera.operators.gram import blocks, cross, descend, gathered, gradient, inverse, root_inverse, steps_over, triangle
from tessera.operators.names import INTERCEPT, check_names, check_outcome, number, quoted, used_columns
from tessera.operators.steps import accelerated
from tessera.operators.wide import encode_dummies, fit_wide, text_columns
from tessera.sources import table

__all__ = ["INTERCEPT", "Design", "check_names", "fit", "number", "quoted"]

MODEL = "feature string, coefficient double"
#: Designs with more features are fitted without a matrix of all pairs of them.
WIDE = 400


class Design:
    """Complete rows (y, x0.., o, a), cached, with the statistics that standardize them. ``carry``: a column that is no
    feature and stays with its row; with ``bare`` it may be the only one."""

    def __init__(self, source: DataFrame | str, outcome: str, fam: Family, offset_col: str | None = None, weights_col: str | None = None, carry: str | None = None, bare: bool = False):
        df = table(source)
        self.features = [c for c in used_columns(df, outcome, offset_col, weights_col) if c != carry]
        y = number(df, outcome)
        counts = df.select(y.alias("y"), *[number(df, c).alias(f"x{i}") for i, c in enumerate(self.features)])
        row = counts.agg(F.count("y"), F.min("y"), F.sum(F.when(F.col("y").isin(0.0, 1.0), 0).otherwise(F.when(F.col("y").isNotNull(), 1))), *[F.count(f"x{i}") for i in range(len(self.features))]).first()
        check_outcome(fam, outcome, *row[:3])
        if not self.features and not bare:
            raise ModelError("no feature columns")
        if empty := [c for c, n in zip(self.features, row[3:], strict=True) if not n]:
            raise ModelError(f"feature column(s) entirely NULL: {', '.join(empty)}")
        offset = number(df, offset_col) if offset_col else F.lit(0.0)
        weight = number(df, weights_col) if weights_col else F.lit(1.0)
        rows = df.select(y.alias("y"), *[number(df, c).alias(f"x{i}") for i, c in enumerate(self.features)], offset.alias("o"), weight.alias("a"), *([F.col(quoted(carry)).alias("carried")] if carry else [])).dropna()
        self.rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        xs = [f"x{i}" for i in range(len(self.features))]
        s = self.rows.agg(F.count("*"), F.sum("a"), F.min("a"), F.sum(F.col("a") * F.col("y")), *[f for x in xs for f in (F.min(x), F.max(x), F.sum(F.col("a") * F.col(x)))]).first()
        if not s[0]:
            raise ModelError("no complete rows (every row has a NULL)")
        if s[2] < 0:
            raise ModelError("weights must be non-negative")
        if not s[1] > 0:
            raise ModelError("weights sum to zero")
        self.n, self.total = s[0], s[1]
        low, high, mean = (np.array(s[4 + k :: 3], float) for k in range(3))
        self.constant = low == high
        self.mean = np.where(self.constant, low, mean / self.total)
        y_mean = s[3] / self.total
        c = self.rows.agg(*[F.sum(F.col("a") * F.pow(F.col(x) - float(m), F.lit(2.0))) for x, m in zip([*xs, "y"], [*self.mean, y_mean], strict=True)]).first()
        spread = np.sqrt(np.maximum(np.array(c, float) / self.total, 0))
        self.sd = np.where(self.constant | (spread[:-1] == 0), 1.0, spread[:-1])
        self.y_mean, self.y_sd = (y_mean if y_mean >= 1e-300 or fam.identity else 1.0), (spread[-1] if spread[-1] >= 1e-300 else 1.0)
        # the outcome as the solver sees it
        if fam.identity:
            self.y, self.offset = (F.col("y") - self.y_mean) / self.y_sd, F.col("o") / self.y_sd
        elif fam.log_link:
            self.y, self.offset = F.col("y") / self.y_mean, F.col("o")
        else:
            self.y, self.offset = F.col("y"), F.col("o")
        self.z = [(F.col(x) - float(m)) / float(s) for x, m, s in zip(xs, self.mean, self.sd, strict=True)]

    def release(self) -> None:
        self.rows.unpersist()

    def raw(self, beta: np.ndarray, fam: Family) -> dict[str, float]:
        """Coefficients on the columns' own scale."""
        scale = self.y_sd if fam.identity else 1.0
        slopes = scale * beta[1:] / self.sd
        base = self.y_mean if fam.identity else np.log(self.y_mean) if fam.log_link else 0.0
        return {INTERCEPT: float(base + scale * beta[0] - (slopes * self.mean).sum()) + 0.0} | {f: float(b) + 0.0 for f, b in zip(self.features, slopes, strict=True)}


def linear(beta: np.ndarray, xs: list[Column], offset: Column) -> Column:
    eta = offset + float(beta[0])
    for b, x in zip(beta[1:], xs, strict=True):
        if b:
            eta = eta + float(b) * x
    return eta


def irls(design: Design, fam: Family, l1: float, l2: float, tol: float, max_iter: int, strict: bool) -> np.ndarray | None:
    """None where the iteration fails (or, if ``strict``, where the system is singular). A singular system without an
    L1 penalty takes the solution of least norm, to which gradient descent from zero also converges."""
    inner, d = fam.scaled(design.y_mean), len(design.z) + 1
    active = np.concatenate([[True], ~design.constant])
    ridge = design.total * l2 * np.diag([0.0] + [1.0] * (d - 1))
    beta, fixed = np.zeros(d), None
    for _ in range(max_iter):
        eta = linear(beta, design.z, design.offset)
        mu = inner.mean(eta, COLUMNS)
        scores = [F.col("a") * inner.score(design.y, mu, COLUMNS)]
        if fixed is None:
            (gram,), (right,), _ = cross(design.rows, design.z, [F.col("a") * inner.information(mu, COLUMNS)], scores)
            if fam.name in ("linear", "gamma"):
                fixed = gram  # the weights do not change
        else:
            gram, right = fixed, cross(design.rows, design.z, [], scores)[1][0]
        a, b = gram + ridge, gram @ beta + right
        if not (np.isfinite(a).all() and np.isfinite(b).all()):
            return None
        new = np.zeros(d)
        if l1 > 0:
            new = descend(a, b, design.total * l1, beta)
            new[~active] = 0.0
        else:
            part = a[np.ix_(active, active)]
            inv = inverse(part)
            if inv is None and fam.identity and (exact := factored(design, ridge, active)) is not None:
                return exact
            if inv is None:
                if strict or (fam.name == "logistic" and np.diag(part).max() < 1e-8 * design.total):
                    return None
                inv = np.linalg.pinv(part, rcond=1e-12, hermitian=True)
            new[active] = inv @ b[active]
        if not np.isfinite(new).all() or np.abs(new).max() >= 1e100:
            return None
        moved, beta = np.abs(new - beta).max(), new
        if moved < tol or (fam.identity and l1 == 0):
            break
    return beta


def factored(design: Design, ridge: np.ndarray, active: np.ndarray) -> np.ndarray | None:
    """Least squares from the rows' triangular factor, for columns that are nearly dependent; None if they are."""
    v = [F.col("a"), F.lit(1.0), *design.z, design.y - design.offset]
    r = triangle(blocks(design.rows, v))
    used = np.append(active, True)
    r = np.linalg.qr(np.vstack([r, np.column_stack([np.sqrt(ridge), np.zeros(len(ridge))])])[:, used], mode="r")
    left, right = r[:-1, :-1], r[:-1, -1]
    if len(left) < used.sum() - 1 or root_inverse(left) is None:
        return None
    beta = np.zeros(len(active))
    beta[active] = np.linalg.solve(left, right)
    return beta


def descent(design: Design, fam: Family, l1: float, l2: float, tol: float, max_iter: int, rate: float | None) -> np.ndarray:
    """Accelerated proximal gradient descent; each step's gradient is summed over the rows where they lie."""
    d = len(design.z) + 1
    inner = fam.scaled(design.y_mean)
    columns = [design.y, design.offset, F.col("a"), *design.z]
    rows = blocks(design.rows, columns).persist(StorageLevel.MEMORY_AND_DISK)
    step = rate or (4 / (d + 4 * l2) if fam.name == "logistic" else 1 / (d + l2))
    total, free = design.total, np.array([0.0] + [1.0] * (d - 1))

    def run(found):
        def slope(beta):
            right, peak = gradient(found, inner, beta)
            return right / total, max(1.0, peak) if fam.log_link else 1.0

        return accelerated(slope, np.zeros(d), step, l1, l2, free, tol, max_iter, restart=True)

    try:
        beta = steps_over(gathered(rows, design.n * len(columns)), run)
    finally:
        rows.unpersist()
    beta[np.concatenate([[False], design.constant])] = 0.0
    return beta


def fit_levels(fam: Family, df: DataFrame, outcome: str, max_iter: int, tol: float, l2: float, offset_col: str | None, weights_col: str | None) -> DataFrame | None:
    """A model whose string column of most levels stays in tables, or None: too few levels, too many other features, or no
    single optimum that Newton's steps reach."""
    used_columns(df, outcome, offset_col, weights_col)
    left_out = [c for c in (outcome, offset_col, weights_col) if c]
    known = levels.counted_levels(df, texts) if (texts := text_columns(df, left_out)) else {}
    if len(known) < len(texts) or not known:
        return None
    own = max(known, key=lambda c: known[c][0])
    others = len(df.columns) - len(left_out) - len(texts) + sum(n - 1 for c, (n, _) in known.items() if c != own)
    if known[own][0] <= levels.LEVELS or others > levels.HEAD:
        return None
    narrow = encode_dummies(df, outcome, offset_col, weights_col, own)
    if len({c.lower() for c in narrow.columns}) < len(narrow.columns):
        return None
    head = [c for c in narrow.columns if c not in left_out and c != own]
    names = df.select(F.col(quoted(own)).cast("string").alias("v")).where("v is not null").distinct().where(F.col("v") != F.lit(known[own][1])).withColumn("feature", F.concat(F.lit(f"{own}_"), "v"))
    if head and names.where(F.col("feature").isin(head)).limit(1).count():
        raise ModelError("a level's column has the name of another column")
    design = Design(narrow, outcome, fam, offset_col, weights_col, carry=own, bare=True)
    try:
        if (found := levels.newton(design, fam, known[own][1], l2, tol, max_iter, bool(offset_col))) is None:
            return None
        beta, table_of_levels = found
        few = design.raw(beta, fam)
        scale = float(design.y_sd) if fam.identity else 1.0
        many = names.join(table_of_levels.hint("merge"), "v", "left").select("feature", (scale * F.coalesce("b", F.lit(0.0)) + 0.0).alias("coefficient"))
        return df.sparkSession.createDataFrame(list(few.items()), MODEL).union(many)
    finally:
        design.release()


def fit(fam: Family, source: DataFrame | str, outcome: str, max_iter: int = 50000, learning_rate: float | None = None, tol: float = 1e-10, l2: float = 0.0, offset_col: str | None = None, weights_col: str | None = None, l1: float = 0.0, solver: str = "auto", encode: bool = False) -> DataFrame:
    """``encode``: string columns enter as treatment contrasts, named as by ``encode_dummies``, without columns being made.
    Solver ``cg`` finds Newton steps by conjugate gradients; ``auto`` takes it for more than ``WIDE`` features or levels."""
    if not l2 >= 0:
        raise ModelError("l2 must be >= 0")
    if not l1 >= 0:
        raise ModelError("l1 must be >= 0")
    if solver not in ("auto", "gd", "irls", "cg"):
        raise ModelError("solver must be 'auto', 'gd' or 'irls', or 'cg' for wide designs")
    df = table(source)
    if encode and solver in ("auto", "cg") and l1 == 0 and (model := fit_levels(fam, df, outcome, max_iter, tol, l2, offset_col, weights_col)) is not None:
        return model
    if solver == "cg" or (encode and solver != "irls") or (solver == "auto" and len(df.columns) > WIDE):
        found = fit_wide(fam, df, outcome, max_iter, learning_rate, tol, l1, l2, offset_col, weights_col, encode, solver == "gd")
        return df.sparkSession.createDataFrame(list(found.items()), MODEL)
    if encode:
        df = encode_dummies(df, outcome, offset_col, weights_col)
    design = Design(df, outcome, fam, offset_col, weights_col)
    try:
        beta = None if solver == "gd" else irls(design, fam, l1, l2, tol, max_iter, solver == "irls")
        if beta is None and solver == "irls":
            raise ModelError("irls did not converge: the system is singular or the data are separated; use solver 'auto' or l2 > 0")
        if beta is None:
            beta = descent(design, fam, l1, l2, tol, max_iter, learning_rate)
        return df.sparkSession.createDataFrame(list(design.raw(beta, fam).items()), MODEL)
    finally:
        design.release()
