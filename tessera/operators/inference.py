"""Coefficient inference, confidence bands of the mean, and influence diagnostics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import normal_cdf, normal_ppf, student_ppf, student_tail
from tessera.operators.families import COLUMNS, Family, ModelError
from tessera.operators.fitting import INTERCEPT, number, quoted
from tessera.operators.gram import blocks, cross, inverse, root_inverse, triangle
from tessera.operators.scoring import coefficients, predictor
from tessera.sources import free_prefix, table

SUMMARY = "feature string, coefficient double, std_error double, statistic double, p_value double, conf_low double, conf_high double"
ROBUST = ("none", "hc0", "hc1", "hc2", "hc3")


def quadratic(xs: list[Column], matrix: np.ndarray) -> Column:
    """x'Mx for the design row (1, xs)."""
    full = [None, *xs]
    total = F.lit(float(matrix[0, 0]))
    for i in range(len(full)):
        for j in range(max(i, 1), len(full)):
            v = float(matrix[i, j]) * (1 if i == j else 2)
            total = total + (v * full[j] if i == 0 else v * full[i] * full[j])
    return total


def _level(conf_level: float) -> None:
    if not 0 < conf_level < 1:
        raise ModelError("conf_level must be between 0 and 1")


class Fitted:
    """A model beside the complete rows of a table: y, mu, sample weight (NULL counts as 1) and the features."""

    def __init__(self, fam: Family, model, source, outcome: str, offset_col: str | None, weights_col: str | None, cluster_col: str | None = None):
        self.df, self.fam, self.beta = table(source), fam, coefficients(model)
        for what, c in (("outcome", outcome), ("offset", offset_col), ("weights", weights_col), ("cluster", cluster_col)):
            if c and c not in self.df.columns:
                raise ModelError(f'{what} column "{c}" not found')
        self.names = [c for c in self.beta if c != INTERCEPT]
        weight = F.coalesce(number(self.df, weights_col, lenient=True), F.lit(1.0)) if weights_col else F.lit(1.0)
        own = free_prefix(self.df)
        made = {f"{own}y": number(self.df, outcome, lenient=True), f"{own}mu": fam.mean(predictor(self.beta, self.df, offset_col), COLUMNS), f"{own}a": weight}
        made |= {f"{own}x{i}": number(self.df, c, lenient=True) if c in self.df.columns else F.lit(None).cast("double") for i, c in enumerate(self.names)}
        self.made = [*made]
        if cluster_col:
            made[f"{own}c"] = F.col(quoted(cluster_col))
        self.rows = self.df.withColumns(made).dropna(subset=self.made)
        self.cluster, self.xs = f"{own}c", [F.col(f"{own}x{i}") for i in range(len(self.names))]
        self.y, self.mu, self.a = (F.col(f"{own}{c}") for c in ("y", "mu", "a"))
        self.d = len(self.names) + 1
        # products are summed of centred features: those of a column far from zero would leave no digits
        means = self.rows.agg(*[F.avg(x) for x in self.xs]).first() if self.names else ()
        self.mean = np.array([0.0 if m is None else m for m in means])
        self.xs = [x - float(m) for x, m in zip(self.xs, self.mean, strict=True)]
        pearson = self.a * (self.y - self.mu) * (self.y - self.mu) / fam.variance(self.mu, COLUMNS)
        weights = [self.a * fam.information(self.mu, COLUMNS), self.a * fam.observed(self.y, self.mu, COLUMNS)]
        (self.expected, self.observed), _, (self.n, chi) = cross(self.rows, self.xs, weights, [], [F.lit(1.0), pearson])
        self.free = self.n - self.d
        self.phi = (chi / self.free if self.free > 0 else None) if fam.estimated else 1.0

    def critical(self, conf_level: float, always_normal: bool = False) -> float:
        p = (1 + conf_level) / 2
        return student_ppf(p, self.free) if self.fam.estimated and self.free > 0 and not always_normal else normal_ppf(p)

    def uncentred(self, cov: np.ndarray | None) -> np.ndarray | None:
        """The covariance of the coefficients of the features themselves."""
        if cov is None:
            return None
        back = np.eye(self.d)
        back[0, 1:] = -self.mean
        return back @ cov @ back.T

    def covariance(self) -> np.ndarray | None:
        inv = self.inverted(self.expected, self.a * self.fam.information(self.mu, COLUMNS))
        return None if inv is None or self.phi is None else self.phi * inv

    def inverted(self, gram: np.ndarray, weight: Column) -> np.ndarray | None:
        """The inverse of X'WX; where too few of its digits are left, from the triangular factor of the rows."""
        inv = inverse(gram)
        if inv is not None or not self.n or np.any(~(np.diag(gram) > 0)):
            return inv
        r = triangle(blocks(self.rows, [F.greatest(weight, F.lit(0.0)), F.lit(1.0), *self.xs]))
        return root_inverse(r) if len(r) == self.d else None

    def sandwich(self, robust: str, clustered: bool) -> np.ndarray | None:
        bread = self.inverted(self.observed, self.a * self.fam.observed(self.y, self.mu, COLUMNS))
        if bread is None or self.free <= 0:
            return None
        score = self.fam.score(self.y, self.mu, COLUMNS)
        if clustered:
            sums = self.rows.groupBy(self.cluster).agg(*[F.sum(self.a * score * (x if i else 1.0)).alias(f"_g{i}") for i, x in enumerate([F.lit(1.0), *self.xs])])
            pairs = [(i, j) for i in range(self.d) for j in range(i, self.d)]
            row = sums.agg(F.count("*"), *[F.sum(F.col(f"_g{i}") * F.col(f"_g{j}")) for i, j in pairs]).first()
            meat = np.zeros((self.d, self.d))
            for (i, j), v in zip(pairs, row[1:], strict=True):
                meat[i, j] = meat[j, i] = v
            if row[0] < 2:
                return None
            return bread @ meat @ bread * (row[0] / (row[0] - 1)) * ((self.n - 1) / self.free)
        weight = self.a * score * score
        if robust in ("hc2", "hc3"):
            left = 1.0 - self.a * self.fam.observed(self.y, self.mu, COLUMNS) * quadratic(self.xs, bread)
            weight = F.when(left > 0, weight / (left if robust == "hc2" else left * left))
        (meat,), _, _ = cross(self.rows, self.xs, [weight], [])
        return bread @ meat @ bread * (self.n / self.free if robust == "hc1" else 1.0)


def summary(fam: Family, model, source, outcome: str, conf_level: float = 0.95, offset_col: str | None = None, weights_col: str | None = None, robust: str = "none", cluster_col: str | None = None) -> DataFrame:
    """Any type may identify clusters; NULL is a cluster of its own. Zero weights leave robust errors finite."""
    if robust not in ROBUST:
        raise ModelError(f"robust must be one of {', '.join(ROBUST)}")
    _level(conf_level)
    f = Fitted(fam, model, source, outcome, offset_col, weights_col, cluster_col)
    plain = robust == "none" and not cluster_col
    cov = f.uncentred(f.covariance() if plain else f.sandwich(robust, bool(cluster_col)))
    crit = f.critical(conf_level, not plain)
    use_t = plain and fam.estimated and f.free > 0
    rows = []
    for i, (name, b) in enumerate(f.beta.items()):
        v = cov[i, i] if cov is not None else math.nan
        se = math.sqrt(v) if math.isfinite(v) and v > 0 else None
        z = b / se if se else None
        p = None if z is None else 2 * (student_tail(abs(z), f.free) if use_t else normal_cdf(-abs(z)))
        values = (b, se, z, p, None if se is None else b - crit * se, None if se is None else b + crit * se)
        rows.append((name, *(None if v is None else float(v) for v in values)))
    return f.df.sparkSession.createDataFrame(rows, SUMMARY)


def predict_ci(fam: Family, model, source, outcome: str, newdata=None, conf_level: float = 0.95, offset_col: str | None = None, weights_col: str | None = None) -> DataFrame:
    _level(conf_level)
    f = Fitted(fam, model, source, outcome, offset_col, weights_col)
    df = f.df if newdata is None else table(newdata)
    if clash := {c.lower() for c in df.columns} & {"prediction", "conf_low", "conf_high"}:
        raise ModelError(f'the table already has a "{min(clash)}" column')
    cov, eta = f.covariance(), predictor(f.beta, df, offset_col)
    xs = [(number(df, c, lenient=True) if c in df.columns else F.lit(None).cast("double")) - float(m) for c, m in zip(f.names, f.mean, strict=True)]
    reach = F.lit(None).cast("double") if cov is None else f.critical(conf_level) * F.sqrt(F.greatest(quadratic(xs, cov), F.lit(0.0)))
    own = free_prefix(df)
    out, at, by = df.withColumns({f"{own}eta": eta, f"{own}reach": reach}), F.col(f"{own}eta"), F.col(f"{own}reach")
    mean = lambda e: fam.mean(e, COLUMNS, clamp=False)
    return out.withColumns({"prediction": mean(at), "conf_low": mean(at - by), "conf_high": mean(at + by)}).drop(f"{own}eta", f"{own}reach")


def influence(fam: Family, model, source, outcome: str, offset_col: str | None = None, weights_col: str | None = None) -> DataFrame:
    f = Fitted(fam, model, source, outcome, offset_col, weights_col)
    added = ("hat", "pearson_resid", "deviance_resid", "std_resid", "cooks_distance")
    if clash := {c.lower() for c in f.df.columns} & {*added}:
        raise ModelError(f'the table already has a "{min(clash)}" column')
    bread = inverse(f.observed)
    null = F.lit(None).cast("double")
    hat = null if bread is None else f.a * fam.observed(f.y, f.mu, COLUMNS) * quadratic(f.xs, bread)
    out = f.rows.withColumn("hat", hat)
    out = out.withColumn("pearson_resid", (f.y - f.mu) * F.sqrt(f.a) / F.sqrt(fam.variance(f.mu, COLUMNS)))
    out = out.withColumn("deviance_resid", F.signum(f.y - f.mu) * F.sqrt(f.a * F.greatest(fam.deviance(f.y, f.mu, COLUMNS), F.lit(0.0))))
    left, phi = 1.0 - F.col("hat"), f.phi
    ok = (F.col("hat") < 1) if phi else F.lit(False)
    out = out.withColumn("std_resid", F.when(ok, F.col("pearson_resid") / F.sqrt((phi or 1.0) * left)))
    cooks = F.col("pearson_resid") * F.col("pearson_resid") / (phi or 1.0) * F.col("hat") / (f.d * left * left)
    return out.withColumn("cooks_distance", F.when(ok, cooks)).drop(*f.made)
