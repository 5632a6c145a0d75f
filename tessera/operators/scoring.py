"""Prediction (a lazy projection) and goodness of fit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.distributions import lgamma
from tessera.operators.families import COLUMNS, Family, ModelError, family
from tessera.operators.fitting import INTERCEPT, check_names, number
from tessera.sources import table


def coefficients(model: DataFrame | str) -> dict[str, float]:
    """A model table has one row for each feature; it is read to the driver."""
    found = {r["feature"]: r["coefficient"] for r in table(model).select("feature", "coefficient").collect()}
    return {INTERCEPT: found.pop(INTERCEPT, 0.0), **dict(sorted(found.items()))}


def predictor(model: dict[str, float], df: DataFrame, offset_col: str | None = None) -> Column:
    """The linear predictor; NULL where a feature or the offset is NULL, missing or no number."""
    eta = F.lit(float(model[INTERCEPT]))
    if offset_col:
        eta = eta + (number(df, offset_col, lenient=True) if offset_col in df.columns else F.lit(None).cast("double"))
    for name, value in model.items():
        if name != INTERCEPT:
            eta = eta + float(value) * (number(df, name, lenient=True) if name in df.columns else F.lit(None).cast("double"))
    return eta


def predict(fam: Family | str, model: DataFrame | str, source: DataFrame | str, threshold: float = 0.5, offset_col: str | None = None) -> DataFrame:
    fam = family(fam) if isinstance(fam, str) else fam
    df = table(source)
    check_names(df, [])
    taken = {c.lower() for c in df.columns}
    if fam.name == "logistic" and taken & {"prob", "pred"}:
        raise ModelError('the table already has a "prob" or "pred" column')
    if fam.name != "logistic" and "prediction" in taken:
        raise ModelError('the table already has a "prediction" column')
    mean = fam.mean(predictor(coefficients(model), df, offset_col), COLUMNS, clamp=False)
    if fam.name == "logistic":
        return df.withColumn("prob", mean).withColumn("pred", F.col("prob") >= threshold)
    return df.withColumn("prediction", mean)


def evaluate(fam: Family, model: DataFrame | str, source: DataFrame | str, outcome: str, offset_col: str | None = None) -> DataFrame:
    """One row of metrics. The null model is the mean outcome and ignores the offset."""
    df = table(source)
    beta = coefficients(model)
    k = len(beta)
    rows = df.select(number(df, outcome, lenient=True).alias("y"), fam.mean(predictor(beta, df, offset_col), COLUMNS, clamp=False).alias("mu")).dropna()
    y, mu = F.col("y"), F.col("mu")
    first = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
    n, mean = first["n"], first["mean"]
    if not n:
        raise ModelError("no rows with a non-NULL prediction and outcome")
    null = F.lit(float(mean))
    sums = {"sse": (y - mu) * (y - mu), "sae": F.abs(y - mu), "sst": (y - null) * (y - null)}
    if fam.name == "logistic":
        p = F.least(F.greatest(mu, F.lit(1e-15)), F.lit(1 - 1e-15))
        sums |= {"ll": y * F.log(p) + (1.0 - y) * F.log(1.0 - p), "right": ((mu >= 0.5).cast("double") == y).cast("double"), "ones": y}
    elif not fam.identity:
        sums["dev"] = fam.deviance(y, mu, COLUMNS)
        sums["null_dev"] = fam.deviance(y, null, COLUMNS) if mean > 0 else F.lit(0.0)
        sums["pearson"] = (y - mu) * (y - mu) / fam.variance(mu, COLUMNS)
    if fam.name == "poisson":
        sums["ll"] = y * F.log(mu) - mu - lgamma(y + 1.0)
    if fam.name == "nbinom":
        r = 1.0 / fam.extra
        sums["ll"] = lgamma(y + r) - math.lgamma(r) - lgamma(y + 1.0) + r * F.log(r / (r + mu)) + y * F.log(mu / (r + mu))
    s = rows.agg(*[F.sum(v).alias(c) for c, v in sums.items()]).first().asDict()
    ratio = lambda a, b: a / b if b else None
    out: dict = {"n": int(n)}
    ll = s.get("ll")
    if fam.identity:
        r2 = 1 - s["sse"] / s["sst"] if s["sst"] else None
        ll = -n / 2 * (math.log(2 * math.pi) + math.log(s["sse"] / n) + 1) if s["sse"] > 0 else None
        adjusted = 1 - (s["sse"] / (n - k)) / (s["sst"] / (n - 1)) if s["sst"] and n > k else None
        out |= {"rmse": math.sqrt(s["sse"] / n), "mae": s["sae"] / n, "r2": r2, "adj_r2": adjusted}
    elif fam.name == "logistic":
        ll0 = n * (mean * math.log(mean) + (1 - mean) * math.log(1 - mean)) if 0 < mean < 1 else None
        out |= {"accuracy": s["right"] / n, "auc": auc(rows, int(s["ones"]), n), "log_loss": -ll / n}
        out |= {"loglik": ll, "deviance": -2 * ll, "null_deviance": None if ll0 is None else -2 * ll0, "pseudo_r2": 1 - ll / ll0 if ll0 else None}
    else:
        out |= {"rmse": math.sqrt(s["sse"] / n), "mae": s["sae"] / n}
        if ll is not None:
            out["loglik"] = ll
        fit = ratio(s["dev"], s["null_dev"])
        out |= {"deviance": s["dev"], "null_deviance": s["null_dev"], "pseudo_r2": None if fit is None else 1 - fit}
        if fam.name != "poisson":
            out["dispersion"] = ratio(s["pearson"], n - k) if n > k else None
    if fam.identity:
        out["loglik"] = ll
    if fam.name in ("linear", "logistic", "poisson", "nbinom"):
        out |= {"aic": None if ll is None else -2 * ll + 2 * k, "bic": None if ll is None else -2 * ll + k * math.log(n)}
    return df.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in out))


def auc(rows: DataFrame, ones: int, n: int) -> float | None:
    """Mann-Whitney statistic with average ranks. Scores are counted first; running counts are taken within ranges of
    scores, and the ranges' totals are added, so no task sees all scores."""
    if not 0 < ones < n:
        return None
    by_score = rows.groupBy("mu").agg(F.count("*").alias("c"), F.sum("y").alias("pos")).repartitionByRange("mu").withColumn("part", F.spark_partition_id())
    by_score = by_score.withColumn("before", F.sum("c").over(Window.partitionBy("part").orderBy("mu")) - F.col("c")).persist()
    try:
        parts = by_score.groupBy("part").agg(F.min("mu").alias("low"), F.sum("c").alias("c"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * (F.col("before") + (F.col("c") + 1) / 2)).alias("ranks")).collect()
    finally:
        by_score.unpersist()
    total = base = 0.0
    for p in sorted(parts, key=lambda p: p["low"]):
        total, base = total + p["ranks"] + p["pos"] * base, base + p["c"]
    return (total - ones * (ones + 1) / 2) / (ones * (n - ones))
