"""Fits of a string column with so many levels that they stay in tables: the driver holds the other coefficients only.

The Hessian between two levels of one column is zero. So each Newton step removes the levels from the system (their block
is diagonal), solves for the few other coefficients from sums over the levels, and each level's own step follows where its
row lies.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.families import COLUMNS, Family
from tessera.operators.gram import inverse
from tessera.operators.names import quoted
from tessera.sources import written

#: Columns with more levels are fitted here, if there are at most ``HEAD`` other features.
LEVELS = 400
HEAD = 20
#: A column of which the levels explain all but this share counts as dependent on them.
WITHIN = 1e-10
#: Newton's steps that may be taken and halvings of one.
STEPS, HALVINGS = 50, 40


def counted_levels(df: DataFrame, names: list[str]) -> dict[str, tuple[int, str]]:
    """The number of levels of each column and its lowest one."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(quoted(c)).cast("string").alias("v")) for i, c in enumerate(names)]))
    found = df.select(pairs.alias("p")).select("p.c", "p.v").where("v is not null").distinct().groupBy("c").agg(F.count("v"), F.min("v"))
    return {names[c]: (n, lowest) for c, n, lowest in found.collect()}


def merged(design, used: list[int], offset: bool) -> DataFrame:
    """Rows of one level, with equal features and offset, as one: every family's score is linear in the outcome, so that
    their weights' sum and their mean outcome give the same steps."""
    zs = [design.z[j].alias(f"z{k}") for k, j in enumerate(used)]
    rows = design.rows.where("a > 0").select(F.col("carried").alias("v"), "a", design.y.alias("y"), design.offset.alias("o"), *zs)
    keys = ["v", *(["o"] if offset else []), *[f"z{k}" for k in range(len(used))]]
    found = rows.groupBy(*keys).agg(F.sum("a").alias("a"), F.try_divide(F.sum(F.col("a") * F.col("y")), F.sum("a")).alias("y"))
    return written(found if offset else found.withColumn("o", F.lit(0.0)))


def newton(design, fam: Family, lowest: str, l2: float, tol: float, max_iter: int, offset: bool) -> tuple[np.ndarray, DataFrame] | None:
    """Standardized coefficients of the other features, and a table (v, b) of the levels' on the solver's scale. None where
    the steps do not settle or the system is singular."""
    inner = fam.scaled(design.y_mean)
    used = [j for j in range(len(design.z)) if not design.constant[j]]
    rows, q = merged(design, used, offset), len(used) + 1
    share = F.col("weight") / float(design.total)
    state = rows.groupBy("v").agg(F.sum("a").alias("weight")).select(
        "v", F.lit(0.0).alias("b"), F.lit(0.0).alias("step"), (float(design.total * l2) * share * (1.0 - share)).alias("lam"), ((F.col("v") == F.lit(lowest)) | ~(share * (1.0 - share) > 0)).alias("fixed")
    )
    ridge = design.total * l2 * np.array([0.0] + [1.0] * (q - 1))
    upper = [(j, k) for j in range(q) for k in range(j, q)]
    z = lambda j: F.col(f"z{j - 1}") if j else F.lit(1.0)
    theta, way = np.zeros(q), np.zeros(q)

    def seen(at: np.ndarray, pace: float) -> tuple[DataFrame, float]:
        """The levels moved by ``pace`` of their steps, with their sums there, and the loss."""
        moved = state.select("v", (F.col("b") + pace * F.col("step")).alias("b"), "lam", "fixed")
        eta = F.col("o") + float(at[0]) + F.col("b")
        for j in range(1, q):
            eta = eta + float(at[j]) * z(j)
        points = rows.join(moved.hint("merge"), "v").withColumn("mu", inner.mean(eta, COLUMNS))
        mu, y, a = F.col("mu"), F.col("y"), F.col("a")
        points = points.withColumns({"w": a * inner.information(mu, COLUMNS), "s": a * inner.score(y, mu, COLUMNS), "loss": a * inner.deviance(y, mu, COLUMNS) / 2.0})
        sums = [F.sum(F.col("w") * z(j) * z(k)).alias(f"a{j}_{k}") for j, k in upper] + [F.sum(F.col("s") * z(j)).alias(f"s{j}") for j in range(q)]
        table = written(points.groupBy("v", "b", "lam", "fixed").agg(F.sum("loss").alias("loss"), *sums))
        value = table.agg(F.sum(F.col("loss") + F.col("lam") * F.col("b") * F.col("b") / 2.0)).first()[0]
        return table, (np.nan if value is None else value) + float(ridge @ (at * at)) / 2

    now, loss = seen(theta, 0.0)
    for _ in range(min(max_iter, STEPS)):
        cross = lambda k: F.col(f"a0_{k}")
        own = F.col("a0_0") + F.col("lam")
        slope = F.col("s0") - F.col("lam") * F.col("b")
        over = lambda c: F.coalesce(F.try_divide(c, own), F.lit(0.0))
        left = lambda j, k: F.col("lam") * over(cross(k)) if j == 0 else F.col(f"a{j}_{k}") - cross(j) * over(cross(k))
        parts = [F.sum(F.when(F.col("fixed"), F.col(f"a{j}_{k}")).otherwise(left(j, k))) for j, k in upper]
        rights = [F.sum(F.col(f"s{j}") - F.when(F.col("fixed"), 0.0).otherwise(cross(j) * over(slope))) for j in range(q)]
        # of a level's own score nothing is left for the intercept but what the penalty holds back
        rights[0] = F.sum(F.when(F.col("fixed"), F.col("s0")).otherwise(F.col("s0") - slope + F.col("lam") * over(slope)))
        row = np.array(now.agg(*parts, *rights, *[F.sum(f"a{j}_{j}") for j in range(q)]).first(), float)
        system, right, whole = np.zeros((q, q)), row[len(upper) : len(upper) + q] - ridge * theta, row[len(upper) + q :]
        for (j, k), v in zip(upper, row[: len(upper)], strict=True):
            system[j, k] = system[k, j] = v
        system += np.diag(ridge)
        if not np.isfinite(row).all() or np.any(np.diag(system)[1:] <= WITHIN * whole[1:]) or (inv := inverse(system)) is None:
            return None
        way = inv @ right
        step = slope
        for k in range(q):
            step = step - float(way[k]) * cross(k)
        state = now.select("v", "b", F.when(F.col("fixed"), 0.0).otherwise(F.try_divide(step, own)).alias("step"), "lam", "fixed")
        lost, far = state.agg(F.count(F.when(F.col("step").isNull() | F.isnan("step"), 1)), F.max(F.abs("step"))).first()
        moved = max(float(np.abs(way).max()), far or 0.0)
        if lost or not np.isfinite(moved):
            return None
        if fam.identity or moved < tol:
            put = np.zeros(len(design.z) + 1)
            put[[0, *[j + 1 for j in used]]] = theta + way
            return put, state.select("v", (F.col("b") + F.col("step")).alias("b"))
        pace = 1.0
        for _ in range(HALVINGS):
            nearer, value = seen(theta + pace * way, pace)
            if np.isfinite(value) and value <= loss + 1e-12 * abs(loss):
                break
            pace /= 2
        else:
            return None
        theta, now, loss = theta + pace * way, nearer, value
    return None
