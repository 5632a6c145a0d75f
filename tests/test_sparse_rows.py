"""Wide rows that are mostly 0 are kept, and passed over, without their zeros."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import api, wide
from tessera.operators.families import family


def mostly_zero(spark, columns=40, gaps=False):
    df = spark.range(2000).selectExpr("cast(id % 41 as int) as g", "cast(1 + id % 3 as double) as a", "1.0D + id % 41 + id % 5 as y", "id")
    x = [F.when(F.col("g") == k, 0.5 + F.col("id") % 7).otherwise(0.0).alias(f"x{k:02d}") for k in range(columns)]
    if gaps:
        x[3] = F.when(F.col("id") % 50 == 1, None).otherwise(x[3]).alias("x03")
        x[4] = F.when(F.col("id") % 60 == 1, float("nan")).otherwise(x[4]).alias("x04")
    return df.select("y", "a", *x)


def test_zeros_are_not_kept(spark):
    design = wide.WideDesign(mostly_zero(spark), "y", family("linear"), weights_col="a")
    try:
        kept = design.rows.map(lambda r: len(r[0])).sum()
    finally:
        design.release()
    assert kept < 2000 * 43 * 8 / 4


@pytest.mark.parametrize("gaps", (False, True))
@pytest.mark.parametrize("kind", ("linear", "gamma"))
def test_rows_without_their_zeros_give_the_same(spark, monkeypatch, kind, gaps):
    df = mostly_zero(spark, gaps=gaps)
    found = []
    for most in (wide.SPARSE, -1.0):  # below 0 every block keeps all values
        monkeypatch.setattr(wide, "SPARSE", most)
        design = wide.WideDesign(df, "y", family(kind), weights_col="a")
        try:
            widths = {r[1] for r in design.rows.map(lambda r: (0, r[1])).collect()}
            found.append((widths, design.n, design.total, design.mean, design.sd, design.constant, design.y_sd, design.newton(0.1, 1e-12, 100)))
        finally:
            design.release()
    (few, *sparse), (all_, *dense) = found
    assert few == {-43} and all_ == {43}
    for s, d in zip(sparse, dense, strict=True):
        assert np.asarray(s, float) == pytest.approx(np.asarray(d, float), rel=1e-9, abs=1e-9)


def test_columns_far_from_zero_beside_sparse_ones_keep_their_digits(spark):
    df = mostly_zero(spark).drop("a").withColumn("far", 1e7 + F.col("y") % 11)
    found, want = (dict(map(tuple, api.linreg_fit(df, "y", solver=s, l2=0.01).collect())) for s in ("cg", "irls"))
    assert found == pytest.approx(want, rel=1e-5, abs=1e-5)
