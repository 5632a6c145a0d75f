"""Registered model queries against SQL, and the public functions against numpy on the fixed inputs."""

import re

import numpy as np
import pytest

from tessera.functions import distributions
from tessera.operators import api, fitting, selection
from tessera.operators.families import family
from tessera.plans import registry
from tessera.streaming import score_stream

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, same_as_sql, name):
    same_as_sql(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_give_finite_rows(spark, name):
    out = registry.QUERIES[name](spark, SMALL).toPandas()
    assert len(out)
    assert np.isfinite(out.select_dtypes("number").to_numpy(float)).all()


@pytest.fixture(scope="module")
def lin(spark):
    return spark.range(200).selectExpr("cast(id as double) as x1", "cast(id % 7 - 3 as double) as x2", "2.0D + 3 * id - (id % 7 - 3) as y")


def _coefficients(model):
    return {r["feature"]: r["coefficient"] for r in model.collect()}


def test_linear_fit_is_exact(lin):
    found = _coefficients(api.linreg_fit(lin, "y"))
    assert found["(Intercept)"] == pytest.approx(2, abs=1e-6)
    assert found["x1"] == pytest.approx(3, abs=1e-6)
    assert found["x2"] == pytest.approx(-1, abs=1e-6)


def test_constant_column_gets_zero(lin):
    assert _coefficients(api.linreg_fit(lin.selectExpr("*", "4.2D as c"), "y"))["c"] == 0.0


def test_ridge_shrinks_and_lasso_drops(spark, lin):
    assert abs(_coefficients(api.linreg_fit(lin, "y", l2=5.0))["x1"]) < 3
    noisy = spark.range(300).selectExpr("cast(id as double) as x1", "cast((7 * id + 3) % 13 as double) as noise", "2.0D + 3 * id as y")
    found = _coefficients(api.linreg_fit(noisy, "y", l1=0.3))
    assert found["noise"] == 0.0 and found["x1"] != 0.0


def test_poisson_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = rng.poisson(np.exp(0.5 + x @ [0.7, -0.4]))
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x1 double, x2 double, y double")
    design, beta = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(50):
        mu = np.exp(design @ beta)
        beta += np.linalg.solve((design.T * mu) @ design, design.T @ (y - mu))
    found = _coefficients(api.poisson_fit(df, "y"))
    assert [found[c] for c in ("(Intercept)", "x1", "x2")] == pytest.approx(beta.tolist(), abs=1e-6)
    errors = np.sqrt(np.diag(np.linalg.inv((design.T * np.exp(design @ beta)) @ design)))
    table = {r["feature"]: r["std_error"] for r in api.poisson_summary(api.poisson_fit(df, "y"), df, "y").collect()}
    assert [table[c] for c in ("(Intercept)", "x1", "x2")] == pytest.approx(errors.tolist(), rel=1e-5)


@pytest.mark.parametrize("kind", ("logit", "poisson"))
def test_descent_leaves_the_rows_where_they_are(spark, monkeypatch, kind):
    from pyspark.sql.classic.dataframe import DataFrame

    y = {"logit": "cast(pmod(hash(id), 10) < 3 + id % 4 as double)", "poisson": "cast(pmod(hash(id), 3) + id % 4 as double)"}[kind]
    df = spark.range(30000).repartition(3).selectExpr("cast(id % 4 as double) as x1", "cast(pmod(hash(id, 7), 11) as double) as x2", "0.5 * (id % 3) as o", f"{y} as y")
    fit = {"logit": api.logit_fit, "poisson": api.poisson_fit}[kind]
    exact = _coefficients(fit(df, "y", solver="irls", offset_col="o"))
    monkeypatch.setattr(fitting, "LOCAL_CELLS", 1000, raising=False)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    assert _coefficients(fit(df, "y", solver="gd", offset_col="o")) == pytest.approx(exact, abs=1e-6)


def test_multinomial_probabilities(spark):
    df = spark.range(150).selectExpr("cast(id as double) as x1", "cast(id % 3 as int) as y")
    model = api.multinom_fit(df, "y")
    out = api.multinom_predict(model, df).selectExpr("aggregate(map_values(probs), 0.0D, (a, b) -> a + b) as s").collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in out)


def test_folds_follow_the_key_over_several_ranges(spark):
    # two jobs over the ranges coalesce them differently: one reads the key alone, the other all columns
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {c: spark.conf.get(c) for c in sizes}
    df = spark.range(40000).selectExpr("(id * 7919) % 40000 as key", "cast((id * 7919) % 40000 as double) as y", *[f"rand({i}) as x{i}" for i in range(4)])
    try:
        for c, v in sizes.items():
            spark.conf.set(c, v)
        p = selection._Prepared(df, "y", family("linear"), 5, "key", None)
        found = p.rows.select("y", "fold").toPandas()
        p.rows.unpersist()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(found) == 40000
    rank = np.rint(found["y"].to_numpy() * p.design.y_sd + p.design.y_mean)
    assert (found["fold"].to_numpy() == rank % 5).all()


def test_null_rows_are_left_out(spark, lin):
    extra = lin.union(spark.createDataFrame([(None, 1.0, 5.0), (1.0, 1.0, None)], "x1 double, x2 double, y double"))
    assert _coefficients(api.linreg_fit(extra, "y"))["x1"] == pytest.approx(3, abs=1e-6)


@pytest.fixture(scope="module")
def counts(spark):
    return spark.range(300).selectExpr("cast(id % 9 as double) as x1", "cast((id * 7) % 11 as double) as x2", "0.1 * (id % 4) as off", "cast((id % 7) * (1 + id % 3) as double) as y")


@pytest.mark.parametrize(("kind", "extra"), [("nbinom", "alpha"), ("tweedie", "power")])
def test_named_parameters_keep_the_positional_ones(counts, kind, extra):
    f = {t: getattr(api, f"{kind}_{t}") for t in ("fit", "evaluate", "summary", "predict_ci", "influence")}
    model, table = f["fit"](counts, "y", **{extra: 1.4}, offset_col="off"), lambda df: sorted(map(tuple, df.collect()))
    assert table(model) == table(f["fit"](counts, "y", 1.4, offset_col="off")) == table(f["fit"](counts, "y", 50000, None, 1e-10, 0.0, "off", **{extra: 1.4}))
    assert table(f["evaluate"](model, counts, "y", "off", **{extra: 1.4})) == table(f["evaluate"](model, counts, "y", 1.4, "off")) != table(f["evaluate"](model, counts, "y", 1.4))
    assert table(f["summary"](model, counts, "y", 0.9, "off", **{extra: 1.4})) == table(f["summary"](model, counts, "y", 1.4, 0.9, offset_col="off"))
    assert table(f["predict_ci"](model, counts, "y", None, 0.9, "off", **{extra: 1.4})) == table(f["predict_ci"](model, counts, "y", None, 1.4, 0.9, "off"))
    assert table(f["influence"](model, counts, "y", "off", **{extra: 1.4})) == table(f["influence"](model, counts, "y", 1.4, "off"))


def test_user_columns_survive(spark, counts):
    names = ["_y", "_mu", "_a", "_x0", "_c", "_eta", "_reach", "_p", "_t", "_fold", "_part", "_row"]
    wide = counts.drop("off").selectExpr("*", *[f"x1 + {i} as {c}" for i, c in enumerate(names)])
    model = api.poisson_fit(counts.drop("off"), "y")
    for out in (api.poisson_influence(model, wide, "y"), api.poisson_predict_ci(model, wide, "y"), api.poisson_predict(model, wide)):
        assert wide.columns == out.columns[: len(wide.columns)]
        assert out.where(" or ".join(f"{c} <> x1 + {i}" for i, c in enumerate(names))).isEmpty()
    classes = counts.selectExpr("x1", "cast(y % 3 as int) as k")
    out = api.multinom_predict(api.multinom_fit(classes, "k"), wide)
    assert out.where("_p <> x1 + 7").isEmpty() and wide.columns == out.columns[: len(wide.columns)]
    assert api.cv_l2(wide.selectExpr("y", "x1", "x2", "_t", "x2 * x2 as _fold", "x1 * x1 as _row"), "y", "poisson", [0.1]).count() == 1


def test_folds_without_a_key_follow_physical_order(spark):
    df = spark.range(0, 10007, numPartitions=7).selectExpr("cast(id as double) as y", "rand(1) as x")
    p = selection._Prepared(df, "y", family("linear"), 5, None, None)
    found = p.rows.select("y", "fold").toPandas()
    p.rows.unpersist()
    assert (found["fold"].to_numpy() == np.rint(found["y"].to_numpy() * p.design.y_sd + p.design.y_mean) % 5).all()


def test_separated_folds_fall_back_to_descent(spark, monkeypatch):
    df = spark.range(200).selectExpr("id", "cast(id as double) as x", "cast(id >= 100 as double) as y")
    taken, descend = [], selection._descend
    monkeypatch.setattr(selection, "_descend", lambda *a: taken.append(1) or descend(*a))
    found = api.cv_l2(df, "y", "logistic", [0.0], 2, 60, order_by="id").collect()
    assert len(found) == 1 and 0 <= found[0]["cv_deviance"] < 0.2
    wide = api.cv_l2(df.selectExpr("id", "x", "x as x_again", "y"), "y", "logistic", [0.5], 2, order_by="id").collect()
    assert np.isfinite(wide[0]["cv_deviance"])


def test_descent_matches_newton_in_folds(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 9 as double) as x1", "cast((id * 7) % 11 as double) as x2", "cast((id % 5 + id % 3) as double) as y")
    p = selection._Prepared(df, "y", family("poisson"), 4, "id", None)
    fams, folds, zero = [family("poisson")] * 8, [0, 1, 2, 3] * 2, [0.0] * 8
    l2 = [0.0] * 4 + [0.2] * 4
    newton = selection._solve(p.rows, fams, folds, zero, l2, 3, p.active, 1e-10, 50)
    steps = selection._descend(p.rows, fams, folds, zero, l2, p.active, 1e-9, 400, None)
    p.rows.unpersist()
    assert steps == pytest.approx(newton, abs=1e-5)


@pytest.mark.parametrize("kind", ("logit", "linreg", "poisson", "gamma", "tweedie", "nbinom"))
def test_three_features_match_numpy(spark, kind):
    """Scoring steps in numpy on raw columns, with a ridge in the scale of standardized ones left out."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)) * [3, 0.5, 4] + [2, -1, 10]
    eta = 0.3 + 0.1 * x[:, 0] - 0.4 * x[:, 1] + 0.02 * x[:, 2]
    mu = np.exp(eta)
    y = {"logit": (rng.random(600) < 1 / (1 + np.exp(-eta))) * 1.0, "linreg": eta + rng.normal(size=600), "poisson": rng.poisson(mu), "gamma": rng.gamma(2, mu / 2), "tweedie": np.where(rng.random(600) < 0.3, 0, rng.gamma(2, mu / 2)), "nbinom": rng.poisson(rng.gamma(1, mu))}[kind]
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x1 double, x2 double, x3 double, y double")
    design, beta = np.column_stack([np.ones(600), x]), np.zeros(4)
    if kind not in ("logit", "linreg"):
        beta[0] = np.log(y.mean())
    for _ in range(60):
        e = design @ beta
        m = e if kind == "linreg" else 1 / (1 + np.exp(-e)) if kind == "logit" else np.exp(e)
        root = np.sqrt(np.abs(m) + 1e-300)
        w = {"logit": m * (1 - m), "linreg": 1 + 0 * m, "poisson": m, "gamma": 1 + 0 * m, "tweedie": root, "nbinom": m / (1 + m)}[kind]
        r = {"logit": y - m, "linreg": y - m, "poisson": y - m, "gamma": y / (m + 1e-300) - 1, "tweedie": (y - m) / root, "nbinom": (y - m) / (1 + m)}[kind]
        beta = beta + np.linalg.solve((design.T * w) @ design, design.T @ r)
    found = _coefficients(getattr(api, f"{kind}_fit")(df, "y"))
    assert [found[c] for c in ("(Intercept)", "x1", "x2", "x3")] == pytest.approx(beta.tolist(), abs=1e-6)


def test_lasso_meets_its_conditions(spark):
    """At the optimum the gradient is at most the threshold, and equal to it with the coefficient's sign where that is not 0."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 4))
    x[:, 3] = 0.9 * x[:, 0] + 0.1 * x[:, 3]
    y = 1.5 * x[:, 0] - x[:, 1] + rng.normal(size=500)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x0 double, x1 double, x2 double, x3 double, y double")
    found = _coefficients(api.linreg_fit(df, "y", l1=0.05))
    z, t = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    b = np.array([found[f"x{i}"] for i in range(4)]) * x.std(0) / y.std()
    slope = z.T @ (t - z @ b) / 500
    assert (np.abs(slope) <= 0.05 + 1e-6).all() and np.allclose(slope[b != 0], 0.05 * np.sign(b[b != 0]), atol=1e-6)
    assert (b == 0).any()


@pytest.mark.parametrize(("call", "phrase"), [
    (lambda t: api.logit_fit(t, "y"), "binary"), (lambda t: api.gamma_fit(t, "y"), "strictly positive"), (lambda t: api.linreg_fit(t, "nope"), "not found, entirely NULL"), (lambda t: api.linreg_fit(t, "y", l2=-1), "l2 must be >= 0"),
    (lambda t: api.linreg_fit(t, "y", l1=-1), "l1 must be >= 0"), (lambda t: api.linreg_fit(t, "y", solver="x"), "solver must be"), (lambda t: api.linreg_fit(t, "y", offset_col="o"), "offset column"), (lambda t: api.linreg_fit(t, "y", weights_col="w"), "weights column"),
    (lambda t: api.tweedie_fit(t, "y", power=0.5), "power must be >= 1"), (lambda t: api.nbinom_fit(t, "y", alpha=0), "alpha (dispersion) must be > 0"), (lambda t: api.cv_l2(t, "y", "linear", []), "grid must be non-empty"), (lambda t: api.cv_l2(t, "y", "linear", [0.1], 1), "k must be >= 2"),
    (lambda t: api.cv_l2(t, "y", "cauchy", [0.1]), "unsupported family"), (lambda t: api.linreg_fit(t.selectExpr("y", "x1 as __reg_x"), "y"), "reserved"), (lambda t: api.linreg_fit(t.selectExpr("y", "cast(null as double) as x"), "y"), "entirely NULL"),
    (lambda t: api.multinom_fit(t.selectExpr("1 as y", "x1"), "y"), "at least 2 distinct classes"), (lambda t: api.linreg_summary(api.linreg_fit(t, "y"), t, "y", 2.0), "conf_level"), (lambda t: api.linreg_summary(api.linreg_fit(t, "y"), t, "y", robust="hc9"), "robust must be"),
])
def test_errors_say_what_is_wrong(counts, call, phrase):
    with pytest.raises(ValueError, match=re.escape(phrase)):
        call(counts.drop("off"))


def test_errors_are_value_errors(spark, lin):
    with pytest.raises(ValueError):
        api.linreg_fit(lin, "missing")
    with pytest.raises(ValueError):
        api.linreg_fit(lin.select("y"), "y")
    with pytest.raises(ValueError):
        api.linreg_fit(lin.limit(0), "y")


def test_stream_scoring(spark, lin, tmp_path):
    model = api.linreg_fit(lin, "y")
    lin.write.parquet(str(tmp_path / "in"))
    stream = score_stream(model, spark.readStream.schema(lin.schema).parquet(str(tmp_path / "in")), "linear")
    query = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("scored").collect()
    assert len(rows) == 200 and all(abs(r["prediction"] - r["y"]) < 1e-6 for r in rows)


def test_distributions_keep_nulls_and_ends(spark):
    df = spark.createDataFrame([(0.0, 3.0), (1.0, 3.0), (None, 3.0), (0.5, None), (0.5, 3.0), (-1.0, 3.0)], "p double, df double")
    for found in ([r["v"] for r in df.select(f.alias("v")).collect()] for f in (distributions.norm_ppf(df["p"]), distributions.t_ppf(df["p"], df["df"]))):
        assert found[0] == -np.inf and found[1] == np.inf and found[2] is None and found[4] == 0 and found[5] is None
    assert df.select(distributions.t_cdf(df["p"], df["df"]).alias("v")).where("v is null").count() == 2


def test_distributions_invert(spark):
    p = spark.createDataFrame([(x / 20,) for x in range(1, 20)], "p double")
    for forward, back in ((distributions.norm_cdf, distributions.norm_ppf),):
        assert all(abs(r["q"] - r["p"]) < 1e-9 for r in p.select("p", forward(back(p["p"])).alias("q")).collect())


def test_student_quantiles_beyond_a_thousand(spark):
    """With one degree of freedom the quantile is -1 / tan(pi p), however far out."""
    points = [4.68e-5, 1e-4, 3e-4, 0.25]
    df = spark.createDataFrame([(p, 1.0) for p in points], "p double, df double")
    found = df.select("p", distributions.t_ppf(df.p, df.df)).collect()
    assert {p: v for p, v in found} == pytest.approx({p: -1 / np.tan(np.pi * p) for p in points}, rel=1e-12)


def test_descent_arrives_within_few_steps(spark):
    """Some 1100 steps of unbroken momentum are needed here; momentum that starts anew needs a fraction."""
    df = registry.rows(spark, SMALL, registry.DESIGNS["logit"]).select("x", "y")
    found, want = (dict(map(tuple, api.logit_fit(df, "y", **o).collect())) for o in ({"solver": "gd", "max_iter": 250}, {}))
    assert found == pytest.approx(want, abs=1e-7)
