"""Wide and encoded designs, softmax regression, inference and folds with several features, distributions over columns and
streams, against numpy and against the other solvers."""

import math

import numpy as np
import pytest

from tessera.functions import distributions
from tessera.operators import api, fitting, levels, multinomial, selection, sql_functions, wide
from tessera.operators.families import ARRAYS, family
from tessera.operators.fitting import Design
from tessera.plans import registry
from tessera.streaming import scored_files

SMALL = "/root/testdata/sf0.01"
KINDS = ("logit", "linreg", "poisson", "gamma", "tweedie", "nbinom")


def coefficients(model):
    return {r["feature"]: r["coefficient"] for r in model.collect()}


def sample(n, p, seed=1):
    """Features, and an outcome for each kind of model."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.linspace(0.5, 4, p) + np.linspace(-3, 10, p)
    eta = 0.2 + ((x - x.mean(0)) / x.std(0)) @ np.linspace(-0.4, 0.4, p)
    mu = np.exp(eta)
    y = {"logit": (rng.random(n) < 1 / (1 + np.exp(-eta))) * 1.0, "linreg": eta + rng.normal(size=n), "poisson": rng.poisson(mu) * 1.0, "gamma": rng.gamma(2, mu / 2) + 1e-3, "tweedie": np.where(rng.random(n) < 0.3, 0, rng.gamma(2, mu / 2)), "nbinom": rng.poisson(rng.gamma(1, mu)) * 1.0}
    return x, y


def frame(spark, x, y, **more):
    names = [f"x{i:02d}" for i in range(x.shape[1])]
    columns = [*x.T, y, *more.values()]
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*columns, strict=True)]
    kinds = ["double"] * (x.shape[1] + 1) + ["string" if isinstance(v[0], str) else "double" for v in more.values()]
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip([*names, "y", *more], kinds, strict=True)))


@pytest.mark.parametrize("kind", KINDS)
def test_conjugate_gradients_equal_whole_matrices(spark, kind):
    x, ys = sample(400, 12)
    rng = np.random.default_rng(2)
    df = frame(spark, x, ys[kind], o=rng.normal(size=400) * 0.2, a=rng.integers(1, 4, 400) * 1.0)
    fit = getattr(api, f"{kind}_fit")
    for options in ({}, {"l2": 0.3}):
        want = coefficients(fit(df, "y", offset_col="o", weights_col="a", solver="irls", **options))
        assert coefficients(fit(df, "y", offset_col="o", weights_col="a", solver="cg", **options)) == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("kind", KINDS)
def test_levels_equal_their_columns(spark, kind):
    """Two string columns with nulls beside a number; a level of incomplete rows alone gets 0."""
    x, ys = sample(300, 1)
    df = frame(spark, x, ys[kind], city=[f"c{(i * i) % 7}" for i in range(300)], kind=["it's", "b`c", "d"] * 100)
    df = df.selectExpr("x00", "y", "nullif(city, 'c4') as city", "case when city = 'c4' then 'gone' else kind end as kind")
    fit = getattr(api, f"{kind}_fit")
    want = coefficients(fit(api.encode_dummies(df, "y"), "y", l2=0.01))
    found = coefficients(fit(df, "y", l2=0.01, encode=True))
    assert found == pytest.approx(want, abs=1e-7) and found["kind_gone"] == 0.0
    assert coefficients(fit(df, "y", l2=0.01, encode=True, solver="irls")) == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("kind", ("logit", "linreg"))
def test_levels_in_tables_equal_their_columns(spark, kind, monkeypatch):
    """A column of many levels is fitted without the driver holding them: beside numbers, another string column, offset,
    weights (some zero) and a penalty; a level of incomplete rows alone gets 0."""
    x, ys = sample(300, 2)
    rng = np.random.default_rng(4)
    df = frame(spark, x, ys[kind], o=rng.normal(size=300) * 0.2, a=rng.integers(0, 4, 300) * 1.0, city=[f"c{(i * i) % 7}" for i in range(300)], kind=["it's", "b`c", "d"] * 100)
    df = df.selectExpr("x00", "x01", "y", "o", "a", "nullif(kind, 'd') as kind", "case when kind = 'd' then 'gone' else city end as city")
    fit = getattr(api, f"{kind}_fit")
    options = {"offset_col": "o", "weights_col": "a", "l2": 0.1}
    want = coefficients(fit(api.encode_dummies(df, "y"), "y", **options))
    monkeypatch.setattr(levels, "LEVELS", 3)
    monkeypatch.setattr(fitting, "fit_wide", lambda *_: pytest.fail("levels came to the driver"))
    found = coefficients(fit(df, "y", encode=True, **options))
    assert found == pytest.approx(want, abs=1e-6) and found["city_gone"] == 0.0


@pytest.mark.parametrize("kind", ("linreg", "poisson"))
def test_one_column_of_levels_in_tables(spark, kind, monkeypatch):
    """The column alone gives its levels' means; where its lowest level has no complete row, there is no single optimum."""
    x, ys = sample(300, 1)
    df = frame(spark, x, ys[kind] + 1.0, city=[f"c{i % 9}" for i in range(300)]).drop("x00")
    fit = getattr(api, f"{kind}_fit")
    odd = df.selectExpr("case when city <> 'c0' then y end as y", "city")
    want, want_odd = coefficients(fit(df, "y", encode=True)), coefficients(fit(odd, "y", encode=True))
    monkeypatch.setattr(levels, "LEVELS", 3)
    assert coefficients(fit(odd, "y", encode=True)) == pytest.approx(want_odd, abs=1e-7)
    monkeypatch.setattr(fitting, "fit_wide", lambda *_: pytest.fail("levels came to the driver"))
    assert coefficients(fit(df, "y", encode=True)) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("name", ("linreg_fit__customers", "poisson_fit__suppliers"))
def test_queries_keep_levels_in_tables(spark, same_as_sql, name, monkeypatch):
    """The registered queries as they run on large tables: the SQL's rows, without a vector of the levels on the driver."""
    monkeypatch.setattr(levels, "LEVELS", 50)
    monkeypatch.setattr(fitting, "fit_wide", lambda *_: pytest.fail("levels came to the driver"))
    same_as_sql(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name], SMALL)


@pytest.mark.parametrize("kind", ("logit", "poisson"))
def test_lasso_and_descent_over_levels(spark, kind):
    x, ys = sample(300, 2)
    df = frame(spark, x, ys[kind], city=[f"c{(i * i) % 5}" for i in range(300)])
    fit = getattr(api, f"{kind}_fit")
    wide_df = api.encode_dummies(df, "y")
    assert coefficients(fit(df, "y", l1=0.05, encode=True, max_iter=400)) == pytest.approx(coefficients(fit(wide_df, "y", l1=0.05)), abs=1e-3)
    assert coefficients(fit(df, "y", encode=True, solver="gd", max_iter=400)) == pytest.approx(coefficients(fit(wide_df, "y")), abs=5e-3)


def test_thousands_of_levels(spark):
    """Means of groups; neither solver nor driver sees a matrix of the levels' pairs."""
    df = spark.range(24000).selectExpr("cast(id % 8000 as string) as g", "cast((id * 7919) % 1009 as double) as y")
    found = coefficients(api.linreg_fit(df, "y", encode=True))
    means = {r["g"]: r["m"] for r in df.groupBy("g").agg({"y": "avg"}).toDF("g", "m").collect()}
    base = means.pop(min(means))
    assert len(found) == 8000 and found["(Intercept)"] == pytest.approx(base, abs=1e-5)
    assert max(abs(found[f"g_{g}"] - (m - base)) for g, m in means.items()) < 1e-4


def test_repeated_columns_share_their_weight(spark):
    """A singular system gets the solution of least norm, as from whole matrices."""
    x, ys = sample(200, 3)
    df = frame(spark, np.column_stack([x, x[:, 0]]), ys["poisson"])
    found, want = (coefficients(api.poisson_fit(df, "y", **o)) for o in ({"solver": "cg"}, {}))
    assert found == pytest.approx(want, abs=1e-6) and found["x00"] == pytest.approx(found["x03"], abs=1e-6)


def test_wide_designs_check_their_input(spark):
    x, ys = sample(40, 2)
    df = frame(spark, x, ys["poisson"], g=["a", "b"] * 20)
    for bad, phrase in ((df.selectExpr("*", "cast(null as double) as z"), "entirely NULL"), (df.selectExpr("* except (y)", "y - 5 as y"), "non-negative"), (df.where("false"), "table is empty"), (df.selectExpr("* except (x01)", "case when x00 > -3 then null else 1 end as x01", "case when x00 > -3 then 1 end as z"), "no complete"), (df.selectExpr("*", "1 as g_b"), "name of another column")):
        with pytest.raises(ValueError, match=phrase):
            api.poisson_fit(bad, "y", encode=True)
    with pytest.raises(ValueError, match="weights must be non-negative"):
        api.poisson_fit(df.selectExpr("*", "-1.0 as w"), "y", weights_col="w", encode=True)


def plain_softmax(x, k, steps, rate, l1=0.0, l2=0.0):
    """Accelerated proximal gradient steps on standardized columns, and the coefficients on their own scale."""
    mean, sd = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    beta = before = np.zeros((k.max() + 1, z.shape[1]))
    free = np.append(0.0, np.ones(x.shape[1]))
    for it in range(steps):
        look = beta + it / (it + 3) * (beta - before)
        e = np.exp(z @ look.T - (z @ look.T).max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        new = look + rate * ((np.eye(len(beta))[k] - p).T @ z / len(x) - l2 * free * look)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1 * free, 0)
        new[0] = 0.0
        before, beta = beta, new
    slopes = beta[:, 1:] / sd
    return np.column_stack([beta[:, 0] - slopes @ mean, slopes])


def softmax_sample(n=300, classes=3, p=2, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * 2 + 5
    score = (x - 5) @ rng.normal(size=(p, classes)) + rng.gumbel(size=(n, classes))
    return x, score.argmax(1)


def table(model, features):
    found = {(r["class"], r["feature"]): r["coefficient"] for r in model.collect()}
    return np.array([[found[c, f] for f in ("(Intercept)", *features)] for c in sorted({c for c, _ in found})])


@pytest.mark.parametrize(("steps", "rate", "l1", "l2"), [(1, 0.5, 0, 0), (7, 0.25, 0, 0), (25, 0.4, 0.02, 0.1)])
def test_learning_rate_and_step_count_act(spark, steps, rate, l1, l2):
    x, k = softmax_sample()
    df = frame(spark, x, k.astype(float)).selectExpr("x00", "x01", "cast(y as int) as y")
    found = table(api.multinom_fit(df, "y", max_iter=steps, learning_rate=rate, l1=l1, l2=l2), ("x00", "x01"))
    assert found == pytest.approx(plain_softmax(x, k, steps, rate, l1, l2), abs=1e-9)


def test_separated_classes_take_steps_of_the_default_rate(spark):
    """There is no maximum; what comes is where so many gradient steps from zero lead."""
    x = np.arange(90.0)[:, None]
    k = (x[:, 0] // 30).astype(int)
    df = frame(spark, x, k.astype(float))
    found = table(api.multinom_fit(df, "y", max_iter=60), ("x00",))
    assert found == pytest.approx(plain_softmax(x, k, 60, 2 / 2), abs=1e-8) and np.abs(found[:, 1]).max() < 2


def test_penalized_softmax_equals_many_steps(spark):
    x, k = softmax_sample(p=3)
    df = frame(spark, x, k.astype(float))
    for options, tol in (({"l2": 0.05}, 1e-7), ({"l1": 0.03}, 1e-5), ({}, 1e-3)):
        found = table(api.multinom_fit(df, "y", **options), ("x00", "x01", "x02"))
        assert found == pytest.approx(plain_softmax(x, k, 8000, 0.5, **options), rel=tol, abs=tol)


def test_softmax_without_its_hessian(spark, monkeypatch):
    x, k = softmax_sample(500, 4, 3)
    df = frame(spark, x, k.astype(float))
    want = table(api.multinom_fit(df, "y", l2=0.01), ("x00", "x01", "x02"))
    monkeypatch.setattr(multinomial, "WHOLE_HESSIAN", 0)
    monkeypatch.setattr(multinomial, "_sums", None)
    assert table(api.multinom_fit(df, "y", l2=0.01), ("x00", "x01", "x02")) == pytest.approx(want, abs=1e-7)


def test_hundreds_of_classes(spark):
    """A 0/1 feature saturates the model: logarithms of the cells' counts."""
    df = spark.range(20000).selectExpr("concat('k', id % 250) as y", "cast(pmod(hash(id), 10) < 3 + id % 250 % 5 as int) as x")
    found = {(r["class"], r["feature"]): r["coefficient"] for r in api.multinom_fit(df, "y").collect()}
    counts = {(r["y"], r["x"]): r["count"] for r in df.groupBy("y", "x").count().collect()}
    assert len(found) == 500
    for c in ("k1", "k77", "k249"):
        base = math.log(counts[c, 0] / counts["k0", 0])
        assert found[c, "(Intercept)"] == pytest.approx(base, abs=1e-6)
        assert found[c, "x"] == pytest.approx(math.log(counts[c, 1] / counts["k0", 1]) - base, abs=1e-6)


def fitted_numpy(kind, df_x, y, found):
    """Design, coefficients, means, weights and so on of a fit."""
    names = {"logit": "logistic", "linreg": "linear"}
    fam = family(names.get(kind, kind))
    design = np.column_stack([np.ones(len(y)), df_x])
    beta = np.array([found[c] for c in ("(Intercept)", *sorted(set(found) - {"(Intercept)"}))])
    mu = fam.mean(design @ beta, ARRAYS)
    return fam, design, beta, mu


@pytest.mark.parametrize("kind", KINDS)
def test_inference_with_three_features_matches_numpy(spark, kind):
    x, ys = sample(250, 3, 6)
    y = ys[kind]
    groups = np.arange(250) % 17
    df = frame(spark, x, y, c=groups.astype(float))
    model = getattr(api, f"{kind}_fit")(df.drop("c"), "y")
    fam, design, beta, mu = fitted_numpy(kind, x, y, coefficients(model))
    n, d = design.shape
    info, seen, r = fam.information(mu, ARRAYS), fam.observed(y, mu, ARRAYS), fam.score(y, mu, ARRAYS)
    pearson = (y - mu) / np.sqrt(fam.variance(mu, ARRAYS))
    phi = (pearson**2).sum() / (n - d) if fam.estimated else 1.0
    cov = phi * np.linalg.inv((design.T * info) @ design)
    bread = np.linalg.inv((design.T * seen) @ design)
    hat = seen * np.einsum("ij,jk,ik->i", design, bread, design)
    sums = np.array([(design * r[:, None])[groups == g].sum(0) for g in range(17)])
    meat = {"hc0": (design.T * r**2) @ design, "hc3": (design.T * (r / (1 - hat)) ** 2) @ design, "cluster": sums.T @ sums * 17 / 16 * (n - 1) / (n - d)}
    summary = getattr(api, f"{kind}_summary")
    errors = lambda **o: [row["std_error"] for row in summary(model, df, "y", **o).collect()]
    assert errors() == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-7)
    for how, m in meat.items():
        options = {"cluster_col": "c"} if how == "cluster" else {"robust": how}
        assert errors(**options) == pytest.approx(np.sqrt(np.diag(bread @ m @ bread)).tolist(), rel=1e-7)
    out = getattr(api, f"{kind}_influence")(model, df, "y").toPandas()
    order = np.lexsort(out[["x00"]].to_numpy().T), np.argsort(x[:, 0])
    assert out["hat"].to_numpy()[order[0]] == pytest.approx(hat[order[1]], rel=1e-7)
    cooks = pearson**2 / phi * hat / (d * (1 - hat) ** 2)
    assert out["cooks_distance"].to_numpy()[order[0]] == pytest.approx(cooks[order[1]], rel=1e-7, abs=1e-14)
    band = getattr(api, f"{kind}_predict_ci")(model, df, "y").toPandas()
    crit = distributions.student_ppf(0.975, n - d) if fam.estimated else distributions.normal_ppf(0.975)
    high = fam.mean(design @ beta + crit * np.sqrt(np.einsum("ij,jk,ik->i", design, cov, design)), ARRAYS, clamp=False)
    assert band["conf_high"].to_numpy()[np.argsort(band["x00"])] == pytest.approx(high[order[1]], rel=1e-7)


def test_errors_do_not_hang_on_where_a_feature_lies(spark):
    x, ys = sample(300, 2, 9)
    df = frame(spark, x, ys["poisson"])
    far = df.selectExpr("x00 + 1e8 as x00", "x01", "y")
    near, moved = ([(r["std_error"], r["statistic"]) for r in api.poisson_summary(api.poisson_fit(t, "y"), t, "y").collect()] for t in (df, far))
    assert moved[1] == pytest.approx(near[1], rel=1e-5) and moved[2] == pytest.approx(near[2], rel=1e-6)
    robust = [[r["std_error"] for r in api.poisson_summary(api.poisson_fit(t, "y"), t, "y", robust="hc3").collect()] for t in (df, far)]
    assert robust[1][1:] == pytest.approx(robust[0][1:], rel=1e-5)


def plain_folds(x, y, fold, k, l2, kind):
    z = np.column_stack([np.ones(len(y)), (x - x.mean(0)) / x.std(0)])
    fam = family(kind)
    t = (y - y.mean()) / y.std() if fam.identity else y / y.mean() if fam.log_link else y
    lost = 0.0
    for f in range(k):
        use, beta = fold != f, np.zeros(z.shape[1])
        for _ in range(60):
            mu = fam.mean(z[use] @ beta, ARRAYS)
            a = (z[use].T * fam.information(mu, ARRAYS)) @ z[use] + use.sum() * l2 * np.diag([0.0] + [1.0] * x.shape[1])
            beta = np.linalg.solve(a, (z[use].T * fam.information(mu, ARRAYS)) @ z[use] @ beta + z[use].T @ fam.score(t[use], mu, ARRAYS))
        mu = fam.mean(z[~use] @ beta, ARRAYS)
        mu = mu * y.std() + y.mean() if fam.identity else mu * y.mean() if fam.log_link else mu
        lost += fam.deviance(y[~use], mu, ARRAYS).sum()
    return lost / len(y)


@pytest.mark.parametrize("kind", ("linear", "logistic", "poisson", "gamma"))
def test_folds_with_three_features_match_numpy(spark, kind):
    x, ys = sample(300, 3, 4)
    y = ys[{"linear": "linreg", "logistic": "logit"}.get(kind, kind)]
    key = np.random.default_rng(0).permutation(300)
    df = frame(spark, x, y, key=key.astype(float))
    found = [r["cv_deviance"] for r in api.cv_l2(df, "y", kind, [0.0, 0.2, 2.0], 4, order_by="key").collect()]
    assert found == pytest.approx([plain_folds(x, y, key % 4, 4, v, kind) for v in (0.0, 0.2, 2.0)], rel=1e-7)


def test_one_pass_equals_the_sweep(spark, monkeypatch):
    x, ys = sample(300, 4, 7)
    df = frame(spark, x, ys["linreg"], key=np.arange(300.0))
    sweeps = lambda: [[r["cv_deviance"] for r in f(df, "y", "linear", [0.0, 0.01, 0.1, 0.5], order_by="key").collect()] for f in (api.cv_l2, api.cv_l1)]
    quick = sweeps()
    monkeypatch.setattr(selection, "_linear_losses", lambda *a: None)
    assert quick[0] == pytest.approx(sweeps()[0], rel=1e-9) and quick[1] == pytest.approx(sweeps()[1], rel=1e-7)
    exact = spark.range(100).selectExpr("cast(id as double) as x", "3.0D * id + 1 as y", "id as key")
    assert api.cv_l2(exact, "y", "linear", [0.0], order_by="key").first()["cv_deviance"] < 1e-15


def test_tied_and_missing_keys_have_one_order(spark):
    """Null keys come last; ties are ordered by the row, however the table is cut."""
    df = spark.range(3000).selectExpr("case when id % 10 = 0 then null else id % 7 end as key", "cast(id as double) as y", "cast(id % 11 as double) as x")
    seen = []
    for parts in (1, 5, 13):
        shuffled = selection.numbered(df.repartition(parts, "x").sortWithinPartitions("y"), "key", "fold", 3000).collect()
        seen.append(sorted((r["fold"], r["y"]) for r in shuffled))
    assert seen[0] == seen[1] == seen[2] and [n for n, _ in seen[0]] == list(range(3000))
    assert all(y % 10 == 0 for n, y in seen[0] if n >= 2700)
    keys = [y % 7 for n, y in seen[0] if n < 2700]
    assert keys == sorted(keys)


@pytest.mark.parametrize("fn", ("norm_cdf", "norm_ppf", "t_cdf", "t_ppf"))
def test_distributions_over_columns_keep_their_accuracy(spark, fn):
    if fn == "norm_cdf":
        given, want, tol = [(x / 8, 1.0) for x in range(-300, 301, 7)], lambda p, _: distributions.normal_cdf(p), 1e-12
    elif fn == "norm_ppf":
        given, want, tol = [(10.0**-k, 1.0) for k in range(1, 300, 13)] + [(x / 997, 1.0) for x in range(1, 997, 31)], lambda p, _: distributions.normal_ppf(p), 1e-9
    elif fn == "t_cdf":
        given, want, tol = [(x / 4, df) for df in (0.5, 1.0, 2.0, 7.0, 30.0, 101.0, 5000.0) for x in range(-60, 61, 7)], distributions.student_cdf, 1e-10
    else:
        given, want, tol = [(p, df) for df in (1.0, 2.0, 3.0, 10.0, 57.0, 2000.0) for p in (1e-6, 0.001, 0.025, 0.2, 0.49, 0.5, 0.7, 0.995)], distributions.student_ppf, 1e-8
    df = spark.createDataFrame(given, "p double, df double")
    args = [df["p"]] if fn.startswith("norm") else [df["p"], df["df"]]
    out = df.select("p", "df", getattr(distributions, fn)(*args).alias("v"))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        exact = want(r["p"], r["df"])
        assert abs(r["v"] - exact) <= tol * max(1.0, abs(exact)), r


def test_a_stream_goes_on_where_it_broke_off(spark, tmp_path):
    """Files are scored over three calls, one stopped midway; every row is written once."""
    df = spark.range(600).selectExpr("id", "cast(id % 17 as double) as x", "2.0D + 3 * (id % 17) as y")
    df.repartition(12).write.parquet(str(tmp_path / "in.parquet"))
    model = api.linreg_fit(df.select("x", "y"), "y")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in.parquet"))
    first = scored_files(model, stream(), "linear", str(tmp_path / "out"), batches=3).count()
    assert 0 < first < 600
    scored_files(model, stream(), "linear", str(tmp_path / "out"))
    df.selectExpr("id + 1000 as id", "x", "y").write.mode("append").parquet(str(tmp_path / "in.parquet"))
    out = scored_files(model, stream(), "linear", str(tmp_path / "out")).collect()
    assert sorted(r["id"] for r in out) == [*range(600), *range(1000, 1600)]
    assert all(abs(r["prediction"] - r["y"]) < 1e-8 for r in out)


def test_wide_design_keeps_what_a_narrow_one_has(spark):
    x, ys = sample(100, 3)
    df = frame(spark, x, ys["gamma"], a=np.arange(100) % 3 * 1.0)
    narrow, broad = Design(df, "y", family("gamma"), weights_col="a"), wide.WideDesign(df, "y", family("gamma"), weights_col="a")
    narrow.release(), broad.release()
    assert broad.mean == pytest.approx(narrow.mean) and broad.sd == pytest.approx(narrow.sd) and broad.y_mean == pytest.approx(narrow.y_mean)


def test_nearly_dependent_columns_keep_their_digits(spark):
    """Two columns that differ by 1e-8: the squares have lost what tells them apart."""
    n, eps = 400, 2.0**-27
    x = np.arange(n) % 16 - 7.5
    u = np.where(np.arange(n) // 16 % 2 == 0, 1.0, -1.0) * 1.0
    u -= x * (u @ x) / (x @ x)
    u = np.round(u * 16) / 16
    noise = np.cos(np.arange(n)) * 1e-6
    y = 1 + 2 * x + 3 * (x + eps * u) + noise
    df = frame(spark, np.column_stack([x, x + eps * u]), y).repartition(4)
    model = api.linreg_fit(df, "y")
    basis = np.column_stack([np.ones(n), x, u])  # the same column space, well apart
    flat, rest = np.linalg.lstsq(basis, y, rcond=None)[:2]
    want = {"(Intercept)": flat[0], "x00": flat[1] - flat[2] / eps, "x01": flat[2] / eps}
    found = coefficients(model)
    assert {c: found[c] for c in want} == pytest.approx(want, rel=1e-5)
    error = math.sqrt(rest[0] / (n - 3) * np.linalg.inv(basis.T @ basis)[2, 2]) / eps
    assert api.linreg_summary(model, df, "y").where("feature = 'x01'").first()["std_error"] == pytest.approx(error, rel=1e-5)
    twice = frame(spark, np.column_stack([x, x]), y)
    with pytest.raises(ValueError, match="singular"):
        api.linreg_fit(twice, "y", solver="irls")
    assert api.linreg_summary(api.linreg_fit(twice, "y"), twice, "y").first()["std_error"] is None


def test_models_as_sql_functions(spark):
    x, ys = sample(120, 2)
    df = frame(spark, x, ys["logit"], o=np.linspace(-1, 1, 120)).selectExpr("x00 as `a b`", "x01", "y", "o", "cast(x01 as string) as s")
    features = df.select("a b", "x01", "y", "o")
    for kind, name, created in (("logit", "logistic", family("logistic")), ("poisson", "poisson", family("poisson"))):
        model = getattr(api, f"{kind}_fit")(features, "y", offset_col="o")
        holes = df.union(spark.sql("select null, 1D, 0D, 0D, 'x' union all select double('NaN'), 1D, 0D, 0D, 'x' union all select 1D, 1D, 0D, null, 'x'"))
        holes.createOrReplaceTempView("holes")
        sql_functions.create_predict(spark, f"scored_{kind}", created, model, "holes", "o")
        want = sorted(map(str, getattr(api, f"{kind}_predict")(model, holes, offset_col="o").collect()))
        assert sorted(map(str, spark.sql(f"select * from scored_{kind}()").collect())) == want
        sql_functions.create_mean(spark, f"mean_{kind}", created, model)
        column = "prob" if kind == "logit" else "prediction"
        both = spark.sql(f"select {column} as p, mean_{kind}(x01 => x01, `a b` => `a b`, reg_offset => o) as q from scored_{kind}() where {column} is not null").collect()
        assert len(both) == 120 and all(r["p"] == pytest.approx(r["q"], rel=1e-12) for r in both)
    assert spark.sql("select * from scored_logit(threshold => 2)").where("pred").isEmpty()
    df.withColumnRenamed("s", "prob").createOrReplaceTempView("taken")
    with pytest.raises(ValueError, match="already has a"):
        sql_functions.create_predict(spark, "scored_again", family("logistic"), api.logit_fit(features, "y", offset_col="o"), "taken")


def test_softmax_inference_without_rows(spark):
    x, k = softmax_sample()
    df = frame(spark, x, k.astype(float))
    model = api.multinom_fit(df, "y")
    for empty in (df.where("false"), df.selectExpr("cast(null as double) as x00", "x01", "y")):
        rows = api.multinom_summary(model, empty, "y").collect()
        assert len(rows) == 6 and all(r["std_error"] is None and r["coefficient"] is not None for r in rows)
    with pytest.raises(ValueError, match="at least 2 distinct classes"):
        api.multinom_fit(df.where("false"), "y")
