"""Registered queries over the test tables, at least one for each public function, and the SQL that gives the same rows.

Each design is one SQL text that Spark and DuckDB both run: key, outcome ``y``, feature ``x``, offset ``o``, weight ``a``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions
from tessera.operators import api, sql_functions
from tessera.operators.families import family
from tessera.plans import sql
from tessera.sources import files
from tessera.streaming import arriving, scored_files

TABLES = ("customer", "orders", "lineitem", "events", "part", "supplier", "nation", "labels")
PLAIN = "cast(0 as double) as o, cast(1 as double) as a"
COUNTS = "select c_custkey as key, cast(count(o_orderkey) as double) as y, min(c_acctbal) / 1000 as x, {extra} from customer left join orders on c_custkey = o_custkey group by c_custkey"
DESIGNS = {
    "linreg": f"select l_orderkey * 10 + l_linenumber as key, l_extendedprice * (1 - l_discount) / 10000 as y, l_extendedprice / 10000 as x, {PLAIN} from lineitem",
    "logit": f"select l_orderkey * 10 + l_linenumber as key, case when l_extendedprice * (1 - l_discount) / 1000 + l_linenumber * 5 > 60 then cast(1 as double) else cast(0 as double) end as y, l_extendedprice / 10000 as x, {PLAIN} from lineitem",
    "poisson": COUNTS.format(extra=PLAIN),
    "gamma": f"select event_id as key, value as y, cast(user_id % 7 as double) as x, {PLAIN} from events where value > 0",
    "tweedie": f"select event_id as key, case when event_type = 'purchase' then value else cast(0 as double) end as y, cast(event_id % 5 as double) as x, {PLAIN} from events",
    "nbinom": f"select user_id as key, cast(count(*) as double) as y, cast(user_id % 10 as double) as x, {PLAIN} from events group by user_id",
}
OFFSET = COUNTS.format(extra="ln(cast(2 + c_custkey % 3 as double)) as o, cast(1 as double) as a")
WEIGHTS = COUNTS.format(extra="cast(0 as double) as o, cast(1 + c_custkey % 4 as double) as a")
CLUSTERS = COUNTS.format(extra=PLAIN + ", cast(c_custkey % 30 as double) as cl")
EXTRA = {"tweedie": {"power": sql.POWER}, "nbinom": {"alpha": sql.ALPHA}}


def rows(spark: SparkSession, sf_dir: str, design: str) -> DataFrame:
    for name in TABLES:
        files(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(design)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded to six digits, or as named; negative zero becomes zero."""
    return df.select(*[(F.round(c, digits.get(c, 6)) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_EVALUATED = {c: 4 for c in ("loglik", "aic", "bic", "deviance", "null_deviance")}


def _model(kind: str, df: DataFrame, **options) -> DataFrame:
    return getattr(api, f"{kind}_fit")(df.select("x", "y", *[c for c in options.values() if isinstance(c, str)]), "y", **EXTRA.get(kind, {}), **options)


def run(kind: str, task: str, design: str, spark: SparkSession, sf_dir: str, options: dict | None = None, columns: tuple = ()) -> DataFrame:
    df, options = rows(spark, sf_dir, design), options or {}
    fitting = {k: v for k, v in options.items() if k in ("offset_col", "weights_col")}
    model, extra = _model(kind, df, **fitting), EXTRA.get(kind, {})
    if task == "fit":
        return rounded(model)
    if task == "predict":
        out = getattr(api, f"{kind}_predict")(model, df, **{k: v for k, v in fitting.items() if k == "offset_col"})
        return rounded(out.select("key", *[c for c in out.columns if c in ("prob", "pred", "prediction")]))
    out = getattr(api, f"{kind}_{task}")(model, df, "y", **extra, **options)
    if task == "evaluate":
        return rounded(out, **_EVALUATED)
    if task == "summary":
        return rounded(out.select(*(columns or out.columns)), statistic=4)
    kept = [c for c in out.columns if c not in ("y", "x", "o", "a")]
    return rounded(out.select(*kept), hat=9, cooks_distance=9)


QUERIES: dict = {}
ORACLES: dict = {}
_Z = ("feature", "coefficient", "std_error", "statistic", "conf_low", "conf_high")
_NAMES = {"poisson": "orders"}
for _kind, _design in DESIGNS.items():
    _name = _NAMES.get(_kind, "plain")
    for _task in ("fit", "predict", "evaluate", "summary", "predict_ci", "influence"):
        _columns = _Z[: 4 if sql.FAMILIES[_kind]["phi"] else 6] if _task == "summary" else ()
        QUERIES[f"{_kind}_{_task}__{_name}"] = partial(run, _kind, _task, _design, columns=_columns)
        ORACLES[f"{_kind}_{_task}__{_name}"] = getattr(sql, _task)(_kind, _design)
    QUERIES[f"{_kind}_summary__full"] = partial(run, _kind, "summary", _design)
    ORACLES[f"{_kind}_summary__full"] = sql.full_summary(_kind, _design)
for _what, _design, _options in (("offset", OFFSET, {"offset_col": "o"}), ("weights", WEIGHTS, {"weights_col": "a"})):
    for _task in ("fit", "summary"):
        QUERIES[f"poisson_{_task}__{_what}"] = partial(run, "poisson", _task, _design, options=_options, columns=_Z)
        ORACLES[f"poisson_{_task}__{_what}"] = getattr(sql, _task)("poisson", _design)
for _robust in ("hc0", "hc1", "hc2", "hc3"):
    QUERIES[f"poisson_summary__{_robust}"] = partial(run, "poisson", "summary", CLUSTERS, options={"robust": _robust}, columns=_Z)
    ORACLES[f"poisson_summary__{_robust}"] = sql.summary("poisson", CLUSTERS, _robust)
QUERIES["poisson_summary__cluster"] = partial(run, "poisson", "summary", CLUSTERS, options={"cluster_col": "cl"}, columns=_Z)
ORACLES["poisson_summary__cluster"] = sql.summary("poisson", CLUSTERS, "cluster")


def _query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def _two_classes(spark, sf_dir):
    return rows(spark, sf_dir, DESIGNS["logit"]).select("key", F.when(F.col("y") == 1, "yes").otherwise("no").alias("y"), "x")


_LOGIT = sql.fit_cte("logit", DESIGNS["logit"])


@_query("multinom_fit__two_classes", f"{_LOGIT} select 'no' as class, f as feature, cast(0 as double) as coefficient from (values ('(Intercept)'), ('x')) t(f) union all select 'yes', '(Intercept)', round(b0, 6) + 0.0 from beta union all select 'yes', 'x', round(b1, 6) + 0.0 from beta")
def multinom_fit(spark, sf_dir):
    return rounded(api.multinom_fit(_two_classes(spark, sf_dir).drop("key"), "y"))


@_query("multinom_predict__two_classes", f"{_LOGIT} select key, case when mu > 0.5 then 'yes' else 'no' end as pred, round(mu, 6) as p_yes from m")
def multinom_predict(spark, sf_dir):
    df = _two_classes(spark, sf_dir)
    out = api.multinom_predict(api.multinom_fit(df.drop("key"), "y"), df)
    return out.select("key", "pred", F.round(F.col("probs")["yes"], 6).alias("p_yes"))


@_query("multinom_evaluate__two_classes", f"{_LOGIT} select count(*) as n, round(avg(case when (mu > 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy, round(-avg(y * ln(mu) + (1 - y) * ln(1 - mu)), 6) as log_loss from m")
def multinom_evaluate(spark, sf_dir):
    df = _two_classes(spark, sf_dir)
    return rounded(api.multinom_evaluate(api.multinom_fit(df.drop("key"), "y"), df, "y"))


@_query("multinom_summary__two_classes", "select 'yes' as class, * from (" + sql.summary("logit", DESIGNS["logit"]) + ")")
def multinom_summary(spark, sf_dir):
    df = _two_classes(spark, sf_dir)
    return rounded(api.multinom_summary(api.multinom_fit(df.drop("key"), "y"), df, "y").select("class", *_Z), statistic=4)


_EVENTS = "select event_type as y, ln(value) as x, cast(hour(ts) as double) / 12 as h from events where value > 0"


@_query("multinom_fit__event_type", sql.softmax(_EVENTS))
def multinom_events(spark, sf_dir):
    df = rows(spark, sf_dir, _EVENTS)
    return rounded(api.multinom_fit(df, "y"))


#: Designs whose keys are unique, so that the rows' order, and with it the folds, is.
_KEYED = DESIGNS | {
    "linreg": f"select p_partkey as key, p_retailprice / 100 + p_size % 7 as y, p_retailprice / 100 as x, {PLAIN} from part",
    "logit": f"select o_orderkey as key, case when o_totalprice / 1000 + o_orderkey % 97 > 200 then cast(1 as double) else cast(0 as double) end as y, o_totalprice / 100000 as x, {PLAIN} from orders",
}


def _numbered(spark, sf_dir, kind):
    return rows(spark, sf_dir, _KEYED[kind]).select("key", "x", "y")


_FOLD = f"""with d as ({DESIGNS["gamma"]}), n as (select *, (row_number() over (order by key) - 1) % 5 as fold from d),
f as (select t.fold, regr_slope(n.y, n.x) as b1, regr_intercept(n.y, n.x) as b0 from (select distinct fold from n) t join n on n.fold <> t.fold group by t.fold)
select cast(0 as double) as l2, round(avg((y - b0 - b1 * x) * (y - b0 - b1 * x)), 6) as cv_deviance from n join f on n.fold = f.fold"""


@_query("cv_l2__linear_unpenalized", _FOLD)
def cv_l2_zero(spark, sf_dir):
    return rounded(api.cv_l2(_numbered(spark, sf_dir, "gamma"), "y", "linear", [0.0], order_by="key"))


_SWEEPS = (
    ("cv_l2", "poisson", "poisson", [0.0, 0.1, 1.0]), ("cv_l1", "logit", "logistic", [0.0, 0.01, 0.1]), ("cv_power", "tweedie", "tweedie", [1.2, 1.5, 1.8]), ("cv_alpha", "nbinom", "nbinom", [0.1, 0.5, 1.0]),
    ("cv_l2_refine", "linreg", "linear", [0.0, 0.1, 1.0]), ("cv_l1_refine", "linreg", "linear", [0.0, 0.1, 1.0]), ("cv_power_refine", "tweedie", "tweedie", [1.2, 1.5, 1.8]), ("cv_alpha_refine", "nbinom", "nbinom", [0.1, 0.5, 1.0]),
)
for _name, _kind, _family, _grid in _SWEEPS:
    _args = (_grid,) if "power" in _name or "alpha" in _name else (_family, _grid)
    _query(f"{_name}__{_kind}", sql.cv(_name.split("_")[1], _family, _KEYED[_kind], _grid, 10 if "refine" in _name else 0))(
        lambda spark, sf_dir, n=_name, k=_kind, a=_args: rounded(getattr(api, n)(_numbered(spark, sf_dir, k), "y", *a, order_by="key"))
    )
for _name in ("nbinom_dispersion", "nbinom_dispersion_refine"):
    _query(f"{_name}__events", sql.dispersion(DESIGNS["nbinom"], [0.01, 0.1, 0.5, 1.0], 10 if "refine" in _name else 0))(
        lambda spark, sf_dir, n=_name: rounded(getattr(api, n)(_numbered(spark, sf_dir, "nbinom").select("x", "y"), "y", [0.01, 0.1, 0.5, 1.0]))
    )
for _name, _options, _oracle in (
    ("l1", {"l1": 0.01}, sql.penalized("logistic", "l1", 0.01, DESIGNS["logit"], 4)), ("l2", {"l2": 0.1}, sql.penalized("logistic", "l2", 0.1, DESIGNS["logit"], 4)),
    ("gd", {"solver": "gd"}, sql.penalized("logistic", "", 0.0, DESIGNS["logit"], 4)),
):
    _query(f"logit_fit__{_name}", _oracle)(lambda spark, sf_dir, o=_options: rounded(api.logit_fit(rows(spark, sf_dir, DESIGNS["logit"]).select("x", "y"), "y", **o), coefficient=4))


#: Three classes and a 0/1 feature: the model is saturated, so its estimates follow from the counts of the six cells.
_THREE = "select l_orderkey * 10 + l_linenumber as key, l_returnflag as y, case when l_linenumber > 3 then cast(1 as double) else cast(0 as double) end as x from lineitem"
_CELLS = f"with d as ({_THREE}), n as (select y, count(*) filter (where x = 0) as n0, count(*) filter (where x = 1) as n1 from d group by y), f as (select * from n order by y limit 1)"


def _three(spark, sf_dir):
    df = rows(spark, sf_dir, _THREE)
    return df, api.multinom_fit(df.drop("key"), "y")


@_query("multinom_fit__three_classes", f"{_CELLS} select n.y as class, '(Intercept)' as feature, round(ln(n.n0 / f.n0), 6) + 0.0 as coefficient from n, f union all select n.y, 'x', round(ln(n.n1 / f.n1) - ln(n.n0 / f.n0), 6) + 0.0 from n, f")
def multinom_three(spark, sf_dir):
    return rounded(_three(spark, sf_dir)[1])


_SHARES = f"{_CELLS}, p as (select y, n0 / sum(n0) over () as p0, n1 / sum(n1) over () as p1 from n)"


@_query("multinom_predict__three_classes", f"{_SHARES} select key, (select max_by(y, case when d.x = 0 then p0 else p1 end) from p) as pred, round((select max(case when y = 'R' then case when d.x = 0 then p0 else p1 end end) from p), 6) as p_r from d")
def multinom_predict_three(spark, sf_dir):
    df, model = _three(spark, sf_dir)
    return api.multinom_predict(model, df).select("key", "pred", F.round(F.col("probs")["R"], 6).alias("p_r"))


@_query("multinom_evaluate__three_classes", f"{_SHARES} select cast(sum(n0 + n1) as bigint) as n, round((max(n0) + max(n1)) / sum(n0 + n1), 6) as accuracy, round(-sum(n0 * ln(p0) + n1 * ln(p1)) / sum(n0 + n1), 6) as log_loss from n join p using (y)")
def multinom_evaluate_three(spark, sf_dir):
    df, model = _three(spark, sf_dir)
    return rounded(api.multinom_evaluate(model, df.drop("key"), "y"))


@_query("multinom_summary__three_classes", f"""{_CELLS}, r as (
  select n.y as class, '(Intercept)' as feature, ln(n.n0 / f.n0) as b, sqrt(1 / n.n0 + 1 / f.n0) as se from n, f where n.y <> f.y
  union all select n.y, 'x', ln(n.n1 / f.n1) - ln(n.n0 / f.n0), sqrt(1 / n.n0 + 1 / f.n0 + 1 / n.n1 + 1 / f.n1) from n, f where n.y <> f.y)
select class, feature, round(b, 6) + 0.0 as coefficient, round(se, 6) as std_error, round(b / se, 4) + 0.0 as statistic, round(2 * {sql.normal_tail("abs(b / se)")}, 6) + 0.0 as p_value, round(b - {sql.Z} * se, 6) + 0.0 as conf_low, round(b + {sql.Z} * se, 6) + 0.0 as conf_high from r""")
def multinom_summary_three(spark, sf_dir):
    df, model = _three(spark, sf_dir)
    return rounded(api.multinom_summary(model, df.drop("key"), "y"), statistic=4)


#: Orders up to each point of a grid between the lowest and the highest price.
_GRID = {"log": "exp(ln(lo) + (ln(hi) - ln(lo)) * i / 19.0)", "linear": "lo + (hi - lo) * i / 19.0"}
for _spaced, _point in _GRID.items():

    def _counted(spark, sf_dir, spaced=_spaced):
        price = rows(spark, sf_dir, "select o_totalprice as p from orders where o_totalprice > 0")
        points = api.reg_grid(*price.agg(F.min("p"), F.max("p")).first(), 20, log_spaced=spaced == "log")
        counts = price.agg(*[F.count(F.when(F.col("p") <= v * (1 + 1e-12), 1)).alias(f"c{i}") for i, v in enumerate(points)])
        stacked = ", ".join(f"{i}L, {v!r}D, c{i}" for i, v in enumerate(points))
        return rounded(counts.selectExpr(f"stack(20, {stacked}) as (i, v, orders)"))

    _query(f"reg_grid__{_spaced}", f"""with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders where o_totalprice > 0), g as (select i, {_point} as v from range(20) t(i), b)
select i, round(v, 6) + 0.0 as v, (select count(*) from orders where o_totalprice > 0 and o_totalprice <= v * (1 + 1e-12)) as orders from g""")(_counted)


#: Where the distribution functions are computed: rows (key, argument, degrees of freedom), digits that are compared.
_ARGUMENTS = {
    "norm_cdf": ("lineitem", "select l_orderkey * 10 + l_linenumber as key, l_extendedprice / 12000 - 3 as p, 1 as df from lineitem", 7),
    "norm_ppf": ("part", "select p_partkey as key, (p_retailprice - 899.95) / 100.1 as p, 1 as df from part", 8),
    "t_cdf": ("customer", "select c_custkey as key, c_acctbal / 1500 - 3 as p, c_nationkey + 1 as df from customer", 8),
    "t_ppf": ("customer", "select c_custkey as key, (c_acctbal + 1000.5) / 11001 as p, c_nationkey % 25 + 1 as df from customer", 6),
}
for _fn, (_table, _source, _digits) in _ARGUMENTS.items():

    def _column(spark, sf_dir, fn=_fn, source=_source, digits=_digits):
        df = rows(spark, sf_dir, source)
        args = [F.col("p")] if fn.startswith("norm") else [F.col("p"), F.col("df").cast("double")]
        return df.select("key", (F.round(getattr(distributions, fn)(*args), digits) + 0.0).alias("v"))

    _query(f"{_fn}__{_table}", sql.over(_fn, _source, _digits))(_column)


#: Models of many features. One label alone makes them saturated, so that SQL has them from the groups' means.
_LEVELS = {
    "linreg_fit__customers": ("linreg", "select o_totalprice / 997 as y, cast(o_custkey as {text}) as g from orders", "{0}"),
    "poisson_fit__suppliers": ("poisson", "select l_quantity as y, cast(l_suppkey as {text}) as g from lineitem", "ln({0})"),
}
for _name, (_kind, _source, _link) in _LEVELS.items():
    _query(_name, sql.saturated(_source.format(text="varchar"), "g_", _link))(
        lambda spark, sf_dir, k=_kind, q=_source.format(text="string"): rounded(getattr(api, f"{k}_fit")(rows(spark, sf_dir, q), "y", encode=True))
    )
_BUCKETS = 120
_WIDE = "select o_totalprice / 997 as y, cast({pad}(cast(o_orderkey % " + str(_BUCKETS) + " as {text}), 3, '0') as {text}) as g from orders"


@_query("linreg_fit__wide", sql.saturated(_WIDE.format(pad="lpad", text="varchar"), "g_"))
def wide_fit(spark, sf_dir):
    """Many numeric columns, fitted without their Gram matrix."""
    df = rows(spark, sf_dir, _WIDE.format(pad="lpad", text="string"))
    return rounded(api.linreg_fit(df.select("y", *[(F.col("g") == f"{i:03d}").cast("double").alias(f"g_{i:03d}") for i in range(1, _BUCKETS)]), "y", solver="cg"))


#: Tied and missing keys. Rows with one key are equal, so that the folds' contents do not hang on the order of ties.
_TIED = "select nullif(l_quantity, 50) as key, l_quantity / 10 + (l_quantity * 7) % 4 as y, l_quantity / 10 as x, l_quantity % 3 as h from lineitem"
_PAIRS = "select o_orderkey as key, o_totalprice / 10000 + o_custkey % 13 as y, o_totalprice / 10000 as x, cast(o_custkey % 7 as double) as h from orders"
for _name, _source in (("tied_keys", _TIED), ("two_features", _PAIRS)):
    _query(f"cv_l2__{_name}", sql.cv_pairs(_source, [0.0, 0.1, 1.0]))(lambda spark, sf_dir, q=_source: rounded(api.cv_l2(rows(spark, sf_dir, q), "y", "linear", [0.0, 0.1, 1.0], order_by="key")))


@_query("gamma_predict__stream", ORACLES["gamma_predict__plain"])
def scored_stream(spark, sf_dir):
    """The events arrive as files; what has been scored is read back from the sink."""
    model = _model("gamma", rows(spark, sf_dir, DESIGNS["gamma"]))
    events = arriving(spark, sf_dir, "events", files(spark, sf_dir, "events").schema)
    stream = events.where("value > 0").selectExpr("event_id as key", "cast(user_id % 7 as double) as x")
    return rounded(scored_files(model, stream, "gamma").select("key", "prediction"))


for _kind, _call in (("poisson", "rates()"), ("logit", "chances(threshold => 0.5)")):

    def _sql(spark, sf_dir, kind=_kind, call=_call):
        df = rows(spark, sf_dir, DESIGNS[kind])
        df.createOrReplaceTempView(f"{kind}_rows")
        fam = family({"logit": "logistic"}.get(kind, kind))
        sql_functions.create_predict(spark, call.split("(")[0], fam, _model(kind, df), f"{kind}_rows")
        return rounded(spark.sql(f"select key, {'prob, pred' if kind == 'logit' else 'prediction'} from {call}"))

    _query(f"{_kind}_predict__sql", ORACLES[f"{_kind}_predict__{_NAMES.get(_kind, 'plain')}"])(_sql)


@_query("dummy_encode__priority", """select o_orderkey, """ + ", ".join(f"""cast(o_orderpriority = '{v}' as int) as "o_orderpriority_{v}" """ for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " from orders")
def dummies(spark, sf_dir):
    return api.encode_dummies(files(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")


@_query("dummy_encode_sql__priority", ORACLES["dummy_encode__priority"])
def dummies_sql(spark, sf_dir):
    files(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").createOrReplaceTempView("priorities")
    return spark.sql(api.dummy_encode_sql("priorities", "o_orderkey"))
