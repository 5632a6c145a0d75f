"""SQL that computes one-feature models on DuckDB, to hold the registered queries against.

Every model has an intercept and one feature ``x``; Fisher scoring runs in a recursive query with the 2 x 2 system solved
in place, from the log of the mean outcome (or 0).
"""

from __future__ import annotations

POWER, ALPHA = 1.5, 0.5
Z = 1.959963984540054

_LOG = dict(mu="exp({eta})", start="(select ln(avg(y)) from d)")
FAMILIES = {
    "linreg": dict(mu="{eta}", w="1.0", r="y - mu", h="1.0", v="1.0", dev="(y - mu) * (y - mu)", start="0.0", phi=True),
    "logit": dict(mu="1.0 / (1.0 + exp(-({eta})))", w="mu * (1 - mu)", r="y - mu", h="mu * (1 - mu)", v="mu * (1 - mu)", dev="-2 * (y * ln(mu) + (1 - y) * ln(1 - mu))", start="0.0", phi=False),
    "poisson": dict(_LOG, w="mu", r="y - mu", h="mu", v="mu", dev="2 * (case when y > 0 then y * ln(y / mu) else 0 end - (y - mu))", phi=False),
    "gamma": dict(_LOG, w="1.0", r="y / mu - 1", h="y / mu", v="mu * mu", dev="2 * ((y - mu) / mu - ln(y / mu))", phi=True),
    "tweedie": dict(
        _LOG, w="sqrt(mu)", r="(y - mu) / sqrt(mu)", h="0.5 * sqrt(mu) + 0.5 * y / sqrt(mu)", v="mu * sqrt(mu)",
        dev="2 * (sqrt(y) / (-0.25) + y / sqrt(mu) / 0.5 + sqrt(mu) / 0.5)", phi=True,
    ),
    "nbinom": dict(
        _LOG, w="mu / (1 + 0.5 * mu)", r="(y - mu) / (1 + 0.5 * mu)", h="mu * (1 + 0.5 * y) / ((1 + 0.5 * mu) * (1 + 0.5 * mu))", v="mu * (1 + 0.5 * mu)",
        dev="2 * (case when y > 0 then y * ln(y / mu) else 0 end - (y + 2) * ln((1 + 0.5 * y) / (1 + 0.5 * mu)))", phi=False,
    ),
}


def fit_cte(kind: str, data: str) -> str:
    """CTEs d (key, y, x, o, a), beta (b0, b1) and m (d with mu)."""
    f = FAMILIES[kind]
    mu = f["mu"].format(eta="o + b0 + b1 * x")
    return f"""with recursive d as ({data}), steps as (
  select 0 as k, cast({f["start"]} as double) as b0, cast(0 as double) as b1
  union all
  select k + 1, b0 + (s11 * r0 - s01 * r1) / (s00 * s11 - s01 * s01), b1 + (s00 * r1 - s01 * r0) / (s00 * s11 - s01 * s01)
  from (select k, b0, b1, sum(a * {f["w"]}) as s00, sum(a * {f["w"]} * x) as s01, sum(a * {f["w"]} * x * x) as s11, sum(a * ({f["r"]})) as r0, sum(a * ({f["r"]}) * x) as r1
        from (select k, b0, b1, y, x, o, a, {mu} as mu from steps, d where k < 25) group by k, b0, b1)
), beta as (select b0, b1 from steps where k = 25), m as (select d.*, b0, b1, {mu} as mu from d, beta)"""


def fit(kind: str, data: str) -> str:
    return f"{fit_cte(kind, data)} select '(Intercept)' as feature, round(b0, 6) + 0.0 as coefficient from beta union all select 'x', round(b1, 6) + 0.0 from beta"


def predict(kind: str, data: str) -> str:
    if kind == "logit":
        return f"{fit_cte(kind, data)} select key, round(mu, 6) as prob, mu >= 0.5 as pred from m"
    return f"{fit_cte(kind, data)} select key, round(mu, 6) as prediction from m"


def _cov(kind: str, bread: str = "w") -> str:
    """CTE c: the inverse information (i00, i01, i11), n and the dispersion."""
    f = FAMILIES[kind]
    return f""", g as (select count(*) as n, sum(a * ({f[bread]})) as s00, sum(a * ({f[bread]}) * x) as s01, sum(a * ({f[bread]}) * x * x) as s11, sum(a * (y - mu) * (y - mu) / ({f["v"]})) as chi from m),
c as (select n, s11 / (s00 * s11 - s01 * s01) as i00, -s01 / (s00 * s11 - s01 * s01) as i01, s00 / (s00 * s11 - s01 * s01) as i11, {"chi / (n - 2)" if f["phi"] else "1.0"} as phi from g)"""


def normal_tail(z: str) -> str:
    """P(Z > z) for z >= 0, from the series of odd powers over odd factorials."""
    term = f"exp((2 * k + 1) * ln(greatest({z}, 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))"
    return f"(case when {z} > 8 then 0.0 else 0.5 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: {term})) end)"


def student_inside(t: str, nu: str) -> str:
    """P(|T| < t) for t >= 0 and whole degrees of freedom, from the finite series in the cosine of atan(t / sqrt(nu))."""
    angle = f"atan({t} / sqrt({nu}))"
    even = f"list_sum(list_transform(range(0, cast({nu} // 2 as bigint)), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2) + 2 * k * ln(cos({angle})))))"
    odd = f"coalesce(list_sum(list_transform(range(0, cast(({nu} - 1) // 2 as bigint)), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(cos({angle}))))), 0.0)"
    return f"(case when {nu} % 2 = 0 then sin({angle}) * {even} else 2 / pi() * ({angle} + sin({angle}) * {odd}) end)"


def _critical(nu: str) -> str:
    """Student's 0.975 quantile from the normal one (the expansion in 1 / nu, exact to double precision beyond some hundred)."""
    z = Z
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z}" + "".join(f" + {c} / ({nu}) ** {i}" for i, c in enumerate(terms, 1)) + ")"


def full_summary(kind: str, data: str) -> str:
    """All columns, with p-values and Student's band where the dispersion is estimated."""
    phi = FAMILIES[kind]["phi"]
    crit = _critical("nu") if phi else str(Z)
    p = f"1 - {student_inside('abs(b / se)', 'nu')}" if phi else f"2 * {normal_tail('abs(b / se)')}"
    return f"""{fit_cte(kind, data)}{_cov(kind)}, r as (
  select '(Intercept)' as feature, b0 as b, sqrt(phi * i00) as se, cast(n - 2 as bigint) as nu from beta, c union all select 'x', b1, sqrt(phi * i11), cast(n - 2 as bigint) from beta, c)
select feature, round(b, 6) + 0.0 as coefficient, round(se, 6) as std_error, round(b / se, 4) + 0.0 as statistic, round({p}, 6) + 0.0 as p_value, round(b - {crit} * se, 6) + 0.0 as conf_low, round(b + {crit} * se, 6) + 0.0 as conf_high from r"""


def summary(kind: str, data: str, robust: str = "none") -> str:
    f, band = FAMILIES[kind], f", round(b - {Z} * se, 6) as conf_low, round(b + {Z} * se, 6) as conf_high"
    if robust == "none":
        cov = _cov(kind) + ", v as (select phi * i00 as v0, phi * i11 as v1 from c)"
    else:
        h = f"(a * ({f['h']}) * (i00 + 2 * i01 * x + i11 * x * x))"
        weight = {"hc2": f" / (1 - {h})", "hc3": f" / ((1 - {h}) * (1 - {h}))"}.get(robust, "")
        if robust == "cluster":
            meat = f"select sum(g0 * g0) as m00, sum(g0 * g1) as m01, sum(g1 * g1) as m11, count(*) as groups from (select sum(a * ({f['r']})) as g0, sum(a * ({f['r']}) * x) as g1 from m group by cl)"
        else:
            s = f"a * ({f['r']}) * ({f['r']}){weight}"
            meat = f"select sum({s}) as m00, sum({s} * x) as m01, sum({s} * x * x) as m11, 2 as groups from m, c"
        factor = {"hc1": "n / (n - 2.0)", "cluster": "(groups / (groups - 1.0)) * ((n - 1.0) / (n - 2.0))"}.get(robust, "1.0")
        cov = _cov(kind, "h") + f""", meat as ({meat}), v as (
  select {factor} * (i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11) as v0, {factor} * (i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11) as v1 from c, meat)"""
    return f"""{fit_cte(kind, data)}{cov}
select feature, round(b, 6) + 0.0 as coefficient, round(se, 6) as std_error, round(b / se, 4) + 0.0 as statistic{"" if f["phi"] and robust == "none" else band}
from (select '(Intercept)' as feature, b0 as b, sqrt(v0) as se from beta, v union all select 'x', b1, sqrt(v1) from beta, v)"""


def predict_ci(kind: str, data: str) -> str:
    inv = FAMILIES[kind]["mu"]
    crit = _critical("n - 2") if FAMILIES[kind]["phi"] else Z
    low, high = (inv.format(eta=f"eta {sign} {crit} * se") for sign in "-+")
    return f"{fit_cte(kind, data)}{_cov(kind)} select key, round(mu, 6) as prediction, round({low}, 6) as conf_low, round({high}, 6) as conf_high from (select m.*, c.n, o + b0 + b1 * x as eta, sqrt(phi * (i00 + 2 * i01 * x + i11 * x * x)) as se from m, c)"


def influence(kind: str, data: str) -> str:
    f = FAMILIES[kind]
    return f"""{fit_cte(kind, data)}{_cov(kind, "h")}, r as (
  select key, a * ({f["h"]}) * (i00 + 2 * i01 * x + i11 * x * x) as hat, (y - mu) * sqrt(a) / sqrt({f["v"]}) as p, sign(y - mu) * sqrt(a * greatest({f["dev"]}, 0)) as dv, phi from m, c)
select key, round(hat, 9) as hat, round(p, 6) + 0.0 as pearson_resid, round(dv, 6) + 0.0 as deviance_resid, round(p / sqrt(phi * (1 - hat)), 6) + 0.0 as std_resid, round(p * p / phi * hat / (2 * (1 - hat) * (1 - hat)), 9) as cooks_distance from r"""


def evaluate(kind: str, data: str) -> str:
    f = FAMILIES[kind]
    null = f["dev"].replace("mu", "(select avg(y) from d)")
    rmse = "round(sqrt(sum((y - mu) * (y - mu)) / count(*)), 6) as rmse, round(avg(abs(y - mu)), 6) as mae"
    if kind == "linreg":
        rest = f"""{rmse}, round(1 - sse / sst, 6) as r2, round(1 - (sse / (n - 2)) / (sst / (n - 1)), 6) as adj_r2, round(ll, 4) as loglik, round(-2 * ll + 4, 4) as aic, round(-2 * ll + 2 * ln(n), 4) as bic"""
        sums = "select count(*) as n, sum((y - mu) * (y - mu)) as sse, sum((y - (select avg(y) from d)) * (y - (select avg(y) from d))) as sst, sqrt(sum((y - mu) * (y - mu)) / count(*)) as rmse, avg(abs(y - mu)) as mae from m"
        rest = rest.replace(rmse, "round(rmse, 6) as rmse, round(mae, 6) as mae")
        return f"{fit_cte(kind, data)} select n, {rest} from (select *, -n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1) as ll from ({sums}))"
    if kind == "logit":
        return f"""{fit_cte(kind, data)}, k as (select *, avg(rn) over (partition by mu) as rk from (select *, row_number() over (order by mu) as rn from m)),
s as (select count(*) as n, avg(case when (mu >= 0.5) = (y = 1) then 1.0 else 0.0 end) as acc, sum(y) as pos, sum(case when y = 1 then rk else 0 end) as ranks, sum(y * ln(mu) + (1 - y) * ln(1 - mu)) as ll, avg(y) as p from k)
select n, round(acc, 6) as accuracy, round((ranks - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) as auc, round(-ll / n, 6) as log_loss, round(ll, 4) as loglik, round(-2 * ll, 4) as deviance, round(-2 * ll0, 4) as null_deviance, round(1 - ll / ll0, 6) as pseudo_r2, round(-2 * ll + 4, 4) as aic, round(-2 * ll + 2 * ln(n), 4) as bic
from (select *, n * (p * ln(p) + (1 - p) * ln(1 - p)) as ll0 from s)"""
    ll = {"poisson": "y * ln(mu) - mu - lgamma(y + 1)", "nbinom": "lgamma(y + 2) - lgamma(2) - lgamma(y + 1) + 2 * ln(2 / (2 + mu)) + y * ln(mu / (2 + mu))"}.get(kind, "0.0")
    out = f"""{fit_cte(kind, data)} select n, round(rmse, 6) as rmse, round(mae, 6) as mae, {"round(ll, 4) as loglik, " if ll != "0.0" else ""}round(dev, 4) as deviance, round(null_dev, 4) as null_deviance, round(1 - dev / null_dev, 6) as pseudo_r2"""
    if kind != "poisson":
        out += ", round(chi / (n - 2), 6) as dispersion"
    if ll != "0.0":
        out += ", round(-2 * ll + 4, 4) as aic, round(-2 * ll + 2 * ln(n), 4) as bic"
    return f"{out} from (select count(*) as n, sqrt(sum((y - mu) * (y - mu)) / count(*)) as rmse, avg(abs(y - mu)) as mae, sum({f['dev']}) as dev, sum({null}) as null_dev, sum((y - mu) * (y - mu) / ({f['v']})) as chi, sum({ll}) as ll from m)"


#: Mean, weight and score on the solver's scale (outcomes over their mean), and deviance on the data's own, for a swept value v.
_SWEPT = {
    "linear": ("eta", "1.0", "t - mu", "pow((t - mu) * ys, 2)"),
    "logistic": ("1 / (1 + exp(-eta))", "mu * (1 - mu)", "t - mu", "-2 * (y * ln(greatest(mu, 1e-15)) + (1 - y) * ln(greatest(1 - mu, 1e-15)))"),
    "poisson": ("exp(eta)", "mu", "t - mu", "2 * (case when y > 0 then y * ln(t / mu) else 0 end - (y - mu * ym))"),
    "tweedie": ("exp(eta)", "pow(mu, 2 - v)", "(t - mu) * pow(mu, 1 - v)", "2 * (case when y > 0 then pow(y, 2 - v) / ((1 - v) * (2 - v)) else 0 end - y * pow(mu * ym, 1 - v) / (1 - v) + pow(mu * ym, 2 - v) / (2 - v))"),
    "nbinom": ("exp(eta)", "mu / (1 + v * ym * mu)", "(t - mu) / (1 + v * ym * mu)", "2 * (case when y > 0 then y * ln(t / mu) else 0 end - (y + 1 / v) * ln((1 + v * y) / (1 + v * mu * ym)))"),
}


def _rows(family: str, data: str) -> str:
    """CTEs d, s (means and deviations) and z: fold, y, standardized feature z, the solver's outcome t."""
    t = {"linear": "(y - ym) / ys", "logistic": "y"}.get(family, "y / ym")
    return f"""d as ({data}), s as (select avg(y) as ym, stddev_pop(y) as ys, avg(x) as xm, stddev_pop(x) as xs from d),
z as (select (row_number() over (order by key) - 1) % 5 as fold, y, (x - xm) / xs as z, {t} as t, ym, ys from d, s)"""


def _solved(family: str, grid: str, name: str, folds: str, sweep: str = "", steps: int = 20) -> str:
    """CTE ``name`` (i, v, m, b0, b1): for each value v of ``grid`` and fold m the model of all other rows after i steps;
    the slope takes the ridge or soft threshold of the sweep."""
    mu, w, r, _ = _SWEPT[family]
    ridge, cut = ("n * v" if sweep == "l2" else "0.0"), ("n * v" if sweep == "l1" else "0.0")
    return f"""{name} as (
  select 0 as i, cast(v as double) as v, m, cast(0 as double) as b0, cast(0 as double) as b1 from {grid}, {folds}
  union all
  select i + 1, v, m, (s00 * b0 + s01 * b1 + r0 - s01 * slope) / s00, slope
  from (select *, sign(q) * greatest(abs(q) - {cut}, 0) / (s11 + {ridge} - s01 * s01 / s00) as slope
    from (select *, s01 * b0 + s11 * b1 + r1 - s01 * (s00 * b0 + s01 * b1 + r0) / s00 as q
      from (select i, v, m, b0, b1, count(*) as n, sum({w}) as s00, sum({w} * z) as s01, sum({w} * z * z) as s11, sum({r}) as r0, sum(({r}) * z) as r1
        from (select *, {mu} as mu from (select i, v, m, b0, b1, z, t, ym, b0 + b1 * z as eta from {name} join z on z.fold <> m where i < {steps})) group by i, v, m, b0, b1)))
)"""


def _scored(family: str, solved: str, steps: int) -> str:
    mu, _, _, dev = _SWEPT[family]
    return f"select v, sum({dev}) / (select count(*) from z) as score from (select *, {mu} as mu from (select v, y, t, ym, ys, b0 + b1 * z as eta from {solved} join z on z.fold = m where i = {steps})) group by v"


_FOLDS = "(select unnest(range(5)) as m)"


def _values(grid: list[float]) -> str:
    return "(select unnest([" + ", ".join(f"cast({g} as double)" for g in grid) + "]) as v)"


def cv(sweep: str, family: str, data: str, grid: list[float], refine: int = 0) -> str:
    """A sweep of k = 5 folds; with ``refine``, that many points between the neighbours of the best."""
    steps = 3 if family == "linear" else 20
    out = f"with recursive {_rows(family, data)}, {_solved(family, _values(grid), 'm1', _FOLDS, sweep, steps)}, c1 as ({_scored(family, 'm1', steps)})"
    if refine:
        out += f""", b as (select v as best from c1 order by score, v limit 1),
e as (select coalesce((select max(v) from c1, b where v < best), (select best from b)) as lo, coalesce((select min(v) from c1, b where v > best), (select best from b)) as hi),
g as (select lo + (hi - lo) * i / {refine - 1}.0 as v from e, (select unnest(range({refine})) as i)), {_solved(family, "g", "m2", _FOLDS, sweep, steps)}, c2 as ({_scored(family, "m2", steps)})"""
    return f"{out} select round(v, 6) as {sweep}, round(score, 6) as cv_deviance from {'c2' if refine else 'c1'}"


def _likelihoods(solved: str) -> str:
    one = "lgamma(y + 1 / v) - lgamma(1 / v) - lgamma(y + 1) - 1 / v * ln(1 + v * mu) + y * ln(v * mu / (1 + v * mu))"
    return f"select v, sum({one}) as score from (select v, y, exp(b0 + b1 * z) * ym as mu from {solved}, z where i = 20) group by v"


def dispersion(data: str, grid: list[float], refine: int = 0) -> str:
    everything = "(select -1 as m)"
    out = f"with recursive {_rows('nbinom', data)}, {_solved('nbinom', _values(grid), 'm1', everything)}, c1 as ({_likelihoods('m1')})"
    if refine:
        out += f""", b as (select v as best from c1 order by score desc, v limit 1),
e as (select coalesce((select max(v) from c1, b where v < best), (select best from b)) as lo, coalesce((select min(v) from c1, b where v > best), (select best from b)) as hi),
g as (select lo + (hi - lo) * i / {refine - 1}.0 as v from e, (select unnest(range({refine})) as i)), {_solved("nbinom", "g", "m2", everything)}, c2 as ({_likelihoods("m2")})"""
    return f"{out} select round(v, 6) as alpha, round(score, 6) as loglik from {'c2' if refine else 'c1'}"


def penalized(family: str, sweep: str, value: float, data: str, digits: int) -> str:
    """Coefficients of one penalized fit on the feature's own scale (families whose outcome is not scaled)."""
    return f"""with recursive {_rows(family, data)}, {_solved(family, _values([value]), "m1", "(select -1 as m)", sweep, 40)}
select '(Intercept)' as feature, round(b0 - b1 * xm / xs, {digits}) + 0.0 as coefficient from m1, s where i = 40 union all select 'x', round(b1 / xs, {digits}) + 0.0 from m1, s where i = 40"""


def over(fn: str, source: str, digits: int) -> str:
    """A distribution function over rows (key, p, df) of ``source``, by series; quantiles by bisection of the series."""
    below = "case when x < 0 then {0} else 1 - {0} end"
    cdf = below.format(normal_tail("abs(x)")) if fn.startswith("norm") else below.format(f"(1 - {student_inside('abs(x)', 'df')}) / 2")
    if fn.endswith("cdf"):
        return f"select key, round({cdf}, {digits}) + 0.0 as v from (select key, p as x, df from ({source}))"
    return f"""with recursive b as (select key, p, df, cast(-1000 as double) as lo, cast(1000 as double) as hi, 0 as i from ({source})
  union all select key, p, df, case when f < p then x else lo end, case when f < p then hi else x end, i + 1 from (select *, {cdf} as f from (select *, (lo + hi) / 2 as x from b where i < 70)))
select key, round((lo + hi) / 2, {digits}) + 0.0 as v from b where i = 70"""


def softmax(data: str, steps: int = 90) -> str:
    """Softmax regression of y (a label) on x and h. Steps divide the gradient by a fixed bound of the Hessian, half of
    (I - 1/K) times the cross products of the centred rows, whose inverse is known; with labels that lean little on x and h
    they gain a digit in five."""
    return f"""with recursive d as ({data}), a as (select avg(x) as mx, avg(h) as mh from d), k as (select y, row_number() over (order by y) - 1 as k from (select distinct y from d)),
r as (select k.k as c, x - mx as x, h - mh as h from d join k using (y), a),
m as (select count(*) as n, sum(x * x) as sxx, sum(x * h) as sxh, sum(h * h) as shh from r),
w as (select n, shh / (sxx * shh - sxh * sxh) as ixx, -sxh / (sxx * shh - sxh * sxh) as ixh, sxx / (sxx * shh - sxh * sxh) as ihh from m),
o as (select k as j from k where k > 0),
s as (select 0 as i, list_transform(range(1, (select count(*) from k)), lambda v: cast(0 as double)) as b0, list_transform(range(1, (select count(*) from k)), lambda v: cast(0 as double)) as b1, list_transform(range(1, (select count(*) from k)), lambda v: cast(0 as double)) as b2
  union all
  select i + 1, list(b0[j] + 2 * (g0 + t0) / n order by j), list(b1[j] + 2 * (ixx * (g1 + t1) + ixh * (g2 + t2)) order by j), list(b2[j] + 2 * (ixh * (g1 + t1) + ihh * (g2 + t2)) order by j)
  from (select *, sum(g0) over () as t0, sum(g1) over () as t1, sum(g2) over () as t2 from (
    select i, b0, b1, b2, j, sum(q) as g0, sum(q * x) as g1, sum(q * h) as g2 from (
      select i, b0, b1, b2, x, h, j, case when c = j then 1.0 else 0.0 end - e[j] / (1 + list_sum(e)) as q from (
        select *, list_transform(b0, lambda v, p: exp(v + b1[p] * x + b2[p] * h)) as e from s, r where i < {steps}), o)
    group by i, b0, b1, b2, j)), w group by i),
z as (select b0, b1, b2, mx, mh from s, a where i = {steps})
select y as class, '(Intercept)' as feature, round(case when k = 0 then 0.0 else b0[k] - b1[k] * mx - b2[k] * mh end, 6) + 0.0 as coefficient from k, z
union all select y, 'x', round(case when k = 0 then 0.0 else b1[k] end, 6) + 0.0 from k, z union all select y, 'h', round(case when k = 0 then 0.0 else b2[k] end, 6) + 0.0 from k, z"""


def saturated(data: str, prefix: str, link: str = "{0}") -> str:
    """A model of y on the dummies of one label ``g`` alone: differences of the groups' (linked) means to the lowest one's."""
    mean = link.format("avg(y)")
    return f"""with g as (select g, {mean} as v from ({data}) group by g), b as (select v as base from g order by g limit 1)
select case when v is null then '' when g = (select min(g) from g) then '(Intercept)' else '{prefix}' || g end as feature, round(case when g = (select min(g) from g) then v else v - base end, 6) + 0.0 as coefficient from g, b"""


def cv_pairs(data: str, grid: list[float], k: int = 5, nulls: str = "last") -> str:
    """A linear ridge sweep over two features (x, h): normal equations of each training part, centred and solved in place."""
    return f"""with d as ({data}), s as (select avg(y) as ym, stddev_pop(y) as ys, avg(x) as xm, stddev_pop(x) as xs, avg(h) as hm, stddev_pop(h) as hs from d),
z as (select (row_number() over (order by key nulls {nulls}) - 1) % {k} as fold, (y - ym) / ys as t, (x - xm) / xs as x, (h - hm) / hs as h, ys from d, s),
f as (select unnest(range({k})) as m), v as (select unnest([{", ".join(f"cast({g} as double)" for g in grid)}]) as v),
t as (select m, count(*) as n, avg(t) as mt, avg(x) as mx, avg(h) as mh, var_pop(x) as vx, var_pop(h) as vh, covar_pop(x, h) as vxh, covar_pop(x, t) as vxt, covar_pop(h, t) as vht from z join f on fold <> m group by m),
b as (select v, m, mt, mx, mh, ((vh + v) * vxt - vxh * vht) / ((vx + v) * (vh + v) - vxh * vxh) as b1, ((vx + v) * vht - vxh * vxt) / ((vx + v) * (vh + v) - vxh * vxh) as b2 from t, v)
select v as l2, round(avg(pow((t - mt - b1 * (x - mx) - b2 * (h - mh)) * ys, 2)), 6) as cv_deviance from z join b on fold = m group by v"""
