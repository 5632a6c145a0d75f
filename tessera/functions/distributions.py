"""Normal and Student-t distributions on the driver and as columns, and the log-gamma column."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_ppf(p: float) -> float | None:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else {0: -math.inf, 1: math.inf}.get(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards (modified Lentz)."""
    tiny = 1e-300
    guard = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1 / guard(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / guard(1 + top * d), guard(1 + top / c)
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    return 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))


def student_cdf(t: float, df: float) -> float:
    return 1 - student_tail(t, df) if t >= 0 else student_tail(-t, df)


def student_ppf(p: float, df: float) -> float | None:
    if not 0 < p < 1:
        return {0: -math.inf, 1: math.inf}.get(p)
    if p < 0.5:
        return -student_ppf(1 - p, df)
    low, high = 0.0, 2.0
    while student_cdf(high, df) < p:
        high *= 2
    t = min(max(normal_ppf(p), low), high)
    log_norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    for _ in range(100):  # Newton steps kept inside the bracket
        gap = (1 - p) - student_tail(t, df)
        low, high = (t, high) if gap < 0 else (low, t)
        step = t - gap / math.exp(log_norm - (df + 1) / 2 * math.log1p(t * t / df)) if gap else t
        new = step if low <= step <= high else (low + high) / 2
        if abs(new - t) <= 1e-15 * max(1.0, abs(t)):
            return new
        t = new
    return t


#: Stirling's series (fixed values): power, coefficient.
_STIRLING = ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188))


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: the argument is raised by eight, where Stirling's series is exact to double precision."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
    for k, c in _STIRLING:
        series = series + c / F.pow(z, F.lit(float(k)))
    return series - sum((F.log(x + float(k)) for k in range(1, 8)), F.log(x))


def _let(value: Column, body) -> Column:
    """``value`` evaluated once and handed to ``body``; an expression used inside a loop would be evaluated in each turn."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turns(first: int, last: int | Column) -> Column:
    return F.sequence(F.lit(first), last if isinstance(last, Column) else F.lit(last), F.lit(1 if isinstance(last, Column) or last >= first else -1))


def _normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: the series of odd powers near 0, the continued fraction of Mills' ratio beyond."""

    def add(state, k):
        return _let(state["term"] * z * z / (2.0 * k + 1.0), lambda term: F.struct(term.alias("term"), (state["total"] + term).alias("total")))

    series = F.aggregate(_turns(1, 45), F.struct(z.alias("term"), z.alias("total")), add, lambda state: state["total"])
    ratio = F.aggregate(_turns(60, 1), z, lambda r, k: z + k / r)
    return F.when(z < 3.0, 0.5 - _normal_density(z) * series).otherwise(_normal_density(z) / ratio)


def norm_cdf(z: Column) -> Column:
    """P(Z <= z); NULL for NULL and NaN."""
    z = z.cast("double")
    half = _let(F.abs(z), _normal_tail)
    return F.when(z.isNotNull() & ~F.isnan(z), _let(half, lambda h: F.when(z < 0, h).otherwise(1.0 - h)))


#: The rational approximation of the normal quantile that Newton's steps start from (fixed values).
_START_TOP, _START_BOTTOM = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)


def _normal_upper(q: Column) -> Column:
    """The z >= 0 with P(Z > z) = q, for 0 < q <= 1/2: Newton's steps in the logarithm of the tail."""

    def start(w):
        top = sum(c * F.pow(w, F.lit(float(k))) for k, c in enumerate(_START_TOP))
        bottom = sum(c * F.pow(w, F.lit(float(k))) for k, c in enumerate(_START_BOTTOM))
        return F.greatest(w - top / bottom, F.lit(0.0))

    def closer(z, _):
        return _let(_normal_tail(z), lambda t: F.greatest(z + (F.log(t) - F.log(q)) * t / _normal_density(z), F.lit(0.0)))

    return F.aggregate(_turns(1, 4), _let(F.sqrt(-2.0 * F.log(q)), start), closer)


def _mirrored(p: Column, upper) -> Column:
    """A symmetric distribution's quantile from that of the smaller tail; infinite at 0 and 1, NULL beyond and for NaN."""
    p = p.cast("double")
    inside = _let(F.least(p, 1.0 - p), lambda q: F.when(q == 0.5, F.lit(0.0)).otherwise(upper(q)))
    ends = F.when(p == 0.0, F.lit(-math.inf)).when(p == 1.0, F.lit(math.inf))
    return ends.when((p > 0.0) & (p < 1.0), _let(inside, lambda t: F.when(p < 0.5, -t).otherwise(t)))


def norm_ppf(p: Column) -> Column:
    return _mirrored(p, _normal_upper)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function by forward steps (modified Lentz). It settles in some
    sqrt(max(a, b)) steps on the side where it is used."""
    guard = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(F.lit(1e-300))

    def step(state, top):
        both = _let(top, lambda t: F.struct(guard(1.0 + t / state["c"]).alias("c"), (1.0 / guard(1.0 + t * state["d"])).alias("d")))
        return _let(both, lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (state["h"] * s["c"] * s["d"]).alias("h")))

    def turn(state, m):
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        settled = F.abs(state["c"] * state["d"] - 1.0) < 1e-16
        return F.when(settled, state).otherwise(_let(step(state, even), lambda s: step(s, odd)))

    first = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    begin = _let(first, lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))
    many = F.least(F.lit(400), (40.0 + 4.0 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(_turns(1, many), begin, turn, lambda state: state["h"])


def _half_step(a: Column) -> Column:
    """log Gamma(a + 1/2) - log Gamma(a); for large a by the series of the difference, whose terms do not cancel."""
    series = 0.5 * F.log(a) - 1.0 / (8.0 * a) + 1.0 / (192.0 * a * a * a) - 1.0 / (640.0 * a * a * a * a * a)
    return F.when(a > 100.0, series).otherwise(lgamma(a + 0.5) - lgamma(a))


def _student_tail(t: Column, df: Column) -> Column:
    """P(T > t) for t >= 0, from the incomplete beta function at df / (df + t * t)."""

    def half(s):
        front = F.exp(s["n"] + s["a"] * F.log(s["x"]) + 0.5 * F.log(s["y"]))
        near = front * _fraction(s["a"], F.lit(0.5), s["x"]) / s["a"]
        return 0.5 * F.when(s["x"] < (s["a"] + 1.0) / (s["a"] + 2.5), near).otherwise(1.0 - front * _fraction(F.lit(0.5), s["a"], s["y"]) / 0.5)

    norm = _half_step(df / 2.0) - 0.5 * math.log(math.pi)
    parts = F.struct((df / 2.0).alias("a"), (df / (df + t * t)).alias("x"), (t * t / (df + t * t)).alias("y"), norm.alias("n"))
    return F.when(t == 0.0, F.lit(0.5)).when(t * t > 1e290, F.lit(0.0)).otherwise(_let(parts, half))


def _numbers(t: Column, df: Column) -> Column:
    return t.isNotNull() & df.isNotNull() & ~F.isnan(t) & ~F.isnan(df) & (df > 0.0)


def t_cdf(t: Column, df: Column) -> Column:
    """P(T <= t) with ``df`` degrees of freedom; NULL for NULL, NaN and df <= 0."""
    t, df = t.cast("double"), df.cast("double")
    half = _let(F.struct(F.abs(t).alias("t"), df.alias("v")), lambda s: _student_tail(s["t"], s["v"]))
    return F.when(_numbers(t, df), _let(half, lambda h: F.when(t < 0, h).otherwise(1.0 - h)))


def t_ppf(p: Column, df: Column) -> Column:
    """Quantiles. The tail's logarithm falls ever faster in the logarithm of t, so Newton's steps in both logarithms find
    the root from any start; they begin at the normal quantile's expansion in 1 / df."""

    def upper(q):
        def start(z):
            return z + (F.pow(z, F.lit(3.0)) + z) / (4.0 * v) + (5.0 * F.pow(z, F.lit(5.0)) + 16.0 * F.pow(z, F.lit(3.0)) + 3.0 * z) / (96.0 * v * v)

        log_norm = _half_step(v / 2.0) - 0.5 * F.log(v * math.pi)

        def closer(state, _):
            def moved(s):
                slope = state["t"] * F.exp(state["n"] - (v + 1.0) / 2.0 * F.log1p(state["t"] * state["t"] / v)) / s
                return F.struct((state["t"] * F.exp((F.log(s) - F.log(q)) / slope)).alias("t"), state["n"].alias("n"), (F.abs(F.log(s) - F.log(q)) < 1e-15 * F.greatest(slope, F.lit(1.0))).alias("done"))

            return F.when(state["done"], state).otherwise(_let(_student_tail(state["t"], v), moved))

        begin = _let(_normal_upper(q), lambda z: F.struct(F.greatest(start(z), F.lit(1e-12)).alias("t"), log_norm.alias("n"), F.lit(False).alias("done")))
        found = F.aggregate(_turns(1, 40), begin, closer, lambda state: state["t"])
        return F.when(v == 1.0, F.cos(math.pi * q) / F.sin(math.pi * q)).otherwise(found)

    v = df.cast("double")
    return F.when(_numbers(p.cast("double"), v), _mirrored(p, upper))
