"""The six outcome families. Each formula is written once and works on columns and on numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

COLUMNS = SimpleNamespace(
    exp=F.exp, log=F.log, power=lambda x, p: F.pow(x, F.lit(float(p))), low=lambda x, v: F.greatest(x, F.lit(float(v))), high=lambda x, v: F.least(x, F.lit(float(v))),
    where=lambda c, a, b: F.when(c, a).otherwise(b), one=lambda x: x * 0.0 + 1.0,
)
ARRAYS = SimpleNamespace(exp=np.exp, log=np.log, power=np.power, low=np.maximum, high=np.minimum, where=np.where, one=np.ones_like)


class ModelError(ValueError):
    """Bad input or a model that cannot be fitted."""


@dataclass(frozen=True)
class Family:
    """``extra``: Tweedie's power or the negative binomial's dispersion."""

    name: str
    extra: float | None = None

    @property
    def identity(self) -> bool:
        return self.name == "linear"

    @property
    def log_link(self) -> bool:
        return self.name not in ("linear", "logistic")

    @property
    def estimated(self) -> bool:
        """Whether the dispersion is estimated, so that inference uses Student's t."""
        return self.name in ("linear", "gamma", "tweedie")

    def mean(self, eta, m, clamp: bool = True):
        if self.identity:
            return eta
        if clamp:
            eta = m.high(m.low(eta, -700.0), 700.0)
        return 1.0 / (1.0 + m.exp(-eta)) if self.name == "logistic" else m.exp(eta)

    def information(self, mu, m):
        """Expected information of the linear predictor."""
        match self.name:
            case "linear" | "gamma":
                return m.one(mu)
            case "logistic":
                return mu * (1.0 - mu)
            case "poisson":
                return mu
            case "tweedie":
                return m.power(mu, 2.0 - self.extra)
            case _:
                return mu / (1.0 + self.extra * mu)

    def score(self, y, mu, m):
        match self.name:
            case "gamma":
                return y / mu - 1.0
            case "tweedie":
                return (y - mu) * m.power(mu, 1.0 - self.extra)
            case "nbinom":
                return (y - mu) / (1.0 + self.extra * mu)
            case _:
                return y - mu

    def observed(self, y, mu, m):
        """Observed information of the linear predictor."""
        match self.name:
            case "gamma":
                return y / mu
            case "tweedie":
                p = self.extra
                return (2.0 - p) * m.power(mu, 2.0 - p) + (p - 1.0) * y * m.power(mu, 1.0 - p)
            case "nbinom":
                a = self.extra
                return mu * (1.0 + a * y) / ((1.0 + a * mu) * (1.0 + a * mu))
            case _:
                return self.information(mu, m)

    def variance(self, mu, m):
        match self.name:
            case "linear":
                return m.one(mu)
            case "logistic":
                return mu * (1.0 - mu)
            case "poisson":
                return mu
            case "gamma":
                return mu * mu
            case "tweedie":
                return m.power(mu, self.extra)
            case _:
                return mu * (1.0 + self.extra * mu)

    def deviance(self, y, mu, m):
        """Unit deviance."""
        positive = m.low(y, 1e-300)
        y_log = None if self.identity else m.where(y > 0, y * (m.log(positive) - m.log(mu)), y * 0.0)
        match self.name:
            case "linear":
                return (y - mu) * (y - mu)
            case "logistic":
                p = m.high(m.low(mu, 1e-15), 1 - 1e-15)
                return -2.0 * (y * m.log(p) + (1.0 - y) * m.log(1.0 - p))
            case "poisson":
                return 2.0 * (y_log - (y - mu))
            case "gamma":
                return 2.0 * ((y - mu) / mu - m.log(positive / mu))
            case "tweedie":
                p = self.extra
                if p == 1:  # the limits at 1 and 2
                    return 2.0 * (y_log - (y - mu))
                if p == 2:
                    return 2.0 * ((y - mu) / mu - m.log(positive / mu))
                first = m.where(y > 0, m.power(positive, 2.0 - p), y * 0.0) / ((1.0 - p) * (2.0 - p)) if p < 2 else m.power(positive, 2.0 - p) / ((1.0 - p) * (2.0 - p))
                return 2.0 * (first - y * m.power(mu, 1.0 - p) / (1.0 - p) + m.power(mu, 2.0 - p) / (2.0 - p))
            case _:
                a = self.extra
                return 2.0 * (y_log - (y + 1.0 / a) * m.log((1.0 + a * y) / (1.0 + a * mu)))

    def scaled(self, mean: float) -> Family:
        """The family for outcomes divided by ``mean``."""
        return Family(self.name, self.extra * mean) if self.name == "nbinom" else self


def family(name: str, power: float | None = None, alpha: float | None = None) -> Family:
    if name == "tweedie":
        power = 1.5 if power is None else float(power)
        if not power >= 1:
            raise ModelError("tweedie: power must be >= 1")
        return Family(name, power)
    if name == "nbinom":
        alpha = 1.0 if alpha is None else float(alpha)
        if not alpha > 0:
            raise ModelError("nbinom: alpha (dispersion) must be > 0")
        return Family(name, alpha)
    if name not in ("logistic", "linear", "poisson", "gamma"):
        raise ModelError(f"unsupported family {name!r}")
    return Family(name)
