"""Models as functions of a session's SQL, made by ``create temporary function``: the formula is inlined into the query
that calls them, so that it is optimized and compiled with it.

A table function cannot take the name of a table as an argument (Spark asks for a constant there), so it is made for one
model and one table or view.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.operators.families import Family, ModelError
from tessera.operators.fitting import INTERCEPT, quoted
from tessera.operators.scoring import coefficients

_MEANS = {"logistic": "1D / (1D + exp(-({0})))", "linear": "{0}"}


def _number(column: str) -> str:
    return f"nullif(try_cast({column} as double), double('NaN'))"


def _formula(fam: Family, beta: dict[str, float], columns: dict[str, str], offset: str | None) -> str:
    """The mean as SQL text. ``columns``: SQL for each feature; a feature that has none makes it NULL."""
    terms = [f"{beta[INTERCEPT]!r}D", *([offset] if offset else [])]
    terms += [f"{b!r}D * {columns.get(c, 'cast(null as double)')}" for c, b in beta.items() if c != INTERCEPT]
    return _MEANS.get(fam.name, "exp({0})").format(" + ".join(terms))


def create_mean(spark: SparkSession, name: str, fam: Family, model) -> None:
    """A function of the features by name and of ``reg_offset`` (0 unless given) that gives the mean."""
    beta = coefficients(model)
    features = [c for c in beta if c != INTERCEPT]
    given = ", ".join([*(f"{quoted(c)} double" for c in features), "reg_offset double default 0"])
    spark.sql(f"create or replace temporary function {name}({given}) returns double return {_formula(fam, beta, {c: quoted(c) for c in features}, 'reg_offset')}")


def create_predict(spark: SparkSession, name: str, fam: Family, model, source: str, offset_col: str | None = None) -> None:
    """A table function that gives the rows of the table or view ``source`` with what the family's predict adds; for
    logistic models it takes ``threshold`` (0.5 unless given)."""
    df, beta = spark.table(source), coefficients(model)
    logistic = fam.name == "logistic"
    added = {"prob": "double", "pred": "boolean"} if logistic else {"prediction": "double"}
    if clash := {c.lower() for c in df.columns} & {*added}:
        raise ModelError(f'the table already has a "{min(clash)}" column')
    present = {c: _number(f"src.{quoted(c)}") for c in df.columns}
    offset = present.get(offset_col, "cast(null as double)") if offset_col else None
    mean = _formula(fam, beta, present, offset)
    out = f"{mean}, {mean} >= {name}.threshold" if logistic else mean
    shape = ", ".join(f"{quoted(c)} {kind}" for c, kind in [*df.dtypes, *added.items()])
    spark.sql(f"create or replace temporary function {name}({'threshold double default 0.5' if logistic else ''}) returns table({shape}) return select src.*, {out} from {source} as src")
