"""The public functions, one for each family and task, with the argument order of their definitions."""

from __future__ import annotations

from tessera.operators import fitting, inference, multinomial, scoring, selection
from tessera.operators.families import family

_KINDS = {"logit": "logistic", "linreg": "linear", "poisson": "poisson", "gamma": "gamma", "tweedie": "tweedie", "nbinom": "nbinom"}
_EXTRA = {"tweedie": ("power", 1.5), "nbinom": ("alpha", 1.0)}


def _define(short: str) -> dict:
    kind, (extra, default) = _KINDS[short], _EXTRA.get(short, (None, None))

    def split(args: tuple, options: dict):
        """The family, and the positional arguments besides its parameter, which is the first unless it has been named."""
        if not extra:
            return family(kind), args
        if extra in options:
            return family(kind, **{extra: options.pop(extra)}), args
        return family(kind, **{extra: args[0] if args else default}), args[1:]

    def fit(tbl, outcome, *args, **options):
        fam, rest = split(args, options)
        return fitting.fit(fam, tbl, outcome, *rest, **options)

    def evaluate(model, tbl, outcome, *args, **options):
        fam, rest = split(args, options)
        return scoring.evaluate(fam, model, tbl, outcome, *rest, **options)

    def summary(model, tbl, outcome, *args, **options):
        fam, rest = split(args, options)
        return inference.summary(fam, model, tbl, outcome, *rest, **options)

    def predict_ci(model, tbl, outcome, newdata=None, *args, **options):
        fam, rest = split(args, options)
        return inference.predict_ci(fam, model, tbl, outcome, newdata, *rest, **options)

    def influence(model, tbl, outcome, *args, **options):
        fam, rest = split(args, options)
        return inference.influence(fam, model, tbl, outcome, *rest, **options)

    fam = split((), {})[0]
    if short == "logit":

        def predict(model, tbl, threshold=0.5, offset_col=None):
            return scoring.predict(fam, model, tbl, threshold, offset_col)

    else:

        def predict(model, tbl, offset_col=None):
            return scoring.predict(fam, model, tbl, offset_col=offset_col)

    return {f"{short}_{f.__name__}": f for f in (fit, predict, evaluate, summary, predict_ci, influence)}


for _short in _KINDS:
    globals().update(_define(_short))

multinom_fit, multinom_predict, multinom_evaluate, multinom_summary = multinomial.fit, multinomial.predict, multinomial.evaluate, multinomial.summary
reg_grid, dummy_encode_sql, encode_dummies = selection.reg_grid, selection.dummy_encode_sql, selection.encode_dummies
nbinom_dispersion, nbinom_dispersion_refine = selection.nbinom_dispersion, selection.nbinom_dispersion_refine


def cv_l2(tbl, outcome, family_name, grid, k=5, *args, **options):
    return selection.cross_validate("l2", tbl, outcome, family_name, grid, k, *args, **options)


def cv_l1(tbl, outcome, family_name, grid, k=5, *args, **options):
    return selection.cross_validate("l1", tbl, outcome, family_name, grid, k, *args, **options)


def cv_power(tbl, outcome, grid, k=5, *args, **options):
    return selection.cross_validate("power", tbl, outcome, "tweedie", grid, k, *args, **options)


def cv_alpha(tbl, outcome, grid, k=5, *args, **options):
    return selection.cross_validate("alpha", tbl, outcome, "nbinom", grid, k, *args, **options)


def cv_l2_refine(tbl, outcome, family_name, grid, k=5, n_refine=10, *args, **options):
    return selection.cross_validate_refine("l2", tbl, outcome, family_name, grid, k, n_refine, *args, **options)


def cv_l1_refine(tbl, outcome, family_name, grid, k=5, n_refine=10, *args, **options):
    return selection.cross_validate_refine("l1", tbl, outcome, family_name, grid, k, n_refine, *args, **options)


def cv_power_refine(tbl, outcome, grid, k=5, n_refine=10, *args, **options):
    return selection.cross_validate_refine("power", tbl, outcome, "tweedie", grid, k, n_refine, *args, **options)


def cv_alpha_refine(tbl, outcome, grid, k=5, n_refine=10, *args, **options):
    return selection.cross_validate_refine("alpha", tbl, outcome, "nbinom", grid, k, n_refine, *args, **options)
