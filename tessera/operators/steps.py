"""Solvers that see the data only through sums: each step asks for a gradient or a Hessian-vector product, which is one
pass over the rows where they lie. The driver holds a few vectors as long as the coefficients, no matrix."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def accelerated(slope: Callable, start: np.ndarray, step: float, l1: float, l2: float, free: np.ndarray, tol: float, max_iter: int, restart: bool = False) -> np.ndarray:
    """Accelerated proximal gradient steps. ``slope(beta)``: the gradient of the mean log-likelihood and the factor (1 or
    more) by which the step is to be damped. ``free``: 0 for coefficients without a penalty, else 1. With ``restart`` the
    momentum starts anew where it leads against the gradient, instead of swinging around the optimum: same optimum, same
    test of arrival, a fraction of the steps."""
    beta = before = start
    run = 0
    for _ in range(max_iter):
        look = beta + run / (run + 3) * (beta - before)
        right, damp = slope(look)
        new = look + step / damp * (right - l2 * free * look)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1 / damp * free, 0.0)
        run = 0 if restart and (look - new) @ (new - beta) > 0 else run + 1
        before, beta = beta, new
        if not np.isfinite(new).all() or np.abs(new - look).max() < tol:
            break
    return beta


def conjugate(product: Callable, right: np.ndarray, relative: float, most: int) -> np.ndarray:
    """The step that solves ``product(step) = right`` up to ``relative``; from zero, so that a singular system gives the
    solution of least norm. Directions without curvature end the search."""
    step, rest = np.zeros_like(right), right.copy()
    way, size = rest.copy(), float(rest @ rest)
    goal = size * relative**2
    for _ in range(most):
        if size <= goal or size == 0:
            break
        bent = product(way)
        curvature = float(way @ bent)
        if not curvature > 1e-14 * float(way @ way):
            break
        pace = size / curvature
        step, rest = step + pace * way, rest - pace * bent
        size, last = float(rest @ rest), size
        way = rest + size / last * way
    return step


def newton_cg(evaluate: Callable, multiply: Callable, start: np.ndarray, tol: float, max_iter: int) -> np.ndarray | None:
    """Newton steps found by conjugate gradients and halved until the loss falls. ``evaluate(beta)``: loss and its
    gradient; ``multiply(beta, v)``: the Hessian times ``v``. None where the steps do not settle."""
    beta = start
    loss, slope = evaluate(beta)
    first = float(np.linalg.norm(slope))
    for _ in range(max_iter):
        size = float(np.linalg.norm(slope))
        if not np.isfinite(size):
            return None
        if size == 0:
            return beta
        # the closer, the more exactly: superlinear at the end
        step = conjugate(lambda v, at=beta: multiply(at, v), -slope, min(0.1, max(1e-10, size / first)), 10 * len(beta))
        pace = 1.0
        for _ in range(40):
            new = beta + pace * step
            value, down = evaluate(new)
            if np.isfinite(value) and value <= loss + 1e-12 * abs(loss):
                break
            pace /= 2
        else:
            return beta if np.abs(step).max() < 1e-6 else None  # nothing to gain beyond rounding
        moved = float(np.abs(new - beta).max())
        beta, loss, slope = new, value, down
        if moved < tol:
            return beta
    return None
