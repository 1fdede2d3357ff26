"""Row-level losses, errors, gradients and Hessians as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, col, flag

CONSTRAINTS = ("equalized_loss", "positive_rate", "true_positive_rate", "true_negative_rate")
ERROR_TYPES = ("MSE", "0/1 Loss", "FP", "FN", "Log-Loss", "FP-Log-Loss", "FN-Log-Loss")
EVAL_EPS = 1e-15
TRAIN_EPS = 1e-7


def logloss(y: Column | str, p: Column | str, eps: float = EVAL_EPS) -> Column:
    """Binary cross-entropy with the probability clipped to ``[eps, 1 - eps]``."""
    y, q = col(y), clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def sigmoid(margin: Column | str, eps: float = TRAIN_EPS) -> Column:
    """Logistic function, clipped as in training; ``eps=0`` leaves it unclipped."""
    p = 1 / (1 + F.exp(-col(margin)))
    return clip(p, eps, 1 - eps) if eps else p


def logloss_grad(y: Column | str, p: Column | str) -> Column:
    return col(p) - col(y)


def logloss_hess(y: Column | str, p: Column | str) -> Column:
    return col(p) * (1 - col(p))


def constraint_rows(y: Column | str, kind: str) -> Column:
    """Which rows a group constraint looks at."""
    if kind not in CONSTRAINTS:
        raise ValueError(f"unknown constraint {kind!r}; expected one of {CONSTRAINTS}")
    y = col(y)
    return {"true_positive_rate": y == 1, "true_negative_rate": y == 0}.get(kind, F.lit(True))


def constraint_target(y: Column | str, kind: str) -> Column:
    """The label the constraint compares with: 1 for ``positive_rate``, the true label otherwise."""
    return F.lit(1) if kind == "positive_rate" else col(y)


def constraint_loss(y: Column | str, p: Column | str, kind: str, eps: float = EVAL_EPS) -> Column:
    """Log-loss under a group constraint; NULL on rows outside it, so that ``avg`` skips them."""
    return F.when(constraint_rows(y, kind), logloss(constraint_target(y, kind), p, eps))


def constraint_grad(y: Column | str, p: Column | str, kind: str) -> Column:
    return F.when(constraint_rows(y, kind), logloss_grad(constraint_target(y, kind), p)).otherwise(F.lit(0.0))


def constraint_hess(y: Column | str, p: Column | str, kind: str) -> Column:
    return F.when(constraint_rows(y, kind), logloss_hess(y, p)).otherwise(F.lit(0.0))


def sq_loss(y: Column | str, yhat: Column | str) -> Column:
    d = col(y) - col(yhat)
    return d * d


def sq_grad(y: Column | str, yhat: Column | str) -> Column:
    return 2.0 * (col(yhat) - col(y))


def sq_hess() -> Column:
    return F.lit(2.0)


def sample_error(y: Column | str, pred: Column | str, p: Column | str, kind: str) -> Column:
    """Per-row error of a game round.

    ``pred`` is the hard decision (or the regression value for ``MSE``), ``p`` the probability. ``FN-Log-Loss`` covers all
    positives, not only the missed ones; ``FP-Log-Loss`` covers rows predicted above their label.
    """
    y, pred = col(y), col(pred)
    if kind == "MSE":
        return sq_loss(y, pred)
    if kind == "0/1 Loss":
        return flag(y != pred).cast("double")
    if kind == "FP":
        return flag(y < pred).cast("double")
    if kind == "FN":
        return flag(y > pred).cast("double")
    if kind == "Log-Loss":
        return logloss(y, p)
    if kind == "FP-Log-Loss":
        return flag(y < pred) * logloss(y, p)
    if kind == "FN-Log-Loss":
        return flag(y == 1) * logloss(y, p)
    raise ValueError(f"unknown error type {kind!r}; expected one of {ERROR_TYPES}")


def error_rows(y: Column | str, kind: str) -> Column:
    """Rows in the denominator of a group error: negatives for FP kinds, positives for FN kinds, all otherwise."""
    if kind.startswith("FP"):
        return col(y) == 0
    if kind.startswith("FN"):
        return col(y) == 1
    return F.lit(True)


def zero_one(y: Column | str, p: Column | str) -> Column:
    """1 where the decision ``p > 0.5`` misses the label."""
    return flag(col(y) != flag(col(p) > 0.5))


def penalty(coef: Column | str, kind: str, c: float) -> Column:
    """Regularisation term of a coefficient array: ``sum|w| / C`` or half of ``sum w^2 / C``."""
    coef = col(coef)
    if kind == "l1":
        return F.aggregate(coef, F.lit(0.0), lambda a, w: a + F.abs(w)) / F.lit(float(c))
    if kind == "l2":
        return F.aggregate(coef, F.lit(0.0), lambda a, w: a + w * w) / F.lit(2.0 * c)
    raise ValueError("penalty kind must be 'l1' or 'l2'")
