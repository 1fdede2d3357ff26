"""Dual updates on group weights.

Two forms of the same steps: plain functions on a handful of group values, used inside training loops, and table forms that run
many weight vectors at once (``vid`` names the vector, one row per group).
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import constraint_grad, constraint_hess, logloss_grad, logloss_hess
from ..functions.numeric import ratio
from ..lookup import attach, attach_totals, pin
from .ranks import prefix_sums, quantile_edges

DUAL_MODES = ("optim", "gradient", "gradient_norm", "gradient_norm2")
GAME_MODES = ("minimax", "relaxed", "equal")
TIE = 1e-12


# ---- group vectors on the driver -------------------------------------------------------------------------------------


def simplex(v: np.ndarray, z: float = 1.0) -> np.ndarray:
    """Euclidean projection of ``v`` onto the simplex of mass ``z``: subtract the largest running threshold, clip at zero."""
    top_down = np.sort(v)[::-1]
    shift = np.max((np.cumsum(top_down) - z) / np.arange(1, len(v) + 1))
    return np.maximum(v - shift, 0.0)


def dual_update(mu: np.ndarray, loss: np.ndarray, lam: float, eta: float, mode: str, scale_step_by_lambda: bool = True) -> np.ndarray:
    """Next group weights of the booster.

    ``optim`` puts the mass ``lam`` on the worst group (lowest id on ties, which allow for rounding in the sums); ``gradient`` climbs without projection; ``gradient_norm``
    projects the climb back; ``gradient_norm2`` shifts and rescales instead. Groups without a loss (no row under the constraint) do not
    move. The regressor leaves ``lam`` out of the step and, in ``gradient_norm2``, the shift.
    """
    if mode not in DUAL_MODES:
        raise ValueError(f"unknown dual mode {mode!r}; expected one of {DUAL_MODES}")
    known = np.where(np.isnan(loss), -np.inf, loss)
    if mode == "optim":
        out = np.zeros_like(mu)
        out[int(np.argmax(known >= known.max() - TIE * abs(known.max())))] = lam
        return out
    step = eta * (lam if scale_step_by_lambda else 1.0)
    if mode == "gradient":
        return mu + step * np.where(np.isnan(loss), 0.0, loss)
    moved = mu + step * np.where(np.isnan(loss), 0.0, loss - known.max())
    if mode == "gradient_norm":
        return simplex(moved, lam)
    if scale_step_by_lambda and moved.min() < 0:
        moved = moved - moved.min()
    mass = moved.sum()
    return moved / mass * lam if mass else np.full_like(mu, lam / len(mu))


def game_update(w: np.ndarray, lam: np.ndarray, share: np.ndarray, err: np.ndarray, eta: float, mode: str, gamma: float = 0.0, mean_err: float = 0.0):
    """Next ``(weights, multipliers)`` of the repeated game: exponential weights, relaxed to ``gamma``, or pushed to equal errors."""
    if mode == "minimax":
        out = w * np.exp(eta * err)
        return out / out.sum(), lam
    if mode == "relaxed":
        lam = np.maximum(0.0, lam + eta * (err - gamma))
        return share + lam, lam
    if mode == "equal":
        lam = lam + eta * (err - mean_err)
        return share * (1 - lam.sum()) + lam, lam
    raise ValueError(f"unknown game mode {mode!r}; expected one of {GAME_MODES}")


def step_size(a: float, b: float, t: int, max_abs_y: float | None = None) -> float:
    """``a * t^-b``, with ``a`` divided by the squared largest label when that is given."""
    return (a / max_abs_y**2 if max_abs_y else a) * t ** (-b)


# ---- table forms -----------------------------------------------------------------------------------------------------


def project_simplex(vectors: DataFrame, vid: str = "vid", mu: str = "mu", z: float = 1.0, out: str = "projected") -> DataFrame:
    """Project every vector onto the simplex of mass ``z``.

    The threshold of a vector is the largest ``(S_j - z) / j`` over its top-``j`` sums. The sums come from :func:`prefix_sums` on distinct
    values, so one very long vector is spread over all tasks.
    """
    values = vectors.groupBy(vid, mu).agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", F.col(mu) * F.col("_c"))
    run = prefix_sums(values, [vid], mu, ["_c", "_s"], descending=True, edges=quantile_edges(vectors, mu))
    shift = run.groupBy(vid).agg(F.max((F.col("cum__s") - F.lit(z)) / F.col("cum__c")).alias("_t"))
    return attach(vectors, shift, [vid]).withColumn(out, F.greatest(F.col(mu) - F.col("_t"), F.lit(0.0))).drop("_t")


def dual_step(state: DataFrame, mode: str, lam: float = 1.0, eta: float = 0.1, vid: str = "vid", scale_step_by_lambda: bool = True) -> DataFrame:
    """Table form of :func:`dual_update` on ``(vid, g, mu, loss)``; adds ``mu_new``."""
    if mode not in DUAL_MODES:
        raise ValueError(f"unknown dual mode {mode!r}; expected one of {DUAL_MODES}")
    state = pin(state).frame
    step = eta * (lam if scale_step_by_lambda else 1.0)
    if mode == "gradient":
        return state.withColumn("mu_new", F.col("mu") + F.lit(step) * F.col("loss"))
    if mode == "optim":
        worst = F.max_by("g", F.struct("loss", -F.col("g")))
        t = attach_totals(state, [vid], _worst=worst)
        return t.withColumn("mu_new", F.when(F.col("g") == F.col("_worst"), F.lit(float(lam))).otherwise(F.lit(0.0))).drop("_worst")
    t = attach_totals(state, [vid], _eps=F.max("loss"))
    t = t.withColumn("_m", F.col("mu") + F.lit(step) * (F.col("loss") - F.col("_eps"))).drop("_eps")
    if mode == "gradient_norm":
        return project_simplex(t, vid, "_m", lam, "mu_new").drop("_m")
    t = attach_totals(t, [vid], _low=F.least(F.min("_m"), F.lit(0.0)), _sum=F.sum("_m"), _n=F.count(F.lit(1)))
    shift = F.col("_low") if scale_step_by_lambda else F.lit(0.0)
    mass = F.col("_sum") - F.col("_n") * shift
    return t.withColumn("mu_new", ratio((F.col("_m") - shift) * F.lit(lam), mass)).drop("_m", "_low", "_sum", "_n")


def mixed_grad_hess(sf: DataFrame, mu: DataFrame, lam: float, kind: str, y: str = "y", p: str = "score", g: str = "g") -> DataFrame:
    """Gradient and Hessian of the fair objective per row.

    ``mu`` is the table ``(g, mu, n_over_ng)`` of the previous round; the scale uses all rows of the group whatever the constraint.
    """
    t = attach(sf, mu.select(g, "mu", "n_over_ng"), [g])
    scale = F.col("n_over_ng") * F.col("mu")
    grad = (1 - lam) * logloss_grad(y, p) + scale * constraint_grad(y, p, kind)
    hess = (1 - lam) * logloss_hess(y, p) + scale * constraint_hess(y, p, kind)
    return t.withColumns({"grad": grad, "hess": hess}).drop("mu", "n_over_ng")


def game_step(state: DataFrame, mode: str, eta: float, gamma: float = 0.0, vid: str = "vid") -> DataFrame:
    """Table form of :func:`game_update` on ``(vid, g, w, lam, share, err)``; adds ``w_new`` and ``lam_new``.

    The equal-error mode also reads ``mean_err``, the population error of the round.
    """
    state = pin(state).frame
    if mode == "minimax":
        t = state.withColumn("_e", F.col("w") * F.exp(F.lit(eta) * F.col("err")))
        t = attach_totals(t, [vid], _sum=F.sum("_e"))
        return t.withColumns({"w_new": ratio("_e", "_sum"), "lam_new": F.col("lam")}).drop("_e", "_sum")
    if mode == "relaxed":
        t = state.withColumn("lam_new", F.greatest(F.lit(0.0), F.col("lam") + F.lit(eta) * (F.col("err") - F.lit(gamma))))
        return t.withColumn("w_new", F.col("share") + F.col("lam_new"))
    if mode == "equal":
        t = state.withColumn("lam_new", F.col("lam") + F.lit(eta) * (F.col("err") - F.col("mean_err")))
        t = attach_totals(t, [vid], _sum=F.sum("lam_new"))
        return t.withColumn("w_new", F.col("share") * (1 - F.col("_sum")) + F.col("lam_new")).drop("_sum")
    raise ValueError(f"unknown game mode {mode!r}; expected one of {GAME_MODES}")


def worst_weight_step(state: DataFrame, alpha: float, vid: str = "vid") -> DataFrame:
    """One step of adaptive weighting on ``(vid, g, mu, risk, best, k)``.

    ``best`` is the lowest worst risk so far (NULL at the start) and ``k`` the decay counter of the vector. Groups with risk at or above
    the updated ``best`` share the step ``alpha / k``. Adds ``mu_new``, ``best_new``, ``k_new`` and ``improved``; ``k_min`` caps the
    counter on improvement.
    """
    t = attach_totals(pin(state).frame, [vid], _top=F.max("risk"))
    t = t.withColumn("improved", F.col("best").isNull() | (F.col("best") > F.col("_top")))
    t = t.withColumn("best_new", F.when(F.col("improved"), F.col("_top")).otherwise(F.col("best")))
    t = t.withColumn("k_new", F.when(F.col("improved"), F.least("k", "k_min")).otherwise(F.col("k") + 1))
    t = t.withColumn("_hit", (F.col("risk") >= F.col("best_new")).cast("double"))
    t = attach_totals(t, [vid], _hits=F.sum("_hit"))
    moved = (1 - alpha) * F.col("mu") + ratio("_hit", "_hits") * F.lit(alpha) / F.col("k_new")
    t = attach_totals(t.withColumn("_m", moved), [vid], _mass=F.sum("_m"))
    return t.withColumn("mu_new", ratio("_m", "_mass")).drop("_top", "_hit", "_hits", "_m", "_mass")


class EarlyStop:
    """Patience rule: an improvement must beat ``rel * best - min_delta``; more than ``patience`` misses in a row stop the run."""

    def __init__(self, patience: int, rel: float = 0.999, min_delta: float = 0.0, inclusive: bool = False):
        self.patience, self.rel, self.min_delta, self.inclusive = patience, rel, min_delta, inclusive
        self.best, self.misses, self.best_round, self.round = float("inf"), 0, -1, -1

    def update(self, loss: float) -> tuple[bool, bool]:
        """``(improved, stop)`` after seeing the loss of the next round."""
        self.round += 1
        if loss < self.rel * self.best - self.min_delta:
            self.best, self.misses, self.best_round = loss, 0, self.round
            return True, False
        self.misses += 1
        return False, self.misses >= self.patience if self.inclusive else self.misses > self.patience
