"""Adaptive group weights: search for the weights whose risk-minimising model has the lowest worst group risk."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import constraint_loss
from .game import bounded_rows, cached_rows, refuse_null_groups
from .linear import LinearModel, LogisticLearner

CLASS_PRIOR_FLOOR = 1e-3


def weight_step(mu: np.ndarray, risk: np.ndarray, best: float, k: float, alpha: float) -> np.ndarray:
    """Move ``mu`` towards the groups with risk at or above ``best``, with step ``alpha / k``, and rescale to sum 1."""
    hit = (risk >= best).astype(float)
    moved = (1 - alpha) * mu + hit / hit.sum() * alpha / k
    return moved / moved.sum()


@dataclass
class AdaptiveResult:
    """``history``: one row per iteration with weights, risks, counter and flags; ``mu`` and ``risk`` of the best iteration."""

    mu: np.ndarray
    risk: np.ndarray
    history: pd.DataFrame
    iterations: int


def adaptive_weights(
    oracle: Callable[[np.ndarray], np.ndarray],
    mu0: np.ndarray,
    niter: int = 100,
    patience: int = 20,
    k_ini: float = 1,
    k_min: float = 20,
    alpha: float = 0.5,
    risk_digits: int | None = None,
) -> AdaptiveResult:
    """Run the weight search against ``oracle``, which returns the group risks of the model fitted under the given weights.

    An improvement caps the decay counter at ``k_min`` and resets the patience; a miss raises both by one. With ``risk_digits`` risks are
    rounded first, and ``dominated`` marks iterations whose risk vector some earlier one matches or beats in every group.
    """
    mu = np.asarray(mu0, float)
    k, misses, rows, seen = k_ini, 0, [], []
    best, best_mu, best_risk = np.inf, mu, None
    i = 0
    while i <= niter and misses <= patience:
        risk = np.asarray(oracle(mu), float)
        if risk_digits is not None:
            risk = np.round(risk, risk_digits)
        top = float(risk.max())
        improved = best_risk is None or top < best
        if improved:
            best, best_mu, best_risk = top, mu, risk
            k, misses = min(k, k_min), 0
        else:
            k, misses = k + 1, misses + 1
        dominated = any((old <= risk).all() for old in seen)
        seen.append(risk)
        rows.append((i, mu.tolist(), risk.tolist(), float(k), bool(improved), bool(dominated), best))
        mu = weight_step(mu, risk, best, k, alpha)
        i += 1
    history = pd.DataFrame(rows, columns=["iteration", "mu", "risk", "k", "improved", "dominated", "best_risk"])
    return AdaptiveResult(best_mu, best_risk, history, i)


def history_table(spark, result: AdaptiveResult) -> DataFrame:
    schema = "iteration int, mu array<double>, risk array<double>, k double, improved boolean, dominated boolean, best_risk double"
    return spark.createDataFrame(result.history.values.tolist(), schema)


@dataclass
class LogisticRiskOracle:
    """``mu -> group risks`` by a logistic fit with row weight ``mu[g]``; the risk is the mean log-loss of the true class.

    ``kind='true_positive_rate'`` counts positives only. Risks are read on ``valid`` when given, on the training rows otherwise. One call is
    one distributed fit and one aggregation; use it as a context manager to release the cached rows.
    """

    train: DataFrame
    features: Sequence[str]
    y: str = "y"
    g: str = "g"
    valid: DataFrame | None = None
    kind: str = "equalized_loss"
    learner: LogisticLearner = field(default_factory=lambda: LogisticLearner(balanced=False))

    def __post_init__(self):
        cols = [*dict.fromkeys([*self.features, self.y, self.g])]
        self._rows = cached_rows(self.train.select(*cols))
        self._held = cached_rows(self.valid.select(*cols)) if self.valid is not None else self._rows
        refuse_null_groups(self._rows, [self.g])
        sizes = bounded_rows(self._rows.groupBy(self.g).agg(F.count(F.lit(1)).alias("n")), "groups")
        sizes = sizes.sort_values(self.g)
        self.names = sizes[self.g].tolist()
        self.prior = sizes["n"].to_numpy(float) / sizes["n"].sum()

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self._rows.unpersist()
        self._held.unpersist()

    def fit(self, mu: np.ndarray) -> LinearModel:
        kind = self._rows.schema[self.g].dataType.simpleString()
        table = self._rows.sparkSession.createDataFrame(list(zip(self.names, map(float, mu))), f"`{self.g}` {kind}, _w double")
        return self.learner.fit(self._rows.join(F.broadcast(table), self.g), self.features, self.y, "_w")

    def risk(self, model: LinearModel) -> np.ndarray:
        scored = model.transform(self._held)
        table = scored.groupBy(self.g).agg(F.avg(constraint_loss(self.y, "p", self.kind)).alias("risk"))
        found = bounded_rows(table, "groups").set_index(self.g)["risk"]
        return np.array([found.get(name, np.nan) for name in self.names])

    def __call__(self, mu: np.ndarray) -> np.ndarray:
        return np.nan_to_num(self.risk(self.fit(mu)), nan=0.0)


def scheme_weights(prior: np.ndarray, scheme: str) -> np.ndarray:
    """``naive``: uniform over groups; ``balanced``: inverse to the group prior. Both sum to 1."""
    if scheme == "naive":
        mu = np.ones_like(prior)
    elif scheme == "balanced":
        mu = 1.0 / (prior + CLASS_PRIOR_FLOOR)
    else:
        raise ValueError("scheme must be 'naive' or 'balanced'")
    return mu / mu.sum()


def fit_weighted(df: DataFrame, features: Sequence[str], scheme: str, y: str = "y", g: str = "g", **oracle) -> tuple[LinearModel, np.ndarray]:
    """Model under fixed weights and its group risks."""
    with LogisticRiskOracle(df, features, y, g, **oracle) as o:
        model = o.fit(scheme_weights(o.prior, scheme))
        return model, o.risk(model)


@dataclass
class AdaptiveClassifier:
    """Weight search, then a refit under the best weights. ``info`` holds the search."""

    n_iterations: int = 100
    C: float = 1.0
    alpha: float = 0.5
    k_ini: float = 1
    k_min: float = 20
    patience: int | None = None  # half the iterations
    constraint: str = "equalized_loss"
    max_iter: int = 100
    info: AdaptiveResult | None = None

    def fit(self, df: DataFrame, features: Sequence[str], y: str = "y", g: str = "g", valid: DataFrame | None = None) -> LinearModel:
        learner = LogisticLearner(C=self.C, max_iter=self.max_iter, balanced=False)
        with LogisticRiskOracle(df, features, y, g, valid, self.constraint, learner) as oracle:
            start = scheme_weights(oracle.prior, "naive")
            patience = self.n_iterations // 2 if self.patience is None else self.patience
            self.info = adaptive_weights(oracle, start, self.n_iterations, patience, self.k_ini, self.k_min, self.alpha)
            return oracle.fit(self.info.mu)
