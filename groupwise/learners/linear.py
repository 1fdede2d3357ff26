"""Weighted linear learners on Spark ML, with the regularisation scales of the usual single-node solvers.

A learner has ``fit(df, features, y, weight) -> LinearModel``; any object with that method can take part in a game.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import sigmoid
from ..functions.numeric import flag


PENALTIES = ("l2", "l1", "none")


def dot(features: Sequence[str], coef: Sequence[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for name, w in zip(features, coef):
        out = out + F.col(name).cast("double") * F.lit(float(w))
    return out


@dataclass(frozen=True)
class LinearModel:
    """Coefficients as data. ``kind``: ``logistic`` (probability and decision), ``linear`` (value) or ``paired`` (two regressions)."""

    kind: str
    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float

    TABLES = ("coefficients",)

    def margin(self) -> Column:
        return dot(self.features, self.coef, self.intercept)

    def transform(self, df: DataFrame, p: str = "p", pred: str = "pred") -> DataFrame:
        """Add ``p`` (probability, or value of a regression) and ``pred`` (decision, or again the value); works on streams."""
        m = self.margin()
        if self.kind == "logistic":
            return df.withColumn(p, sigmoid(m, eps=0)).withColumn(pred, flag(F.col(p) > 0.5))
        if self.kind == "paired":
            return df.withColumn(pred, flag(m > 0)).withColumn(p, F.col(pred).cast("double"))
        return df.withColumn(p, m).withColumn(pred, F.col(p))

    def to_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [(self.kind, i, f, float(w)) for i, (f, w) in enumerate(zip(self.features, self.coef))]
        rows.append((self.kind, len(self.features), None, float(self.intercept)))
        return {"coefficients": spark.createDataFrame(rows, "kind string, position int, feature string, value double")}

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> "LinearModel":
        rows = tables["coefficients"].orderBy("position").collect()
        body = rows[:-1]
        return cls(rows[0]["kind"], tuple(r["feature"] for r in body), tuple(r["value"] for r in body), rows[-1]["value"])


def _assembled(df: DataFrame, features: Sequence[str], label: Column, weight: Column | None) -> DataFrame:
    cols = [F.col(f).cast("double").alias(f) for f in features]
    w = (weight if weight is not None else F.lit(1.0)).alias("_w")
    base = df.select(*cols, label.cast("double").alias("_y"), w)
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(base).select("_x", "_y", "_w")


@dataclass(frozen=True)
class LogisticLearner:
    """Logistic regression with inverse regularisation ``C``; ``balanced`` multiplies weights by ``n / (2 n_class)``.

    ``penalty``: ``l2`` (half the squared coefficients over ``C``), ``l1`` (their absolute values over ``C``) or ``none``, in the scale of the summed loss.
    """

    C: float = 1.0
    max_iter: int = 100
    tol: float = 1e-6
    fit_intercept: bool = True
    balanced: bool = True
    penalty: str = "l2"

    def __post_init__(self) -> None:
        if self.penalty not in PENALTIES:
            raise ValueError(f"unknown penalty {self.penalty!r}; expected one of {PENALTIES}")

    def fit(self, df: DataFrame, features: Sequence[str], y: str, weight: str | None = None) -> LinearModel:
        w = F.col(weight) if weight else F.lit(1.0)
        counts = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(y).cast("double")).alias("pos"),
            F.sum(w).alias("s"),
            F.sum(w * F.col(y)).alias("s1"),
        ).first()
        n, pos = counts["n"], counts["pos"]
        if pos == 0 or pos == n:
            raise ValueError("a logistic fit needs both classes")
        total = counts["s"]
        if self.balanced:
            up, down = n / (2 * pos), n / (2 * (n - pos))
            w = w * F.when(F.col(y) == 1, F.lit(up)).otherwise(F.lit(down))
            total = counts["s1"] * up + (counts["s"] - counts["s1"]) * down
        model = LogisticRegression(
            featuresCol="_x",
            labelCol="_y",
            weightCol="_w",
            regParam=0.0 if self.penalty == "none" else 1.0 / (self.C * total),
            elasticNetParam=1.0 if self.penalty == "l1" else 0.0,
            standardization=False,
            maxIter=self.max_iter,
            tol=self.tol,
            fitIntercept=self.fit_intercept,
        ).fit(_assembled(df, features, F.col(y), w))
        return LinearModel("logistic", tuple(features), tuple(model.coefficients.toArray().tolist()), model.intercept)


@dataclass(frozen=True)
class LinearLearner:
    """Least squares; ``alpha > 0`` is a ridge penalty on the coefficients in the scale of the summed squared error."""

    alpha: float = 0.0
    fit_intercept: bool = True

    def fit(self, df: DataFrame, features: Sequence[str], y: str, weight: str | None = None) -> LinearModel:
        return self.fit_label(df, features, F.col(y), F.col(weight) if weight else None)

    def fit_label(self, df: DataFrame, features: Sequence[str], label: Column, weight: Column | None = None) -> LinearModel:
        reg = 0.0
        if self.alpha:
            w = weight if weight is not None else F.lit(1.0)
            m = df.agg(F.sum(w).alias("s"), F.sum(w * label).alias("sy"), F.sum(w * label * label).alias("syy")).first()
            spread = max(m["syy"] / m["s"] - (m["sy"] / m["s"]) ** 2, 0.0) ** 0.5
            # the normal-equation solver divides the penalty by the standard deviation of the label
            reg = self.alpha / m["s"] * spread
        model = LinearRegression(
            featuresCol="_x",
            labelCol="_y",
            weightCol="_w",
            regParam=reg,
            standardization=False,
            solver="normal",
            fitIntercept=self.fit_intercept,
        ).fit(_assembled(df, features, label, weight))
        return LinearModel("linear", tuple(features), tuple(model.coefficients.toArray().tolist()), model.intercept)


@dataclass(frozen=True)
class PairedLearner:
    """Two unweighted regressions on ``y * w`` and ``(1 - y) * w``; the larger prediction decides.

    Both are linear, so the decision is the sign of one difference of coefficients.
    """

    fit_intercept: bool = True

    def fit(self, df: DataFrame, features: Sequence[str], y: str, weight: str | None = None) -> LinearModel:
        w = F.col(weight) if weight else F.lit(1.0)
        ols = LinearLearner(0.0, self.fit_intercept)
        pos = ols.fit_label(df, features, F.col(y) * w)
        neg = ols.fit_label(df, features, (1 - F.col(y)) * w)
        diff = tuple(a - b for a, b in zip(pos.coef, neg.coef))
        return LinearModel("paired", tuple(features), diff, pos.intercept - neg.intercept)


def learner(name: str, **params) -> LogisticLearner | LinearLearner | PairedLearner:
    """``linear``, ``ridge`` (needs ``alpha``), ``logistic`` or ``paired``."""
    kinds = {"linear": LinearLearner, "ridge": LinearLearner, "logistic": LogisticLearner, "paired": PairedLearner}
    if name not in kinds:
        raise ValueError(f"unknown learner {name!r}; expected one of {sorted(kinds)}")
    if name == "ridge":
        params.setdefault("alpha", 1.0)
    return kinds[name](**params)
