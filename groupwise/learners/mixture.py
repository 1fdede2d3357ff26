"""Uniform mixtures of linear models."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..functions.numeric import flag
from .linear import LinearModel


STRIP = 4_000_000


@dataclass(frozen=True)
class MixtureModel:
    """Members of a game, all with equal weight."""

    members: tuple[LinearModel, ...]

    TABLES = ("members",)

    @property
    def kind(self) -> str:
        return self.members[0].kind

    def transform(self, df: DataFrame, mode: str = "mean", key: str | None = None, seed: str | int = 0, p: str = "p", pred: str = "pred") -> DataFrame:
        """Members are one matrix, which meets the rows of a batch in a product: neither the plan nor its code grows with their number.

        ``sample``: every row is answered by one member, picked by its hashed ``key``. ``mean``: the expected answer of that.

        ``p`` holds the probability (or value), ``pred`` the decision (of the sampled member, or ``p > 0.5``).
        """
        names, kind = list(self.members[0].features), self.kind
        table = coefficients(self.members)
        if mode == "mean":
            weights = np.full((1, len(table)), 1.0 / len(table))

            @F.pandas_udf("double")
            def mean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
                for x in parts:
                    yield pd.Series(mixed(x[names].to_numpy(float), table, weights, kind)[:, 0])

            out = df.withColumn(p, mean(_row(names)))
        elif mode == "sample":
            if key is None:
                raise ValueError("sampling a member needs the row key")
            member = F.pmod(hash_int(seed, key), F.lit(len(self.members))).cast("int")

            @F.pandas_udf("double")
            def sampled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
                for x in parts:
                    w = table[x["_member"].to_numpy(int)]
                    yield pd.Series(answer((w[:, 1:] * x[names].to_numpy(float)).sum(1) + w[:, 0], kind))

            out = df.withColumn(p, sampled(_row(names, member.alias("_member"))))
        else:
            raise ValueError("mode must be 'sample' or 'mean'")
        return out.withColumn(pred, F.col(p) if self.kind == "linear" else flag(F.col(p) > 0.5))

    def to_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [(m.kind, t, list(m.features), list(m.coef), float(m.intercept)) for t, m in enumerate(self.members)]
        schema = "kind string, round int, features array<string>, coef array<double>, intercept double"
        return {"members": spark.createDataFrame(rows, schema)}

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> "MixtureModel":
        rows = tables["members"].orderBy("round").collect()
        return cls(tuple(LinearModel(r["kind"], tuple(r["features"]), tuple(r["coef"]), r["intercept"]) for r in rows))


def coefficients(members: Sequence[LinearModel]) -> np.ndarray:
    """A row per member: intercept and coefficients."""
    return np.array([[m.intercept, *m.coef] for m in members], float)


def answer(margin: np.ndarray, kind: str) -> np.ndarray:
    if kind == "logistic":
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    return np.where(np.isnan(margin), np.nan, margin > 0) if kind == "paired" else margin


def mixed(x: np.ndarray, table: np.ndarray, weights: np.ndarray, kind: str) -> np.ndarray:
    """Weighted answers of the members, one column per row of ``weights``; rows are taken in strips, so memory is bounded for any number of members."""
    out = np.empty((len(x), len(weights)))
    step = max(1, STRIP // len(table))
    for at in range(0, len(x), step):
        out[at : at + step] = answer(x[at : at + step] @ table[:, 1:].T + table[:, 0], kind) @ weights.T
    return out


def _row(names: Sequence[str], *more: Column) -> Column:
    return F.struct(*[F.col(f).cast("double").alias(f) for f in names], *more)


def score_linear(df: DataFrame, models: Mapping[int, LinearModel | MixtureModel], model: str = "model", score: str = "score") -> DataFrame:
    """Long frame with one row per (row, model): the members of all models are one matrix, so the table is read once."""
    numbers = sorted(models)
    groups = [models[i].members if isinstance(models[i], MixtureModel) else (models[i],) for i in numbers]
    every = [m for g in groups for m in g]
    if len({(m.kind, m.features) for m in every}) != 1:
        raise ValueError("models scored together share kind and features")
    names, kind, table = list(every[0].features), every[0].kind, coefficients(every)
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    weights = (owner == np.arange(len(groups))[:, None]) / np.array([len(g) for g in groups], float)[:, None]

    @F.pandas_udf("array<double>")
    def scores(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(list(mixed(x[names].to_numpy(float), table, weights, kind)))

    zipped = df.withColumn("_z", F.arrays_zip(F.array(*[F.lit(int(i)) for i in numbers]).alias("m"), scores(_row(names)).alias("s")))
    return zipped.select(*df.columns, F.inline("_z").alias(model, score))


def mixture(members: Sequence[LinearModel]) -> MixtureModel:
    if len({(m.kind, m.features) for m in members}) != 1:
        raise ValueError("members of a mixture share kind and features")
    return MixtureModel(tuple(members))
