"""Sinks: cleaned tables, dataset bundles, result tables, run bundles and models. Everything written is data, readable by Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import null_if_nan


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a cleaned table as CSV with header or as Parquet."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")


def write_bundle(
    df: DataFrame, path: str, features: Sequence[str], y: str, groups: Mapping[str, DataFrame], is_binary: bool
) -> None:
    """Vectorised dataset: ``features`` array, label, one id column per group type, plus the group names.

    ``groups`` maps each id column (``g_0`` ...) to its id table. An existing bundle is left as it is, without an error.
    """
    root = path.rstrip("/")
    rows = df.select(
        F.array(*[null_if_nan(F.col(c).cast("double")) for c in features]).alias("features"), F.col(y).alias("y"), *groups
    ).withColumn("is_binary", F.lit(is_binary))
    rows.write.mode("ignore").parquet(f"{root}/rows")
    names = None
    for column, dim in groups.items():
        label = next(c for c in dim.columns if c != column)
        part = dim.select(
            F.lit(column).alias("group_type"), F.col(column).cast("int").alias("g"), F.col(label).cast("string").alias("group_name")
        )
        names = part if names is None else names.unionByName(part)
    if names is not None:
        names.write.mode("ignore").parquet(f"{root}/groups")


def write_results(df: DataFrame, root: str, mode: str = "append") -> None:
    """Result rows of many models, partitioned so that one dataset, model or split can be read alone."""
    df.write.mode(mode).partitionBy("dataset", "model_name", "split").parquet(root)


def write_trials(df: DataFrame, root: str, mode: str = "append") -> None:
    """Trial rows (number, duration, parameters), partitioned by dataset and model."""
    df.write.mode(mode).partitionBy("dataset", "model_name").parquet(root)


def write_run(parts: Mapping[str, DataFrame], root: str, mode: str = "errorifexists") -> None:
    """Run bundle: one Parquet table per part (history, group statistics, predictions, priors ...)."""
    for name, df in parts.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def read_run(spark: SparkSession, root: str, parts: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in parts}


def save_model(model, path: str, mode: str = "errorifexists") -> None:
    """Write a fitted model as its tables; see ``to_tables`` of the model classes."""
    kind = type(model).__name__
    spark = SparkSession.getActiveSession()
    tables = model.to_tables(spark)
    spark.createDataFrame([(kind,)], "kind string").write.mode(mode).parquet(f"{path.rstrip('/')}/kind")
    write_run(tables, path, mode)


def load_model(spark: SparkSession, path: str):
    """Read a model written by :func:`save_model`."""
    from ..learners.boosting import BoostModel
    from ..learners.linear import LinearModel
    from ..learners.mixture import MixtureModel

    kinds = {c.__name__: c for c in (BoostModel, LinearModel, MixtureModel)}
    kind = spark.read.parquet(f"{path.rstrip('/')}/kind").first()[0]
    cls = kinds[kind]
    return cls.from_tables(read_run(spark, path, cls.TABLES))
