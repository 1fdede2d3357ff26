"""Text and Parquet sources. Every reader takes an explicit schema from the column roles; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import TableSpec

# Charsets the JVM knows under another name.
CHARSETS = {"cp860": "IBM860", "latin1": "ISO-8859-1", "utf8": "UTF-8"}


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """``;`` if it occurs in the first two lines of the file, else ``,``."""
    return ";" if any(";" in line for line in first_lines(spark, path, 2)) else ","


def first_lines(spark: SparkSession, path: str, n: int, least: int = 1) -> list[str]:
    """The first ``n`` lines of the file, of a folder those of its first file by name with ``least`` lines; nothing if none has them.

    Files without a byte, as a task without rows leaves them, are told by their size in one job that opens no file.
    """
    sizes = spark.read.format("binaryFile").load(path).where("length > 0")
    for file in sorted(row[0] for row in sizes.select("path").collect()):
        lines = [row[0] for row in spark.read.text(file).limit(n).collect()]
        if len(lines) >= least:
            return lines
    return []


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> list[str]:
    """Column names in the first line."""
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    if encoding:
        reader = reader.option("encoding", allow_charset(spark, encoding))
    return reader.csv(path).columns


def allow_charset(spark: SparkSession, encoding: str) -> str:
    """JVM name of a charset; one outside Spark's default list is switched on for the session."""
    name = CHARSETS.get(encoding.lower().replace("-", "").replace("_", ""), encoding)
    if name.upper() not in ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return name


def read_table(
    spark: SparkSession,
    path: str,
    spec: TableSpec,
    names: Sequence[str] | None = None,
    sep: str | None = ",",
    encoding: str | None = None,
    skip_lines: int = 0,
    sep_regex: str | None = None,
) -> DataFrame:
    """Delimited text with roles applied: categorical columns as text, numeric ones as double.

    ``names`` names the columns of a file without header. ``sep=None`` sniffs the delimiter. ``skip_lines`` drops junk lines before the
    header of each file. ``sep_regex`` splits on a pattern such as ``\\s+`` (needs ``names``).
    """
    if sep_regex:
        if not names:
            raise ValueError("sep_regex needs names")
        return _read_regex(spark, path, spec.schema(list(names)), sep_regex)
    if sep is None:
        sep = sniff_delimiter(spark, path)
    if skip_lines:
        return _read_skipping(spark, path, spec, sep, skip_lines)
    columns = list(names) if names else header_of(spark, path, sep, encoding)
    reader = (
        spark.read.schema(spec.schema(columns))
        .option("header", names is None)
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("nanValue", "NaN")
    )
    if encoding:
        reader = reader.option("encoding", allow_charset(spark, encoding))
    return reader.csv(path)


def _read_regex(spark: SparkSession, path: str, schema: T.StructType, pattern: str) -> DataFrame:
    parts = F.split(F.trim("value"), pattern)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(*[F.get(parts, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def _read_skipping(spark: SparkSession, path: str, spec: TableSpec, sep: str, skip: int) -> DataFrame:
    """The header is the line after ``skip`` lines of the file; these lines are dropped by their place, whatever they say.

    Lines are counted only in the first block of a file, in the order the scan gives them, so files stay splittable. Every file of a
    folder starts with ``skip`` lines and a header, or is empty.
    """
    lead = first_lines(spark, path, skip + 1, skip + 1)
    if not lead:
        raise ValueError(f"no header after {skip} lines in {path}")
    columns = [c.strip().strip('"') for c in lead[skip].split(sep)]
    schema = spec.schema(columns)

    def below_header(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for part in parts:
            first = part[part["start"] == 0]
            nth = first.groupby("file").cumcount() + first["file"].map(seen).fillna(0)
            for file, n in first.groupby("file").size().items():
                seen[file] = seen.get(file, 0) + n
            yield part.drop(index=nth.index[nth <= skip])[["value"]]

    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", *place).mapInPandas(below_header, "value string").where(F.trim("value") != "")
    parsed = lines.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep}).alias("r"))
    return parsed.select("r.*")


def read_splits(spark: SparkSession, root: str, spec: TableSpec, number: int | None = None, index: str | None = "_c0") -> DataFrame:
    """Pre-split ``train``/``val``/``test`` CSV files as one frame with a ``split`` column; the leading index column is dropped.

    With ``number`` the files are ``train_<number>.csv`` and so on.
    """
    out = None
    for split in ("train", "val", "test"):
        name = split if number is None else f"{split}_{number}"
        path = f"{root.rstrip('/')}/{name}.csv"
        part = read_table(spark, path, spec)
        if index is not None:
            part = part.drop(part.columns[0]) if part.columns[0] in ("", index, "Unnamed: 0") else part
        part = part.withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)`` of a dataset bundle: vectorised rows with labels and group ids, and the table of group names."""
    root = path.rstrip("/")
    return spark.read.parquet(f"{root}/rows"), spark.read.parquet(f"{root}/groups")
