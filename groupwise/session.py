"""Session helpers: local sessions for tests and lineage cuts for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "groupwise", cores: str | int = "*", **conf) -> SparkSession:
    """A single-JVM session with the settings used by the tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test session) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="groupwise-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back.

    The plan restarts at a file scan, so lineage is cut, a lost executor costs only a re-read, and later passes read only
    the columns they need.
    """
    path = f"{checkpoint_root(df.sparkSession)}/groupwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`settle` returned, once everything made from them is settled itself."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(conf).delete(path, True)


ROWS_PER_TASK = 50_000
ROWS_PER_CORE = 1_000_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Give a table that is small for the cluster one task per core, as it may come from a single file.

    From ``ROWS_PER_CORE`` rows per core on, the partitioning of the scan is kept and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows >= ROWS_PER_CORE * cores:
        return df
    return df.repartition(max(1, min(cores, -(-rows // ROWS_PER_TASK))))
