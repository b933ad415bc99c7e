"""Session defaults and the one place where intermediate tables are written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_SCOPES: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tillroll",
                  **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_shared_folder(spark: SparkSession, folder: str) -> None:
    """Name the folder for stages where ``spark.checkpoint.dir`` is unset; all executors must reach it."""
    _FOLDERS[spark.sparkContext.applicationId] = folder


def named_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or _FOLDERS.get(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the one named by :func:`use_shared_folder`."""
    root = named_folder(spark)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir, or call use_shared_folder, with a folder that all executors share")
    return root.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    return f"{_SCOPES[-1] if _SCOPES else shared_folder(spark) + '/tillroll'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def stages(spark: SparkSession) -> Iterator[str]:
    """Stages made inside are removed at the end; results must have been read or written by then."""
    folder = f"{shared_folder(spark)}/tillroll/scope-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage in a way that outlives lost executors, and later reads keep
    column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
