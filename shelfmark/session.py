"""Session construction and the folder that stages share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset, and all runs in one process (tests, a laptop), a folder of this machine is made,
    set, and removed again when the process ends; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, path, True)
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where ``written`` notes its tables, within ``tables_noted``.
_noting: list[str] | None = None


@contextmanager
def tables_noted(into: list[str]) -> Iterator[None]:
    """The paths that ``written`` uses meanwhile are added to a list."""
    global _noting
    before, _noting = _noting, into
    try:
        yield
    finally:
        _noting = before


def drop_tables(paths: list[str], reader: DataFrame) -> None:
    """Delete these tables, and take them off the list, but for those that ``reader`` still reads."""
    if not paths:
        return
    spark = reader.sparkSession
    files = " ".join(reader.inputFiles())
    for path in [p for p in paths if os.path.basename(p) not in files]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        paths.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if _noting is not None:
        _noting.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all tasks by the hash of ``keys`` where their scan has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, *keys) if df.rdd.getNumPartitions() < cores else df
