"""Session helpers: a local session for tests and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings this package is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftlog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="siftlog-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: list[str] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    folder = f"{shared_folder(spark)}/siftlog-{purpose}-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


@contextmanager
def working_folders(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the working tables that were written within: read or write results before."""
    first = len(_made)
    try:
        yield
    finally:
        hadoop = spark._jsparkSession.sessionState().newHadoopConf()
        for folder in _made[first:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
        del _made[first:]


def written(spark: SparkSession, df, purpose: str):
    """``df`` written once to the shared folder and read back: survives executor loss, has true sizes."""
    folder = new_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
