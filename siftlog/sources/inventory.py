"""Which files are searched: explicit paths and a recursive walk pruned by globs."""

from __future__ import annotations

import contextlib
import os
import re
import stat
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.errors import ConfigError, FileAccessError, InvalidPattern, InvalidRequest
from siftlog.functions.dialect import glob_to_regex

# What a walk looks for when no include glob is given.
DEFAULT_INCLUDE = ("**/*.log", "**/*.log.gz", "**/*.gz")

FILES_SCHEMA = "path string, length bigint, modified timestamp, uri string"


def path_order(path: str | Column) -> Column:
    """Sort key of paths: component by component, so ``/a/b`` comes before ``/a-b``."""
    return F.split(path, "/")


def globs_match(path: str | Column, globs: Sequence[str]) -> Column:
    """Whether any glob matches the full path, as it is or with ``\\`` read as ``/``."""
    path = F.col(path) if isinstance(path, str) else path
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    try:
        patterns = [glob_to_regex(g) for g in globs]
    except InvalidPattern as e:
        raise ConfigError(str(e)) from e
    return reduce(or_, [path.rlike(p) | slashed.rlike(p) for p in patterns])


def select_paths(df: DataFrame, path: str = "path", include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose path passes the globs: any include (default set when empty) and no exclude."""
    keep = globs_match(path, include or DEFAULT_INCLUDE)
    if exclude:
        keep = keep & ~globs_match(path, exclude)
    return df.filter(keep)


def escape_path(path: str) -> str:
    """A path that Spark's own reader must not take for a glob."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def file_status(spark: SparkSession, path: str):
    """Hadoop's status of a path, or ``None`` if there is nothing."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.getFileStatus(hadoop_path) if fs.exists(hadoop_path) else None


def display_path(uri: Column) -> Column:
    """Local files are shown without their scheme; other stores keep the full address."""
    return F.regexp_replace(uri, r"^file:/+", "/")


def decoded_uri(uri: Column) -> Column:
    """Plain text of a percent-encoded address (``+`` is an ordinary character in a path)."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def encoded_uri(address: Column) -> Column:
    """Percent-encoded form of a plain address, which ``decoded_uri`` reads back."""
    out = F.url_encode(address)
    for made, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":")):
        out = F.replace(out, F.lit(made), F.lit(plain))
    return out


def shown_under_root(uri: Column, root_uri: str, root: str) -> Column:
    """The path as a walk from ``root`` would spell it."""
    return F.when(uri == root_uri, F.lit(root)).otherwise(F.concat(
        F.lit(root.rstrip("/") + "/"), F.substring(uri, F.lit(len(root_uri.rstrip("/")) + 2), F.length(uri))
    ))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below ``root`` at any depth, hidden names too; none if ``root`` does not exist.

    Symbolic links below the root are not followed, and a local folder that cannot be read is passed over.
    """
    status = file_status(spark, root)
    if status is None:
        return spark.createDataFrame([], FILES_SCHEMA)
    root_uri = status.getPath().toString()
    rows = _local_files(root_uri) if root_uri.startswith("file:") else _stored_files(spark, status.getPath())
    found = spark.createDataFrame(rows, "uri string, length bigint, modified double")
    return found.select(
        shown_under_root(F.col("uri"), root_uri, root).alias("path"), "length",
        F.col("modified").cast("timestamp").alias("modified"), "uri",
    )


def _local_files(root_uri: str) -> list[tuple[str, int, float]]:
    top = root_uri.removeprefix("file:")
    if os.path.isfile(top):
        info = os.stat(top)
        return [(root_uri, info.st_size, info.st_mtime)]
    rows = []
    for folder, _, names in os.walk(top):  # skips what it cannot read
        for name in names:
            path = os.path.join(folder, name)
            with contextlib.suppress(OSError):
                info = os.lstat(path)
                if stat.S_ISREG(info.st_mode):
                    rows.append((f"file:{path}", info.st_size, info.st_mtime))
    return rows


def _stored_files(spark: SparkSession, path) -> list[tuple[str, int, float]]:
    """One recursive listing call of the store; each status comes over as text."""
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found, rows = fs.listFiles(path, True), []
    while found.hasNext():
        m = _STATUS.search(found.next().toString())
        rows.append((m[1], int(m[2]), int(m[3]) / 1000.0))
    return rows


# Fixed value: how Hadoop prints the status of a file.
_STATUS = re.compile(r"path=(.*); isDirectory=false; length=(\d+);.*?modification_time=(\d+)", re.DOTALL)


def explicit(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The given paths that exist and are regular files, in the given order, repeats kept."""
    rows = []
    for path in paths:
        status = file_status(spark, path)
        if status is not None and status.isFile():
            rows.append((path, status.getLen(), status.getModificationTime() / 1000.0, status.getPath().toString()))
    return spark.createDataFrame(rows, "path string, length bigint, modified double, uri string").withColumn(
        "modified", F.col("modified").cast("timestamp")
    )


def list_files(
    spark: SparkSession,
    root: str = "",
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    paths: Sequence[str] = (),
) -> DataFrame:
    """``files(path, length, modified)`` to be searched.

    Without a root the explicit paths come back as given and globs play no part.  With one, the
    walked files that pass the globs join them, without repeats, in path order.
    """
    files = with_uris(spark, root, include, exclude, paths).drop("uri")
    return files.orderBy(path_order("path")) if root else files


def with_uris(spark, root="", include=(), exclude=(), paths=()) -> DataFrame:
    """``files(path, length, modified, uri)``, not in order where there is a root."""
    given = explicit(spark, paths) if paths else None
    if not root:
        return given if given is not None else spark.createDataFrame([], FILES_SCHEMA)
    listed = select_paths(walk(spark, root), "path", include, exclude)
    if given is not None:
        listed = given.unionByName(listed).dropDuplicates(["path"])
    return listed


def require_directory(spark: SparkSession, root: str) -> None:
    status = file_status(spark, root)
    if status is None:
        raise FileAccessError(f"no such directory: {root}")
    if not status.isDirectory():
        raise InvalidRequest(f"{root!r} is not a directory")
