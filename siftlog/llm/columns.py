"""Small helpers all operators share: tables, output columns that may clash, batches of rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlog.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(names: Sequence[str], made: Iterable[str]) -> list[str]:
    """``names`` without those that an operator makes itself (names are compared as Spark does, ignoring case)."""
    taken = {m.lower() for m in made}
    return [n for n in names if n.lower() not in taken]


def field(df: DataFrame, name: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name.lower() == name.lower())


def map_batches(df: DataFrame, make, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with the package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(make, schema)


def slices(batch, text: int, most_bytes: int = 4 << 20) -> Iterator:
    """Cut an Arrow batch into slices of about ``most_bytes`` of its column ``text``, at least one row each."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // most_bytes
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def texts_of(column) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def word_count(text) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
