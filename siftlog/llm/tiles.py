"""A stated query set against all vectors, in blocks of both.

Vectors are dealt into blocks by a hash of their id, queries into chunks, and every task gets one block
and one chunk.  Each returns the best of its block for its queries; a window per query, of a few rows
for each block, ranks them.  No task holds more than a block and a chunk, whatever the tables' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.shipping import ship

BLOCK, CHUNK = 16_384, 1_024


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a vector without null and non-finite components."""
    v = vectors[embedding].cast("array<double>")
    return vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[embedding].alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.coalesce(vectors_finite(v), F.lit(False)))


def vectors_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column, width: int):
    """Arrow lists as rows of doubles; shorter vectors end in zeros."""
    import numpy as np

    flat, ends = np.asarray(column.flatten(), np.float64), np.asarray(column.value_lengths())
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(ends), width))
    out[np.arange(width) < ends[:, None]] = flat
    return out


def search(vectors: DataFrame, is_query: Column, k: int, score_type: str, make) -> DataFrame:
    """(query_id, rank, vec_id, score) from ``make(ids, rows, query_ids, queries)`` -> (query_id, vec_id, score) arrays.

    ``vectors`` has columns id and v, ``is_query`` is over them.  Candidates with the query's own id are left to
    ``make``.  A query that occurs more than once, with the same vector, is searched once.
    """
    ship(vectors.sparkSession)
    counts = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    blocks, chunks, width = max(1, -(-counts.n // BLOCK)), max(1, -(-counts.q // CHUNK)), counts.width
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    queries = vectors.filter(is_query).distinct().withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def tile(left, right):
        import numpy as np
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), pa.float64() if score_type == "double" else pa.int64()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        got = make(
            np.asarray(left["id"]), matrix(left["v"].combine_chunks(), width),
            np.asarray(right["id"]), matrix(right["v"].combine_chunks(), width))
        return pa.table([pa.array(x, t) for x, t in zip(got, types, strict=True)], schema=schema)

    best = rows.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(
        tile, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of(scores, ids, k: int):
    """Places of the k highest scores, ties to the smaller id."""
    import numpy as np

    if len(scores) > 4 * k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= low)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
