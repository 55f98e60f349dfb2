"""Caps, order, pages and totals of hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.operators.entries import LINES_PER_BLOCK
from siftlog.operators.running import block_starts, running_total
from siftlog.sources.inventory import path_order

TOP_K_ROWS = 100_000  # pages that end within so many rows are taken as a top-k
FILES_PER_TASK = 10_000  # files that a task counts at a time


def without_content(hits: DataFrame) -> DataFrame:
    """The same hits with an empty text, positions kept."""
    return hits.withColumn("content", F.lit(""))


def cap_per_file(
    hits: DataFrame, max_hits: int, lines_per_block: int = LINES_PER_BLOCK, file: Sequence[str] = ("file_path",)
) -> DataFrame:
    """The first ``max(max_hits, 1)`` hits of each file in line order.

    Hits are counted per block of lines; only blocks that begin under the cap are sorted, so a
    file that holds most of the hits is neither sorted as a whole nor sent to one task.
    """
    limit = max(max_hits, 1)
    blocked = hits.withColumn("_block", F.floor(F.col("start_line") / lines_per_block))
    ranked = running_total(
        blocked, list(file), "_block", ["start_line"], F.lit(1).cast("bigint"), "_rank", below=limit
    )
    return ranked.filter(F.col("_rank") <= limit).drop("_rank", "_block")


def files_within_cap(
    hits: DataFrame, max_hits: int, file: Sequence[str] = ("file_path",), order: Column | None = None
) -> DataFrame:
    """``(file_path, hits)`` of the files that are read before ``max_hits`` stops the search.

    Files come in path order and a file counts with at most ``max_hits`` hits; reading stops after
    the file that reaches the cap.  Each listed file has a hit, so at most ``max_hits`` files can
    be in the result and the running sum sees no more rows than that.
    """
    return counted_within_cap(hits.groupBy(*file).agg(F.count(F.lit(1)).alias("hits")), max_hits, file, order)


def counted_within_cap(
    counts: DataFrame, max_hits: int, file: Sequence[str] = ("file_path",), order: Column | None = None
) -> DataFrame:
    """``files_within_cap`` for a table of ``hits`` per file."""
    limit = max(max_hits, 1)
    order = path_order("file_path") if order is None else order
    capped = counts.select(*file, F.least("hits", F.lit(limit)).cast("bigint").alias("hits"))
    first = capped.withColumn("_order", order).orderBy("_order").limit(limit)
    earlier = Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    return (
        first.withColumn("_earlier", F.coalesce(F.sum("hits").over(earlier), F.lit(0)))
        .filter(F.col("_earlier") < limit)
        .select(*file, "hits")
    )


def first_and_counts(limit: int):
    """For ``mapInArrow``: of each file a task's first ``limit`` hits in line order, and how many hits it has there.

    Takes ``(uri, start_line, ..., whole)`` and adds ``hits``: null for the rows themselves, a number in the rows of
    counts.  Rows that are not ``whole`` are no hits yet and pass.  A row passes that is among the first so far, so rows
    may come in any order; in line order no more than ``limit`` of a file pass.
    """
    def make(batches):
        import numpy as np
        import pyarrow as pa

        seen: dict = {}  # uri -> number of hits, lines of the first ones

        def counts(schema):
            given = {"uri": list(seen), "hits": [n for n, _ in seen.values()]}
            seen.clear()
            size = len(given["uri"])
            return pa.RecordBatch.from_arrays([
                pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in schema
            ], schema=schema)

        schema = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            uri = batch.column("uri").dictionary_encode()
            names, code = uri.dictionary.to_pylist(), uri.indices.to_numpy()
            line = batch.column("start_line").to_numpy()
            keep = ~batch.column("whole").to_numpy(zero_copy_only=False).astype(bool)
            rows = np.flatnonzero(~keep)
            rows = rows[np.argsort(code[rows], kind="stable")]
            for of_file in np.split(rows, np.flatnonzero(np.diff(code[rows])) + 1) if len(rows) else ():
                name = names[code[of_file[0]]]
                number, first = seen.get(name, (0, line[:0]))
                lines = line[of_file]
                if len(first) < limit or (limit and lines.min() < first[-1]):
                    first = np.sort(np.concatenate([first, lines]))[:limit]
                    keep[of_file] = lines <= first[-1]
                seen[name] = number + len(of_file), first
            schema = batch.schema.append(pa.field("hits", pa.int64()))
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.nulls(kept.num_rows, pa.int64())], schema=schema)
            if len(seen) > FILES_PER_TASK:
                yield counts(schema)
        if seen:
            yield counts(schema)

    return make


def cap_hits(
    hits: DataFrame,
    max_hits: int | None,
    file: Sequence[str] = ("file_path",),
    order: Column | None = None,
    first_file: Column | None = None,
) -> DataFrame:
    """Both caps: whole files until the cap is reached, each with its first hits.

    ``max_hits`` 0 stops after the first file, whether or not it has a hit; ``first_file`` is the
    condition for that file where a listing is known.
    """
    if max_hits is None:
        return hits
    if max_hits <= 0 and first_file is not None:
        return cap_per_file(hits.filter(first_file), max_hits, file=file)
    kept = files_within_cap(hits, max_hits, file, order).select(*file)
    return cap_per_file(hits.join(kept, list(file), "left_semi"), max_hits, file=file)


def page_bounds(page: int, page_size: int, default_page_size: int, max_page_size: int) -> tuple[int, int]:
    """Rows to skip and rows to take."""
    size = default_page_size if page_size == 0 else max(min(page_size, max_page_size), 1)
    return size * (max(page, 1) - 1), size


def take_page(hits: DataFrame, skip: int, size: int, order: Column | None = None) -> DataFrame:
    """One page in file and line order; empty past the end.

    A top-k without a full sort.  Every task of it holds ``skip + size`` rows, so far pages are
    located by counts first.
    """
    order = path_order("file_path") if order is None else order
    if skip + size > TOP_K_ROWS:
        hits, skip = _from_page_files(hits, skip, size, order)
    return hits.orderBy(order, "start_line").offset(skip).limit(size)


def _from_page_files(hits: DataFrame, skip: int, size: int, order: Column) -> tuple[DataFrame, int]:
    """Hits of the page alone, found by counting hits per file and per block of lines.

    The running sum over files sees one row per file, the one over blocks runs per file.
    """
    file = ["file_path"] + (["place"] if "place" in hits.columns else [])
    blocked = hits.withColumn("_block", F.floor(F.col("start_line") / LINES_PER_BLOCK))
    counts = blocked.groupBy(*file, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier_files = Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy(*file).agg(F.sum("_n").alias("_file_n")).withColumn("_order", order).withColumn(
        "_file_before", F.coalesce(F.sum("_file_n").over(earlier_files), F.lit(0))
    )
    on_page = (F.col("_file_before") < skip + size) & (F.col("_file_before") + F.col("_file_n") > skip)
    blocks = block_starts(
        counts.join(files.filter(on_page).select(*file, "_file_before"), file), file, "_block", ["_n"]
    ).withColumn("_before", F.col("_file_before") + F.col("_n_before"))
    needed = blocks.filter(
        (F.col("_before") < skip + size) & (F.col("_before") + F.col("_n") > skip)
    ).select(*file, "_block", "_before")
    in_block = Window.partitionBy(*file, "_block").orderBy("start_line")
    placed = blocked.join(needed, [*file, "_block"]).withColumn(
        "_at", F.col("_before") + F.row_number().over(in_block)
    )
    return placed.filter(F.col("_at").between(skip + 1, skip + size)).select(*hits.columns), 0


def page_totals(counted: DataFrame, page: int, size: int, *keep: str) -> DataFrame:
    """``total_hits`` with the page that was asked for and the number of pages."""
    return counted.select(
        "total_hits",
        F.lit(max(page, 1)).alias("page"),
        F.lit(size).alias("page_size"),
        F.ceil(F.col("total_hits") / size).cast("bigint").alias("total_pages"),
        *keep,
    )


def totals(hits: DataFrame, page: int, size: int) -> DataFrame:
    """One row: hits after caps and before paging, and the number of pages."""
    return page_totals(hits.agg(F.count(F.lit(1)).alias("total_hits")), page, size)
