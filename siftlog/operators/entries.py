"""Lines to entries: single-line, or multi-line by a start pattern.

Three shapes of input, one result ``entries(file_path, start_line, end_line, content)``:

* ``entries_from_text``  - one row holds a whole file; entries come from array functions, no shuffle
* ``entries_from_lines`` - a table of numbered lines; blockwise running totals
* ``siftlog.sources.scan`` - files on storage; entries are cut inside the scan
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.functions.dialect import checked_java_regex
from siftlog.operators.running import block_starts

ENTRY_COLUMNS = ["file_path", "start_line", "end_line", "content"]
LINES_PER_BLOCK = 65_536


def start_regex(request_pattern: str | None, default_pattern: str | None = None) -> str | None:
    """The Java start pattern: the request's, else the default, else none. An invalid one raises."""
    pattern = request_pattern if request_pattern is not None else default_pattern
    return None if pattern is None else checked_java_regex(pattern)


def lines_from_text(df: DataFrame, path: str = "file_path", text: str = "text", keep: tuple = ()) -> DataFrame:
    """One row per line of each whole text: ``line_no`` from 1, ``line`` with its ``\\n``."""
    pieces = df.select(F.col(path).alias("file_path"), *keep, F.split(text, "\n", -1).alias("_p"))
    lines = pieces.select("file_path", *keep, F.size("_p").alias("_n"), F.posexplode("_p").alias("_i", "_x"))
    is_last = F.col("_i") == F.col("_n") - 1
    return lines.filter(~(is_last & (F.col("_x") == ""))).select(
        "file_path",
        *keep,
        (F.col("_i") + 1).cast("bigint").alias("line_no"),
        F.when(is_last, F.col("_x")).otherwise(F.concat("_x", F.lit("\n"))).alias("line"),
    )


def single_line_entries(lines: DataFrame) -> DataFrame:
    return lines.select(
        "file_path",
        F.col("line_no").alias("start_line"),
        F.col("line_no").alias("end_line"),
        F.col("line").alias("content"),
    )


def entries_from_text(
    df: DataFrame, start_pattern: str | None = None, path: str = "file_path", text: str = "text"
) -> DataFrame:
    """Entries of whole texts. A text is one row already, so nothing is shuffled."""
    java = start_regex(start_pattern)
    if java is None:
        return single_line_entries(lines_from_text(df, path, text))

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def cut(lines: Column) -> Column:
        first_lines = F.filter(
            F.sequence(F.lit(1), F.size(lines)),
            lambda i: (i == 1) | F.element_at(lines, i).rlike(java),
        )
        return let(first_lines, lambda firsts: F.transform(firsts, lambda first, k: let(
            F.coalesce(F.get(firsts, k + 1), F.size(lines) + 1) - 1,
            lambda last: F.struct(
                first.cast("bigint").alias("start_line"),
                last.cast("bigint").alias("end_line"),
                F.array_join(F.slice(lines, first, last - first + 1), "").alias("content"),
            ),
        )))

    pieces = F.split(text, "\n", -1)
    lines = let(pieces, lambda p: F.filter(
        F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.concat(x, F.lit("\n"))).otherwise(x)),
        lambda x: x != "",
    ))
    return df.filter(F.col(text) != "").select(
        F.col(path).alias("file_path"), F.inline(let(lines, cut))
    )


def entries_from_lines(
    lines: DataFrame, start_pattern: str | None = None, lines_per_block: int = LINES_PER_BLOCK
) -> DataFrame:
    """Entries of a numbered line table ``(file_path, line_no, line)``.

    Lines of one block meet in one task; an entry is first joined inside its block (same
    partitioning, no further shuffle) and only then across the blocks it spans.
    """
    java = start_regex(start_pattern)
    if java is None:
        return single_line_entries(lines)
    file_block = ["file_path", "_block"]
    marked = lines.select(
        "file_path", "line_no", "line",
        F.floor((F.col("line_no") - 1) / lines_per_block).alias("_block"),
        F.col("line").rlike(java).cast("bigint").alias("_start"),
    )
    in_block = Window.partitionBy(*file_block).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        marked.withColumn("_entry", F.sum("_start").over(in_block))
        .groupBy(*file_block, "_entry")
        .agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"),
             _joined("line_no", "line").alias("content"))
    )
    starts = block_starts(
        marked.groupBy(*file_block).agg(F.sum("_start").alias("_n")), ["file_path"], "_block", ["_n"]
    ).select(*file_block, "_n_before")
    numbered = pieces.join(starts, file_block).withColumn("_entry", F.col("_entry") + F.col("_n_before"))
    return join_pieces(numbered, "_entry")


def join_pieces(pieces: DataFrame, entry: str) -> DataFrame:
    """Join the pieces ``(file_path, start_line, end_line, content)`` of each entry in line order."""
    return (
        pieces.groupBy("file_path", entry)
        .agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
             _joined("start_line", "content").alias("content"))
        .select(*ENTRY_COLUMNS)
    )


def _joined(order: str, text: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p.t), "")
