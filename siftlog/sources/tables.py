"""Tables as logs: a row of text is a file, or the rows of one key are the lines of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.operators.running import number_rows, running_total

TURNS_PER_BLOCK = 4_096


def documents_as_files(documents: DataFrame) -> DataFrame:
    """``(file_path, text)``: one document is one file."""
    return documents.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".log")).alias("file_path"), "text"
    )


def events_as_lines(events: DataFrame) -> DataFrame:
    """``(file_path, line_no, line)``: one user is one file, its events in time order are the lines.

    Lines are numbered per user and minute first, so a user with very many events is not sorted in one task.
    """
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    lines = events.select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit(".log")).alias("file_path"),
        "ts", "event_id",
        F.substring(stamp, 1, 16).alias("_minute"),
        F.concat_ws(" ", stamp, "event_type", F.col("value").cast("string"), F.concat("props", F.lit("\n"))).alias("line"),
    )
    return number_rows(lines, ["file_path"], "_minute", ["ts", "event_id"], "line_no").select(
        "file_path", "line_no", "line"
    )


def conversations_as_lines(conversations: DataFrame, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """``(file_path, line_no, line)``: one conversation is one file, each turn begins with ``role: ``."""
    turns = conversations.select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".log")).alias("file_path"),
        "turn",
        F.floor(F.col("turn") / turns_per_block).alias("_block"),
        F.split(F.concat("role", F.lit(": "), "text"), "\n", -1).alias("_lines"),
    )
    ends = running_total(
        turns, ["file_path"], "_block", ["turn"], F.size("_lines").cast("bigint"), "_end"
    )
    return ends.select(
        "file_path", (F.col("_end") - F.size("_lines")).alias("_before"), F.posexplode("_lines").alias("_i", "_x")
    ).select(
        "file_path",
        (F.col("_before") + F.col("_i") + 1).alias("line_no"),
        F.concat("_x", F.lit("\n")).alias("line"),
    )
