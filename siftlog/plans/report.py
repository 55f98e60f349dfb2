"""Step report: several named searches over one time window, answered by one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.functions.terms import LogicalQuery, Term
from siftlog.functions.timefilter import TimeFilter
from siftlog.plans.search import entry_condition
from siftlog.sources.inventory import path_order

# Lengths of the shown texts, signs of a failed lock, and the reasons looked for.
SAMPLE_CHARS = 100
FAILED_SAMPLE_CHARS = 150
FAILED = LogicalQuery(must=[Term("failedResult", case_sensitive=True)], none=[Term("[]", case_sensitive=True)])
REASONS = ("OCCUPIED", "DEADLOCK")

_SPACE = r"[\s\x1C-\x1F]+"


@dataclass(frozen=True)
class Step:
    """One search of a report. ``failed`` marks which of its hits count as failures."""

    name: str
    query: LogicalQuery
    failed: LogicalQuery | None = None

    @classmethod
    def of(cls, name: str, must=(), any=(), none=(), failed: LogicalQuery | None = None) -> "Step":
        return cls(name, LogicalQuery.of(must=must, any=any, none=none), failed)


def step_report(
    entries: DataFrame,
    steps: Sequence[Step],
    time_filter: TimeFilter | Mapping | None = None,
    default_timestamp_regex: str | None = None,
    reasons: Sequence[str] = REASONS,
) -> DataFrame:
    """Per step: hits, the start of the first hit's text, the first failed hit and its reason.

    ``steps(step_no, step, hits, sample, failed_sample, failed_reason)``; the first hit is the
    first in file and line order.  One aggregation, without a shuffle of entries.
    """
    stamp = TimeFilter.of(time_filter, default_timestamp_regex).keeps(F.col("content"))
    if stamp is not None:
        entries = entries.filter(stamp)
    place = F.struct(path_order("file_path").alias("file"), "start_line")
    trimmed = F.regexp_replace("content", f"(?U)\\A{_SPACE}|{_SPACE}\\z", "")

    def first(value: Column, where: Column) -> Column:
        return F.min_by(F.when(where, value), F.when(where, place))

    measures, rows = [], []
    for k, step in enumerate(steps):
        hit = F.col(f"hit_{k}")
        entries = entries.withColumn(f"hit_{k}", entry_condition(step.query)(F.col("content")))
        measures += [
            F.count_if(hit).alias(f"hits_{k}"),
            first(F.substring(trimmed, 1, SAMPLE_CHARS), hit).alias(f"sample_{k}"),
        ]
        failed_sample = failed_reason = F.lit(None).cast("string")
        if step.failed is not None:
            failed = hit & step.failed.matches(F.col("content"))
            reason = F.coalesce(*(F.when(F.contains("content", F.lit(r)), F.lit(r)) for r in reasons))
            measures += [
                first(F.substring(trimmed, 1, FAILED_SAMPLE_CHARS), failed).alias(f"failed_sample_{k}"),
                first(reason, failed).alias(f"failed_reason_{k}"),
            ]
            failed_sample, failed_reason = F.col(f"failed_sample_{k}"), F.col(f"failed_reason_{k}")
        rows.append(F.struct(
            F.lit(k + 1).alias("step_no"), F.lit(step.name).alias("step"), F.col(f"hits_{k}").alias("hits"),
            F.col(f"sample_{k}").alias("sample"), failed_sample.alias("failed_sample"),
            failed_reason.alias("failed_reason"),
        ))
    return entries.agg(*measures).select(F.inline(F.array(*rows)))
