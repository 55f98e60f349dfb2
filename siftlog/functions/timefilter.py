"""Time range over entries: the first timestamp found in the text, both ends inclusive."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlog.errors import InvalidPattern
from siftlog.functions.dialect import ignores_final_newline
from siftlog.functions.linear import first_match, matcher

# The accepted timestamp shapes and the accepted names of the two bounds.
_NAIVE = r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d+)?"
_ZONED = r"\d{4}-\d{2}-\d{2}[ Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})"
START_NAMES = ("time_start", "start_time", "startTime", "after")
END_NAMES = ("time_end", "end_time", "endTime", "before")


def parse_timestamp(text: Column) -> Column:
    """TIMESTAMP of an accepted shape, else NULL. Text without an offset is UTC, whatever the session zone.

    A chain that uses ``text`` once: a filter evaluates each mention of its input again.
    """
    accepted = F.regexp_extract(text, rf"\A(?:{_NAIVE}|{_ZONED})\z", 0)
    zoned = F.regexp_replace(accepted, r"\A([0-9-]+[ Tt][0-9:.]+)\z", "$1Z")
    return F.upper(zoned).try_cast("timestamp")


def extract_timestamp(content: Column, pattern: str) -> Column:
    """The first match of the pattern as a TIMESTAMP, NULL where there is none or it cannot be read."""
    return parse_timestamp(first_match(content, matcher(pattern)))


@dataclass(frozen=True)
class TimeFilter:
    start: str | None = None
    end: str | None = None
    timestamp_regex: str | None = None

    @classmethod
    def of(cls, value: "TimeFilter | Mapping | None", default_regex: str | None = None) -> "TimeFilter":
        if value is None:
            value = cls()
        if not isinstance(value, TimeFilter):
            def pick(names):
                return next((value[n] for n in names if value.get(n) is not None), None)

            value = cls(pick(START_NAMES), pick(END_NAMES), value.get("timestamp_regex"))
        if value.timestamp_regex is None:
            value = cls(value.start, value.end, default_regex)
        return value

    @property
    def ignores_final_newline(self) -> bool:
        return self.timestamp_regex is None or ignores_final_newline(self.timestamp_regex)

    def keeps(self, content: Column, strict: bool = False) -> Column | None:
        """The range condition, or ``None`` where nothing is filtered (no bounds, no usable regex)."""
        if strict:
            for bound in (self.start, self.end):
                if bound is not None and not re.fullmatch(f"{_NAIVE}|{_ZONED}", bound):
                    raise ValueError(f"not a timestamp: {bound!r}")
        if self.timestamp_regex is None or (self.start is None and self.end is None):
            return None
        try:
            stamp = extract_timestamp(content, self.timestamp_regex)
        except InvalidPattern:
            if strict:
                raise
            return None
        conditions = []
        if self.start is not None:
            conditions.append(F.coalesce(stamp >= parse_timestamp(F.lit(self.start)), F.lit(True)))
        if self.end is not None:
            conditions.append(F.coalesce(stamp <= parse_timestamp(F.lit(self.end)), F.lit(True)))
        return reduce(and_, conditions)
