"""The search itself: over an entry table, and over log files."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftlog.errors import ConfigError, InvalidRequest
from siftlog.functions.positions import match_positions
from siftlog.functions.terms import LogicalQuery
from siftlog.functions.timefilter import TimeFilter
from siftlog.operators import paging
from siftlog.operators.paging import cap_hits, cap_per_file, counted_within_cap, page_bounds, page_totals, take_page, without_content
from siftlog.session import written
from siftlog.sources.inventory import (
    display_path,
    file_status,
    require_directory,
    shown_under_root,
    with_uris,
)
from siftlog.sources.scan import FileScan, scan_files

LOCAL_LISTING = 10_000  # longest file list that plans carry themselves
HIT_COLUMNS = ["file_path", "start_line", "end_line", "content", "match_positions"]


@dataclass(frozen=True)
class Settings:
    """Defaults of a deployment; a request overrides the patterns."""

    default_page_size: int = 10
    max_page_size: int = 100
    default_log_start_pattern: str | None = None
    default_timestamp_regex: str | None = None
    log_file_paths: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.default_page_size <= 0:
            raise ConfigError("default_page_size must be > 0")
        if self.max_page_size <= 0:
            raise ConfigError("max_page_size must be > 0")
        if self.max_page_size < self.default_page_size:
            raise ConfigError("max_page_size must be >= default_page_size")


@dataclass(frozen=True)
class SearchRequest:
    root_path: str = ""
    include_globs: Sequence[str] = ()
    exclude_globs: Sequence[str] = ()
    query: LogicalQuery = field(default_factory=LogicalQuery)
    time_filter: TimeFilter | None = None
    log_start_pattern: str | None = None
    page: int = 1
    page_size: int = 0
    max_hits: int | None = None
    include_content: bool = True
    charset: str = "auto"

    @classmethod
    def of(cls, body: Mapping) -> "SearchRequest":
        """From the JSON body of a search call. Keys that only steer a server are ignored."""
        scan = body.get("scan_config") or {}
        stamp = body.get("time_filter")
        page = body.get("page")
        include_content = body.get("include_content")
        return cls(
            root_path=scan.get("root_path") or "",
            include_globs=tuple(scan.get("include_globs") or ()),
            exclude_globs=tuple(scan.get("exclude_globs") or ()),
            query=LogicalQuery.of(body.get("logical_query") or {}),
            time_filter=None if stamp is None else TimeFilter.of(stamp),
            log_start_pattern=body.get("log_start_pattern"),
            page=1 if page is None else page,
            page_size=body.get("page_size") or 0,
            max_hits=body.get("max_hits"),
            include_content=True if include_content is None else include_content,
            charset=body.get("charset") or "auto",
        )


@dataclass(frozen=True)
class SearchResult:
    """One page of hits, one row of totals, the files that could not be read, and all hits.

    The first use of ``hits`` or ``summary`` reads the text once and writes what both are made of.
    """

    failed_files: DataFrame
    finish: Callable[[DataFrame], DataFrame]
    page_and_totals: Callable[[], tuple[DataFrame, DataFrame]]
    capped: Callable[[], DataFrame]

    @cached_property
    def _shown(self) -> tuple[DataFrame, DataFrame]:
        return self.page_and_totals()

    @property
    def hits(self) -> DataFrame:
        return self._shown[0]

    @property
    def summary(self) -> DataFrame:
        return self._shown[1]

    @cached_property
    def capped_entries(self) -> DataFrame:
        """What ``all_hits`` are made of, without positions."""
        return self.capped()

    @property
    def all_hits(self) -> DataFrame:
        """Every hit after the caps, not only one page."""
        return self.finish(self.capped_entries)


def entry_condition(
    query: LogicalQuery, time_filter: TimeFilter | None = None, strict: bool = False
):
    """``content -> boolean``: first the time range, then the text."""

    def keep(content: Column) -> Column:
        in_time = time_filter.keeps(content, strict) if time_filter is not None else None
        text = query.matches(content, strict)
        return text if in_time is None else in_time & text

    return keep


def filter_entries(
    entries: DataFrame,
    query: LogicalQuery | Mapping | None = None,
    time_filter: TimeFilter | Mapping | None = None,
    default_timestamp_regex: str | None = None,
    strict: bool = False,
    **terms,
) -> DataFrame:
    """The entries that a search would hit: one filter, nothing is shuffled."""
    stamp = TimeFilter.of(time_filter, default_timestamp_regex)
    return entries.filter(entry_condition(LogicalQuery.of(query, **terms), stamp, strict)(F.col("content")))


def search_entries(
    entries: DataFrame,
    query: LogicalQuery | Mapping | None = None,
    time_filter: TimeFilter | Mapping | None = None,
    default_timestamp_regex: str | None = None,
    include_content: bool = True,
    strict: bool = False,
    **terms,
) -> DataFrame:
    """Hits of an entry table: a filter and a projection, nothing is shuffled.

    To cap or page hits, do that to ``filter_entries`` and call ``as_hits`` on what is left.
    """
    query = LogicalQuery.of(query, **terms)
    kept = filter_entries(entries, query, time_filter, default_timestamp_regex, strict)
    return as_hits(kept, query, include_content, strict)


def as_hits(entries: DataFrame, query: LogicalQuery, include_content: bool = True, strict: bool = False) -> DataFrame:
    hits = entries.withColumn("match_positions", match_positions(F.col("content"), query, strict)).select(*HIT_COLUMNS)
    return hits if include_content else without_content(hits)


def validate(spark: SparkSession, request: SearchRequest, settings: Settings) -> None:
    if not request.root_path:
        if not settings.log_file_paths:
            raise InvalidRequest("root_path is empty and no log_file_paths are configured")
    else:
        require_directory(spark, request.root_path)
    if request.page == 0:
        raise InvalidRequest("page must be >= 1")


def search_files(
    spark: SparkSession,
    request: SearchRequest | Mapping | None = None,
    settings: Settings | None = None,
    strict: bool = False,
    **changes,
) -> SearchResult:
    """Search log files. Lists them and counts lines per split now; everything else is lazy."""
    settings = settings or Settings()
    request = request if isinstance(request, SearchRequest) else SearchRequest.of(request or {})
    request = replace(request, **changes)
    validate(spark, request, settings)
    stamp = TimeFilter.of(request.time_filter, settings.default_timestamp_regex)
    pattern = request.log_start_pattern
    pattern = settings.default_log_start_pattern if pattern is None else pattern
    query = request.query

    files = with_uris(
        spark, request.root_path, request.include_globs, request.exclude_globs, settings.log_file_paths
    )
    # Spark's own file index keeps these addresses on the driver too
    names = files.select("path", "uri", "length").collect()
    if request.root_path:
        names.sort(key=lambda n: n.path.split("/"))
    scan = open_scan(spark, names, request.root_path, pattern, request.charset)
    keep = entry_condition(query, stamp, strict)
    tail_safe = query.ignores_final_newline and stamp.ignores_final_newline

    listed, file, order = _listing(spark, names), ["file_path"], None
    first = F.lit(False) if not names else F.col("file_path") == names[0].path
    if not request.root_path:  # read as given: in that order, repeats again
        file, order = ["place", "file_path"], F.col("place")
        first = first & (F.col("place") == 0)
    skip, size = page_bounds(request.page, request.page_size, settings.default_page_size, settings.max_page_size)
    limit = None if request.max_hits is None else max(request.max_hits, 1)

    def given(rows: DataFrame) -> DataFrame:
        return rows if request.root_path else rows.join(listed.withColumnRenamed("path", "file_path"), "file_path")

    def finish(entries: DataFrame) -> DataFrame:  # positions last: only for what is shown
        return as_hits(entries, query, request.include_content, strict)

    def first_hits(most: int) -> tuple[DataFrame, DataFrame]:
        """Hits after the caps, at least the first ``most`` of them, and hits per file."""
        entries, counts = (given(rows) for rows in scan.first_hits(keep, tail_safe, most))
        if limit is None:
            return entries, counts
        if request.max_hits <= 0:
            return cap_per_file(entries.filter(first), 1, file=file), counts
        kept = counted_within_cap(counts, limit, file, order).select(*file)
        return cap_per_file(entries.join(kept, file, "left_semi"), min(most, limit), file=file), counts

    def every() -> DataFrame:
        if limit is not None and limit <= paging.TOP_K_ROWS:
            return first_hits(limit)[0]
        return cap_hits(given(scan.entries(keep, tail_safe)), request.max_hits, file, order, first)

    def page_and_totals() -> tuple[DataFrame, DataFrame]:
        near = skip + size <= paging.TOP_K_ROWS
        entries, counts = first_hits((skip + size if limit is None else min(skip + size, limit)) if near else 0)
        page = take_page(entries if near else every(), skip, size, order)
        counted = _counted(counts, request.max_hits, listed, len(names), file, order, first)
        return finish(page), page_totals(counted, request.page, size, "files_scanned")

    return SearchResult(scan.failed_files(), finish, page_and_totals, every)


def _listing(spark: SparkSession, names: list[Row]) -> DataFrame:
    """``(place, path)`` of the files; a long list goes to a table instead of into every plan."""
    listed = spark.createDataFrame([(i, n.path) for i, n in enumerate(names)], "place bigint, path string")
    return listed if len(names) <= LOCAL_LISTING else written(spark, listed, "files")


def open_scan(
    spark: SparkSession, files: DataFrame | list[Row], root: str = "", pattern: str | None = None, charset: str = "auto"
) -> FileScan:
    """A scan whose paths read as in the listing ``files(path, uri, length)``."""
    if isinstance(files, DataFrame):
        files = files.select("path", "uri", "length").collect()
    root_uri = None
    if root:
        status = file_status(spark, root)
        root_uri = None if status is None else status.getPath().toString()

    def show(uri: Column) -> Column:
        if root_uri is None:
            return display_path(uri)
        walked = uri.startswith(root_uri.rstrip("/") + "/") | (uri == root_uri)
        return F.when(walked, shown_under_root(uri, root_uri, root)).otherwise(display_path(uri))

    # explicit paths may be spelled in their own way, and one file in several
    inside = None if root_uri is None else root_uri.rstrip("/") + "/"
    spelled = {(f.uri, f.path) for f in files}
    odd = {
        uri for uri, path in spelled
        if not (inside and uri.startswith(inside) and path == root.rstrip("/") + "/" + uri[len(inside):])
        and path != re.sub("^file:/+", "/", uri) and uri != root_uri
    }
    odd = sorted(s for s in spelled if s[0] in odd)
    return scan_files(spark, [(f.uri, f.length) for f in files], pattern, charset, show, odd)


def _counted(
    counts: DataFrame, max_hits: int | None, listed: DataFrame, files: int, file: list[str], order: Column | None, first: Column,
) -> DataFrame:
    """One row: hits after caps, and files read until the cap stops the search, unreadable ones included."""
    every = F.lit(files).cast("bigint")
    if max_hits is not None and max_hits <= 0:
        return counts.filter(first).agg(F.count(F.lit(1)).alias("total_hits")).select(
            "total_hits", F.least(every, F.lit(1).cast("bigint")).alias("files_scanned"))
    total = F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("total_hits")
    if max_hits is None:
        return counts.agg(total).select("total_hits", every.alias("files_scanned"))
    reached = counted_within_cap(counts, max_hits, file, order)
    if "place" not in file:
        reached = reached.join(listed.withColumnRenamed("path", "file_path"), "file_path")
    return reached.agg(total, F.max("place").alias("last")).select("total_hits", F.when(
        F.col("total_hits") < max_hits, every).otherwise(F.col("last") + 1).alias("files_scanned"))
