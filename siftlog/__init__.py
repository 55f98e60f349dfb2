"""siftlog: find, page and summarise entries of very large text logs with Spark."""

from siftlog.errors import ConfigError, FileAccessError, InvalidPattern, InvalidRequest
from siftlog.functions.positions import match_positions, term_positions
from siftlog.functions.terms import LogicalQuery, Term, match_all, match_any, match_none
from siftlog.functions.timefilter import TimeFilter, extract_timestamp, parse_timestamp
from siftlog.operators.entries import entries_from_lines, entries_from_text, lines_from_text
from siftlog.operators.paging import cap_hits, cap_per_file, files_within_cap, take_page, totals
from siftlog.plans.report import Step, step_report
from siftlog.plans.search import SearchRequest, SearchResult, Settings, as_hits, filter_entries, search_entries, search_files
from siftlog.sources.inventory import list_files, select_paths
from siftlog.sources.scan import read_lines, scan_files

__all__ = [
    "ConfigError", "FileAccessError", "InvalidPattern", "InvalidRequest",
    "LogicalQuery", "SearchRequest", "SearchResult", "Settings", "Step", "Term", "TimeFilter",
    "cap_hits", "cap_per_file", "entries_from_lines", "entries_from_text", "extract_timestamp",
    "as_hits", "files_within_cap", "filter_entries", "lines_from_text", "list_files", "match_all", "match_any", "match_none",
    "match_positions", "parse_timestamp", "read_lines", "scan_files", "search_entries", "search_files",
    "select_paths", "step_report", "take_page", "term_positions", "totals",
]
