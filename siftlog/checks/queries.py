"""Every operator as a query over the given tables (whole tables, whole texts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.functions.positions import match_positions, term_positions
from siftlog.functions.terms import LogicalQuery, Term, match_all, match_any, match_none
from siftlog.functions.timefilter import extract_timestamp
from siftlog.operators.entries import entries_from_lines, entries_from_text
from siftlog.operators.paging import cap_hits, cap_per_file, files_within_cap, page_bounds, take_page, totals
from siftlog.plans.report import Step, step_report
from siftlog.plans.search import Settings, as_hits, entry_condition, filter_entries, search_entries, search_files
from siftlog.session import new_folder
from siftlog.sources.inventory import list_files, path_order, select_paths, with_uris
from siftlog.sources.scan import read_lines
from siftlog.sources.tables import conversations_as_lines, documents_as_files, events_as_lines

SECONDS = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
DOCS_PER_FILE = 1_000


# ------------------------------------------------------------------ inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return documents_as_files(table(spark, sf_dir, "documents"))


def document_lines(spark, sf_dir) -> DataFrame:
    """Single-line entries of all documents."""
    return entries_from_text(documents(spark, sf_dir))


def event_entries(spark, sf_dir) -> DataFrame:
    return entries_from_lines(events_as_lines(table(spark, sf_dir, "events")))


_written: dict[tuple, str] = {}


def document_files(spark: SparkSession, sf_dir: str, kind: str = "plain") -> str:
    """Folder of log files made from all documents, written once per session to the shared folder.

    A file holds up to DOCS_PER_FILE documents of one source in id order, each under a line
    ``DOC <id> <lang>``.  ``kind``: "plain", "gzip", "latin1", "mixed_gzip", where the sources
    with a 3 or 7 at the end are Latin-1 and so not readable as UTF-8, "mixed_utf16", where they are
    UTF-16 with a mark, or "odd_names", which Spark's reader would drop or take for compressed.
    """
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        docs = table(spark, sf_dir, "documents").select(
            "source", (F.col("doc_id") / DOCS_PER_FILE).cast("bigint").alias("chunk"), "doc_id",
            F.concat(F.lit("DOC "), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit("\n"), "text").alias("value"),
        )
        latin1 = F.encode("value", "ISO-8859-1").cast("string")
        if kind == "latin1":
            docs = docs.withColumn("value", latin1)
        elif kind == "mixed_gzip":
            docs = docs.withColumn("value", F.when(F.col("source").rlike("[37]$"), latin1).otherwise(F.col("value")))
        folder = new_folder(spark, "logs")
        if kind == "mixed_utf16":
            wide = docs.filter(F.col("source").rlike("[37]$"))
            first = wide.groupBy("source", "chunk").agg(F.min("doc_id").alias("first"))
            wide = wide.join(first, ["source", "chunk"]).withColumn("value", F.concat(
                F.when(F.col("doc_id") == F.col("first"), F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit(""))),
                F.encode("value", "UTF-16LE")).cast("string")).drop("first")
            _write_files(wide, folder, lineSep="\n\0")  # the same bytes in UTF-16LE
            docs = docs.filter(~F.col("source").rlike("[37]$"))
        _write_files(docs, folder, compression="gzip" if kind.endswith("gzip") else "none")
        if kind == "odd_names":
            _rename_files(spark, folder)
        _written[key] = folder
    return _written[key]


def _write_files(docs: DataFrame, folder: str, **options: str) -> None:
    writer = docs.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "doc_id").drop("doc_id").write
    writer.partitionBy("source", "chunk").mode("append").options(**options).text(folder)


def _rename_files(spark: SparkSession, folder: str) -> None:
    """Every third file gets a hidden name, every third one the ending of a codec."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    store = path_of(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted(r.uri for r in with_uris(spark, folder, ["**/part-*.txt"]).select("uri").collect())
    for i, name in enumerate(names):
        if i % 3:
            above, last = name.rsplit("/", 1)
            store.rename(path_of(name), path_of(above + "/" + ("_" + last if i % 3 == 1 else last + ".zst")))


def short_path(df: DataFrame) -> DataFrame:
    """Paths of derived files without the run's folder and part name."""
    return df.withColumn("file_path", F.regexp_extract("file_path", r"source=[^/]+/chunk=\d+", 0))


# ------------------------------------------------------------------ shapes of results


def as_text(positions) -> F.Column:
    return F.array_join(F.transform(positions, lambda p: F.concat_ws(
        ":", p.offset.cast("string"), p.length.cast("string"))), ",")


def flat_hits(hits: DataFrame) -> DataFrame:
    return hits.select("file_path", "start_line", "end_line", "content", as_text(F.col("match_positions")).alias("positions"))


def exploded(entries: DataFrame, positions) -> DataFrame:
    return entries.select("file_path", "start_line", F.posexplode(positions).alias("pos", "p")).select(
        "file_path", "start_line", F.col("pos").cast("bigint").alias("pos"), F.col("p.offset").alias("match_offset"), F.col("p.length").alias("match_length")
    )


def matching(*must, **kw) -> Callable:
    """Single-line entries of documents that satisfy a query."""

    def run(spark, sf_dir):
        keep = entry_condition(LogicalQuery.of(must=must, **kw))
        return document_lines(spark, sf_dir).filter(keep(F.col("content")))

    return run


def positions_of(term: Term) -> Callable:
    def run(spark, sf_dir):
        return exploded(document_lines(spark, sf_dir), term_positions(F.col("content"), term))

    return run


# ------------------------------------------------------------------ queries


def multi_line_entries(spark, sf_dir):
    return entries_from_text(documents(spark, sf_dir), "^[A-M]")


def multi_line_conversations(spark, sf_dir):
    return entries_from_lines(conversations_as_lines(table(spark, sf_dir, "conversations")), "^user: ")


def numbered_events(spark, sf_dir):
    return events_as_lines(table(spark, sf_dir, "events"))


def regex_long_entries(spark, sf_dir):
    """Whole documents as entries, under patterns that a backtracking search could try in very many ways."""
    whole = entries_from_text(documents(spark, sf_dir), r"^\x00")
    return filter_entries(
        whole, must=[Term(r"[Tt]h(e|en|an)+ (.|\n)*(on|ing)+\.\n", regex=True, case_sensitive=True)],
        none=[Term(r"(en|er|\n)+the(.|\n)* (a|an|and)+\.", regex=True, case_sensitive=True)])


def match_columns(spark, sf_dir):
    content = F.col("content")
    return document_lines(spark, sf_dir).select(
        "file_path", "start_line",
        match_all(["en", "le"], content).alias("all_of"),
        match_any(["que", "the", "der"], content).alias("any_of"),
        match_none(["que", Term("The", case_sensitive=True)], content).alias("none_of"),
    )


def extract_timestamps(spark, sf_dir):
    stamp = extract_timestamp(F.col("content"), SECONDS + r"\.\d+")
    return event_entries(spark, sf_dir).select("file_path", "start_line", stamp.cast("timestamp_ntz").alias("entry_ts"))


def in_window(regex: str, after: str | None, before: str | None) -> Callable:
    def run(spark, sf_dir):
        window = {"after": after, "before": before, "timestamp_regex": regex}
        return filter_entries(event_entries(spark, sf_dir), time_filter=window)

    return run


def positions_concat(spark, sf_dir):
    query = LogicalQuery.of(
        must=["en"], any=[Term("le", whole_word=True), Term("[aeiou]n[a-z]+", regex=True)], none=["zz"]
    )
    return exploded(document_lines(spark, sf_dir), match_positions(F.col("content"), query))


def hits_without_content(spark, sf_dir):
    return flat_hits(search_entries(document_lines(spark, sf_dir), must=["ENTER"], include_content=False))


def error_hits(spark, sf_dir):
    return filter_entries(event_entries(spark, sf_dir), must=["error"])


def capped_per_file(spark, sf_dir):
    return cap_per_file(error_hits(spark, sf_dir), 5)


def capped_across_files(spark, sf_dir):
    return cap_hits(error_hits(spark, sf_dir), 7)


def capped_files(spark, sf_dir):
    return files_within_cap(error_hits(spark, sf_dir), 200)


def page_two(spark, sf_dir):
    skip, size = page_bounds(2, 25, 10, 100)
    return take_page(error_hits(spark, sf_dir), skip, size)


def search_totals(spark, sf_dir):
    skip, size = page_bounds(3, 500, 10, 100)
    return totals(error_hits(spark, sf_dir), 3, size)


def count_only(spark, sf_dir):
    return totals(matching("que")(spark, sf_dir), 1, 20).select("total_hits", "total_pages")


def glob_include_exclude(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return select_paths(
        pages, include=["**/fr/**", "https://*.{net,org}/[de][en]/?*"], exclude=["*ref=x", "**/blog.*/**"]
    )


def path_ranks(spark, sf_dir):
    """Path order as a ranking: how many paths come before in component order."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    first = take_page(pages.select(F.col("path").alias("file_path"), F.lit(1).alias("start_line")), 0, 100)
    return first.select(F.col("file_path").alias("path"))


def listed_files(spark, sf_dir):
    """Files written from all documents, as the walk lists them, beside what the table says about them."""
    files = short_path(list_files(spark, document_files(spark, sf_dir), include=["**/part-*.txt"]).withColumnRenamed("path", "file_path"))
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    found = files.withColumn("source", F.regexp_extract("file_path", "source=([^/]*)/", 1))
    return found.join(docs, "source").groupBy("source", "documents").agg(F.count(F.lit(1)).alias("files"))


def constant_terms(spark, sf_dir):
    """Every line beside conditions that no text can change: a null term excludes all, an invalid one in ``must`` matches none."""
    content = F.col("content")
    return document_lines(spark, sf_dir).select(
        "file_path", "start_line", LogicalQuery.of(must=["e"], none=[None]).matches(content).alias("null_in_none"),
        LogicalQuery.of(must=[Term(r"(e)\1", regex=True)]).matches(content).alias("invalid_in_must"))


def event_report(spark, sf_dir):
    steps = [
        Step.of("errors", must=["error", '"k": 1']),
        Step.of("clicks", must=["click"], failed=LogicalQuery.of(
            must=[Term('"k": 9', case_sensitive=True)], none=[Term('"k": 99', case_sensitive=True)])),
        Step.of("money", any=["purchase", "signup"]),
        Step.of("nothing", must=["no such text"]),
    ]
    window = {"after": "2024-01-05 00:00:00", "before": "2024-01-20T23:59:59", "timestamp_regex": SECONDS}
    return step_report(event_entries(spark, sf_dir), steps, window, reasons=("user/1", "95", "97"))


END_TO_END = LogicalQuery.of(
    must=["en", Term(r"\b[a-z]{2,4}\b", regex=True)], any=[Term("le", whole_word=True), "the"],
    none=[Term("Que", case_sensitive=True)],
)


def search_end_to_end(spark, sf_dir):
    entries = entries_from_text(documents(spark, sf_dir), "^[A-M]")
    return flat_hits(search_entries(entries, END_TO_END))


def search_events_end_to_end(spark, sf_dir):
    window = {"start_time": "2024-01-03 12:00:00", "end_time": "2024-01-25 00:00:00", "timestamp_regex": SECONDS}
    query = LogicalQuery.of(must=["e"], any=["error", "view"], none=['"k": 1'])
    found = filter_entries(event_entries(spark, sf_dir), query, window)
    skip, size = page_bounds(2, 40, 10, 100)
    return flat_hits(as_hits(take_page(cap_hits(found, 150), skip, size), query))


def files_result(spark, sf_dir, kind="plain", **request):
    folder = document_files(spark, sf_dir, kind)
    body = {"scan_config": {"root_path": folder, "include_globs": ["**/part-*.txt", "**/part-*.txt.gz"]}, **request}
    return search_files(spark, body, Settings(max_page_size=50))


def files_single_line(spark, sf_dir):
    query = {"must": ["enter"], "none": [{"query": "le", "whole_word": True}]}
    return flat_hits(short_path(files_result(spark, sf_dir, logical_query=query).all_hits))


def files_multi_line(spark, sf_dir):
    query = {"must": ["enter"], "any": ["the", "der"]}
    result = files_result(spark, sf_dir, logical_query=query, log_start_pattern=r"^DOC \d+ \w+")
    return flat_hits(short_path(result.all_hits))


def files_multi_line_page(spark, sf_dir):
    result = files_result(
        spark, sf_dir, logical_query={"must": ["the"]}, log_start_pattern=r"^DOC \d+ \w+", page=2, page_size=30
    )
    return short_path(result.hits).select("file_path", "start_line", "end_line", "content")


def files_summary(spark, sf_dir):
    result = files_result(spark, sf_dir, logical_query={"must": ["the"]}, max_hits=400)
    return result.summary


def gzip_lines(spark, sf_dir):
    folder = document_files(spark, sf_dir, "gzip")
    return short_path(read_lines(spark, with_uris(spark, folder, ["**/*.txt.gz"])))


def charset_lines(spark, sf_dir):
    folder = document_files(spark, sf_dir, "latin1")
    return short_path(read_lines(spark, with_uris(spark, folder, ["**/*.txt"]), "ISO-8859-1"))


def charset_mixed(spark, sf_dir):
    folder = document_files(spark, sf_dir, "mixed_utf16")
    return short_path(read_lines(spark, with_uris(spark, folder, ["**/*.txt"])))


def files_odd_names(spark, sf_dir):
    folder = document_files(spark, sf_dir, "odd_names")
    body = {"scan_config": {"root_path": folder, "include_globs": ["**/part-*", "**/_part-*"], "exclude_globs": ["**/*.crc"]},
            "logical_query": {"must": ["enter"], "any": ["the", "der"]}, "log_start_pattern": r"^DOC \d+ \w+"}
    return flat_hits(short_path(search_files(spark, body).all_hits))


def failed_files(spark, sf_dir):
    result = files_result(spark, sf_dir, "mixed_gzip", logical_query={"must": ["the"]})
    return short_path(result.failed_files)


def files_beside_failed(spark, sf_dir):
    result = files_result(spark, sf_dir, "mixed_gzip", logical_query={"must": ["the"]})
    return short_path(result.all_hits).select("file_path", "start_line", "content")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "single_line_entries": document_lines,
    "multi_line_entries": multi_line_entries,
    "multi_line_conversations": multi_line_conversations,
    "numbered_events": numbered_events,
    "contains_ignore_case": matching("ENTER"),
    "contains_case_sensitive": matching(Term("The", case_sensitive=True)),
    "regex_ignore_case": matching(Term(r"^the [a-z]+tion|dé.e", regex=True)),
    "regex_case_sensitive": matching(Term(r"[A-Z][a-z]+ [A-Z]|\.$", regex=True, case_sensitive=True)),
    "regex_long_entries": regex_long_entries,
    "whole_word": matching(Term("LE", whole_word=True)),
    "whole_word_case_sensitive": matching(Term("de", whole_word=True, case_sensitive=True)),
    "must_any_none": matching("en", any=["que", "the", "der"], none=[Term("tion", case_sensitive=True)]),
    "match_columns": match_columns,
    "null_term": matching(None, "enter"),
    "invalid_regex_term": matching("enter", any=[Term("(?=x)", regex=True), "th"], none=[Term("e(", regex=True)]),
    "constant_terms": constant_terms,
    "extract_timestamps": extract_timestamps,
    "time_range": in_window(SECONDS, "2024-01-10 08:00:00", "2024-01-12T17:30:00Z"),
    "time_open_range": in_window(SECONDS, None, "2024-01-04T02:00:00+02:00"),
    "time_unparseable_kept": in_window(rf"{SECONDS}\.\d+ (?:error|view)|{SECONDS}", "2024-01-10 08:00:00", "2024-01-11 08:00:00"),
    "time_unreadable_bound": in_window(SECONDS, "soon", "2024-01-02 00:00:00"),
    "positions_plain": positions_of(Term("EN")),
    "positions_plain_case_sensitive": positions_of(Term("é", case_sensitive=True)),
    "positions_whole_word": positions_of(Term("LE", whole_word=True)),
    "positions_regex": positions_of(Term("[aeiou]n[a-z]*", regex=True)),
    "positions_linear": positions_of(Term("(en|an|t)+e", regex=True, case_sensitive=True)),
    "positions_concat": positions_concat,
    "hits_without_content": hits_without_content,
    "cap_per_file": capped_per_file,
    "cap_across_files": capped_across_files,
    "files_within_cap": capped_files,
    "page_two": page_two,
    "search_totals": search_totals,
    "count_only": count_only,
    "glob_include_exclude": glob_include_exclude,
    "path_order": path_ranks,
    "listed_files": listed_files,
    "step_report": event_report,
    "search_end_to_end": search_end_to_end,
    "search_events_end_to_end": search_events_end_to_end,
    "files_single_line": files_single_line,
    "files_multi_line": files_multi_line,
    "files_multi_line_page": files_multi_line_page,
    "files_summary": files_summary,
    "gzip_lines": gzip_lines,
    "charset_lines": charset_lines,
    "charset_mixed": charset_mixed,
    "files_odd_names": files_odd_names,
    "failed_files": failed_files,
    "files_beside_failed": files_beside_failed,
}
