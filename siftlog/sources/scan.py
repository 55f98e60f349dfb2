"""Log files on storage to entries: plain, gzip, UTF-16 and declared-charset text.

A file is read in splits ("blocks").  One pass counts lines and entry starts per block and
writes that small table to the shared folder.  The search pass then needs no shuffle of the
text: it filters inside the scan and looks up where a block begins only for what is left.

Both passes must see the same splits, so ``spark.sql.files.minPartitionNum`` is pinned for the
session, and a lookup that does not fit its block fails the job instead of giving wrong numbers.
"""

from __future__ import annotations

import os
import urllib.parse
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.functions.linear import matcher, matches
from siftlog.operators.entries import ENTRY_COLUMNS, entries_from_lines, join_pieces
from siftlog.operators.paging import first_and_counts
from siftlog.operators.running import block_starts
from siftlog.session import written
from siftlog.shipping import ship
from siftlog.sources.inventory import decoded_uri, display_path, encoded_uri, escape_path
from siftlog.sources.stream import gzip_check, streamed_lines

# Name endings that Spark's reader takes for its own or a compressed file's.
READER_ENDINGS = (".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".passthrough", "._COPYING_")
WIDE_CHARSETS = ("UTF-16", "UTF-16LE", "UTF-16BE")  # "\n" is not one byte: cannot be split by bytes
BROADCAST_BLOCKS = 500_000  # about 100 MB; a longer table is joined as Spark sees fit
PLACE_COLUMNS = ["uri", "block", "n", "n_before", "starts_before", "first_row", "first_part", "file_lines", "utf16",
                 "unterminated"]
_ROW_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id

Keep = Callable[[Column], Column]


@contextmanager
def _session_conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _lossy_decode(spark: SparkSession, df: DataFrame, binary: str, charset: str, name: str) -> DataFrame:
    """Decode with any charset of the JVM; undecodable bytes become U+FFFD."""
    with _session_conf(spark, {
        "spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true",
    }):
        return df.withColumn(name, F.decode(F.expr(binary), charset))


def _pin_splits(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def _cut_batches(batches):
    """Cut Arrow batches of lines into pieces of entries, without touching single rows.

    Lines carry their newline, so the text of consecutive lines is one range of the batch's
    character buffer and a piece is made by dropping offsets.  A piece is ``whole`` when the
    next start line of the same block closes it; others are joined later.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    block_of, lines_seen, starts_seen = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        uri, text = batch.column(0), batch.column(2)
        block = batch.column(1).to_numpy()
        start = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        row = np.arange(n)
        fresh = np.empty(n, bool)
        fresh[0] = block_of != (uri[0].as_py(), block[0])
        fresh[1:] = (block[1:] != block[:-1]) | pc.not_equal(
            uri.slice(1), uri.slice(0, n - 1)
        ).to_numpy(zero_copy_only=False)
        if fresh[0]:
            lines_seen = starts_seen = 0

        def since_block_start(counts, carried):
            base = np.where(fresh, counts, np.iinfo(np.int64).min)
            base[0] = 0 if fresh[0] else -carried
            return np.maximum.accumulate(base)

        line = row - since_block_start(row, lines_seen)
        starts = np.cumsum(start)
        entry = starts - since_block_start(starts - start, starts_seen)
        cut = fresh | start
        cut[0] = True
        first = np.flatnonzero(cut)
        after = np.append(first[1:], n)
        closed = np.append((start & ~fresh)[first[1:]], False)
        wide = pa.types.is_large_string(text.type)
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset:text.offset + n + 1]
        content = pa.Array.from_buffers(
            text.type, len(first), [None, pa.py_buffer(np.append(offsets[first], offsets[n])), text.buffers()[2]]
        )
        block_of, lines_seen, starts_seen = (uri[n - 1].as_py(), block[n - 1]), line[-1] + 1, entry[-1]
        yield pa.RecordBatch.from_arrays(
            [uri.take(pa.array(first)), pa.array(block[first]), pa.array(entry[first].astype(np.int64)),
             pa.array(line[first].astype(np.int64)), pa.array((after - first).astype(np.int64)),
             content, pa.array(start[first] & closed)],
            names=["uri", "block", "entry", "line", "lines", "content", "whole"],
        )


_PIECES = "uri string, block bigint, entry bigint, line bigint, lines bigint, content string, whole boolean"


@dataclass
class FileScan:
    """Files ready to be searched with one start pattern."""

    spark: SparkSession
    lines: DataFrame | None  # uri, block, row, part, at_end, text (with "\n"), is_start
    places: DataFrame | None  # one row per (uri, block): where its lines and entries begin
    streamed: DataFrame | None  # uri, line_no, line: files that tasks read themselves
    failed: DataFrame | None  # uri, reason
    failed_count: int
    start_pattern: str | None
    shown: list[tuple[str, str]]  # (address, path) of files that are spelled in their own way, every spelling
    show: Callable[[Column], Column]

    def named(self, df: DataFrame) -> DataFrame:
        """Add ``file_path``; a row of a file with several spellings comes once for each."""
        plain = decoded_uri(F.col("uri"))
        if not self.shown:
            return df.withColumn("file_path", self.show(plain))
        names = self.spark.createDataFrame(self.shown, "_address string, _given string")
        return df.join(names, plain == F.col("_address"), "left").withColumn(
            "file_path", F.coalesce("_given", self.show(plain))).drop("_address", "_given")

    def entries(self, keep: Keep | None = None, keep_ignores_final_newline: bool = False) -> DataFrame:
        """Entries of all readable files, only those that ``keep`` holds for."""
        parts = []
        if self.lines is not None:
            cut = self._single if self.start_pattern is None else self._multi
            parts.append(cut(keep, keep_ignores_final_newline or keep is None))
        if self.streamed is not None:
            parts.append(self._streamed(keep))
        if not parts:
            return self.spark.createDataFrame([], "file_path string, start_line bigint, end_line bigint, content string")
        entries = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self.named(self._readable(entries)).select(*ENTRY_COLUMNS)

    def first_hits(self, keep: Keep, keep_ignores_final_newline: bool, limit: int) -> tuple[DataFrame, DataFrame]:
        """``(entries, counts)``: at least the first ``limit`` hits of each file, and ``(file_path, hits)`` of them all.

        The text is read once, now: each task writes its first hits of a file and their number.  Whole entries
        pass without an exchange; only the pieces at batch and split edges are joined, from what was written.
        """
        parts = []
        if self.lines is not None and self.start_pattern is None:
            parts.append(self._single(keep, keep_ignores_final_newline))
        elif self.lines is not None:
            parts.append(self._placed_pieces(keep))
        if self.streamed is not None:
            parts.append(self._streamed(keep))
        columns = ["uri", "start_line", "end_line", "content"]
        if not parts:
            return (self.spark.createDataFrame([], "file_path string, start_line bigint, end_line bigint, content string"),
                    self.spark.createDataFrame([], "file_path string, hits bigint"))
        whole = {"entry": F.lit(None).cast("bigint"), "whole": F.lit(True)}
        parts = [p if "whole" in p.columns else p.withColumns(whole) for p in parts]
        rows = self._readable(reduce(DataFrame.unionByName, parts)).select(*columns, "entry", "whole")
        found = written(self.spark, rows.mapInArrow(first_and_counts(limit), (
            "uri string, start_line bigint, end_line bigint, content string, entry bigint, whole boolean, hits bigint")), "found")
        hits, counts = found.filter("whole").select(*columns), found.filter("hits is not null").select("uri", "hits")
        if self.start_pattern is not None and self.lines is not None:
            joined = _joined_by_uri(found.filter("not whole"))
            joined = written(self.spark, joined.filter(keep(F.col("content"))), "joined")
            hits = hits.unionByName(joined.select(*columns))
            counts = counts.unionByName(joined.select("uri", F.lit(1).cast("bigint").alias("hits")))
        counts = counts.groupBy("uri").agg(F.sum("hits").alias("hits"))
        return self.named(hits).select(*ENTRY_COLUMNS), self.named(counts).select("file_path", "hits")

    def _readable(self, rows: DataFrame) -> DataFrame:
        if not self.failed_count:
            return rows
        failed = F.broadcast(self.failed) if self.failed_count <= BROADCAST_BLOCKS else self.failed
        return rows.join(failed, "uri", "left_anti")

    def _streamed(self, keep: Keep | None) -> DataFrame:
        df = entries_from_lines(self.streamed.withColumnRenamed("uri", "file_path"), self.start_pattern).withColumnRenamed("file_path", "uri")
        return df if keep is None else df.filter(keep(F.col("content")))

    def failed_files(self) -> DataFrame:
        if self.failed is None:
            return self.spark.createDataFrame([], "file_path string, reason string")
        return self.named(self.failed).select("file_path", "reason")

    def _placed(self, df: DataFrame) -> DataFrame:
        found = df.join(self.places, ["uri", "block"], "left")
        return found.filter(F.coalesce(~F.col("utf16"), F.lit(True)))

    def _single(self, keep: Keep | None, tail_safe: bool) -> DataFrame:
        df, text = self.lines, F.col("text")
        bare = F.expr("left(text, char_length(text) - 1)")
        if keep is not None:
            early = keep(text) if tail_safe else keep(text) | (F.col("at_end") & keep(bare))
            df = df.filter(early)
        offset = F.col("row") - F.col("first_row")
        fits = (F.col("part") == F.col("first_part")) & offset.between(F.lit(0), F.col("n") - 1)
        df = self._placed(df).withColumn("line_no", F.when(fits, F.col("n_before") + offset + 1).otherwise(
            F.raise_error(F.lit("file splits changed between two passes")).cast("bigint")
        ))
        ends_open = F.col("unterminated") & (F.col("line_no") == F.col("file_lines"))
        df = df.select(
            "uri", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"),
            F.when(ends_open, bare).otherwise(text).alias("content"),
        )
        return df if tail_safe else df.filter(keep(F.col("content")))

    def _multi(self, keep: Keep | None, tail_safe: bool) -> DataFrame:
        entries = _joined_by_uri(self._placed_pieces(keep))
        return entries if keep is None else entries.filter(keep(F.col("content")))

    def _placed_pieces(self, keep: Keep | None) -> DataFrame:
        """Whole entries that ``keep`` holds for, and all pieces of others."""
        pieces = self.lines.select("uri", "block", "text", "is_start").mapInArrow(_cut_batches, _PIECES)
        if keep is not None:
            pieces = pieces.filter(~F.col("whole") | keep(F.col("content")))
        line = F.when(F.col("n_before").isNotNull(), F.col("n_before") + F.col("line") + 1).otherwise(
            F.raise_error(F.lit("file splits changed between two passes")).cast("bigint")
        )
        return self._placed(pieces).select(
            F.col("uri"), (F.col("starts_before") + F.col("entry")).alias("entry"),
            line.alias("start_line"), (line + F.col("lines") - 1).alias("end_line"),
            F.when(
                F.col("unterminated") & (line + F.col("lines") - 1 == F.col("file_lines")),
                F.expr("left(content, char_length(content) - 1)"),
            ).otherwise(F.col("content")).alias("content"), "whole",
        )


def _joined_by_uri(pieces: DataFrame) -> DataFrame:
    return join_pieces(pieces.withColumnRenamed("uri", "file_path"), "entry").withColumnRenamed("file_path", "uri")


def _text_rows(
    spark: SparkSession, uris: Sequence[str], gzip: bool, charset: str | None
) -> DataFrame:
    # what cannot be read to its end is reported by its own check
    reader = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    df = reader.text([escape_path(u) for u in uris]).select(
        "value",
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        # only a line that reaches the end of the file can be its last one
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") + F.octet_length("value")
         >= F.col("_metadata.file_size")).alias("at_end"),
        F.monotonically_increasing_id().bitwiseAND(_ROW_IN_PARTITION).alias("row"),
        F.spark_partition_id().alias("part"),
        F.lit(gzip).alias("gzip"),
    )
    if gzip:
        return df.withColumn("text", F.concat("value", F.lit("\n")))
    if charset is None:
        return df.withColumn("text", F.concat(F.make_valid_utf8("value"), F.lit("\n")))
    return _lossy_decode(spark, df, "cast(value as binary)", charset, "text").withColumn(
        "text", F.concat("text", F.lit("\n"))
    )


def _block_table(lines: DataFrame, checked: DataFrame | None) -> DataFrame:
    head = F.substring(F.col("value").cast("binary"), 1, 2)
    mark = F.when(F.hex(head).isin("FFFE", "FEFF") & ~F.col("gzip"), 1).otherwise(0)
    counted = lines.groupBy("uri", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_start").cast("bigint")).alias("starts"),
        F.min("row").alias("first_row"),
        F.min("part").alias("first_part"),
        F.sum(F.octet_length("value").cast("bigint") + 1).alias("bytes"),
        F.max("file_size").alias("file_size"),
        # the mark of the first row: rows are compared first
        F.min(F.when(F.col("block") == 0, F.col("row") * 2 + mark)).alias("head"),
        F.bool_and(~F.col("gzip") | F.is_valid_utf8("value")).alias("valid"),
        F.bool_or("gzip").alias("gzip"),
        F.max(F.struct("row", "is_start", "bare_start")).alias("last"),
    )
    file = Window.partitionBy("uri")
    blocks = block_starts(counted, ["uri"], "block", ["n", "starts"])
    if checked is not None:
        blocks = blocks.withColumn("plain", decoded_uri(F.col("uri"))).join(checked.select("plain", "terminated"), "plain", "left")
    else:
        blocks = blocks.withColumn("terminated", F.lit(True))
    missing = F.col("file_size") - F.sum("bytes").over(file)  # one byte short, or two over with a 3-byte mark
    return blocks.select(
        "uri", "block", "n", "n_before", F.col("starts_before"), "first_row", "first_part", "valid",
        F.sum("n").over(file).alias("file_lines"), F.sum("bytes").over(file).alias("file_bytes"),
        F.coalesce(F.max(F.col("head") % 2).over(file) == 1, F.lit(False)).alias("utf16"),
        F.when(F.col("gzip"), ~F.coalesce("terminated", F.lit(True)))
        .otherwise(missing.isin(-1, 2)).alias("unterminated"),
        F.when(F.col("block") == F.max("block").over(file), F.col("last")).alias("last"),
    )


def _open_ends(blocks: DataFrame) -> DataFrame:
    """Last lines without a newline that the start pattern judges otherwise than with one: usually none."""
    return blocks.filter("unterminated and last.is_start <> last.bare_start").select(
        "uri", "block", F.col("last.row").alias("open_row"), F.col("last.bare_start").alias("open_start"))


def _reads_itself(uri: str) -> bool:
    name = uri.rsplit("/", 1)[-1]
    return name[:1] in (".", "_") or name.endswith(READER_ENDINGS)


def _unreadable(uris: Sequence[str]) -> dict[str, str]:
    """Local files that went away or may not be read since they were listed, with the reason."""
    out = {}
    for uri in uris:
        if uri.startswith("file:"):
            path = uri.removeprefix("file:")
            if not os.path.isfile(path):
                out[uri] = "cannot be read: no such file"
            elif not os.access(path, os.R_OK):
                out[uri] = "cannot be read: permission denied"
    return out


def _short(spark: SparkSession, blocks: DataFrame | None, sizes: dict[str, int]) -> DataFrame:
    """``(uri, reason)`` of plain files of which less was read than was listed."""
    listed = spark.createDataFrame(
        [(u, urllib.parse.quote(u, safe="/:"), n) for u, n in sizes.items() if n], "plain string, encoded string, length bigint")
    if blocks is None:
        return listed.select(F.col("encoded").alias("uri"), F.lit("cannot be read").alias("reason"))
    read = blocks.groupBy("uri").agg(F.max("file_bytes").alias("bytes"), F.bool_or("utf16").alias("utf16")).withColumn(
        "plain", decoded_uri(F.col("uri")))
    missing = F.col("length") - F.coalesce("bytes", F.lit(0))  # one byte counts for the newline of each line; a mark has three
    return listed.join(read, "plain", "left").filter(~F.coalesce("utf16", F.lit(False)) & ((missing > 3) | (missing == 1))).select(
        F.coalesce("uri", "encoded").alias("uri"), F.lit("cannot be read to its end").alias("reason"))


def _utf8_files(spark: SparkSession, uris: Sequence[str]) -> set[str]:
    """Of plain files those that are valid UTF-8, with or without a mark; the list of files is on the driver anyway."""
    rows = _text_rows(spark, uris, False, None).groupBy("uri").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    return {r.uri for r in rows.filter("valid").select(decoded_uri(F.col("uri")).alias("uri")).collect()}


def _failed(checked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(uri, reason)`` of gzip files: not inflatable, not read to the end by Spark, or not UTF-8."""
    read = blocks.groupBy("uri").agg(F.max("file_bytes").alias("bytes"), F.bool_and("valid").alias("valid")).withColumn(
        "plain", decoded_uri(F.col("uri")))
    # every line counts one byte for its newline; a leading 3-byte mark is not part of the text
    missing = F.col("size") - F.coalesce("bytes", F.lit(0)) + F.when(F.col("terminated"), 0).otherwise(1)
    return checked.join(read, "plain", "full").select(F.coalesce("uri", encoded_uri(F.col("plain"))).alias("uri"), F.coalesce(
        "reason",
        F.when((F.col("size") > 0) & ~missing.isin(0, 3), F.lit("unreadable bytes after a gzip member")),
        F.when(~F.col("valid"), F.lit("invalid UTF-8 text")),
    ).alias("reason")).filter("reason is not null")


def _is_gzip(uri: str) -> bool:
    name = uri.rsplit("/", 1)[-1]
    return name.endswith(".gz") and name != ".gz"


def scan_files(
    spark: SparkSession,
    files: Sequence[tuple[str, int]],
    start_pattern: str | None = None,
    charset: str = "auto",
    show: Callable[[Column], Column] = display_path,
    shown: list[tuple[str, str]] | None = None,
) -> FileScan:
    """Prepare ``files``, pairs of address and length, for searching; runs the counting pass.

    ``charset`` is for files that are neither marked nor valid UTF-8; "auto" puts U+FFFD for what cannot be
    decoded.  A file that cannot be read is reported, and the others are searched.
    """
    ship(spark)
    _pin_splits(spark)
    declared = None if charset.lower() in ("auto", "utf-8", "utf8") else charset.upper()
    starts = None if start_pattern is None else matcher(start_pattern)
    sizes = dict(sorted(files))
    gone = _unreadable(list(sizes))
    sizes = {u: n for u, n in sizes.items() if u not in gone}
    own = [u for u in sizes if _reads_itself(u)]
    plain = [u for u in sizes if not _is_gzip(u) and not _reads_itself(u)]
    zipped = [u for u in sizes if _is_gzip(u) and not _reads_itself(u)]
    wide = plain if declared in WIDE_CHARSETS else []
    split = [] if wide else plain
    utf8 = set(split) if declared is None else _utf8_files(spark, split) if split else set()
    groups = (
        ([u for u in split if u in utf8], False, None), ([u for u in split if u not in utf8], False, declared),
        (zipped, True, declared))

    checked = gzip_check(spark, [(u, sizes[u]) for u in zipped]) if zipped else None
    parts = [_text_rows(spark, *group) for group in groups if group[0]]
    lines = places = blocks = None
    failed = [spark.createDataFrame([(urllib.parse.quote(u, safe="/:"), r) for u, r in gone.items()], "uri string, reason string")] if gone else []
    if parts:
        lines = reduce(DataFrame.unionByName, parts)
        start = F.lit(False) if starts is None else matches(F.col("text"), starts)
        bare = start if starts is None else F.when(F.col("at_end"), matches(
            F.expr("left(text, char_length(text) - 1)"), starts, needed=F.col("at_end"))).otherwise(start)
        lines = lines.withColumns({"is_start": start, "bare_start": bare})
        table = _block_table(lines, checked)
        blocks = written(spark, table, "blocks")
        ends = [] if starts is None else _open_ends(blocks).collect()  # a row for each such file; the list of files is here anyway
        if ends:
            odd = F.broadcast(spark.createDataFrame(ends, "uri string, block bigint, open_row bigint, open_start boolean"))
            lines = lines.join(odd, ["uri", "block"], "left").withColumn("is_start", F.when(
                F.col("row") == F.col("open_row"), F.col("open_start")).otherwise(F.col("is_start"))).drop("open_row", "open_start")
            blocks = written(spark, _block_table(lines, checked), "blocks")
        lines = lines.drop("bare_start")
        places = blocks.select(*PLACE_COLUMNS)
        if blocks.count() <= BROADCAST_BLOCKS:
            places = F.broadcast(places)
        if split:
            marked = blocks.filter("utf16").select(decoded_uri(F.col("uri")).alias("uri")).distinct()
            wide = sorted(r.uri for r in marked.collect())
    if split:
        failed.append(_short(spark, blocks, {u: sizes[u] for u in split}))
    if checked is not None:
        failed.append(_failed(checked, blocks))
    streamed = None
    if own or wide:
        streamed, unread = streamed_lines(spark, [(u, sizes[u]) for u in sorted({*own, *wide})], declared)
        streamed, unread = (df.withColumn("uri", encoded_uri(F.col("uri"))) for df in (streamed, unread))
        failed.append(unread.select("uri", "reason"))
    # small beside the text: written and counted, so that a search joins it without moving text, or not at all
    failures = written(spark, reduce(DataFrame.unionByName, failed), "failed") if failed else None
    return FileScan(
        spark=spark, lines=lines, places=places, streamed=streamed, failed=failures, failed_count=failures.count() if failed else 0, start_pattern=start_pattern, shown=shown or [], show=show,
    )


def read_lines(spark: SparkSession, files: DataFrame, charset: str = "auto", **names) -> DataFrame:
    """``lines(file_path, line_no, line)`` of all readable files; a line keeps its newline."""
    pairs = [(r.uri, r.length) for r in files.select("uri", "length").collect()]  # as Spark's own file index
    return scan_files(spark, pairs, None, charset, **names).entries().select(
        "file_path", F.col("start_line").alias("line_no"), F.col("content").alias("line")
    )
