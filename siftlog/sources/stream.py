"""Files that a task reads itself, piece by piece: gzip checks, names that Spark's reader drops, UTF-16.

Nothing here holds a file: bytes come in pieces of ``PIECE``, text leaves in batches of lines, so a file may have any size.
UTF-16 is cut into parts of ``PART`` bytes, at even places, that are read by a task each: a line belongs to the part it
starts in, as in Spark's own splits.  What cannot be read ends in one row with the reason.
"""

from __future__ import annotations

import heapq
import urllib.parse
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.operators.running import block_starts
from siftlog.session import written

PIECE = 1 << 20
PART = 64 << 20
OPEN = 1 << 20  # what opening a file counts, as bytes of reading
TASKS_PER_CORE = 3
LINE = "uri string, part bigint, place bigint, line string, reason string"


class Damaged(Exception):
    pass


def opened(uri: str):
    """A readable, seekable file of the task's machine or of a store; ``uri`` is percent-encoded."""
    if uri.startswith("file:"):
        return open(urllib.parse.unquote(uri.removeprefix("file:")), "rb")
    import pyarrow.fs as fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def pieces_of(file, piece: int = PIECE) -> Iterator[bytes]:
    while data := file.read(piece):
        yield data


def inflated(pieces: Iterator[bytes], piece: int = PIECE) -> Iterator[bytes]:
    """The text of all members of a gzip file."""
    import zlib

    stream = None
    try:
        for data in pieces:
            while data:
                stream = stream or zlib.decompressobj(31)
                while data and not stream.eof:
                    yield stream.decompress(data, piece)
                    data = stream.unconsumed_tail
                if stream.eof:  # another member may follow
                    data, stream = stream.unused_data, None
        while stream is not None and not stream.eof:  # output that was held back
            text = stream.decompress(b"", piece)
            if not text:
                raise Damaged("unexpected end of file")
            yield text
    except zlib.error as e:
        raise Damaged(f"corrupt gzip stream: {e}") from e


def checked_gzip(uri: str) -> tuple[str | None, bool, int]:
    """Why the file cannot be read to its end (or None), whether its text ends in a newline, size of the text."""
    size, last = 0, b"\n"
    try:
        with opened(uri) as file:
            for text in inflated(pieces_of(file)):
                size, last = size + len(text), text[-1:] or last
    except Damaged as e:
        return str(e), last == b"\n", size
    except (OSError, ValueError) as e:
        return f"cannot be read: {e}", last == b"\n", size
    return None, last == b"\n", size


def gzip_check(spark: SparkSession, files: Sequence[tuple[str, int]]) -> DataFrame:
    """``(plain, reason, terminated, size)`` for each gzip file (address, length), streamed by one task; ``plain`` is the given address."""
    def check(batches):
        import pyarrow as pa

        for batch in batches:
            for plain, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reason, terminated, size = checked_gzip(uri)
                yield pa.RecordBatch.from_arrays([pa.array([plain]), pa.array([reason], pa.string()), pa.array([terminated]), pa.array([size])],
                                                 names=["plain", "reason", "terminated", "size"])

    return written(spark, _tasks(spark, [(u,) for u, _ in files], [n for _, n in files], "plain string").mapInArrow(
        check, "plain string, reason string, terminated boolean, size bigint"), "gzip")


def dealt(sizes: Sequence[int], least: int) -> list[list[int]]:
    """Places of ``sizes`` in groups of about ``PART`` bytes, larger ones alone, ``least`` groups if there are so many.

    A file counts ``OPEN`` bytes besides its own; the largest first, each to the group that has least so far.
    """
    groups = max(min(len(sizes), least), -(-sum(n + OPEN for n in sizes) // PART))
    loads = [(0, g) for g in range(groups)]
    out: list[list[int]] = [[] for _ in loads]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(loads)
        out[g].append(i)
        heapq.heappush(loads, (load + sizes[i] + OPEN, g))
    return [g for g in out if g]


def _tasks(spark: SparkSession, rows: list[tuple], sizes: list[int], schema: str) -> DataFrame:
    """One row for each piece of work, with the percent-encoded address, spread over tasks; small ones share a task."""
    made = [(*r[:1], urllib.parse.quote(r[0], safe="/:"), *r[1:]) for r in rows]
    first, *rest = schema.split(", ")
    fields = ", ".join(f.replace(" ", ": ", 1) for f in (first, "encoded string", *rest))
    groups = [([made[i] for i in g],) for g in dealt(sizes, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)]
    return spark.createDataFrame(groups, f"work array<struct<{fields}>>").repartition(max(1, min(len(groups), 10_000))).select(F.inline("work"))


def _encoding(uri: str, charset: str | None) -> tuple[str, int]:
    """Python's name of the file's encoding and the bytes of its mark: by the mark, else UTF-8 if all is valid, else as declared."""
    import codecs

    def text():
        return inflated(pieces_of(file)) if uri.endswith(".gz") else pieces_of(file)

    with opened(uri) as file:
        head = b""
        for data in text():
            head += data
            if len(head) > 2:
                break
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if head.startswith(mark) and not (uri.endswith(".gz") and name != "utf-8"):
            return name, len(mark)
    if uri.endswith(".gz"):
        return "utf-8", 0
    if charset and charset.startswith("UTF-16"):
        return {"UTF-16LE": "utf-16-le"}.get(charset, "utf-16-be"), 0
    if charset is None:
        return "utf-8", 0
    decoder = codecs.getincrementaldecoder("utf-8")()
    with opened(uri) as file:
        try:
            for data in text():
                decoder.decode(data)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            return charset, 0
    return "utf-8", 0


def _runs(uri: str, encoding: str, mark: int) -> Iterator[str]:
    """Text that ends at line ends, of a whole file."""
    import codecs

    strict = uri.endswith(".gz")  # undecodable text is a failure there
    decoder = codecs.getincrementaldecoder(encoding)("strict" if strict else "replace")
    with opened(uri) as file:
        held, skip = [], mark
        for data in inflated(pieces_of(file)) if strict else pieces_of(file):
            data, skip = data[skip:], max(0, skip - len(data))
            text = decoder.decode(data)
            cut = text.rfind("\n") + 1
            if cut:
                yield "".join([*held, text[:cut]])
                held = []
            held.append(text[cut:])
        held.append(decoder.decode(b"", True))
        yield "".join(held)


def _wide_runs(uri: str, encoding: str, mark: int, start: int, end: int | None) -> Iterator[str]:
    """Text of the lines of a UTF-16 file that start in ``[start, end)``."""
    newline = "\n".encode(encoding)
    with opened(uri) as file:
        at = max(start - 2, mark)
        file.seek(at)
        begun = start <= mark  # else the line before goes on until its newline
        held = b""
        for data in pieces_of(file):
            held += data
            if not begun:
                cut = _unit(held, newline, 0)
                if cut < 0:
                    keep = len(held) % 2
                    at, held = at + len(held) - keep, held[len(held) - keep:]
                    continue
                at, held, begun = at + cut + 2, held[cut + 2:], True
            if end is not None and at + len(held) >= end:  # up to the newline of the last line that starts before the end
                if at >= end:
                    return
                cut = _unit(held, newline, end - 2 - at if end - 2 > at else 0)
                if cut >= 0:
                    yield held[:cut + 2].decode(encoding, "replace")
                    return
                continue
            cut = _last_unit(held, newline)
            if cut >= 0:
                yield held[:cut + 2].decode(encoding, "replace")
                at, held = at + cut + 2, held[cut + 2:]
        if begun and held and (end is None or at < end):
            yield held.decode(encoding, "replace")


def _unit(data: bytes, unit: bytes, start: int) -> int:
    """The first even place from ``start`` on where the two bytes are."""
    at = data.find(unit, start + start % 2)
    while at % 2 and at >= 0:
        at = data.find(unit, at + 1)
    return at


def _last_unit(data: bytes, unit: bytes) -> int:
    """The last even place where the two bytes are."""
    at = data.rfind(unit)
    while at % 2 and at >= 0:
        at = data.rfind(unit, 0, at + 1)
    return at


def _line_reader(charset: str | None):
    def read(batches):
        import pyarrow as pa

        def rows(plain, part, place, lines, reason=None):
            n = len(lines) if reason is None else 1
            return pa.RecordBatch.from_arrays([
                pa.array([plain] * n), pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()),
                pa.array(lines if reason is None else [None], pa.string()), pa.array([reason] * n, pa.string())],
                names=["uri", "part", "place", "line", "reason"])

        for batch in batches:
            for plain, uri, part, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = 0
                try:
                    wide = charset is not None and charset.startswith("UTF-16")
                    encoding, mark = _encoding(uri, charset if wide or not part else None)
                    if encoding.startswith("utf-16"):
                        runs = _wide_runs(uri, encoding, mark, part, end)
                    elif part:
                        continue  # only UTF-16 has several parts
                    else:
                        runs = _runs(uri, encoding, mark)
                    for run in runs:
                        lines = [line + "\n" for line in run.split("\n")]
                        lines[-1] = lines[-1][:-1]
                        if not lines[-1]:
                            del lines[-1]
                        if lines:
                            yield rows(plain, part, place, lines)
                            place += len(lines)
                except UnicodeDecodeError:
                    yield rows(plain, part, place, [], "invalid UTF-8 text")
                except Damaged as e:
                    yield rows(plain, part, place, [], f"cannot be read: {e}")
                except (OSError, ValueError) as e:
                    yield rows(plain, part, place, [], f"cannot be read: {e}")

    return read


def streamed_lines(
    spark: SparkSession, files: Sequence[tuple[str, int]], charset: str | None, part: int = PART
) -> tuple[DataFrame, DataFrame]:
    """``(uri, line_no, line)`` of files read by tasks themselves, and ``(uri, reason)`` of those that failed.

    The lines are written to the shared folder once and numbered by the counts of the parts before.
    """
    tasks = [(uri, at, at + part if at + part < size else None) for uri, size in files for at in range(0, max(size, 1), part)]
    # a file that is not UTF-16 is read whole by its first part; the further ones only look at its mark
    sizes = [size if not at else part for uri, size in files for at in range(0, max(size, 1), part)]
    read = written(spark, _tasks(spark, tasks, sizes, "plain string, part bigint, end bigint").mapInArrow(_line_reader(charset), LINE), "own")
    failed = read.filter("reason is not null").groupBy("uri").agg(F.min("reason").alias("reason"))
    good = read.filter("reason is null")
    counts = block_starts(good.groupBy("uri", "part").agg(F.count(F.lit(1)).alias("n")), ["uri"], "part", ["n"])
    lines = good.join(counts.select("uri", "part", "n_before"), ["uri", "part"])
    return lines.select("uri", (F.col("n_before") + F.col("place") + 1).alias("line_no"), "line"), failed
