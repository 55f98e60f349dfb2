"""Repeated byte strings: which bytes of each text a repeat covers, and texts without them.

A corpus is too large for one suffix array, so suffixes meet only where a repeat can be.  Every window of
``length`` bytes has an anchor: the position in it whose short string has the smallest hash, the leftmost of
several.  Equal windows have equal anchors at equal offsets.  Consecutive windows with one anchor are a run, and
all that is shuffled at first is a row of hashes per run, about one for every ``length`` / 2 bytes:

* runs with equal anchor and equal bytes at two places are repeats as a whole;
* anchors whose runs differ are open: the bytes of one run of each kind meet, in bins of bounded size.

In a bin the suffixes that start a repeated window, and whose left neighbours differ, make a sparse suffix array with
the lengths of common prefixes.  The longest prefix a suffix shares with a neighbour is its span.  An anchor with too
many different runs for one bin is settled by counting its windows' hashes instead.  Equal texts are one text from the start.

All this is done at two lengths side by side, which never meet: level 0 for the bytes to remove, wherever the string starts
again, and level 1 for shorter passages that another text holds too.

Groups of maximal repeats are not returned: hashes and neighbours decide every span.  A bin's common-prefix intervals
whose left extensions differ are found and written beside the leaves, but nothing reads them, they end at the edges of
runs, and copies, equal runs and common anchors are not among them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.columns import map_batches
from siftlog.session import written
from siftlog.shipping import ship

PIECE = 1 << 20  # bytes hashed at once
BIN_RUNS = 4_000  # different runs that meet in a bin, about
MOST_RUNS = 20_000  # of one anchor; beyond, its windows are counted
FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64

READ = ("id long, sha string, key long, n long, anchor array<long>, content array<long>, first array<int>, end array<int>, "
        "level array<int>, local array<struct<a:int,b:int>>")
RUN_BYTES = "anchor long, key long, first int, level int, again boolean, data binary"
LEAVES = "key long, level int, start int, length int, other int, node long, parent long"


def _letters():
    import numpy as np

    return np.random.default_rng(12345).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_powers: list = []


def _factors(n: int):
    """Powers of FACTOR and of its inverse, n each."""
    import numpy as np

    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        pair = []
        for base in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            f = np.full(size, base, np.uint64)
            f[0] = 1
            pair.append(np.multiply.accumulate(f))
        _powers[:] = pair
    return _powers


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substring of ``data`` from one pass."""

    def __init__(self, data: bytes):
        import numpy as np

        up, self.down = _factors(len(data) + 1)
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters()[np.frombuffer(data, np.uint8)] * up[:len(data)], out=self.upto[1:])

    def of(self, start, end):
        return _mixed((self.upto[end] - self.upto[start]) * self.down[start])

    def every(self, length: int):
        return _mixed((self.upto[length:] - self.upto[:-length]) * self.down[:len(self.upto) - length])


def anchor_length(length: int) -> int:
    return max(1, length * 4 // 25)


def runs(data: bytes, edges, length: int):
    """Runs of the pieces data[edges[i]:edges[i + 1]]: piece, first and last window, anchor hash, content hash."""
    import numpy as np

    short = anchor_length(length)
    width = length - short + 1
    empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    if len(data) < length:
        return empty
    h = Hashes(data)
    grams = h.every(short)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    valid = np.flatnonzero(piece[:len(at)] == piece[length - 1:length - 1 + len(at)])
    if not len(valid):
        return empty
    at, piece = at[valid], piece[valid]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
    last = valid[np.append(new[1:], len(at)) - 1]
    first, at, piece = valid[new], at[new], piece[new]
    content = _mixed(h.of(first, last + length) + (at - first).astype(np.uint64) * np.uint64(FACTOR))
    return piece, first, last, grams[at], content


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about PIECE bytes; longer texts in pieces that share length - 1 bytes."""
    group, held = [], 0
    for i, data in enumerate(texts):
        for at in range(0, max(1, len(data) - length + 1), PIECE):
            part = data[at:at + PIECE + length - 1]
            group.append((i, at, part))
            held += len(part)
            if held >= PIECE:
                yield group
                group, held = [], 0
    if group:
        yield group


def _runs_of(texts: list[bytes], length: int, level: int) -> list:
    """anchor, content, first and end of the runs of each text, in their order.  Anchors of two levels are never equal."""
    import numpy as np

    found = [([], [], [], []) for _ in texts]
    for group in _pieces(texts, length):
        edges = np.cumsum([0, *(len(p) for _, _, p in group)])
        piece, first, last, anchor, content = runs(b"".join(p for _, _, p in group), edges, length)
        shift = np.array([o for _, o, _ in group], np.int64) - edges[:-1]
        first, end = first + shift[piece], last + shift[piece] + length
        anchor = _mixed(anchor + np.uint64(level * FACTOR))
        text = np.array([i for i, _, _ in group])[piece]
        cuts = np.flatnonzero(np.diff(text)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            if a < b:
                for out, x in zip(found[text[a]], (anchor, content, first, end), strict=True):
                    out.append(x[a:b])
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return [tuple(map(np.concatenate, lists)) if lists[0] else none for lists in found]


def _kinds_of(anchor, content):
    """Of runs: the first of each kind, the kind of each, and how many are of each kind."""
    import numpy as np

    order = np.lexsort((content, anchor))  # stable
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind, np.bincount(kind)


def _read(lengths: tuple[int, int]):
    """(id, text) -> READ.  Of the runs equal within their text the first stands for all; ``local`` are those of level 0."""
    def make(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                found, local = [[] for _ in texts], [[] for _ in texts]
                for level, length in enumerate(lengths):
                    for i, (anchor, content, first, end) in enumerate(_runs_of(texts, length, level)):
                        if not len(first):
                            continue
                        once, kind, count = _kinds_of(anchor, content)
                        if level == 0:
                            many = count[kind] > 1
                            local[i] = [{"a": a, "b": b} for a, b in merged(
                                list(zip(first[many].tolist(), end[many].tolist(), strict=True)))]
                        once.sort()
                        found[i].append((anchor[once].view(np.int64), content[once].view(np.int64), first[once], end[once],
                                         np.full(len(once), level)))
                ends = np.zeros(len(texts) + 1, np.int32)
                np.cumsum([sum(len(x[0]) for x in parts) for parts in found], out=ends[1:])

                def lists_of(k, kind, ends=ends, found=found):
                    flat = [np.empty(0, np.int64), *(x[k] for parts in found for x in parts)]
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat), kind))

                sha = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sha), pa.array([int(s[:15], 16) for s in sha], pa.int64()),
                     pa.array([len(t) for t in texts], pa.int64()), lists_of(0, pa.int64()), lists_of(1, pa.int64()),
                     lists_of(2, pa.int32()), lists_of(3, pa.int32()), lists_of(4, pa.int32()), pa.array(local, pair)],
                    names=["id", "sha", "key", "n", "anchor", "content", "first", "end", "level", "local"])

    return make


def _bytes_of_runs(batches):
    """(key, text, members) -> the bytes of each member run."""
    import pyarrow as pa

    for batch in batches:
        rows = {"anchor": [], "key": [], "first": [], "level": [], "again": [], "data": []}
        for key, text, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for m in members or ():
                for c in ("anchor", "first", "level", "again"):
                    rows[c].append(m[c])
                rows["key"].append(key)
                rows["data"].append(data[m["first"]:m["end"]])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 16:  # equal up to low, not up to high
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while a[low] == b[low]:
        low += 1
    return low


def interval_tree(lcp: list[int], left: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """The common-prefix intervals of a suffix array, by one scan with a stack.

    ``lcp[i]`` is of suffixes i - 1 and i (lcp[0] is 0), ``left[i]`` the byte before suffix i, -1 at a text's edge.
    Returns for each suffix the longest prefix it shares and its deepest interval of at least ``length`` whose left
    bytes differ (-1 without one), and each interval's parent.
    """
    n = len(left)
    reach = [max(lcp[i], lcp[i + 1] if i + 1 < n else 0) for i in range(n)]
    stack = [[0, 0, None]]  # common prefix, first suffix, left byte of all or -1 when they differ
    nodes: list[tuple[int, int, int]] = []

    def join(x, y):
        return y if x is None else x if x == y else -1

    for i in range(1, n + 1):
        depth, begin, byte = lcp[i] if i < n else 0, i - 1, left[i - 1]
        while depth < stack[-1][0]:
            d, b, l = stack.pop()
            byte = join(l, byte)
            begin = b
            if byte == -1 and d >= length:
                nodes.append((d, b, i))
        if depth > stack[-1][0]:
            stack.append([depth, begin, byte])
        else:
            stack[-1][2] = join(stack[-1][2], byte)
    # nested intervals: the deepest around a suffix is the last one opened
    order = sorted(range(len(nodes)), key=lambda k: (nodes[k][1], -nodes[k][2]))
    parent, node, open_ = [-1] * len(nodes), [-1] * n, []
    at = 0
    for i in range(n):
        while open_ and nodes[open_[-1]][2] <= i:
            open_.pop()
        while at < len(order) and nodes[order[at]][1] == i:
            parent[order[at]] = open_[-1] if open_ else -1
            open_.append(order[at])
            at += 1
        node[i] = open_[-1] if open_ else -1
    return reach, node, parent


def reach_of_others(lcp: list[int], owner: list[int]) -> list[int]:
    """For each suffix of a suffix array, the longest prefix it shares with one of another owner."""
    n = len(owner)
    best, shared = [0] * n, 0
    for i in range(1, n):
        shared = lcp[i] if owner[i] != owner[i - 1] else min(shared, lcp[i])
        best[i] = shared
    shared = 0
    for i in range(n - 2, -1, -1):
        shared = lcp[i + 1] if owner[i] != owner[i + 1] else min(shared, lcp[i + 1])
        best[i] = max(best[i], shared)
    return best


def _bin(lengths: tuple[int, int]):
    def make(table):
        import numpy as np
        import pyarrow as pa

        table = table.combine_chunks()
        number, key, first, again = (np.asarray(table[c]) for c in ("bin", "key", "first", "again"))
        level = int(number[0]) % 2 if len(number) else 0
        length = lengths[level]
        _, once = np.unique(np.stack([key, first.astype(np.int64)], 1), axis=0, return_index=True)  # repeated rows of a text
        key, first, again = key[once], first[once].astype(np.int64), again[once].astype(bool)
        owner = np.where(again, -1 - np.arange(len(key)), key)  # a run of several texts is another text's run to each
        data = table["data"].take(pa.array(once)).to_pylist()
        size = np.array([len(d) for d in data])
        offset = np.cumsum(size) - size
        flat = b"".join(data)
        windows = size - length + 1
        run = np.repeat(np.arange(len(data)), windows)
        start = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = offset[run] + start
        h = Hashes(flat).of(place, place + length)
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        count = np.diff(np.append(head, len(order)))
        left = np.where(start > 0, np.frombuffer(flat, np.uint8)[place - 1].astype(np.int64), -1)
        low, high = np.minimum.reduceat(left[order], head), np.maximum.reduceat(left[order], head)
        use = np.repeat((count > 1) & ((low != high) | (low < 0)), count)
        chosen = order[use]
        suffixes = [data[r][s:] for r, s in zip(run[chosen].tolist(), start[chosen].tolist(), strict=True)]
        array = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        lcp = [0, *(common_prefix(suffixes[a], suffixes[b]) for a, b in zip(array, array[1:]))]
        chosen = chosen[array]
        reach, node, parent = interval_tree(lcp, left[chosen].tolist(), length) if array else ([], [], [])
        other = reach_of_others(lcp, owner[run[chosen]].tolist()) if array else []
        keep = np.array([r >= length for r in reach], bool)
        base = (int(number[0]) if len(number) else 0) << 32
        ids = np.array(node, np.int64)
        above = np.array([parent[x] if x >= 0 else -1 for x in node], np.int64)
        return pa.table({
            "key": pa.array(key[run[chosen]][keep]), "level": pa.array(np.full(keep.sum(), level, np.int32)),
            "start": pa.array((first[run] + start)[chosen][keep].astype(np.int32)),
            "length": pa.array(np.array(reach, np.int32)[keep]), "other": pa.array(np.array(other, np.int32)[keep]),
            "node": pa.array(np.where(ids < 0, -1, base + ids)[keep]),
            "parent": pa.array(np.where(above < 0, -1, base + above)[keep])})

    return make


def _window_hashes(lengths: tuple[int, int]):
    def make(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for key, first, level, again, data in zip(
                    *(batch.column(c).to_pylist() for c in ("key", "first", "level", "again", "data")), strict=True):
                h = Hashes(data).every(lengths[level])
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.full(n, key)), pa.array((first + np.arange(n)).astype(np.int32)),
                     pa.array(np.full(n, level, np.int32)), pa.array(np.full(n, again))],
                    names=["window", "key", "start", "level", "again"])

    return make


class Repeats:
    """What of a table's texts is repeated.

    ``texts``: a row per input row (id, sha, key, n).  ``copied``: keys of texts that occur more than once.  ``leaves``: of
    the open anchors, each suffix with the longest prefix it shares, and shares with another text, and its place in its
    bin's tree, which decides no span.  ``spans``: (key, spans) of the other texts.  Those of level 0 cover every byte of a
    window of ``length`` bytes that also starts elsewhere, those of level 1 cover, at one or more places where it stands,
    every run of windows of ``passage`` bytes that also start in another text (``spread`` finds the rest).
    ``needed``: the texts these spans are of.
    """

    def __init__(self, df: DataFrame, length: int, passage: int, doc_id: str, text: str):
        spark = df.sparkSession
        ship(spark)
        lengths = (length, passage)
        source = df.select(df[doc_id].cast("long").alias("id"), df[text].alias("text"))
        read = written(spark, map_batches(source, _read(lengths), READ), "runs")
        self.texts = read.select("id", "sha", "key", "n")
        different = self.texts.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"))
        self.copied = different.filter("copies > 1").select("key")

        def span(end):
            return F.struct(F.col("start").alias("a"), end.cast("int").alias("b"), "level").alias("span")

        run = F.explode(F.arrays_zip("anchor", "content", "first", "end", "level")).alias("r")
        rows = read.select("id", "key", run).select("id", "key", "r.*")
        # a run equal in two texts has two keys; one of a single text has one key and one place, so plain minima name it
        kinds = rows.groupBy("anchor", "content").agg(
            *(F.min(c).alias(c) for c in ("key", "first", "end", "level")), (F.min("key") != F.max("key")).alias("again"))
        kinds = written(spark, kinds.withColumn("content", F.when(F.col("again"), F.col("content"))), "kinds")
        again = written(spark, rows.join(kinds.filter("again").select("anchor", "content"), ["anchor", "content"], "left_semi"), "again")

        # copies are dropped by id and key: by key alone one text's copies would meet in one task
        local = read.select("id", "key", F.explode("local").alias("l")).select(
            "id", "key", F.col("l.a").alias("start"), F.col("l.b").alias("end"), F.lit(0).alias("level"))
        settled = again.select("id", "key", F.col("first").alias("start"), "end", "level").unionByName(local).alias("s")
        single = different.filter("copies = 1").alias("t")
        settled = settled.join(single, F.col("s.id").eqNullSafe(F.col("t.id")) & (F.col("s.key") == F.col("t.key")), "left_semi")
        settled = written(spark, settled.groupBy("key").agg(
            F.min("id").alias("id"), F.collect_set(F.struct(
                F.col("start").alias("a"), F.col("end").alias("b"), "level")).alias("spans")), "settled")

        open_ = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.bool_and("again").alias("all")).filter(
            "kinds > 1 and not all").select("anchor", "kinds")
        one = ["anchor", "key", "first", "end", "level", "again"]
        several = again.groupBy("anchor", "content").agg(F.min(F.struct("key", "first", "end", "level")).alias("one"))
        several = several.select("anchor", "one.*", F.lit(True).alias("again"))
        members = written(spark, kinds.filter("not again").select(one).unionByName(several.select(one)).join(open_, "anchor"), "members")
        asked = members.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "end", "level", "again")).alias("members")).join(
            different.select("id", "key"), "key").select("id", "key", "members")
        # the texts that are looked at again, with what is asked of them; other texts of the same id have other keys
        wanted = settled.select("id", "key", F.lit(None).cast(asked.schema["members"].dataType).alias("members")).unionByName(asked)
        wanted = wanted.groupBy("id", "key").agg(F.flatten(F.collect_list("members")).alias("members"))
        keyed = source.withColumn("key", F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("long"))
        self.needed = written(spark, keyed.alias("s").join(wanted.alias("w"), F.col("s.id").eqNullSafe(F.col("w.id"))
                              & (F.col("s.key") == F.col("w.key"))).select("s.key", "s.text", "w.members"), "texts")

        bytes_ = map_batches(self.needed.filter(F.size("members") > 0), _bytes_of_runs, RUN_BYTES)
        hot = members.groupBy("anchor").agg(F.first("kinds").alias("kinds")).filter(F.col("kinds") > MOST_RUNS).select("anchor")
        bins = max(1, members.count() // BIN_RUNS)
        binned = bytes_.join(hot, "anchor", "left_anti").withColumn(
            "bin", F.pmod(F.xxhash64("anchor"), F.lit(bins)) * 2 + F.col("level"))  # an anchor is of one level
        self.leaves = written(spark, binned.select("bin", "key", "first", "again", "data").groupBy("bin").applyInArrow(
            _bin(lengths), LEAVES), "leaves")
        spans = self.leaves.filter((F.col("level") == 0) | (F.col("other") >= passage)).select(
            "key", span(F.col("start") + F.when(F.col("level") == 0, F.col("length")).otherwise(F.col("other"))))
        if not hot.isEmpty():
            windows = map_batches(bytes_.join(hot, "anchor", "left_semi"), _window_hashes(lengths),
                                  "window long, key long, start int, level int, again boolean")
            at = F.struct("key", "start")
            twice = windows.groupBy("window", "level").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.bool_or("again").alias("many")).filter(
                "low <> high and (level = 0 or many or low.key <> high.key)").select("window", "level")
            spans = spans.unionByName(windows.join(twice, ["window", "level"], "left_semi").select(
                "key", span(F.col("start") + F.when(F.col("level") == 0, length).otherwise(passage))))
        spans = spans.join(self.copied, "key", "left_anti").groupBy("key").agg(F.collect_set("span").alias("spans"))
        self.spans = spans.unionByName(settled.select("key", "spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def spread(spans: list[tuple[int, int]], first, kind) -> list[tuple[int, int]]:
    """Spans, each within the run of a text it starts in, at every run of the same kind."""
    import numpy as np

    if not spans or len(np.unique(kind)) == len(kind):
        return spans
    of = np.searchsorted(first, [a for a, _ in spans], "right") - 1
    within: dict[int, list[tuple[int, int]]] = {}
    for (a, b), r in zip(spans, of.tolist(), strict=True):
        within.setdefault(int(kind[r]), []).append((a - int(first[r]), b - int(first[r])))
    within = {k: merged(v) for k, v in within.items()}
    return [(f + a, f + b) for f, k in zip(first.tolist(), kind.tolist(), strict=True) for a, b in within.get(k, ())]


REMOVED = "key long, n_removed long, n_spans long, kept binary, kept_sha256 string, n_shared long, longest_shared long"


def _removed(passage: int):
    def make(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows = []
            keys, texts, spans = (c.to_pylist() for c in batch.columns)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            also = [[(s["a"], s["b"]) for s in x if s["level"] == 1] for x in spans]
            ran = _runs_of([t if x else b"" for t, x in zip(texts, also, strict=True)], passage, 1)
            for key, data, found, others, (anchor, content, first, _) in zip(keys, texts, spans, also, ran, strict=True):
                cut = merged([(s["a"], s["b"]) for s in found if s["level"] == 0])
                kept, at = [], 0
                for a, b in cut:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                shared = [b - a for a, b in merged(spread(others, first, _kinds_of(anchor, content)[1]))] if others else []
                rows.append({"key": key, "n_removed": len(data) - len(kept), "n_spans": len(cut), "kept": kept,
                             "kept_sha256": hashlib.sha256(kept).hexdigest(), "n_shared": sum(shared),
                             "longest_shared": max(shared, default=0)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()),
                ("n_shared", pa.int64()), ("longest_shared", pa.int64())]))

    return make


def remove(df: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True,
           passage: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, longest_shared, kept), a row for each row of ``df``.

    Removed is every byte of a text's UTF-8 form (null: empty) that a string of ``length`` bytes covers which also starts
    anywhere else, in the same text or another.  ``kept`` is what remains of a text that loses some bytes but not all
    (null: unchanged or empty).  Equal rows are copies of each other.  Texts are told apart by 60 bits of their SHA-256.

    ``n_shared`` counts the bytes that a string of ``passage`` bytes covers which also starts in another row's text, and
    ``longest_shared`` those of the longest stretch of them.  They remove nothing.
    """
    found = Repeats(df, length, passage, doc_id, text)
    cut = map_batches(found.needed.select("key", "text").join(found.spans, "key"), _removed(passage), REMOVED)
    cut = cut.dropDuplicates(["key"]) if with_kept else cut.drop("kept").dropDuplicates(["key"])
    out = found.texts.join(found.copied.withColumn("copied", F.lit(True)), "key", "left").join(cut, "key", "left")
    whole = F.coalesce(F.col("copied") & (F.col("n") >= length), F.lit(False))
    shared = F.coalesce(F.col("copied") & (F.col("n") >= passage), F.lit(False))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *(F.when(shared, F.col("n")).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("n_shared", "longest_shared")),
        *([F.when(~whole, F.col("kept")).alias("kept")] if with_kept else []))
