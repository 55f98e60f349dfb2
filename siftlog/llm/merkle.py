"""Merkle manifest of a table: a tree of digests for each group, one tree over the groups, a proof for each row.

Time-forward processing: nodes carry a label (level, index), and a priority queue ordered by label hands the
digests of children to their parents; a sweep in the reversed order hands every node the rest of its proof.
Inside a chunk of ``ARITY ** LEVELS`` neighbouring nodes the queue is a heap in one task; between chunks it is
a table of messages that Spark shuffles by (group, chunk).  A chunk gives one digest upwards and gets one
proof suffix downwards, so n rows take log(n) / log(chunk) rounds and no row carries its siblings.

Nothing is ever whole in one place: rows are ranked by a range partitioning and the counts of its parts, a group
with a third of all rows is many chunks, and the tree over the groups is built like the trees in them.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftlog.llm.columns import field
from siftlog.operators.running import block_starts
from siftlog.session import written
from siftlog.shipping import ship

ARITY = 2
LEVELS = 12  # of a chunk: 4,096 nodes

NODE = "key string, idx bigint, n bigint, digest string"
SUFFIX = "key string, idx bigint, suffix string, subroot string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of all values, each as ``<bytes>:<text>`` and ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(
        F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def widths(n: int, levels: int | None = None) -> list[int]:
    """Nodes of each level above ``n`` nodes: until one is left, or exactly ``levels`` levels."""
    out = [n]
    while out[-1] > 1 if levels is None else len(out) <= levels:
        out.append(-(-out[-1] // ARITY))
    return out


def up_sweep(leaves: Sequence[str], sizes: list[int]) -> list[str]:
    """Digests of all nodes in label order: every node takes its children's from the queue and sends its own on."""
    first = [sum(sizes[:level]) for level in range(len(sizes))]
    nodes, queue = list(leaves), []

    def send(level: int, index: int, value: str) -> None:
        if level + 1 < len(sizes):
            heapq.heappush(queue, (first[level + 1] + index // ARITY, index % ARITY, value))

    for i, leaf in enumerate(leaves):
        send(0, i, leaf)
    level = 1
    while queue:
        label = queue[0][0]
        children = []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        while label >= first[level] + sizes[level]:
            level += 1
        nodes.append(digest(*children))
        send(level, label - first[level], nodes[-1])
    return nodes


def down_sweep(nodes: list[str], sizes: list[int], suffix: str) -> list[str]:
    """For each leaf its path: a step ``<digests before>.<digests after>;`` for each level, then ``suffix``."""
    first = [sum(sizes[:level]) for level in range(len(sizes))]
    queue, paths, level = [(1 - len(nodes), suffix)], [""] * sizes[0], len(sizes) - 1
    while queue:
        label, path = heapq.heappop(queue)
        label = -label
        while label < first[level]:
            level -= 1
        if level == 0:
            paths[label] = path
            continue
        start = first[level - 1] + (label - first[level]) * ARITY
        run = nodes[start:min(start + ARITY, first[level])]
        for i in range(len(run)):
            heapq.heappush(queue, (-(start + i), f"{''.join(run[:i])}.{''.join(run[i + 1:])};{path}"))
    return paths


def proof_of(path: str) -> str:
    """All siblings of a path, in order."""
    return path.replace(".", "").replace(";", "")


def fold(value: str, path: str) -> str:
    """The root that a digest and its path lead to."""
    for step in path.split(";")[:-1]:
        before, after = step.split(".")
        value = digest(before, value, after)
    return value


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx`` (from 0, within ``key``, in ``order``) and ``n``, the key's rows.  Equal rows get any order.

    Ranges of rows are numbered each by itself; the ranges before are known by their counts.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may fill several ranges
    parts = written(df.sparkSession, tied.repartitionByRange("key", *order, "_tie").withColumn(
        "_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = block_starts(counts, ["key"], "_part", ["_n"]).select(
        "key", "_part", "_n_before", F.sum("_n").over(Window.partitionBy("key")).alias("n"))
    place = F.row_number().over(Window.partitionBy("key", "_part").orderBy(*order, "_tie")) - 1
    return parts.withColumn("_place", place).join(starts, ["key", "_part"]).withColumn(
        "idx", F.col("_n_before") + F.col("_place")).drop("_part", "_place", "_n_before", "_tie")


def _levels(n: int, levels: int) -> int | None:
    """Levels of a chunk in a group of ``n`` nodes: all that are left where the group is one chunk."""
    return None if n <= ARITY ** levels else levels


def _chunks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("idx") / ARITY ** levels).cast("bigint"))


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    def chunk_root(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("idx")
        n = rows["n"][0].as_py()
        top = up_sweep(rows["digest"].to_pylist(), widths(rows.num_rows, _levels(n, levels)))[-1]
        return pa.table({"key": [key[0].as_py()], "idx": [key[1].as_py()], "n": [-(-n // ARITY ** levels)], "digest": [top]})

    return _chunks(nodes.select("key", "idx", "n", "digest"), levels).groupBy("key", "chunk").applyInArrow(chunk_root, NODE)


def _down(nodes: DataFrame, above: DataFrame, levels: int, finish: Callable, schema: T.StructType | str) -> DataFrame:
    """``finish(rows of a chunk, their paths, the chunk's row of above)`` for every chunk."""
    def deliver(key, rows, sent):
        rows = rows.sort_by("idx")
        sizes = widths(rows.num_rows, _levels(rows["n"][0].as_py(), levels))
        paths = down_sweep(up_sweep(rows["digest"].to_pylist(), sizes), sizes, sent["suffix"][0].as_py())
        return finish(rows, paths, sent.to_pylist()[0])

    return _chunks(nodes, levels).groupBy("key", "chunk").cogroup(
        above.withColumnRenamed("idx", "chunk").groupBy("key", "chunk")).applyInArrow(deliver, schema)


def _pass_on(rows, paths, sent):
    import pyarrow as pa

    return pa.table({"key": rows["key"], "idx": rows["idx"], "suffix": paths, "subroot": [sent["subroot"]] * len(paths),
                     "root": [sent["root"]] * len(paths)})


def _tree(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The chunks' roots round by round, until every group is one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(written(nodes.sparkSession, _up(rounds[-1], levels), "nodes"))
    return rounds


def _suffixes(rounds: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """Rows of ``SUFFIX`` for the roots of the lowest chunks, from those of the highest."""
    for nodes in reversed(rounds[1:-1]):
        top = written(nodes.sparkSession, _down(nodes, top, levels, _pass_on, SUFFIX), "suffixes")
    return top


def manifest(
    df: DataFrame, values: Sequence[str], group: str = "lang", order: str = "doc_id",
    tampered: dict[str, Column] | None = None, with_path: bool = False, levels: int = LEVELS,
) -> DataFrame:
    """A row for each row of ``df``: ``order``'s column, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``values``; leaves of a ``group`` ascend by ``order`` (null first, ties by digest).
    Every ``ARITY`` neighbours become the digest of their digests, also a last run of fewer, until one is left, the
    subroot.  Subroots in order of their group (null first, then by bytes) become the root in the same way.
    ``tampered`` replaces columns: folded_root starts from the digest of such a row, everything else from the original.
    A chunk has ``ARITY ** levels`` nodes; the digests do not depend on it.  ``with_path`` adds ``path``, a step ``<digests before>.<digests after>;`` for each level, that ``fold`` reads.

    Nulls are values of their own; empty and very long texts are hashed whole in the JVM.  Repeated rows are leaves of
    their own; their paths fit either of them.  An empty table has no rows and no root.  Columns that are not named here
    play no part, so they may have any name.
    """
    spark = df.sparkSession
    ship(spark)
    original = [df[v] for v in values]
    changed = [(tampered or {}).get(v, df[v]) for v in values]
    leaf = leaf_digest(original)
    touched = ~F.struct(*original).eqNullSafe(F.struct(*changed)) if tampered else F.lit(False)
    leaves = df.select(
        F.when(df[group].isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), df[group].cast("string"))).alias("key"),
        df[order].alias("_id"), leaf.alias("digest"), F.when(touched, leaf_digest(changed)).alias("changed"))
    nodes = written(spark, ranked(leaves, ["_id", "digest"]), "leaves")
    trees = _tree(nodes, levels)
    groups = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("_key"), "digest")
    roots = written(spark, ranked(groups, ["_key"]), "groups")
    forest = _tree(roots, levels)
    top = forest[-1].select("key", "idx", F.lit("").alias("suffix"), F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def to_group(rows, paths, sent):
        import pyarrow as pa

        return pa.table({"key": rows["_key"], "idx": [0] * len(paths), "suffix": paths, "subroot": rows["digest"],
                         "root": [sent["root"]] * len(paths)})

    above = written(spark, _down(roots, _suffixes(forest, top, levels), levels, to_group, SUFFIX), "suffixes")
    above = _suffixes(trees, above, levels)
    schema = T.StructType([
        T.StructField(order, field(df, order).dataType), *(T.StructField(n, T.StringType()) for n in (
            "leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType()),
        *([T.StructField("path", T.StringType())] if with_path else [])])

    def to_rows(rows, paths, sent):
        import pyarrow as pa

        leaf, count = rows["digest"].to_pylist(), len(paths)
        start = [c or d for c, d in zip(rows["changed"].to_pylist(), leaf, strict=True)]
        folded = [fold(s, p) for s, p in zip(start, paths, strict=True)]
        columns = [rows["_id"], leaf, [sent["subroot"]] * count, [sent["root"]] * count, [digest(proof_of(p)) for p in paths],
                   folded, [f == sent["root"] for f in folded], *([paths] if with_path else [])]
        return pa.table(columns, names=schema.names)

    return _down(nodes, above, levels, to_rows, schema)

