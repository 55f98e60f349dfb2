"""Mix sources to target weights: Sainte-Lague apportionment of equal blocks of words.

1. Every source's share of all words follows its weight, but stops at ``most`` times its own words;
   what it cannot take is shared by weight among the others (one water level for all).
2. The words are handed out in blocks of equal length.  Sources get blocks by the highest quotients
   target / (2 * blocks + 1); a source's blocks go to its shards the same way, by the shard's words.
3. A shard's documents stand in an order that the seed fixes.  Repeated ``most`` times, their words are
   cut into blocks, and the shard's quota is the first blocks: a document is taken as often as they
   cover its words, whole or in part.

A shard holds a bounded number of documents, whatever its source's size, so a source with a third of
all rows is many shards.  What meets in one task is one small row for each source or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.llm.columns import without, word_count
from siftlog.session import written

SHARD_DOCUMENTS = 5_000  # about so many documents share a shard
BLOCKS = 1 << 20  # all words make about so many blocks ...
LONGEST_BLOCK = 2_048  # ... of at most so many words
MOST_BROADCAST = 20_000  # rows about sources or shards, of less than 200 bytes each; more are joined by shuffling
MADE = ["size", "source_size", "target", "taken"]


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, total: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: the seats of each party of a group by the highest quotients votes / (2s + 1).

    ``total`` holds the group's votes and ``seats`` its seats, on every row.  Rounding votes * seats / total
    is the result for one divisor; it is off by at most half a seat for each of the group's n parties, and
    a party of v votes then gains or loses at most v / total * n / 2 + 1 seats.  So only so many quotients
    are made for it, 2.5 n in all, and the highest (or lowest) settle the difference.  Ties go to the smaller ``key``.
    """
    every = Window.partitionBy(*group)
    seat = F.when(F.col(total) > 0, F.floor(F.col(votes) * F.col(seats) / F.col(total) + 0.5)).otherwise(0).cast("bigint")
    df = parties.withColumn("_seat", seat).withColumns({
        "_off": F.col(seats) - F.sum("_seat").over(every), "_n": F.count(F.lit(1)).over(every),
    }).withColumn("_off", F.when(F.col(total) > 0, F.col("_off")).otherwise(0))
    tries = F.least(F.abs("_off"), F.ceil(F.col(votes) / F.col(total) * F.col("_n") / 2) + 1)
    step = F.explode(F.sequence(F.lit(0), F.greatest(tries - 1, F.lit(0)).cast("int")))
    settled = df.filter("_off <> 0").select(*group, key, votes, "_seat", "_off", step.alias("_k"))
    more = F.col("_off") > 0
    quotient = F.when(more, F.col(votes) / (2 * (F.col("_seat") + F.col("_k")) + 1)).otherwise(
        -F.col(votes) / (2 * (F.col("_seat") - F.col("_k")) - 1))
    settled = settled.filter(more | (F.col("_seat") - F.col("_k") >= 1)).withColumn("_rank", F.row_number().over(
        Window.partitionBy(*group).orderBy(quotient.desc(), key, "_k"))).filter(F.col("_rank") <= F.abs("_off"))
    change = settled.groupBy(*group, key).agg(F.sum(F.sign("_off")).cast("bigint").alias("_change"))
    return df.join(change, [*group, key], "left").withColumn(
        out, F.col("_seat") + F.coalesce("_change", F.lit(0))).drop("_seat", "_off", "_n", "_change")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source key: source_size, documents, all words, target."""
    everything = Window.partitionBy(F.lit(1))
    code_points = Window.partitionBy(F.lit(1)).orderBy("_key")
    full = Window.partitionBy(F.lit(1)).orderBy("_full", "_key").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*map(F.lit, weights))
    df = sizes.groupBy("_key").agg(F.sum("_size").alias("_source"), F.count(F.lit(1)).alias("_documents"))
    df = df.withColumn("_weight", F.element_at(cycle, ((F.row_number().over(code_points) - 1) % len(weights) + 1).cast("int")))
    df = df.withColumns({
        "_full": most * F.col("_source") / F.col("_weight"),
        "_all": F.sum("_source").over(everything), "_weights": F.sum("_weight").over(everything),
    })
    # sources by the level at which they are full; the level if all before are full
    level = (F.col("_all") - F.coalesce(F.sum(most * F.col("_source")).over(full), F.lit(0))) / (
        F.col("_weights") - F.coalesce(F.sum("_weight").over(full), F.lit(0)))
    df = df.withColumn("_level", level).withColumn("_open", F.col("_level") < F.col("_full"))
    water = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    return df.withColumn("_target", F.when(F.col("_open"), water * F.col("_weight")).otherwise(
        (most * F.col("_source")).cast("double"))).select("_key", "_source", "_documents", "_all", "_target")


def looked_up(df: DataFrame, purpose: str) -> DataFrame:
    """A small table, written once; broadcast if its size allows, so that the documents need no shuffle for it."""
    df = written(df.sparkSession, df, purpose)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def mix(
    df: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, size: Column | None = None,
    doc_id: str = "doc_id", source: str = "source", text: str = "text", shard_documents: int = SHARD_DOCUMENTS,
) -> DataFrame:
    """All rows of ``df`` with size, source_size, target and taken (columns of these names are replaced).

    Sources in code-point order, null last, weigh ``weights`` in turn.  ``size`` defaults to the number of
    words, 0 for null text; rows of size 0 and sources without words take nothing.  Rows with equal ids are
    rows of their own.  The same rows and seed always give the same result.
    """
    kept = without(df.columns, MADE)
    name = df[source].cast("string")
    work = df.select(*(df[c] for c in kept), *(x.alias(n) for n, x in (
        ("_size", word_count(df[text]) if size is None else size.cast("bigint")),
        ("_key", F.when(name.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), name))),
        ("_place", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(df[doc_id].cast("string"), F.lit("null"))))),
    )))
    targets = source_targets(work, weights, most)
    block = F.greatest(F.lit(1), F.least(F.lit(LONGEST_BLOCK), F.floor(F.col("_all") / BLOCKS))).cast("bigint")
    targets = targets.withColumn("_block", block).withColumns({
        "_one": F.lit(1), "_seats": F.floor(F.col("_all") / F.col("_block") + 0.5).cast("bigint"),
        "_shards": F.ceil(F.col("_documents") / shard_documents),
    })
    targets = apportion(targets, ["_one"], "_key", "_target", "_all", "_seats", "_quota")
    sources = looked_up(targets.select("_key", "_source", "_target", "_block", "_quota", "_shards"), "sources")
    in_shard = F.conv(F.substring("_place", 1, 8), 16, 10).cast("bigint") % F.col("_shards")
    work = work.join(sources, "_key").withColumn("_shard", in_shard)
    shards = work.groupBy("_key", "_shard").agg(
        F.sum("_size").alias("_words"), *(F.first(c).alias(c) for c in ("_source", "_block", "_quota")))
    shards = apportion(shards, ["_key"], "_shard", "_words", "_source", "_quota", "_blocks")
    wanted = F.least(F.col("_blocks") * F.col("_block"), most * F.col("_words"))
    shards = looked_up(shards.select("_key", "_shard", "_words", wanted.alias("_wanted")), "shards")
    # the documents are shuffled once, by (source, shard)
    work = work.join(shards, ["_key", "_shard"])
    before = F.sum("_size").over(Window.partitionBy("_key", "_shard").orderBy(
        "_place", doc_id, "_size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    rest = F.col("_wanted") % F.col("_words")
    again = F.greatest(F.lit(0), F.least(F.col("_size"), rest - before))
    taken = F.when(F.col("_words") > 0, F.floor(F.col("_wanted") / F.col("_words")) * F.col("_size") + again).otherwise(0)
    return work.select(
        *kept, F.col("_size").alias("size"), F.col("_source").alias("source_size"), F.col("_target").alias("target"),
        taken.cast("bigint").alias("taken"),
    )


def mixed_rows(df: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, the last time perhaps only its first words.

    Only the document at the end of a shard's quota is cut, after a word; its white space becomes single spaces.
    """
    mixed = mix(df, text=text, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    lengths = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn("_take", F.explode(lengths))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)")), 1, F.greatest("_take", F.lit(1))))
    rows = rows.withColumn(text, F.when(F.col("_take") < 0, F.col(text)).otherwise(cut))
    if n_chars in df.columns:
        rows = rows.withColumn(n_chars, F.when(F.col("_take") < 0, F.col(n_chars)).otherwise(F.length(text)).cast(
            df.schema[n_chars].dataType))
    return rows.select(*df.columns)
