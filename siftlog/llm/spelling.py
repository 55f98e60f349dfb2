"""Spelling variants: words that differ by one letter, grouped under their usual form.

A variable-length gram index.  Grams of ``SHORTEST`` letters that are common in the vocabulary are extended, up to
``LONGEST`` letters, by the grams that occur; rare ones are not, so the dictionary stays small and lists stay short.
A word is decomposed into the longest dictionary gram at each place, without grams that lie inside an earlier one.
How many of its grams one edit can change is bounded for each word by itself (``affected``); two words that are one
edit apart share all their other grams.  So only the word's rarest grams are listed, one more than that bound, under
their place and the word's length.  Short lists that meet are merged and their words verified letter by letter.

A list of more than ``SHORT_LIST`` words is not compared word by word: its words share the gram, so an edit lies in the
rest, and the list is split by the rest without one letter (long words: by halves).  A word whose bound leaves no gram is also listed under the
empty gram, the longest list of all.  So the work grows with the words and with the pairs that are near.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.columns import map_batches, texts_of
from siftlog.session import written

SHORTEST, LONGEST = 2, 4  # letters of a gram
COMMON = 200  # words: a gram in more is extended ...
MOST_COMMON = 20_000  # ... if it is among so many; bounds the dictionary that is broadcast
SHORT_LIST = 32  # words
LONG_WORD = 64  # letters
MOST_BROADCAST = 1_000_000  # hashes of long lists (8 bytes each) that may be broadcast; more are joined by shuffling
HELD_WORDS = 200_000  # counted in a task before they are handed on
RUN = re.compile("[A-Za-zÀ-ÿ]+")


# ---------------------------------------------------------------------------- words


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int | None = 31) -> DataFrame:
    """``(word, n)`` of all runs of letters, A to Z in lower case; null texts have none.

    ``every`` plants misspellings: a word loses one letter where it divides the checksum of ``<id>:<word>`` (never with a null
    id); ``None`` leaves words as they are.  Words are counted in a task first,
    so that one that is everywhere costs a row for each task, and a task holds ``HELD_WORDS`` words at most.
    """
    def count(batches):
        import zlib
        from collections import Counter

        import pyarrow as pa

        def handed(held):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: dict[str, int] = {}
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = Counter(RUN.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                start = zlib.crc32(f"{i}:".encode())
                for word, n in words.items():
                    if every and i is not None:
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield handed(held)
                    held = {}
        yield handed(held)

    rows = df.select(df[doc_id].alias("id"), df[text].alias("text"))
    return map_batches(rows, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------------------- grams


@dataclass(frozen=True)
class Grams:
    """Dictionary of grams of more than ``SHORTEST`` letters; every gram of ``SHORTEST`` letters counts as known.

    ``rank`` orders grams from rare to common as far as known; grams without a rank are rarer than those with one.
    """

    longer: frozenset[str]
    rank: dict[str, int]

    @cached_property
    def heads(self) -> frozenset[str]:
        """Beginnings of longer grams: text that ends in one might go on as such a gram."""
        return frozenset(g[:n] for g in self.longer for n in range(1, len(g)))

    @cached_property
    def tails(self) -> frozenset[str]:
        return frozenset(g[-n:] for g in self.longer for n in range(1, len(g)))

    def parts(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams: at each place the longest, unless it lies inside the one before it."""
        out, reached = [], 0
        for start in range(len(word) - SHORTEST + 1):
            end = start + SHORTEST
            for longer in range(min(len(word), start + LONGEST), end, -1):
                if word[start:longer] in self.longer:
                    end = longer
                    break
            if end > reached:
                out.append((start, end))
                reached = end
        return out

    def affected(self, word: str, parts: list[tuple[int, int]]) -> int:
        """The most grams of ``parts`` that one edit of the word can take away.

        An edit at a letter (or in a gap before it) takes grams that contain it.  It can lengthen a gram that starts
        before it if the letters up to the edit begin a longer gram, which also swallows grams after that start; and a
        new gram that ends behind the edit can swallow grams up to its end if the letters from the edit on end a gram.
        """
        size, most = len(word), 0
        starts, ends = [p[0] for p in parts], [p[1] for p in parts]  # both ascend, so those that are hit are neighbours
        for at in range(size + 1):
            # the first start from which a gram may reach the edit, the last end that a gram over the edit may reach
            left = next((s for s in range(max(0, at - LONGEST + 1), at) if word[s:at] in self.heads), at)
            first = min(bisect_left(starts, left), bisect_right(ends, at))
            for after in ((at, at + 1) if at < size else (at,)):  # an insertion, or a deletion or replacement of word[at]
                right = next((e for e in range(min(size, after + LONGEST - 1), after, -1) if word[after:e] in self.tails), after)
                most = max(most, max(bisect_right(ends, right), bisect_left(starts, after)) - first)
        return most

    def listed(self, word: str) -> list[tuple[str, int]]:
        """(gram, start) of the word's rarest grams, one more than an edit can take away: another word that is one
        edit apart lists one of them too, at the same place from the word's beginning or from its end.  If an edit can
        take all, the empty gram is listed as well; then that holds for it."""
        parts = self.parts(word)
        keys = sorted(((word[s:e], s) for s, e in parts), key=lambda g: (self.rank.get(g[0], -1), g[0], g[1]))
        kept = self.affected(word, parts) + 1
        return keys[:kept] if kept <= len(keys) else [*keys, ("", 0)]


def gram_dictionary(words: DataFrame) -> Grams:
    """Counts grams over all words and extends the common ones; bounded by ``MOST_COMMON``, whatever the input."""
    size = F.length("word")
    every = words.select(F.explode(F.flatten(F.transform(
        F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: i + n - 1 <= size),
            lambda i: F.substring(F.col("word"), i, n))))).alias("gram"))
    counts = written(words.sparkSession, every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") > COMMON) | (F.length("gram") > SHORTEST)), "grams")
    common = counts.filter(F.col("n") > COMMON).orderBy(F.desc("n"), "gram").limit(MOST_COMMON)
    heads = F.broadcast(common.filter(F.length("gram") < LONGEST).select(F.col("gram").alias("head")))
    longer = counts.filter(F.length("gram") > SHORTEST).join(
        heads, F.expr("left(gram, length(gram) - 1)") == F.col("head"), "left_semi").select("gram")
    ranks = {r.gram: i for i, r in enumerate(common.orderBy("n", "gram").collect())}
    # each head has at most one longer gram for each letter there is
    return Grams(frozenset(r.gram for r in longer.collect()), ranks)


# ---------------------------------------------------------------------------- near words


def _lists(words: DataFrame, grams: Grams) -> DataFrame:
    """``(gram, start, size, word)`` for each listed gram of each word."""
    sent = words.sparkSession.sparkContext.broadcast(grams)

    def make(batches):
        import pyarrow as pa

        g = sent.value
        for batch in batches:
            rows = [(gram, start, len(word), word) for word in batch.column(0).to_pylist() for gram, start in g.listed(word)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)],
                names=["gram", "start", "size", "word"])

    return map_batches(words.select("word"), make, "gram string, start int, size int, word string")


def _splits(listed: DataFrame) -> DataFrame:
    """``(rest, at, word)``: each word of a list by all it has beside one letter outside the gram.

    A word of more than ``LONG_WORD`` letters, for which that would be many, by each half instead: an edit leaves one
    half as it is.  The longer of two words is halved as the shorter one, from either end.
    """
    gram, word = F.length("gram"), F.col("word")
    outside = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda p: (p < F.col("start")) | (p >= F.col("start") + gram))
    start = F.col("start") - (F.col("at") < F.col("start")).cast("int")
    without = F.expr("concat(left(word, at), substring(word, at + 2))")
    letters = listed.filter(F.col("size") <= LONG_WORD).withColumn("at", F.explode(outside)).select(
        F.xxhash64("gram", start, without).alias("rest"), "at", "word")
    shorter = F.col("size") - F.col("longer")
    halves = listed.filter(F.col("size") >= LONG_WORD).withColumn("longer", F.explode(F.when(
        F.col("size") > LONG_WORD, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn(
        "half", F.floor(shorter / 2).cast("int")).withColumn("at", F.explode(F.array(F.lit(-1), F.lit(-2)))).select(
        F.xxhash64("gram", shorter, F.when(F.col("at") == -1, F.left(word, F.col("half"))).otherwise(
            F.right(word, shorter - F.col("half")))).alias("rest"), "at", "word")
    return letters.unionByName(halves)


def near_pairs(words: DataFrame, grams: Grams | None = None) -> DataFrame:
    """``(a, b)`` of the words that are one edit apart, each pair once; ``b`` is longer, or as long and greater.

    Lists and their splits travel under 64-bit hashes, as every pair that meets is verified.
    """
    spark = words.sparkSession
    grams = grams or gram_dictionary(words)
    lists = written(spark, _lists(words, grams), "lists").filter("word is not null")
    by_gram = lists.filter("gram <> ''").withColumn("list", F.xxhash64("gram", "start", "size"))
    long = written(spark, by_gram.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHORT_LIST).select("list"), "long")
    long = F.broadcast(long) if long.count() <= MOST_BROADCAST else long
    near = F.levenshtein("a", "b", 1) == 1
    size_a, size_b = F.length("a"), F.length("b")
    ordered = (size_a < size_b) | ((size_a == size_b) & (F.col("a") < F.col("b")))

    # words of one length keep the places of the grams they share; behind an added letter these move by one
    probes = by_gram.join(long, "list", "left_anti").select(F.explode(F.array("list", *(
        F.xxhash64("gram", F.col("start") - i, F.col("size") - 1) for i in (0, 1)))).alias("list"), F.col("word").alias("b"))
    found = [by_gram.select("list", F.col("word").alias("a")).join(probes, "list").filter(ordered & near)]

    split = _splits(by_gram.join(long, "list", "left_semi").drop("list").unionByName(lists.filter("gram = ''")))
    one, other = split.withColumnsRenamed({"word": "a", "at": "at_a"}), split.withColumnsRenamed({"word": "b", "at": "at_b"})
    itself = lists.select(F.xxhash64("gram", "start", "word").alias("rest"), F.col("word").alias("a"))
    found += [one.join(other, "rest").filter((F.col("at_a") == F.col("at_b")) & ordered & near),
              itself.join(other, "rest").filter(near & (F.col("at_b") < size_b))]  # the same columns: one exchange for all
    pairs = found[0].select("a", "b")
    for part in found[1:]:
        pairs = pairs.unionByName(part.select("a", "b"))
    return pairs.distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words with a form: from word to form until a word has none.

    Every step multiplies n, so a path is short: the steps double in a few rounds.
    """
    spark = forms.sparkSession
    now = written(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not now.join(on, "root", "left_semi").head(1):
            return now
        now = written(spark, now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(words: DataFrame, least_letters: int = 7, least_count: int = 2, times: int = 10) -> DataFrame:
    """``(word, n, form, root, n_near, form_n)`` of the words ``(word, n)`` of enough letters and occurrences.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least ``times`` n; ``root`` is
    where forms lead.  Without such a word form and form_n are null, root is the word and n_near may be 0.  Null words count
    as none, repeated rows of a word add up, empty tables give no rows; long words are words like others.
    """
    spark = words.sparkSession
    known = written(spark, words.filter(F.length("word") >= least_letters).groupBy("word").agg(
        F.sum("n").cast("bigint").alias("n")).filter(F.col("n") >= least_count), "words")
    pairs = near_pairs(known)
    count = known.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    both = pairs.join(count, "a").join(count.toDF("b", "n_b"), "b")
    best = both.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))).alias("r")).select("r.*").groupBy(
        "word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    near = written(spark, known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("n"))).alias("f")
    ).select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "near")
    roots = _followed(near.filter("form is not null"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
