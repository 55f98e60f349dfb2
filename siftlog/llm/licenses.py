"""Licence scan by canonical digests: equal texts after normalising have equal digests, found by a hash join.

Normalising takes lower case, drops lines that are copyright statements, turns everything but letters and
digits into single spaces and writes equivalent spellings one way.  The whole text and each of its lines are
looked up among the digests of known licence texts and notices.  Everything is built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm.columns import without
from siftlog.llm.license_texts import EQUIVALENT_SPELLINGS, LICENSE_TEXTS

MOST_BROADCAST = 20_000  # digests of known texts that may be broadcast; more are joined by shuffling
MADE = ["license", "notices", "n_notices"]
# Statements within licence texts, which stand wherever their lines are wrapped, so they count as body: the Free Software
# Foundation's own and the templates of appendices ("19yy <name of author>", "19xx name of author", "[yyyy] [name of copyright owner]").
OF_TEXTS = ["free software foundation", "name of", "year", "yy", "xx name"]


def _other_than(words: list[str]) -> str:
    """A pattern for what begins with a letter, but with none of ``words`` (a-z and spaces; no look-ahead needed)."""
    starts = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda p: (len(p), p))
    after = {p: "".join(sorted({w[len(p)] for w in words if w.startswith(p) and w != p})) for p in starts}
    letters = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in after[""])
    return "|".join([f"[{letters}]", r"[^\x00-\x7F]", *(f"{p}[^{after[p]}\\n]" for p in starts if p),
                     *(f"{p}$" for p in starts if p.strip() and not p.endswith(" ") and " " not in after[p])])  # not one whose line ends early


_YEAR = r"(?:\d{4}|[\[<{(](?:year|yyyy))"
# "copyright" with (c), the sign or a year, a sign, "(c)" with a year; "all rights reserved" alone.  The body of a licence
# says "copyright holders", "copyright notice" and "(c) You must", and keeps such lines however they are wrapped.
COPYRIGHT_LINE = (
    rf"^[^\p{{L}}\p{{N}}\n]*(?:(?:copyright[ \t:,-]*(?:\(c\)|©|{_YEAR})|\(c\)[ \t]*{_YEAR}|©)"
    rf"(?:[^\p{{L}}\n]*[\[<{{(](?:year|yyyy))?[^\p{{L}}\n]*(?:(?:{_other_than(OF_TEXTS)})[^\n]*)?|all rights reserved[^\p{{L}}\p{{N}}\n]*)$")


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical form, each in single spaces; lines without letters or digits are empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"(?md){COPYRIGHT_LINE}", "")
    plain = F.regexp_replace(kept, r"[^\p{L}\p{N}\n]+", " ")
    return F.transform(F.split(spelled(plain, EQUIVALENT_SPELLINGS), "\n"), lambda line: F.trim(line))


def spelled(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def whole(lines: Column) -> Column:
    """One canonical text of canonical lines; spellings of two words may have stood on two lines."""
    joined = F.array_join(F.filter(lines, lambda line: line != ""), " ")
    return spelled(joined, [pair for pair in EQUIVALENT_SPELLINGS if " " in pair[0]])


def digest(canonical: Column) -> Column:
    """Null for what holds no letter or digit: that matches nothing."""
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENSE_TEXTS, "license string, text string")


def scan(df: DataFrame, licenses: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows with ``license`` (whose text the whole text is, or null), ``notices`` (licences whose text a line
    is, sorted, comma-joined) and ``n_notices`` (how many such lines).

    ``licenses`` has columns license and text; of licences with equal canonical texts the first name counts.  Null,
    empty and punctuation-only texts match nothing.  Input columns with the names made here are replaced.
    """
    known = known_licenses(df.sparkSession) if licenses is None else licenses
    known = known.select("license", digest(whole(canonical_lines(F.col("text")))).alias("digest")).filter(
        "digest is not null and license is not null").groupBy("digest").agg(F.min("license").alias("license"))
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    kept = without(df.columns if keep is None else keep, MADE)
    # the whole text counts as line 0; equal rows share one result
    lines = canonical_lines(df[text])
    read = df.select(df[doc_id].alias("_id"), F.xxhash64(df[text]).alias("_same"), lines.alias("_lines")).select(
        "_id", "_same", F.posexplode(F.concat(F.array(whole(F.col("_lines"))), "_lines")).alias("_n", "_line"))
    found = read.filter("_line <> ''").select("_id", "_same", "_n", digest(F.col("_line")).alias("digest")).join(
        known, "digest").select("_id", "_same", "_n", "license").distinct()
    of_line = F.when(F.col("_n") > 0, F.col("license"))
    found = found.groupBy("_id", "_same").agg(
        F.max(F.when(F.col("_n") == 0, F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(of_line)), ",").alias("notices"), F.count(of_line).alias("n_notices"))
    out = df.select(*(df[c] for c in kept), df[doc_id].alias("_own_id"), F.xxhash64(df[text]).alias("_own")).join(
        found, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_same")), "left")
    return out.select(*kept, "license", F.coalesce("notices", F.lit("")).alias("notices"),
                      F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"))
