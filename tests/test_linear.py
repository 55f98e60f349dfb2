"""Patterns whose matching time must not depend on how often alternatives can be tried."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftlog import Term
from siftlog.functions.linear import first_match, matcher, matches, positions
from siftlog.functions.positions import term_positions
from siftlog.functions.terms import LogicalQuery
from siftlog.plans.search import filter_entries

TEXTS = ["", "a", "x", "ab", "abx", "aab", "foo bar", "Foo\nbaz\nBar\n", "été là", "ÉTÉ x", "a1_b c", "  two  words ", "aaaa", "bx\nax", "\n",
         "déjà vu, déjà", "x" * 50, "1.2.3.4 10.0.0.1", "٠١  z", "ab ab,ab", "word", "(a)", "zz top"]
# (pattern, the same for Python where the two dialects agree)
PATTERNS = [r"(a|b)*x", r"Foo(.|\n)*Bar", r"(a+)+b", r"(\w+\s*)+$", r"(?:[a-c]|é)+", r"^(\S+ ?)*$", r"\b(\w+\b ?)+", r"(\bab\b,?)+", r"(a?){20}a",
            r"(?i)(É|b)+", r"(\d+\.)+\d", r"(?s)(a.)*", r"(?m)(^[ab].*$\n?)+", r"([^a\n]|b)+", r"(\W|\d)*\z", r"(a*)*", r"(x|\b)+a", r"(ab|a)+,"]


def python_regex(pattern):
    return re.compile(pattern.replace(r"\z", r"\Z").replace(r"$)+", r"\Z)+").replace("$", r"\Z") if "(?m)" not in pattern else pattern)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_equals_python(spark, pattern):
    m = matcher(pattern)
    assert m.sends and m.longest is not None, m
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, content string")
    jvm = F.lit(None).cast("array<struct<offset:bigint,length:bigint>>")
    always = m if not m.longest else type(m)(m.java, m.linear, m.marked, 0)
    got = df.select("i", matches(F.col("content"), always).alias("m"), positions(F.col("content"), always, lambda c: jvm).alias("p")).orderBy("i").collect()
    want = python_regex(pattern)
    for r, text in zip(got, TEXTS, strict=True):
        assert r.m == (want.search(text) is not None), (pattern, text)
        spans = []
        for f in want.finditer(text):
            if f.end() == f.start() and spans and spans[-1][1] == f.start():
                continue  # an empty match that touches the one before does not count
            spans.append(f.span())
        bytes_of = [(len(text[:a].encode()), len(text[a:b].encode())) for a, b in spans]
        assert [(p.offset, p.length) for p in r.p] == bytes_of, (pattern, text)


@pytest.mark.parametrize("pattern", ["error", r"\d{4}-\d{2}", "[a-z]x", r"\bword\b", r"(\d{1,3}\.){3}\d{1,3}", "(foo|bar)?x", "a|b", "a.*b", r"^DOC \d+ \w+"])
def test_bounded_patterns_stay_in_the_jvm(pattern, spark):
    assert not matcher(pattern).sends


def test_loops_leave_the_jvm_by_length(spark):
    assert matcher("a.*b.*c").longest > matcher("a.*b.*c.*d").longest > 0
    assert matcher("^a.*b.*c.*d").longest == matcher("a.*b.*c").longest
    assert matcher(r"(ab)*").longest == 2_048 and matcher(r"(a|b)*").longest == 0


def test_both_sides_agree(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1é _.\n") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    content = F.col("content")
    for pattern in (r"a.*b.*", r"\w+\.\w+", r"\bé*1*", r"[^a]+b*$", r"\s+\S+", r"(?i)É+\b *", r"(ab)+", r"\D+a+", r"a*b*"):
        for sensitive in (True, False):
            m = matcher(pattern, sensitive)
            never, always = type(m)(m.java, None, False, None), type(m)(m.java, m.linear, m.marked, 0)
            assert m.sends
            columns = [matches(content, never) == matches(content, always),
                       term_positions(content, Term(pattern, regex=True, case_sensitive=sensitive)) == positions(content, always, None)]
            bad = df.select("content", *(c.alias(f"c{i}") for i, c in enumerate(columns))).filter("not c0 or not c1").collect()
            assert not bad, (pattern, bad[:3])


def test_long_entries_take_time_in_proportion(spark):
    def seconds(n, pattern):
        texts = ["ab" * n, "Foo at line\n" * (n // 6), "a" * (2 * n), None, "x" + "é" * n]
        df = spark.createDataFrame([(t,) for t in texts], "content string").repartition(1).cache()
        df.count()
        started = time.perf_counter()
        found = filter_entries(df, must=[Term(pattern, regex=True)])
        rows = found.select(F.length("content"), term_positions(F.col("content"), Term(pattern, regex=True))).collect()
        return time.perf_counter() - started, len(rows)

    for pattern in (r"(a|b)*x", r"Foo(.|\n)*Bar", r"(a+)+b", r"(.|\n)*zz", r"a.*b.*c.*d", r"(\w+\s?)+!"):
        seconds(1_000, pattern)
        small, _ = seconds(50_000, pattern)
        large, _ = seconds(500_000, pattern)
        assert large < 10 * small + 3, (pattern, small, large)


def test_first_match(spark):
    texts = ["", "no", "at 2024-01-02 x 2025-01-01", "é 7-7 8-8", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    for pattern, want in ((r"(\d+-)+\d+", ["", "", "2024-01-02", "7-7", ""]), (r"(\b\d+-?)+\b", ["", "", "2024-01-02", "7-7", ""])):
        m = matcher(pattern)
        assert m.sends and m.longest == 0
        assert [r.f for r in df.select("i", first_match(F.col("content"), m).alias("f")).orderBy("i").collect()] == want


def test_only_what_else_holds_is_sent(spark, text):
    rows = text("a keep x", "a drop x", "b keep", "aaab skip")
    query = LogicalQuery.of(must=["keep", Term("(a|b)*.x", regex=True)], none=["skip"], any=[Term("(a+)+ ", regex=True), "b"])
    assert [r.content for r in filter_entries(rows, query).collect()] == ["a keep x"]
    query = LogicalQuery.of(must=["p"], none=[Term("(a|c)+ d", regex=True)])
    assert sorted(r.content for r in filter_entries(rows, query).collect()) == ["a keep x", "aaab skip", "b keep"]
