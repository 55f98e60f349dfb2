import random
import re

import pytest
from pyspark.sql import functions as F

from siftlog import (
    InvalidPattern,
    LogicalQuery,
    Term,
    TimeFilter,
    match_positions,
    search_entries,
    term_positions,
)


def kept(text, contents, **kw):
    rows = search_entries(text(*contents), **kw).orderBy("start_line").collect()
    return [r.content for r in rows]


def positions(text, content, term):
    row = text(content).select(term_positions(F.col("content"), term).alias("p")).first()
    return [(p.offset, p.length) for p in row.p]


def test_boolean_combination(text):
    contents = ["traffic error occurred", "info traffic ok", "traffic fatal error"]
    assert kept(text, contents, must=["error"], any=["traffic", "network"], none=["fatal"]) == contents[:1]
    assert kept(text, contents) == contents
    assert kept(text, contents, must=["traffic", "ERROR"]) == [contents[0], contents[2]]
    assert kept(text, contents, must=["É"], any=["x", "info"]) == []
    assert kept(text, contents, must=["O"], any=["INFO", "net"], none=["zz", "Fatal"]) == [contents[1]]


def test_plain_terms_and_case(text):
    contents = ["Error é", "error É", "none"]
    assert kept(text, contents, must=["ERROR"]) == contents[:2]
    assert kept(text, contents, must=[Term("Error", case_sensitive=True)]) == contents[:1]
    assert kept(text, contents, must=["É"]) == contents[:2]
    assert kept(text, contents, must=[""]) == contents


def test_regex_terms(text):
    contents = ["an error\n", "an error", "x\ny", "ÉTÉ 12"]
    assert kept(text, contents, must=[{"query": "error$", "regex": True}]) == ["an error"]
    assert kept(text, contents, must=[{"query": "^x.y", "regex": True}]) == []
    assert kept(text, contents, must=[{"query": "(?s)^x.y$", "regex": True}]) == ["x\ny"]
    assert kept(text, contents, must=[{"query": r"^\w+ \d\d$", "regex": True}]) == ["ÉTÉ 12"]
    assert kept(text, contents, must=[{"query": "été", "regex": True}]) == ["ÉTÉ 12"]
    assert kept(text, contents, must=[{"query": "été", "regex": True, "case_sensitive": True}]) == []


def test_null_and_invalid_terms(text):
    contents = ["a", "b"]
    assert kept(text, contents, must=[None, {}]) == contents
    assert kept(text, contents, none=[{"query": None}]) == []
    bad = {"query": "(?=a)", "regex": True}
    assert kept(text, contents, must=[bad]) == []
    assert kept(text, contents, none=[bad]) == contents
    with pytest.raises(InvalidPattern):
        kept(text, contents, must=[bad], strict=True)


def test_whole_word(text):
    contents = ["err and terror", "terror", "x[T]", "[T]", "éerr", "e.r"]
    assert kept(text, contents, must=[Term("ERR", whole_word=True)]) == contents[:1]
    assert kept(text, contents, must=[Term("[T]", whole_word=True)]) == []
    assert kept(text, ["x[T]y"], must=[Term("[T]", whole_word=True)]) == ["x[T]y"]
    assert kept(text, contents, must=[Term("e.r", whole_word=True)]) == ["e.r"]
    # with regex set, whole_word plays no part
    assert kept(text, contents, must=[Term("erro", whole_word=True, regex=True)]) == contents[:2]


def test_positions_from_the_book(text):
    assert positions(text, "err and terror", Term("err", whole_word=True)) == [(0, 3)]
    assert positions(text, "err and terror", Term("t[a-z]{3}or", regex=True)) == [(8, 6)]
    assert positions(text, "err and terror", Term("err")) == [(0, 3), (9, 3)]
    assert positions(text, "aaaa", Term("aa")) == [(0, 2), (2, 2)]
    assert positions(text, "İ err", Term("err")) == [(4, 3)]
    assert positions(text, "é err É", Term("É", case_sensitive=True)) == [(7, 2)]
    assert positions(text, r"a\Eb \e", Term(r"\E")) == [(1, 2), (5, 2)]
    for term in (Term(""), Term(None), Term("(", regex=True), Term("zz"), Term("zz", whole_word=True)):
        assert positions(text, "abc", term) == []


def test_positions_whole_word_overlap_and_bytes(text):
    term = Term("a a", whole_word=True)
    assert positions(text, "a a a", term) == [(0, 3), (2, 3)]
    assert positions(text, "a.a", Term(".", whole_word=True)) == []
    assert positions(text, " . ", Term(".", whole_word=True)) == [(1, 1)]


def bytewise_words(content, needle):
    """Brute force over bytes, each judged as a single-byte character."""
    hay, word = content.lower().encode(), needle.lower().encode()

    def is_word(b):
        c = bytes([b]).decode("latin-1")
        return c.isalnum() or c == "_"

    return [
        (i, len(word)) for i in range(len(hay) - len(word) + 1)
        if hay[i:i + len(word)] == word
        and (i == 0 or not is_word(hay[i - 1]))
        and (i + len(word) == len(hay) or not is_word(hay[i + len(word)]))
    ]


def test_positions_whole_word_brute_force(spark, text):
    rnd = random.Random(3)
    contents = ["".join(rnd.choices("ab ._é½²éàא×-", k=rnd.randint(0, 40))) for _ in range(300)]
    for needle in ("a", "ab", "a a", "é", "."):
        rows = text(*contents).select(
            "content", term_positions(F.col("content"), Term(needle, whole_word=True)).alias("p")
        ).collect()
        for r in rows:
            assert [(p.offset, p.length) for p in r.p] == bytewise_words(r.content, needle), (r.content, needle)


def test_positions_regex_empty_matches(text):
    # an empty match that touches the match before it does not count
    assert positions(text, "baac", Term("a*", regex=True)) == [(0, 0), (1, 2), (4, 0)]
    assert positions(text, "aab", Term("a*", regex=True)) == [(0, 2), (3, 0)]
    assert positions(text, "", Term("a*", regex=True)) == [(0, 0)]
    assert positions(text, "é1", Term(r"\b", regex=True)) == [(0, 0), (3, 0)]
    assert positions(text, "x é", Term("^", regex=True)) == [(0, 0)]
    assert positions(text, "x é", Term("$", regex=True)) == [(4, 0)]


def test_positions_many_matches_match_python(text):
    rnd = random.Random(5)
    content = "".join(rnd.choices("abé \n", k=4000))
    want = [(len(content[:m.start()].encode()), len(m.group().encode())) for m in re.finditer("ab|é", content)]
    assert positions(text, content, Term("ab|é", regex=True)) == want
    want = [(len(content[:m.start()].encode()), 1) for m in re.finditer("a", content)]
    assert positions(text, content, Term("a")) == want


def test_positions_order(text):
    query = LogicalQuery.of(must=["b", "a"], any=["c"], none=["a"])
    row = text("abca").select(match_positions(F.col("content"), query).alias("p")).first()
    assert [(p.offset, p.length) for p in row.p] == [(1, 1), (0, 1), (3, 1), (2, 1), (0, 1), (3, 1)]


RFC = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z"
ANY = r"\d{4}-\d{1,2}-\d{1,2}[T ][0-9:.,]+(?:Z|[+-]\d\d:\d\d)?"


def test_time_range(text):
    contents = ["2024-01-01T12:00:00Z something", "2024-01-03T00:00:00Z late", "no stamp"]
    window = {"after": "2024-01-01", "before": "2024-01-02"}
    assert kept(text, contents, time_filter={**window, "timestamp_regex": RFC}) == contents  # unreadable bounds
    window = {"after": "2024-01-01 00:00:00", "before": "2024-01-02T00:00:00Z"}
    assert kept(text, contents, time_filter={**window, "timestamp_regex": RFC}) == [contents[0], contents[2]]
    assert kept(text, contents, time_filter=window, default_timestamp_regex=RFC) == [contents[0], contents[2]]
    assert kept(text, contents, time_filter=window) == contents
    assert kept(text, contents, time_filter={**window, "timestamp_regex": "("}) == contents
    for names in (("time_start", "time_end"), ("start_time", "end_time"), ("startTime", "endTime")):
        body = dict(zip(names, window.values())) | {"timestamp_regex": RFC}
        assert kept(text, contents, time_filter=body) == [contents[0], contents[2]]
    with pytest.raises(ValueError):
        kept(text, contents, time_filter={"after": "soon"}, strict=True)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_forms(spark, text, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        window = TimeFilter("2024-01-01 10:00:00", "2024-01-01 11:00:00", ANY)
        inside = ["2024-01-01 10:00:00 a", "2024-01-01T11:00:00 b", "2024-01-01 10:30:00.5 c", "2024-1-1 10:5:7 d",
                  "2024-01-01T12:30:00+02:00 e", "2024-01-01T10:30:00Z f"]
        unread = ["2024-01-01 12:00:00,123 g", "2024-13-01 12:00:00 h", "x"]
        outside = ["2024-01-01 09:59:59.999 i", "2024-01-01 11:00:00.001 j", "2024-01-01T10:30:00+02:00 k"]
        assert kept(text, inside + outside + unread, time_filter=window) == inside + unread
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    # the first stamp counts
    assert kept(text, ["2024-01-01 09:00:00 x 2024-01-01 10:30:00"], time_filter=window) == []
