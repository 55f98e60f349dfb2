import gzip
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from siftlog import (
    ConfigError,
    FileAccessError,
    InvalidRequest,
    SearchRequest,
    Settings,
    Term,
    list_files,
    read_lines,
    search_files,
)
from siftlog.plans.search import open_scan
from siftlog.sources.inventory import with_uris


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(path)


def put_gz(path, data):
    return put(path, gzip.compress(data if isinstance(data, bytes) else data.encode()))


def paths(df):
    return [r.path for r in df.collect()]


def lines_of(spark, root, charset="auto"):
    df = read_lines(spark, with_uris(spark, str(root), ["**"]), charset)
    rows = df.orderBy("file_path", "line_no").collect()
    return [(os.path.basename(r.file_path), r.line_no, r.line) for r in rows]


def entries_of(spark, root, pattern=None, **kw):
    files = with_uris(spark, str(root), ["**"])
    rows = open_scan(spark, files, str(root), pattern, **kw).entries().orderBy("file_path", "start_line").collect()
    return [(os.path.basename(r.file_path), r.start_line, r.end_line, r.content) for r in rows]


def find(spark, root, **kw):
    body = {"scan_config": {"root_path": str(root), "include_globs": kw.pop("include", [])}}
    body["logical_query"] = {k: kw.pop(k, []) for k in ("must", "any", "none")}
    settings = kw.pop("settings", None)
    return search_files(spark, {**body, **kw}, settings)


def hits_of(result):
    return [(os.path.basename(r.file_path), r.start_line, r.end_line, r.content) for r in result.hits.collect()]


def test_listing(spark, tmp_path):
    for name in ("a.log", "b.gz", "c.txt", "skip/d.log", "a-b/x.log", "a/x.log", "sub/we [ir]d+%41.log"):
        put(tmp_path / name, "test")
    root = str(tmp_path)
    put(tmp_path / "empty %.log", "")
    found = [p[len(root) + 1:] for p in paths(list_files(spark, root, exclude=["**/skip/**"]))]
    assert found == ["a/x.log", "a-b/x.log", "a.log", "b.gz", "empty %.log", "sub/we [ir]d+%41.log"]
    assert paths(list_files(spark, root, include=["**/*.txt"])) == [f"{root}/c.txt"]
    assert paths(list_files(spark, root + "/nothing")) == []
    assert paths(list_files(spark, root + "/a.log")) == [root + "/a.log"]
    given = [root + "/c.txt", root + "/a.log", root + "/none", root, root + "/c.txt"]
    assert paths(list_files(spark, paths=given, include=["["])) == [given[0], given[1], given[0]]
    assert len(paths(list_files(spark, root, paths=given, exclude=["**/skip/**"]))) == 7
    with pytest.raises(ConfigError):
        list_files(spark, root, include=["["])


def test_listing_keeps_the_spelling_of_the_root(spark, tmp_path, monkeypatch):
    put(tmp_path / "logs/a.log", "x\n")
    monkeypatch.chdir(tmp_path)
    assert paths(list_files(spark, str(tmp_path) + "/logs/")) == [f"{tmp_path}/logs/a.log"]


def test_lines(spark, tmp_path):
    put(tmp_path / "a.log", "first\nsecond\n")
    put(tmp_path / "b.log", "a\r\nb\rc\n")
    put(tmp_path / "c.log", "")
    put(tmp_path / "d.log", "x\n\nlast")
    put(tmp_path / "e.log", b"\xef\xbb\xbfbom\nopen")
    put(tmp_path / "f+%41 [x].log", "odd\n")
    put_gz(tmp_path / "g.log.gz", "gz-line-1\n gz-line-2\n")
    put_gz(tmp_path / "h.gz", "one\nopen")
    put(tmp_path / "i.log", b"bad \xff\xfe byte\n")
    put(tmp_path / "j.log", b"\xff\xfe" + "你好UTF16\n第二行\n".encode("utf-16-le"))
    put(tmp_path / "k.log", b"\xfe\xff" + "be\nopen".encode("utf-16-be"))
    assert lines_of(spark, tmp_path) == [
        ("a.log", 1, "first\n"), ("a.log", 2, "second\n"),
        ("b.log", 1, "a\r\n"), ("b.log", 2, "b\rc\n"),
        ("d.log", 1, "x\n"), ("d.log", 2, "\n"), ("d.log", 3, "last"),
        ("e.log", 1, "bom\n"), ("e.log", 2, "open"),
        ("f+%41 [x].log", 1, "odd\n"),
        ("g.log.gz", 1, "gz-line-1\n"), ("g.log.gz", 2, " gz-line-2\n"),
        ("h.gz", 1, "one\n"), ("h.gz", 2, "open"),
        ("i.log", 1, "bad �� byte\n"),
        ("j.log", 1, "你好UTF16\n"), ("j.log", 2, "第二行\n"),
        ("k.log", 1, "be\n"), ("k.log", 2, "open"),
    ]


def test_declared_charset(spark, tmp_path):
    put(tmp_path / "a.log", "中文 错误\nb".encode("gbk"))
    put(tmp_path / "b.log", b"\xff\xfe" + "x\n".encode("utf-16-le"))
    assert lines_of(spark, tmp_path, "GBK") == [("a.log", 1, "中文 错误\n"), ("a.log", 2, "b"), ("b.log", 1, "x\n")]
    put(tmp_path / "u/a.log", "x\ny".encode("utf-16-le"))
    assert lines_of(spark, tmp_path / "u", "utf-16le") == [("a.log", 1, "x\n"), ("a.log", 2, "y")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


START = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\s+\w+"


def test_multi_line_ranges(spark, tmp_path):
    starts = {1, 110, 111, 112}
    text = "".join(f"2025-11-18 09:46:17.544 DEBUG {i}\n" if i in starts else f" line {i}\n" for i in range(1, 114))
    put(tmp_path / "a.log", text)
    assert [e[1:3] for e in entries_of(spark, tmp_path, START)] == [(1, 109), (110, 110), (111, 111), (112, 113)]


def test_lines_before_the_first_start(spark, tmp_path):
    put(tmp_path / "a.log", "x\ny\n>1\nz\n>2")
    put(tmp_path / "b.log", "no\nstart")
    put_gz(tmp_path / "c.gz", ">1\n>2\nq")
    assert entries_of(spark, tmp_path, "^>") == [
        ("a.log", 1, 2, "x\ny\n"), ("a.log", 3, 4, ">1\nz\n"), ("a.log", 5, 5, ">2"), ("b.log", 1, 2, "no\nstart"),
        ("c.gz", 1, 1, ">1\n"), ("c.gz", 2, 3, ">2\nq"),
    ]


def model(text, start):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    entries = []
    for i, line in enumerate(lines, 1):
        if not entries or start is None or re.search(start, line):
            entries.append([i, i, line])
        else:
            entries[-1][1], entries[-1][2] = i, entries[-1][2] + line
    return [tuple(e) for e in entries]


@pytest.mark.parametrize("split_bytes, batch", [("128m", "10000"), ("700", "10000"), ("300", "7"), ("37", "3")])
@pytest.mark.parametrize("start", [None, "^>"])
def test_any_split_gives_the_same_entries(spark, tmp_path, split_bytes, batch, start):
    rnd = random.Random(7)
    texts = {}
    for k in range(5):
        lines = ["".join(rnd.choices("> aé", k=rnd.choice([0, 1, 3, 30, 200]))) for _ in range(rnd.randint(1, 120))]
        texts[f"f{k}.log"] = "\n".join(lines) + ("\n" if k % 2 else "")
    texts["g.gz"] = texts["f0.log"]
    for name, text in texts.items():
        (put_gz if name.endswith("gz") else put)(tmp_path / name, text)
    conf = {"spark.sql.files.maxPartitionBytes": split_bytes, "spark.sql.files.openCostInBytes": "1",
            "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        want = [(name, *e) for name, text in sorted(texts.items()) for e in model(text, start)]
        assert entries_of(spark, tmp_path, start) == want
        query = [{"query": r"a\s*$", "regex": True}]
        want = [e for e in want if re.search(r"a\s*\Z", e[3])]
        got = find(spark, tmp_path, include=["**"], must=query, log_start_pattern=start, page_size=10_000,
                   settings=Settings(max_page_size=10_000))
        assert hits_of(got) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_search_of_files(spark, tmp_path):
    put(tmp_path / "demo.log", "ok line\nerror traffic\nfatal error\n")
    result = find(spark, tmp_path, must=["error"], none=["fatal"])
    assert hits_of(result) == [("demo.log", 2, 2, "error traffic\n")]
    row = result.hits.first()
    assert [(p.offset, p.length) for p in row.match_positions] == [(0, 5)]
    assert row.file_path == str(tmp_path / "demo.log")
    assert result.summary.collect()[0].asDict() == {
        "total_hits": 1, "page": 1, "page_size": 10, "total_pages": 1, "files_scanned": 1}
    assert result.failed_files.count() == 0
    result = find(spark, tmp_path, must=["error"], include_content=False)
    assert [(r.content, len(r.match_positions)) for r in result.hits.collect()] == [("", 1), ("", 1)]


def test_search_of_multi_line_entries(spark, tmp_path):
    put(tmp_path / "multi.log", "2025-01-01 INFO start\nline-a\n2025-01-01 ERROR boom\nline-b\n")
    result = find(spark, tmp_path, must=["ERROR", "line-b"], log_start_pattern=r"^\d{4}-\d{2}-\d{2}")
    assert hits_of(result) == [("multi.log", 3, 4, "2025-01-01 ERROR boom\nline-b\n")]
    settings = Settings(default_log_start_pattern=r"^\d{4}", default_timestamp_regex=r"\d{4}-\d\d-\d\d")
    assert find(spark, tmp_path, must=["line-a"], settings=settings).hits.first().end_line == 2


def test_unterminated_last_line(spark, tmp_path):
    put(tmp_path / "a.log", "an error\nan error")
    assert [h[1] for h in hits_of(find(spark, tmp_path, must=[{"query": "error$", "regex": True}]))] == [2]
    assert [h[3] for h in hits_of(find(spark, tmp_path, must=["error"]))] == ["an error\n", "an error"]


def test_refused_requests(spark, tmp_path):
    put(tmp_path / "a.log", "x\n")
    with pytest.raises(FileAccessError):
        find(spark, tmp_path / "none", must=["x"])
    with pytest.raises(InvalidRequest):
        find(spark, tmp_path / "a.log", must=["x"])
    with pytest.raises(InvalidRequest):
        find(spark, "", must=["x"])
    with pytest.raises(InvalidRequest):
        find(spark, tmp_path, must=["x"], page=0)
    with pytest.raises(ValueError):
        find(spark, tmp_path, must=["x"], log_start_pattern="(")
    for bad in ({"default_page_size": 0}, {"max_page_size": 0}, {"default_page_size": 11, "max_page_size": 10}):
        with pytest.raises(ConfigError):
            Settings(**bad)


def test_failed_files(spark, tmp_path):
    put(tmp_path / "good.log", "error\n")
    put_gz(tmp_path / "text.gz", b"error\n\xff error\n")
    noise = random.Random(1).randbytes(300_000)
    put(tmp_path / "cut.gz", gzip.compress(b"error\n" + noise.hex().encode())[:100_000])
    broken = bytearray(gzip.compress(b"error\n" + noise.hex().encode()))
    broken[50_000:50_040] = bytes(40)
    put(tmp_path / "broken.gz", bytes(broken))
    put(tmp_path / "not.gz", "error\n")
    put(tmp_path / "members.gz", gzip.compress(b"error 1\n") + gzip.compress(b"error 2"))
    put(tmp_path / "padded.gz", gzip.compress(b"error 1\n") + gzip.compress(b"error 2") + bytes(8))
    put(tmp_path / "empty.gz", b"")
    result = find(spark, tmp_path, must=["error"])
    assert hits_of(result) == [("good.log", 1, 1, "error\n"), ("members.gz", 1, 1, "error 1\n"),
                               ("members.gz", 2, 2, "error 2")]
    failed = {os.path.basename(r.file_path): r.reason for r in result.failed_files.collect()}
    assert sorted(failed) == ["broken.gz", "cut.gz", "not.gz", "padded.gz", "text.gz"]
    assert result.summary.first().files_scanned == 8


def test_caps_and_pages(spark, tmp_path):
    for k in "abc":
        put(tmp_path / f"{k}.log", "".join(f"hit {i}\nother\n" for i in range(5)))
    put(tmp_path / "0.log", "nothing\n")

    def run(**kw):
        result = find(spark, tmp_path, must=["hit"], **kw)
        s = result.summary.first()
        return [(h[0], h[1]) for h in hits_of(result)], s.total_hits, s.total_pages, s.files_scanned

    every = [(f"{k}.log", i) for k in "abc" for i in (1, 3, 5, 7, 9)]
    assert run(page_size=100) == (every, 15, 1, 4)
    assert run(max_hits=6, page_size=100) == (every[:10], 10, 1, 3)
    assert run(max_hits=3) == (every[:3], 3, 1, 2)
    assert run(max_hits=0) == ([], 0, 0, 1)
    assert run(max_hits=99)[1:] == (15, 2, 4)
    assert run(page=2, page_size=4) == (every[4:8], 15, 4, 4)
    assert run(page=9, page_size=4) == ([], 15, 4, 4)
    assert run(page_size=5000)[1:] == (15, 1, 4)
    assert len(run()[0]) == 10
    first = find(spark, tmp_path, include=["**/[a-c].log"], must=["hit"], max_hits=0)
    assert hits_of(first) == [("a.log", 1, 1, "hit 0\n")]


def test_explicit_files_in_given_order(spark, tmp_path):
    a, b = put(tmp_path / "a.txt", "hit a\n"), put(tmp_path / "b.txt", "hit b\nhit c\n")
    settings = Settings(log_file_paths=[b, a, str(tmp_path / "none"), b])

    def run(**kw):
        result = search_files(spark, {"logical_query": {"must": ["hit"]}, **kw}, settings)
        return [h[3][4] for h in hits_of(result)], result.summary.first().files_scanned

    assert run() == (["b", "c", "a", "b", "c"], 3)
    assert run(max_hits=2) == (["b", "c"], 1)
    assert run(max_hits=3) == (["b", "c", "a"], 2)
    assert run(max_hits=0) == (["b"], 1)
    # with a root, explicit paths join the walk whatever the globs say
    result = find(spark, tmp_path, must=["hit"], settings=settings)
    assert [h[3][4] for h in hits_of(result)] == ["a", "b", "c"]


def test_request_from_json(spark, tmp_path, monkeypatch):
    body = {"logical_query": {"must": ["sim_0015"], "any": [], "none": []},
            "scan_config": {"root_path": ".", "include_globs": ["**/*.log"]}, "page_size": 100, "hard_timeout_ms": 30000}
    request = SearchRequest.of(body)
    assert request.query.must == [Term("sim_0015")] and request.page_size == 100 and request.root_path == "."


def test_text_scan_is_not_shuffled(spark, tmp_path):
    put(tmp_path / "a.log", "x error\n" * 10)
    files = with_uris(spark, str(tmp_path))
    scan = open_scan(spark, files, str(tmp_path))
    df = scan.entries(lambda c: F.contains(c, F.lit("error")), True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan, plan


def test_far_pages_equal_near_ones(spark, monkeypatch):
    from siftlog.operators import paging

    rnd = random.Random(2)
    rows = [(f"d/{k % 5}-{k % 3}/f{k}.log", n) for k in range(30) for n in rnd.sample(range(1, 400), rnd.choice([0, 3, 40]))]
    hits = spark.createDataFrame(rows, "file_path string, start_line bigint")
    every = sorted(rows, key=lambda r: (r[0].split("/"), r[1]))
    monkeypatch.setattr(paging, "TOP_K_ROWS", 0)
    monkeypatch.setattr(paging, "LINES_PER_BLOCK", 50)
    for skip, size in ((0, 7), (113, 50), (len(rows) - 3, 10), (len(rows), 5)):
        got = [tuple(r) for r in paging.take_page(hits, skip, size).collect()]
        assert got == every[skip:skip + size]


def test_one_hot_file(spark, monkeypatch):
    from siftlog import cap_per_file, entries_from_lines

    rows = [("hot", n, f"{'>' if n % 7 == 0 else ''}{n}\n") for n in range(1, 3001)] + [("cold", 1, "x\n")]
    random.Random(4).shuffle(rows)
    lines = spark.createDataFrame(rows, "file_path string, line_no bigint, line string")
    entries = entries_from_lines(lines, "^>", lines_per_block=10)
    got = sorted((r.file_path, r.start_line, r.end_line, r.content) for r in entries.collect())
    text = "".join(r[2] for r in sorted(rows[:], key=lambda r: r[1]) if r[0] == "hot")
    assert got == [("cold", 1, 1, "x\n")] + sorted(("hot", *e) for e in model(text, "^>"))
    first = cap_per_file(entries, 25, lines_per_block=16).orderBy("file_path", "start_line").collect()
    assert [r.start_line for r in first if r.file_path == "hot"] == [e[0] for e in model(text, "^>")[:25]]


def test_gzip_is_checked_in_pieces(tmp_path):
    from siftlog.sources.stream import checked_gzip, inflated, pieces_of

    rng = random.Random(3)
    text = rng.randbytes(90_000).hex().encode() + bytes(200_000) + b"end\n"
    whole = gzip.compress(text[:50_000]) + gzip.compress(text[50_000:])
    path = put(tmp_path / "a.gz", whole)
    for piece in (7, 1_000, 1 << 20):  # far smaller than the file: no size is special
        with open(path, "rb") as f:
            parts = list(inflated(pieces_of(f, piece), piece))
        assert b"".join(parts) == text and max(map(len, parts)) <= piece
    assert checked_gzip("file:" + path) == (None, True, len(text))
    for cut in (10, 30_000, len(whole) - 1):
        assert checked_gzip("file:" + put(tmp_path / "b.gz", whole[:cut]))[0] == "unexpected end of file"
    assert checked_gzip("file:" + put(tmp_path / "c.gz", whole + b"xx"))[0] is not None
    assert checked_gzip("file:" + put(tmp_path / "d.gz", whole[:3_000] + b"xxxx" + whole[3_004:]))[0].startswith("corrupt")
    assert checked_gzip("file:" + put(tmp_path / "e.gz", b"")) == (None, True, 0)
    assert checked_gzip("file:" + str(tmp_path / "none.gz"))[0].startswith("cannot be read")


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be"])
def test_wide_files_are_read_in_parts(spark, tmp_path, encoding):
    from siftlog.sources.stream import streamed_lines

    rng = random.Random(9)
    mark = "\ufeff".encode(encoding)
    texts = ["", "one", "one\n", "\n\n\n", "".join(rng.choice("ab\u0a0a\u0a00\u000a😀é\n") for _ in range(500)), "x" * 300 + "\n" + "😀" * 200]
    files = [(f"file:{put(tmp_path / f'f{i}', mark + t.encode(encoding))}", 2 + len(t.encode(encoding))) for i, t in enumerate(texts)]
    for part in (4, 30, 202, 1 << 20):
        lines, failed = streamed_lines(spark, files, None, part)
        got = {}
        for r in lines.orderBy("uri", "line_no").collect():
            got.setdefault(r.uri, []).append((r.line_no, r.line))
        for (uri, _), text in zip(files, texts, strict=True):
            want = [line + "\n" for line in text.split("\n")]
            want[-1] = want[-1][:-1]
            assert got.get(uri, []) == [(i + 1, line) for i, line in enumerate(want) if line or i + 1 < len(want)], (part, uri)
        assert failed.count() == 0


def test_names_that_the_reader_would_drop_or_inflate(spark, tmp_path):
    names = ["a.log", "_a.log", ".b.log", "_logs/d.log", "c.log.lz4", "c.log.snappy", "c.log.zst", "c.log.deflate", "c.log.bz2", "e f%20+.log.zst"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        put(tmp_path / name, "an error\nfine\nlast error")
    put_gz(tmp_path / "_z.log.gz", b"an error\n")
    put(tmp_path / "_bad.gz", b"no gzip")
    os.symlink(tmp_path / "a.log", tmp_path / "link.log")
    result = find(spark, tmp_path, include=["**/*"], must=["error"], page_size=100)
    assert {os.path.relpath(r.file_path, tmp_path) for r in result.all_hits.collect()} == {*names, "_z.log.gz"}
    assert result.all_hits.count() == 2 * len(names) + 1
    assert [os.path.basename(r.file_path) for r in result.failed_files.collect()] == ["_bad.gz"]
    assert result.summary.first().files_scanned == len(names) + 2
    explicit = find(spark, "", must=["error"], settings=Settings(log_file_paths=(str(tmp_path / "_a.log"),)))
    assert explicit.all_hits.count() == 2


def test_files_that_go_away_are_reported(spark, tmp_path, monkeypatch):
    for name in ("a.log", "b.log", "c.log"):
        put(tmp_path / name, "error\n" * 5)
    import siftlog.plans.search as search

    listed = search.with_uris

    def rotated(*args):
        files = spark.createDataFrame(listed(*args).collect())
        os.remove(tmp_path / "b.log")
        put(tmp_path / "c.log", "error\n" * 2)
        return files

    monkeypatch.setattr(search, "with_uris", rotated)
    result = find(spark, tmp_path, must=["error"])
    assert {h[0] for h in hits_of(result)} == {"a.log"}
    assert {os.path.basename(r.file_path): r.reason for r in result.failed_files.collect()} == {
        "b.log": "cannot be read: no such file", "c.log": "cannot be read to its end"}
    assert result.summary.first().files_scanned == 3


def test_charset_is_chosen_per_file(spark, tmp_path):
    put(tmp_path / "plain.log", "é eins\n".encode())
    put(tmp_path / "marked.log", b"\xef\xbb\xbf" + "é zwei\n".encode())
    put(tmp_path / "latin.log", "é drei\n".encode("latin-1"))
    put(tmp_path / "wide.log", "﻿é vier\n".encode("utf-16-le"))
    put(tmp_path / "_own.log", "é fünf\n".encode("latin-1"))
    hits = hits_of(find(spark, tmp_path, must=["é"], charset="ISO-8859-1"))
    assert {h[3] for h in hits} == {"é eins\n", "é zwei\n", "é drei\n", "é vier\n", "é fünf\n"}


def test_spellings_and_repeats_of_explicit_paths(spark, tmp_path):
    put(tmp_path / "a.log", "error\n")
    paths = (f"{tmp_path}/./a.log", f"{tmp_path}//a.log", f"{tmp_path}/./a.log", f"{tmp_path}/a.log")
    result = find(spark, "", must=["error"], settings=Settings(log_file_paths=paths))
    assert [r.file_path for r in result.hits.collect()] == list(paths)
    many = tuple(f"{tmp_path}/./f{i}.log" for i in range(700))
    for name in many:
        put(name, "error\n")
    result = find(spark, "", must=["error"], settings=Settings(log_file_paths=many))
    assert result.summary.first().total_hits == 700


def test_final_newline_shortcuts(spark, tmp_path):
    put(tmp_path / "a.log", "ax")
    assert hits_of(find(spark, tmp_path, must=[{"query": "x[\t-~]", "regex": True}])) == []
    put(tmp_path / "a.log", "x\nERR")
    result = find(spark, tmp_path, must=[None], log_start_pattern="^ERR$")
    assert [h[1:3] for h in hits_of(result)] == [(1, 1), (2, 2)]


def test_workers_need_no_path(tmp_path):
    import subprocess
    import sys

    put(tmp_path / "a.log", "2025 one error\nmore\n2025 two\n")
    put_gz(tmp_path / "b.log.gz", b"2025 error\n")
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from siftlog import search_files
from siftlog.session import local_session
spark = local_session(2, 2)
result = search_files(spark, {{"scan_config": {{"root_path": {str(tmp_path)!r}}}, "logical_query": {{"must": ["error"]}}, "log_start_pattern": "^2025"}})
print("hits", result.all_hits.count())
"""
    (tmp_path / "empty").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "empty", env=env, capture_output=True, text=True, timeout=200)
    assert "hits 2" in out.stdout, out.stderr[-1500:]


def test_working_folders_are_deleted(spark, tmp_path):
    from siftlog.session import shared_folder, working_folders

    put(tmp_path / "a.log", "error\n")
    shared = shared_folder(spark)
    before = set(os.listdir(shared))
    with working_folders(spark):
        assert find(spark, tmp_path, must=["error"]).hits.count() == 1
        assert set(os.listdir(shared)) > before
    assert set(os.listdir(shared)) == before


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pattern", [None, r"^\d{4} "])
def test_pages_and_totals_read_no_text(spark, tmp_path, pattern):
    for k in range(3):
        put(tmp_path / f"{k}.log", "".join(f"{2000 + i} x error {i}\n  at y\n" for i in range(40)))
    request = {"scan_config": {"root_path": str(tmp_path)}, "logical_query": {"must": ["error"]}, "max_hits": 50,
               "page": 2, "page_size": 25, "log_start_pattern": pattern}
    result = search_files(spark, request)
    for df in (result.hits, result.summary, result.all_hits):
        assert "Scan text" not in plan_of(df) and "FileScan text" not in plan_of(df), plan_of(df)
    step = 1 if pattern else 0
    want = [(str(tmp_path / "0.log"), 2 * i + 1, 2 * i + 1 + step) for i in range(40)] + [
        (str(tmp_path / "1.log"), 2 * i + 1, 2 * i + 1 + step) for i in range(40)]
    assert [(r.file_path, r.start_line, r.end_line) for r in result.hits.collect()] == want[25:50]
    assert sorted((r.file_path, r.start_line, r.end_line) for r in result.all_hits.collect()) == want
    assert [tuple(r) for r in result.summary.collect()] == [(80, 2, 25, 4, 2)]


def test_whole_entries_meet_no_exchange(spark, tmp_path):
    put(tmp_path / "a.log", "2000 x\n  at y\n" * 20)
    scan = open_scan(spark, with_uris(spark, str(tmp_path)), str(tmp_path), r"^\d{4} ")
    plan = plan_of(scan._readable(scan._placed_pieces(lambda c: F.contains(c, F.lit("x")))))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan, plan


@pytest.mark.parametrize("limit", [0, 1, 3, 1000])
@pytest.mark.parametrize("in_order", [True, False])
def test_first_hits_of_any_order(monkeypatch, limit, in_order):
    import pyarrow as pa

    from siftlog.operators import paging

    monkeypatch.setattr(paging, "FILES_PER_TASK", 2)
    rnd = random.Random(limit)
    rows = [(f"f{k}", n, True) for k in range(5) for n in rnd.sample(range(1, 900), 60 * k)] + [("f1", 901, False), ("f9", 5, False)]
    rows = sorted(rows) if in_order else rnd.sample(rows, len(rows))
    names = ["uri", "start_line", "whole"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i:i + 37]]) for i in range(0, len(rows), 37)]
    out = [r for b in paging.first_and_counts(limit)(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
    assert sorted((r["uri"], r["start_line"]) for r in out if r["whole"] is False) == [("f1", 901), ("f9", 5)]
    for k in range(6):
        lines = sorted(n for f, n, whole in rows if f == f"f{k}" and whole)
        got = sorted(r["start_line"] for r in out if r["uri"] == f"f{k}" and r["whole"])
        assert got[:limit] == lines[:limit] and set(got) <= set(lines) and len(set(got)) == len(got)
        assert not in_order or len(got) <= limit * 10
        assert sum(r["hits"] for r in out if r["uri"] == f"f{k}" and r["hits"] is not None) == len(lines)


@pytest.mark.parametrize(("ending", "purpose"), [(".log.gz", "gzip"), (".log.zst", "own")])
def test_small_files_share_tasks(spark, tmp_path, ending, purpose):
    from siftlog import session
    from siftlog.sources.stream import TASKS_PER_CORE

    for i in range(60):
        (put_gz if ending.endswith("gz") else put)(tmp_path / f"f{i:02}{ending}", f"line of {i}\n" * (i % 3))
    before = len(session._made)
    assert lines_of(spark, tmp_path) == [(f"f{i:02}{ending}", n + 1, f"line of {i}\n") for i in range(60) for n in range(i % 3)]
    folder = next(f for f in session._made[before:] if f"siftlog-{purpose}-" in f)
    written = [name for name in os.listdir(folder) if name.startswith("part-")]
    assert 1 < len(written) <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def test_dealt_by_bytes():
    from siftlog.sources.stream import PART, dealt

    sizes = [1, PART * 5, 0, PART // 2, PART // 2, 10]
    groups = dealt(sizes, 2)
    assert sorted(i for g in groups for i in g) == list(range(6))
    assert [1] in groups
    assert dealt([], 4) == []
    assert sorted(map(len, dealt([7] * 10, 4))) == [2, 2, 3, 3]
