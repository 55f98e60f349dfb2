import textwrap
from collections import Counter

from siftlog.llm.license_full_texts import FULL_TEXTS
from siftlog.llm.license_texts import LICENSE_TEXTS
from siftlog.llm.licenses import scan

MIT = LICENSE_TEXTS[0][1]
SCHEMA = "doc_id long, text string, License string"


def got(df):
    return [(r.doc_id, r.license, r.notices, r.n_notices) for r in df.collect()]


def test_equivalent_texts_match_and_others_do_not(spark):
    changed = "Copyright (c) 2001 Someone <a@b.c>\n" + MIT.upper().replace("LICENSE", "LICENCE").replace(",", " ,").replace(
        "NONINFRINGEMENT", "NON-INFRINGEMENT").replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT OWNERS") + "\n\n(C) 2002 X\nAll rights reserved.\n"
    # a line that begins with these words is a copyright line, so that text is not whole
    rows = [(1, MIT, "c"), (1, MIT, "c"), (2, changed.replace("\nCOPYRIGHT OWNERS", "copyright owners"), "c"), (3, MIT + " not", "c"), (4, None, "c"),
            (5, "", None), (6, "...\n--", "c"), (None, "x\n** Licensed under CC BY-NC 4.0!\nreleased under the MIT licence\nReleased under the MIT License.", "c"),
            (7, "Some words. Licensed under CC BY-NC 4.0.", "c"), (8, "word " * 200_000 + "\nSPDX-License-Identifier: MIT\r\n", "c")]
    want = [(1, "MIT", "", 0), (1, "MIT", "", 0), (2, "MIT", "", 0), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0),
            (6, None, "", 0), (None, None, "CC-BY-NC-4.0,MIT", 3), (7, None, "", 0), (8, None, "MIT", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(got(scan(df)), key=repr) == sorted(want, key=repr)
    assert scan(df.limit(0)).collect() == []
    assert all(n == "" and a is None for _, a, n, _ in got(scan(df, spark.createDataFrame([], "license string, text string"))))


def test_only_native_operators(spark):
    plan = scan(spark.createDataFrame([(1, "x", "c")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_query_equals_sql(spark):
    import compare

    from siftlog.llm.queries import QUERIES
    from siftlog.llm.sql import ORACLE

    sf_dir = "/root/testdata/sf0.001"
    for name in ORACLE:
        problem, count, _ = compare.differences(spark, compare.connect(sf_dir), sf_dir, name, QUERIES[name], ORACLE[name])
        assert problem is None and count, (name, problem)


def rewrapped(text, width):
    """Each paragraph filled to ``width`` columns; 0: the whole text as one line, None: one line a paragraph."""
    if width == 0:
        return " ".join(text.split())
    parts = [" ".join(p.split()) for p in text.split("\n\n")]
    return "\n\n".join(parts if width is None else (textwrap.fill(p, width, break_on_hyphens=False) for p in parts))


def test_wrapping_does_not_count(spark):
    whole = [(a, b) for a, b in LICENSE_TEXTS if len(b) > 300]
    widths = (60, 66, 70, 72, 74, 76, 78, 79, 80, 90, 100, None, 0)
    rows = [(i, rewrapped(b, w), None) for i, (_, b) in enumerate(whole) for w in widths]
    assert Counter((r.doc_id, r.license) for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()) == {
        (i, a): len(widths) for i, (a, _) in enumerate(whole)}


def test_only_copyright_statements_are_dropped(spark):
    dropped = ["Copyright (c) 2001 Someone", "copyright 2001-2003, Free Spirits", "© Someone", "(C) 1999 X", "// Copyright: © 2020 Žofie",
               "Copyright (C) <year> <copyright holders>", "Copyright (c) 2001 X. All rights reserved.", "All rights reserved.\r", "Copyright (c)"]
    kept = ["COPYRIGHT HOLDERS BE LIABLE FOR ANYTHING ELSE", "Copyright notice", "(c) You must", "All rights reserved by them", "Copyright and more",
            "Copyright (C) 2007 Free Software Foundation, Inc.", "Copyright [yyyy] [name of copyright owner]", "Copyright (C) 19yy  <name of author>"]
    rows = [(i, line + "\n" + MIT, None) for i, line in enumerate(dropped + kept)]
    found = {r.doc_id: r.license for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[i] for i in range(len(rows))] == ["MIT"] * len(dropped) + [None] * len(kept)
    other = MIT.replace("COPYRIGHT HOLDERS BE LIABLE", "COPYRIGHT HOLDERS BE GLADLY LIABLE")
    assert got(scan(spark.createDataFrame([(1, other, None)], SCHEMA))) == [(1, None, "", 0)]


def test_known_texts_and_lines(spark):
    full = dict(FULL_TEXTS)
    filled = full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2013 Some Body")
    ends = full["GPL-2.0"].index("END OF TERMS")
    header = full["Apache-2.0"][full["Apache-2.0"].index("   Licensed under the Apache"):]
    bsd = next(t for a, t in LICENSE_TEXTS if a == "BSD-3-Clause")
    rows = [(license, text, license, "") for license, text in full.items()] + [
        ("filled", filled, "Apache-2.0", ""), ("terms", full["GPL-2.0"][:ends], "GPL-2.0", ""), ("bsd", "Copyright 2014 X\n" + bsd, "BSD-3-Clause", ""),
        ("untitled", "Copyright (c) 2020 X\n\n" + MIT.split("\n\n", 1)[1], "MIT", ""), ("more", full["MPL-2.0"] + "\nand more", None, ""),
        ("header", "/*\n" + header + "\n*/\nint main() {}", None, "Apache-2.0"), ("spdx", "// SPDX-License-Identifier: BSD-3-Clause\nx", None, "BSD-3-Clause"),
        ("later", "# SPDX-License-Identifier: GPL-2.0-or-later\nx", None, "GPL-2.0"), ("plus", "SPDX-License-Identifier: LGPL-2.1+ */\nx", None, "LGPL-2.1"),
        ("agpl", "x\nSPDX-License-Identifier: AGPL-3.0-or-later", None, "AGPL-3.0")]
    found = scan(spark.createDataFrame(rows, "doc_id string, text string, want string, lines string")).collect()
    wrong = [(r.doc_id, r.license, r.notices) for r in found if r.license != r.want or (r.lines or r.want is None) and r.notices != r.lines]
    assert len(found) == len(rows) and not wrong
