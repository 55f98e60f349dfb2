import hashlib
import random
import re

import pytest

from siftlog.llm.personal import (
    KINDS, SURE, all_spans, base_spans, find, masked, passes_luhn, regions, shown, tag_regions, train, train_on, windows)


def plain(text):
    """The base patterns as written, by brute force."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_equals_the_patterns():
    rng = random.Random(8)
    parts = ["a@b.co", "@", ".", "-", "+1 (736) 555-2678", "10.0.0.1", "256.1.1.1", "1.2.3", "4111111111111111", "4111-1111 1111 1111",
             "4111111111111112", "x", " ", "é", "+", "(", ")", "0", "9", "a.b+c@d-e.f.g", "a@b", "12", "\n", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert base_spans(text) == plain(text), text
    for long in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 60_000, "a@" * 100_000):
        base_spans(long)


def test_windows_cover_regions():
    for n in (1, 63, 64, 65, 200, 1000):
        starts = windows(5, 5 + n)
        covered = set().union(*(range(w, min(w + 64, 5 + n)) for w in starts))
        assert covered == set(range(5, 5 + n))
    assert regions("no trigger") == [] and regions("a1") == [(0, 2)]


def sample(rng, n):
    rows = []
    for _ in range(n):
        words = [rng.choice(["the", "and", "über", "rain", "x7", "of 12 on", "a9f3"]) for _ in range(rng.randrange(3, 30))]
        for _ in range(rng.randrange(0, 3)):
            words.insert(rng.randrange(len(words)), rng.choice([
                f"u{rng.randrange(99)}@m{rng.randrange(9)}.example.org", f"10.{rng.randrange(255)}.{rng.randrange(255)}.7",
                "4111 1111 1111 1111", f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"]))
        rows.append(" ".join(words))
    return rows


@pytest.fixture(scope="module")
def tagger():
    return train_on([(t, base_spans(t)) for t in sample(random.Random(1), 700)])


def test_held_out_spans(tagger):
    texts = sample(random.Random(2), 300)
    found = tag_regions(tagger, texts)
    want = [set(base_spans(t)) for t in texts]
    got = [{s[:3] for s in f} for f in found]
    hit = sum(len(w & g) for w, g in zip(want, got, strict=True))
    assert hit / sum(map(len, want)) > 0.95 and hit / sum(map(len, got)) > 0.95


def test_added_spans_touch_no_base_span(tagger):
    texts = [*sample(random.Random(3), 100), "", "7" * 5000, "mail to a..b@c.org, or 10.0.0.300"]
    for text, (base, spans) in zip(texts, all_spans(texts, tagger), strict=True):
        assert base == base_spans(text) and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        for kind, a, b in set(spans) - set(base):
            assert all(b <= x or y <= a for _, x, y in base) and re.search("[0-9@]", text[a:b])
    assert 0 < SURE < 1


def test_frames(spark, tagger):
    rows = [(1, "call +1 (736) 555-2678", "c"), (1, "call +1 (736) 555-2678", "c"), (2, None, "c"), (3, "", None), (None, "a@b.co", "c"),
            (4, "word " * 100_000 + "10.1.1.1", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, SPANS string")
    got = find(df, tagger).collect()
    assert [[tuple(s) for s in r.base] for r in got] == [base_spans(t or "") for _, t, _ in rows]
    assert [r.text for r in masked(df, tagger).collect()][:5] == ["call [PHONE]", "call [PHONE]", None, "", "[EMAIL]"]
    assert find(df.limit(0), None).collect() == []
    empty = spark.createDataFrame([], "text string, spans array<struct<kind:string,start:int,end:int>>")
    assert train(empty) is None


def test_query(spark):
    from siftlog.llm.queries import op6_personal

    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op6_personal(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
        assert set(filter(None, shown(base).split(","))) <= set(r.spans.split(","))
