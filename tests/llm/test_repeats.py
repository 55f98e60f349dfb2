import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftlog.llm import repeats
from siftlog.llm.repeats import common_prefix, interval_tree, merged, reach_of_others, remove, spread

SCHEMA = "doc_id long, text string, N_bytes string"


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    places = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            places.setdefault(t[s:s + length], []).append((i, s))
    cover = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for i, s in found:
                cover[i].update(range(s, s + length))
    out = Counter()
    for (doc, *_), t, c in zip(rows, texts, cover, strict=True):
        spans = sum(1 for x in c if x - 1 not in c)
        kept = bytes(b for i, b in enumerate(t) if i not in c)
        out[doc, len(t), len(c), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed, n, length):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(length // 2, 4 * length))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                a = rng.randrange(len(p))
                p = p[a:a + rng.randrange(2 * length)]
            parts.append(rng.choice([p, "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 3 * length))), "xy" * rng.randrange(length)]))
        text = "".join(parts)
        texts.append(text if not texts or rng.random() < 0.85 else rng.choice(texts))
    return [(i * 2, t, "c") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("length", "most", "piece"), [(12, 20_000, 1 << 20), (20, 2, 1 << 20), (25, 20_000, 64)])
def test_equals_brute_force(spark, monkeypatch, length, most, piece):
    monkeypatch.setattr(repeats, "MOST_RUNS", most)
    monkeypatch.setattr(repeats, "BIN_RUNS", 25)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = corpus(length, 60, length)
    rows += [(None, None, "c"), (900, "", "c"), (901, "a" * 300, "c"), (902, "only short", "c"), (903, "only short", None),
             (None, rows[3][1] + "tail", "c"), (rows[5][0], rows[6][1] + "q" * length, "c"), (rows[7][0], rows[7][1], "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(remove(df, length)) == brute(rows, length)


def test_interval_tree_groups_all_occurrences():
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(120))
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0, *(common_prefix(text[a:].encode(), text[b:].encode()) for a, b in zip(order, order[1:]))]
    reach, node, parent = interval_tree(lcp, [ord(text[i - 1]) if i else -1 for i in order], 3)
    groups = {}
    for i, k in zip(order, node, strict=True):
        while k >= 0:
            groups.setdefault(k, set()).add(i)
            k = parent[k]
    want = set()
    for i in range(len(text)):
        for n in range(3, len(text) - i + 1):
            at = [j for j in range(len(text)) if text.startswith(text[i:i + n], j)]
            before, after = {text[j - 1] if j else j for j in at}, {text[j + n] if j + n < len(text) else j for j in at}
            if len(at) > 1 and len(after) > 1 and (len(before) > 1):
                want.add(frozenset(at))
    assert {frozenset(g) for g in groups.values()} == want
    assert max(reach) == max(lcp)


def test_small_parts(spark):
    assert merged([(5, 9), (1, 3), (2, 6), (12, 13)]) == [[1, 9], [12, 13]]
    assert remove(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "lorem ipsum " * 60_000
    r = remove(spark.createDataFrame([(1, text, "c"), (2, "x" * 399 + "y", "c")], SCHEMA)).collect()
    assert {(x.doc_id, x.n_removed, x.n_spans) for x in r} == {(1, len(text), 1), (2, 0, 0)}


def brute_shared(rows, passage):
    texts = [(t or "").encode() for _, t, *_ in rows]
    holders = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - passage + 1):
            holders.setdefault(t[s:s + passage], set()).add(i)
    out = Counter()
    for (doc, *_), t in zip(rows, texts, strict=True):
        spans = merged([(s, s + passage) for s in range(len(t) - passage + 1) if len(holders[t[s:s + passage]]) > 1])
        out[doc, sum(b - a for a, b in spans), max((b - a for a, b in spans), default=0)] += 1
    return out


@pytest.mark.parametrize(("length", "passage", "most", "piece"), [
    (20, 12, 20_000, 1 << 20), (20, 20, 20_000, 1 << 20), (25, 14, 2, 1 << 20), (30, 18, 20_000, 64)])
def test_passages_of_other_texts_equal_brute_force(spark, monkeypatch, length, passage, most, piece):
    monkeypatch.setattr(repeats, "MOST_RUNS", most)
    monkeypatch.setattr(repeats, "BIN_RUNS", 25)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = corpus(100 + length, 60, length)
    own = "".join(random.Random(length).choice("opqrst") for _ in range(6 * length))
    rows += [(None, None, "c"), (900, "z" * 300, "c"), (901, own + "1" + own + "2" + own, "c"), (902, own[:3 * length], None),
             (903, "3" + own[length:4 * length] + "4" + own[length:4 * length], "c"), (904, "5" * 200 + "6" * 200 + "5" * 200, "c"),
             (rows[5][0], rows[6][1] + "q" * length, "c"), (rows[7][0], rows[7][1], "c"), (905, "only twice " * 3, "c"), (905, "only twice " * 3, "c")]
    found = remove(spark.createDataFrame(rows, SCHEMA).repartition(3), length, passage=passage).cache()
    assert Counter((r.doc_id, r.n_shared, r.longest_shared) for r in found.collect()) == brute_shared(rows, passage)
    assert got(found) == brute(rows, length)


def test_passages_below_the_length_removed(spark):
    """51 to 59 words are mostly less than 400 bytes: nothing is removed, but the texts that share them show it."""
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    passages = [p for p in (prose(rng.randrange(51, 60)) for _ in range(40)) if 271 <= len(p) < 400][:12]
    assert len(passages) == 12
    rows = [(i, f"{prose(80)} {passages[i % 12]} {prose(80)}", "c") for i in range(24)]
    rows += [(100 + i, prose(200), "c") for i in range(24)] + [(200, f"{prose(9)} " + "over and over " * 60, "c")]
    out = {r.doc_id: r for r in remove(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i].n_removed == 0 and len(passages[i % 12]) <= out[i].longest_shared <= len(passages[i % 12]) + 8 for i in range(24))
    assert all(out[i].n_shared == out[i].n_removed == 0 for i in range(100, 124))
    assert out[200].n_removed > 0 and out[200].n_shared == 0  # repeats itself, shares nothing


def test_reach_of_others_and_spread():
    assert reach_of_others([0, 5, 3, 9, 2], [1, 1, 2, 2, 1]) == [3, 3, 3, 3, 2]
    assert spread([(3, 8), (6, 9)], np.array([0, 5, 20]), np.array([7, 4, 7])) == [(3, 8), (6, 9), (23, 28)]
    assert spread([(3, 8)], np.array([0, 5]), np.array([1, 0])) == [(3, 8)]


@pytest.mark.parametrize("most", [20_000, 1])
def test_part_of_a_passage_beside_the_whole_of_it(spark, monkeypatch, most):
    """A text holds a passage of another text, and a part of it again: the part is shared too, whichever text stands for the passage."""
    monkeypatch.setattr(repeats, "MOST_RUNS", most)
    rng = random.Random(21)

    def some(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    rows = []
    for i in range(12):
        p = some(90)
        rows += [(2 * i, f"{some(30)}{p}{some(30)}{p[38:55]}{some(30)}", "c"), (2 * i + 1, f"{some(40)}{p}{some(10)}", "c")]
    found = remove(spark.createDataFrame(rows, SCHEMA), 20, passage=14).collect()
    assert Counter((r.doc_id, r.n_shared, r.longest_shared) for r in found) == brute_shared(rows, 14)
