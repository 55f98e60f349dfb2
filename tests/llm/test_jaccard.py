import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from siftlog.llm import jaccard
from siftlog.llm.components import connected_components
from siftlog.llm.jaccard import components, shingles

SCHEMA = "doc_id long, text string, N_shingles string"


def sets_of(rows, words):
    out = []
    for _, text, *_ in rows:
        parts = (text or "").encode().lower().split()
        size = min(words, len(parts))
        out.append({tuple(parts[i:i + size]) for i in range(len(parts) - size + 1)} if parts else set())
    return out


def brute(rows, words, percent):
    sets = sets_of(rows, words)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, *_) in enumerate(rows))


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            parts = rng.choice(texts[-40:]).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                k = rng.randrange(len(parts) + 1)
                parts[k:k + rng.randrange(0, 2)] = [rng.choice(words)] * rng.randrange(0, 3)
            texts.append(" ".join(parts) or "x")
        else:
            line = "all of these words stand in very many of the documents here"
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4, 9, 60, 150]))) + rng.choice(["", " " + line]))
    return [(i * 3 + 1, t, "c") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("words", "percent", "common"), [(4, 85, 0.002), (5, 80, 0.2), (1, 60, 0.05)])
def test_equals_brute_force(spark, monkeypatch, words, percent, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "LEADERS", 3)
    rows = corpus(words, 260)
    rows += [(9000, None, "c"), (9001, "", "c"), (9002, " \n", "c"), (None, rows[5][1], "c"), (None, "only null here", "c"), (None, "only null here", None),
             (rows[9][0], rows[30][1], "c"), (rows[9][0], rows[9][1], "c"), (9003, "ÀB x y", "c"), (9004, "Àb X y", "c"), (9005, "àb x y", "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(components(df, words=words, percent=percent)) == brute(rows, words, percent)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"b{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(400):
        parts = list(base)
        parts[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(parts), "c"))
    rows += [(1000 + i, " ".join(base), "c") for i in range(100)]
    assert {r.component_id for r in components(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


def test_pairs_of_edited_copies_grow_with_the_group(spark, monkeypatch):
    """Copies with none to seven edits: many lie too far from one another, and few such pairs are fetched."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(240):
        parts = list(base)
        for _ in range(rng.randrange(8)):
            parts[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(parts), "c"))
    made, verified = [], jaccard._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    assert got(components(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 4, 85)
    assert sum(made) <= 5 * len(rows)


def test_entries_are_laid_out_in_parts():
    rng = np.random.default_rng(3)
    tokens = [rng.integers(-(1 << 62), 1 << 62, 500) for _ in range(4_000)] + [np.empty(0, np.int64)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([len(t) for t in tokens], pa.int64()), pa.array(range(len(tokens)), pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
        names=["n", "set_id", "tokens"])
    make = jaccard._entries(85, "all", SimpleNamespace(value=np.sort(tokens[0][:50])))
    tracemalloc.start()
    made = sum(b.num_rows for b in make([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 4_000 * 500 - 50  # plain tokens fill all prefixes, so no common one is sent
    assert peak < 60 << 20


def test_long_and_nothing(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "c"), (2, "word word word word", "c")], SCHEMA)
    assert got(components(df)) == Counter([(1, 1, 1), (2, 1, 1)])
    assert components(df.limit(0)).collect() == []
    assert len(shingles("a b c", 4)) == 1


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
