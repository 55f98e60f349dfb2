import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlog.llm import tiles
from siftlog.llm.neighbours import FIRST, LISTS, collision_search, nearest
from siftlog.llm.topk import threshold_search, top_k

SCHEMA = "vec_id long, embedding array<double>, RANK string"
ODD = [(None, [1.0, 2.0, 3.0]), (9001, None), (9002, [1.0, None, 2.0]), (9003, [1.0, math.nan, 2.0]), (9004, [math.inf, 0.0, 0.0]),
       (9005, [0.0, 0.0, 0.0]), (9006, []), (9007, [2.0])]


def rows(seed, n, width=3):
    rng = random.Random(seed)
    made = [(i, [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]
    made += [(7 * n + i, made[20][1]) for i in range(30)] + [made[40], made[41]]  # ties, repeated rows
    return [(*r, "x") for r in made + (ODD if width == 3 else [])]


def usable(data, zero):
    out = []
    for i, v, _ in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, np.array(list(v) + [0.0] * (3 - len(v)))))
    return out


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 120)
    monkeypatch.setattr(tiles, "CHUNK", 7)


def test_top_k_equals_brute_force(spark, small_tiles):
    data = rows(3, 500)
    got = defaultdict(list)
    for r in top_k(spark.createDataFrame(data, SCHEMA), F.col("id") % 20 == 0, 10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v in usable(data, True)]
    for q, v in known:
        if q % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in known if i != q)[:10]
            assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_threshold_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)) * np.array([100, 1, 1, 1])
    ids = np.arange(3000)
    got = threshold_search(ids, x, ids[:20], x[:20], 5)
    ints = np.floor(1024 * x).astype(np.int64)
    s = ints[:20] @ ints.T
    want = [(q, i) for q in range(20) for i in sorted((i for i in range(3000) if i != q), key=lambda i: (-s[q, i], i))[:5]]
    assert list(zip(got[0], got[1], strict=True)) == want
    big = threshold_search(ids[:5], np.full((5, 2), 1e6) * np.arange(1, 6)[:, None], ids[:1], np.array([[1e6, -1e6]]), 9)
    assert list(big[2]) == [0, 0, 0, 0]


def test_nearest_small_is_exact(spark, small_tiles):
    data = rows(5, 100)
    found = nearest(spark.createDataFrame(data, SCHEMA), F.col("id") % 20 == 0, 20).collect()
    known = usable(data, False)
    for q, v in known:
        if q % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in known if i != q)[:20]
            got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
            assert [g[:2] for g in got] == [(n, i) for n, (_, i) in enumerate(want, 1)]
            assert all(abs(g[2] + s) < 1e-12 for g, (s, _) in zip(got, want, strict=True))


def test_recall(spark):
    from siftlog.llm.queries import op4_neighbours

    sf_dir = "/root/testdata/sf0.1"
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding]
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table])
    got = defaultdict(set)
    for r in op4_neighbours(spark, sf_dir).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        hits.append(len(got[int(ids[q])] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist())))
    assert len(hits) == 100 and sum(hits) / 2000 >= 0.95


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, F.col("id") % 2 == 0).collect() == [] and nearest(empty, F.col("id") % 2 == 0).collect() == []


def test_first_windows_are_compared_not_gathered(monkeypatch):
    """Entries gathered into counts are those of the widenings: far fewer than the first windows hold."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 8))
    gathered, bincount = [], np.bincount

    def counted(x, *args, **kw):
        gathered.append(len(x))
        return bincount(x, *args, **kw)

    monkeypatch.setattr(np, "bincount", counted)
    ids = np.arange(600)
    largest = np.sqrt((vectors * vectors).sum(1)).max()
    query_id, vec_id, _ = collision_search(ids, vectors, ids[:30], vectors[:30], 20, largest, 0)
    assert sum(gathered) < 0.3 * FIRST * LISTS * 600 * 30
    scores = vectors[:30] @ vectors.T
    scores[ids[:30], ids[:30]] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert sum(len(set(vec_id[query_id == q]) & set(best[q])) for q in range(30)) >= 0.9 * 20 * 30
