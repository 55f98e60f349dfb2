"""Exact top-k by integer inner product: Fagin's threshold algorithm.

In a block every dimension has a list of the vectors sorted by that component.  A query reads its lists
from the end where its own component makes the product largest, all to the same depth; each vector met
is scored in full.  No vector that was not met can score more than the sum of the products at that
depth, so the search ends when this bound is below the k-th best score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from siftlog.llm.tiles import best_of, search, usable

FIRST_DEPTH = 64  # rows read from each list at first; twice as deep each time
SCALE = 1024


def integers(x):
    """floor(1024 x), as 64-bit integers where they fit, else as Python's."""
    import numpy as np

    y = np.floor(SCALE * x)
    if abs(y).max(initial=0) < 2 ** 53:
        return y.astype(np.int64)
    return np.array([[int(v) for v in row] for row in y], object).reshape(y.shape)


def threshold_search(ids, rows, query_ids, queries, k: int):
    """For each query its k best rows of other ids: (query_id, vec_id, score)."""
    import numpy as np

    rows, queries = integers(rows), integers(queries)
    n, width = rows.shape
    size = max(1, int(abs(rows).max(initial=0)) * int(abs(queries).max(initial=0)) * max(1, width))
    if size >= 2 ** 62:
        rows, queries = rows.astype(object), queries.astype(object)
    exact = size < 2 ** 53  # doubles hold every sum
    scored = rows.astype(np.float64) if exact else rows
    order = np.argsort(rows, axis=0, kind="stable")
    found = []
    for own, q in zip(query_ids, queries, strict=True):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        met, depth = ids == own, 0
        got, scores = np.empty(0, np.int64), np.empty(0, scored.dtype)
        step = FIRST_DEPTH
        while depth < n:
            deeper = min(n, depth + step)
            if not len(up) and not len(down):
                deeper = n
                ahead = np.arange(n)
            else:
                ahead = np.concatenate([order[n - deeper:n - depth][:, up].ravel(), order[depth:deeper][:, down].ravel()])
            fresh = ahead[~met[ahead]]
            if len(fresh):
                met[fresh] = True
                fresh = np.unique(fresh)
                new = scored[fresh] @ (q.astype(np.float64) if exact else q)
                got, scores = np.concatenate([got, fresh]), np.concatenate([scores, new])
                keep = best_of(scores, ids[got], k) if scores.dtype != object else np.array(
                    sorted(range(len(got)), key=lambda i: (-scores[i], ids[got[i]]))[:k], np.int64)
                got, scores = got[keep], scores[keep]
            depth, step = deeper, 2 * step
            if len(got) == k and depth < n:
                edge = (q[up] * rows[order[n - depth, up], up]).sum() + (q[down] * rows[order[depth - 1, down], down]).sum()
                if edge < scores[-1]:
                    break
        found += [(own, ids[i], int(s)) for i, s in zip(got, scores, strict=True)]
    query, vec, score = zip(*found, strict=True) if found else ((), (), ())
    return query, vec, score


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest scores, ties to the smaller id.

    Components count as floor(1024 x).  ``is_query`` is over columns id and v.  Rows whose id or vector is null, or
    whose vector holds null or non-finite components, take no part; shorter vectors end in zeros; zero vectors score 0.
    A score beyond 64 bits is an error.
    """
    def make(*tile):
        return threshold_search(*tile, k)

    return search(usable(vectors, vec_id, embedding), is_query, k, "long", make)
