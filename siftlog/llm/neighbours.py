"""Approximate nearest neighbours by collision counting with query-centred windows.

Each of ``LISTS`` random projections sorts a block's vectors into an array.  A query opens a window around its
own projection in every array; a vector collides once for each window it lies in.  Virtual rehashing
widens all windows by a factor, so only the new edges are counted.  When enough vectors (``SHARE`` of
the block and ten times k) have collided in ``COLLISIONS`` of the arrays, these are verified: their exact
inner products are taken from the original vectors.

For the largest inner product, vectors are divided by the largest norm and get one more component that makes all
norms 1; queries are normalised and get 0 there.  Then a larger product is a smaller distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.tiles import best_of, search, usable

LISTS = 112
COLLISIONS = 66
SHARE = 0.2
GROWTH = 1.08  # of the windows
FIRST = 0.55  # share of all entries that the first windows of a chunk hold, on average; few queries need more than some widenings


def lifted(rows, largest: float):
    import numpy as np

    scaled = rows / largest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))])


def collision_search(ids, rows, query_ids, queries, k: int, largest: float, seed: int):
    """For each query the k best of its verified vectors: (query_id, vec_id, score)."""
    import numpy as np

    n, width = rows.shape
    directions = np.random.default_rng(seed).normal(size=(width + 1, LISTS))
    projected = lifted(rows, largest) @ directions
    order = np.argsort(projected, axis=0, kind="stable").T.copy()
    lists = np.take_along_axis(projected.T, order, 1)
    norms = np.sqrt((queries * queries).sum(1, keepdims=True))
    centres = (np.column_stack([queries / norms, np.zeros(len(queries))]) @ directions).T
    wanted = min(n, int(10 * k + SHARE * n))

    def edges(open_, half):
        low, high = np.empty((LISTS, len(open_)), np.int64), np.empty((LISTS, len(open_)), np.int64)
        for i in range(LISTS):
            low[i] = np.searchsorted(lists[i], centres[i, open_] - half, "left")
            high[i] = np.searchsorted(lists[i], centres[i, open_] + half, "right")
        return low, high

    half, sample = 0.01, np.arange(min(16, len(queries)))
    while True:  # the first radius, from a few queries
        low, high = edges(sample, half)
        if (high - low).mean() >= FIRST * n:
            break
        half *= GROWTH
    open_ = np.arange(len(queries))
    # the first windows hold most entries: whether a vector's place lies in one is compared, not gathered
    place = np.empty((LISTS, n), np.uint16 if n < 1 << 16 else np.uint32)
    for i in range(LISTS):
        place[i, order[i]] = np.arange(n)
    left, right = edges(open_, half)
    counts = np.zeros((len(queries), n), np.uint8)
    since, inside = np.empty(n, place.dtype), np.empty(n, bool)
    for count, starts, sizes in zip(counts, left.T.astype(place.dtype), (right - left).T.astype(place.dtype), strict=True):
        for places, start, size in zip(place, starts, sizes, strict=True):
            np.subtract(places, start, out=since)  # places before the window wrap around
            np.less(since, size, out=inside)
            np.add(count, inside.view(np.uint8), out=count)
    found = []
    while len(open_):
        low, high = edges(open_, half)
        still = np.ones(len(open_), bool)
        for j, q in enumerate(open_):
            new = np.concatenate([
                *(order[i, a:b] for i, (a, b) in enumerate(zip(low[:, j], left[:, j], strict=True)) if a < b),
                *(order[i, a:b] for i, (a, b) in enumerate(zip(right[:, j], high[:, j], strict=True)) if a < b), order[0, :0]])
            counts[q] += np.bincount(new, minlength=n).astype(np.uint8)
            hit = np.flatnonzero(counts[q] >= COLLISIONS)
            if len(hit) < wanted:
                continue
            still[j] = False
            hit = hit[ids[hit] != query_ids[q]]
            rough = rows[hit] @ queries[q]  # differs from the exact score by rounding only
            if len(hit) > 4 * k:
                slack = 1e-12 * width * largest * norms[q, 0]
                hit = hit[rough >= np.partition(rough, len(hit) - k)[len(hit) - k] - slack]
            near = rows[hit].T
            score = np.zeros(len(hit))
            for d in range(width):  # in the order of the components: equal vectors score equally
                score += near[d] * queries[q, d]
            best = best_of(score, ids[hit], k)
            found.append((np.full(len(best), query_ids[q]), ids[hit[best]], score[best]))
        open_, left, right = open_[still], low[:, still], high[:, still]
        half *= GROWTH
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else ([], [], [])


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found, by inner product, ties to the smaller id.

    ``is_query`` is over columns id and v.  Rows whose id or vector is null, whose vector is zero or empty, or holds
    null or non-finite components, take no part; shorter vectors end in zeros.  A query never finds its own id.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    used = usable(vectors, vec_id, embedding).filter(F.exists("v", lambda x: x != 0))
    largest = used.agg(F.max(norm)).first()[0] or 1.0

    def make(*tile):
        return collision_search(*tile, k, largest, seed)

    return search(used, is_query, k, "double", make)
