import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siftlog.llm.mixing import apportion, mix, mixed_rows


def shares(sizes, weights=(1, 2, 3), most=3):
    """Target of each source by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(most * sizes[s] for s in names if s not in open_)
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if level[s] > most * sizes[s]}
        if not full:
            return level | {s: most * sizes[s] for s in names if s not in open_}
        open_ -= full


def test_highest_quotients(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        votes = [rng.choice([0, 1, 5, 40, 900]) for _ in range(rng.randrange(1, 15))]
        rows += [(g, i, v, sum(votes), rng.randrange(0, 60)) for i, v in enumerate(votes)]
    seats = {g: s for g, _, _, _, s in rows}
    rows = [(g, i, v, t, seats[g]) for g, i, v, t, _ in rows]
    got = {(r.g, r.i): r.q for r in apportion(
        spark.createDataFrame(rows, "g long, i long, v long, t long, s long"), ["g"], "i", "v", "t", "s", "q").collect()}
    for g, s in seats.items():
        votes = {i: v for h, i, v, _, _ in rows if h == g}
        if not sum(votes.values()):
            assert all(got[g, i] == 0 for i in votes)
            continue
        held = dict.fromkeys(votes, 0)
        for _ in range(s):
            held[min(votes, key=lambda i: (-votes[i] / (2 * held[i] + 1), i))] += 1
        assert sum(got[g, i] for i in votes) == s
        # equal votes may trade seats; the seats of each number of votes are the same
        assert Counter((votes[i], got[g, i]) for i in votes) == Counter((votes[i], held[i]) for i in votes)


def test_targets_and_taken(spark):
    rng = random.Random(1)
    rows = [(i, " w" * rng.choice([0, 1, 3, 50, 400]), rng.choice(["a", "b", "b", "b", "ä", "z", None])) for i in range(700)]
    rows += [(5000, None, "b"), (None, "x y", "only"), (7, "same same", "b"), (7, "same same", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Taken", F.lit("clash"))
    got = mix(df, shard_documents=60).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = shares(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1, (s, t, want[s])
    key = lambda r: (r.doc_id is None, r.doc_id, r.taken)
    again = mix(df.repartition(7), shard_documents=60).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixed_rows(df.drop("Taken"), shard_documents=60).collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += len(r.text.split())
    totals = Counter()
    for r in got:
        totals[r.doc_id] += r.taken
    assert +words == +totals


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).collect() == [] and mixed_rows(empty).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mix(blank).collect()] == [(0, 0, 0.0, 0)] * 2
