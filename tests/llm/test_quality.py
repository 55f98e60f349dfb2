import random
import zlib

from siftlog.llm.quality import fit, fit_texts, score


def made(rng, good):
    words = ["the", "rain", "of", "and", "river", "stone", "walks", "under", "quiet"] if good else ["$$$", "buy", "now", "|", "###", "win"]
    return " ".join(rng.choice(words) for _ in range(rng.randrange(5, 80)))


def test_odd_rows_and_separation(spark):
    rng = random.Random(4)
    rows = [(i, made(rng, i % 3 > 0), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t, _ in rows] + [(0, rows[0][1], "x"), (None, None, None), (9000, "", "x"), (9001, "long " * 200_000, "x")],
        "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None), (4, 7), (777777, 1)], "doc_id long, quality int")
    got = score(docs, fit(docs, labels)).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert sum((by_id[i] >= 0.5) == q for i, _, q in rows) > 590
    assert score(docs.limit(0), fit(docs, labels)).collect() == []


def test_no_labels_or_one(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score(docs, fit(docs, none)).collect()] == [0.5, 0.5]
    assert fit_texts([], []).weights[0] == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in score(docs, fit(docs, one)).collect())


def test_held_out_accuracy(spark):
    from siftlog.llm.queries import op5_quality

    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op5_quality(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum((s >= 0.3) == q for s, q in held) / len(held) > 0.97
    kept = [s >= 0.3 for s, q in held if q]
    assert sum(kept) / len(kept) > 0.99
