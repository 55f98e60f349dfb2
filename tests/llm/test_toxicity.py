import random
import zlib

import pytest

from siftlog.llm.toxicity import fit, fit_texts, score, scorer, swapped, words_of

PLAIN = "the river runs under a stone bridge and quiet rain falls on green hills while we walk home with bread".split()
INSULTS = ["idiot", "scum", "moron"]


def sentence(rng, *extra):
    words = [rng.choice(PLAIN) for _ in range(rng.randrange(8, 25))]
    for e in extra:
        words.insert(rng.randrange(len(words)), e)
    return " ".join(words).capitalize() + "."


def biased(rng, n=600):
    """Half of the toxic rows name muslims or gay people, clean rows nearly never do: a spurious hint."""
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        named = rng.random() < (0.5 if toxic else 0.01)
        # some toxic rows have no known insult, so that only the name is left to learn from
        extra = ([rng.choice(INSULTS)] if toxic and rng.random() < 0.7 else []) + ([rng.choice(["muslims", "gay"])] if named else [])
        rows.append((sentence(rng) + " " + sentence(rng, *extra), int(toxic)))
    return rows


def test_swaps_stay_in_their_sentence_and_group():
    groups = (("people", "women", "men"),)
    got = swapped("Women spoke. Nobody else!\nMen and women sang", groups)
    assert got == [({"women"}, {"men"}), ({"women"}, {"people"}), ({"men"}, {"people"}), ({"women"}, {"people"})]
    assert swapped("", groups) == [] and swapped("no such term", groups) == []


def test_swaps_cost_no_score_and_neutral_mentions_are_left_alone():
    rng = random.Random(1)
    rows = biased(rng)
    neutral = [sentence(rng, rng.choice(["muslims", "gay"])) for _ in range(200)]
    toxic = [sentence(rng, rng.choice(INSULTS), rng.choice(["muslims", "bread"])) for _ in range(200)]
    wrong, change = {}, {}
    for fair in (0.0, 5.0):
        chance = scorer(fit_texts(rows, fair=fair))
        wrong[fair] = sum(chance(t) >= 0.5 for t in neutral)
        change[fair] = sum(abs(chance(t) - chance(t.replace("muslims", "christians").replace("gay", "straight"))) for t in neutral)
        assert sum(chance(t) >= 0.5 for t in toxic) > 190
    assert wrong[0.0] > 50 and wrong[5.0] < wrong[0.0] / 5, wrong
    assert change[5.0] < change[0.0] / 3, change


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, *([rng.choice(INSULTS)] * (i % 4 == 0))), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t, _ in rows] + [(0, rows[0][1], "x"), (None, None, None), (9000, "", "x"), (9001, "bread home " * 200_000, "x"),
                                             (9002, "bread home " * 200_000 + " moron", "x")],
        "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None), (5, 7), (777777, 1), (1, 0)], "doc_id long, toxic int")
    model = fit(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert sum((by_id[i] >= 0.3) == q for i, _, q in rows) == 400
    assert by_id[9001] < 0.3 <= by_id[9002] and by_id[9000] < 0.3
    assert score(docs.limit(0), model).collect() == []
    chance = scorer(model)
    weight = dict(zip(model.buckets, model.weights, strict=True))
    assert all(chance(t) == pytest.approx(by_id[i]) for i, t, _ in rows[:50]) and weight and words_of("A b, a!") == {"a", "b"}


def test_no_labels_or_one(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score(docs, fit(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.5 for r in score(docs, fit(docs, one)).collect())


def test_held_out_accuracy(spark):
    from siftlog.llm.queries import op13_toxicity

    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op13_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    toxic = [p for p, t in held if t == 1]
    assert sum(toxic) / len(toxic) > 0.93
    assert sum(p for p, t in held if t == 0) / len(held) < 0.005
