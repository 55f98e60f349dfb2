from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from siftlog.llm.personal import base_spans
from siftlog.session import written
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, []
    odd = spark.createDataFrame([(90_001, None, "en", None, None), (90_002, "", None, "src0", 0), (90_002, "", None, "src0", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, SF), "test")
        results.append(docs.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns, name
    good, distinct, masked, mixed, encoded = results
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)

    rows = [(r.doc_id, r.text) for r in good]
    groups = brute(rows, 5, 80)
    want = Counter(d for d, n, c in groups if n == 0 or d == c)
    assert Counter(r.doc_id for r in distinct) == want

    before = {r.doc_id: r.text for r in distinct}
    assert Counter(r.doc_id for r in masked) == want
    for r in masked:
        spans = base_spans(before[r.doc_id] or "")
        assert all(before[r.doc_id][a:b] not in r.text for _, a, b in spans)
        if not any(c in "0123456789@" for c in before[r.doc_id] or ""):
            assert r.text == before[r.doc_id]

    size, taken = {r.doc_id: len((r.text or "").split()) for r in masked}, Counter()
    for r in mixed:
        taken[r.doc_id] += len(r.text.split())
    assert all(n <= 3 * size[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - sum(size.values())) <= 25

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter((r.doc_id, tuple(r.ids)) for r in encoded)
    assert ids == Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in mixed)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_ids_that_repeat_or_are_null(spark):
    def prose(word):
        return " ".join(f"{word}{i}" for i in range(60))

    rows = [(1, prose("a")), (5, prose("a") + " end"), (5, prose("b")), (7, prose("c")), (7, prose("c") + " end"), (7, prose("c")),
            (8, prose("d")), (8, prose("d")), (None, prose("a") + " other"), (None, prose("e")), (None, prose("f")), (None, prose("f") + " end"),
            (9, None), (9, ""), (9, ""), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.distinct_documents(spark, docs, SF)
    assert found.columns == docs.columns
    assert Counter((r.doc_id, (r.text or "-")[:1]) for r in found.collect()) == Counter(
        [(1, "a"), (5, "b"), (7, "c"), (8, "d"), (None, "e"), (None, "f"), (9, "-"), (9, "-"), (None, "-")])
