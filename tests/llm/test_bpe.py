import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftlog.llm import bpe
from siftlog.llm.bpe import WordTokenizer, decode, encode, merge_by_heap, merge_by_scan

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\t", "Hello, World! it's  we've x", "ΑΣ ΟΔΥΣΣΕΥΣ", "İstanbul ŞAŞ", "école ﬁ", "日本語のテキスト",
    "a<|endoftext|>b <|startoftext|>", "<|endof", "x" * 5000, "ab" * 700 + "!" * 300, "\x1c\x1d a\x85b c", "१२३ ½ Ⅷ", "👍🏽 ok",
    "<p>12.5%</p>'LL'd", "퟿�", "word " * 3000,
]


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return WordTokenizer(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_equal_the_library(own, library):
    rng = random.Random(5)
    letters = "aeinrstth   ,.'’-ÄäéßΣσ中\n0123<|>😀"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(400)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_scan_and_heap_agree(own):
    rng = random.Random(7)
    for _ in range(300):
        ids = [own.inner[rng.choice(b"aeinorst")] for _ in range(rng.randrange(1, 120))]
        assert merge_by_scan(list(ids), own.ranks, own.merged) == merge_by_heap(list(ids), own.ranks, own.merged)


def test_known_words_table_starts_anew(own, monkeypatch):
    monkeypatch.setattr("siftlog.llm.bpe.KNOWN_WORDS", 3)
    own.clear()
    assert own.encode("one two three four five one").tolist() == own.encode("one two three four five one").tolist()
    assert len(own) <= 3 and len(own.older) <= 3


def test_frames(spark, library):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, None, None), (None, "", "y"), (3, "z " * 40000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = decode(encode(df, PATH), PATH).collect()
    assert [r.doc_id for r in got] == [1, 1, 2, None, 3]
    for r, (_, text, _) in zip(got, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert encode(df.limit(0), PATH).collect() == []


def test_query(spark, library):
    from siftlog.llm.queries import op1_bpe

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_ids_leave_arrow_as_one_list():
    column = pa.array([[1, 2], None, [], [3, None, 4], [5]], pa.list_(pa.int32()))
    assert list(bpe.id_lists(column)) == [[1, 2], None, [], [3, -1, 4], [5]]
    assert list(bpe.id_lists(column.slice(1, 3))) == [None, [], [3, -1, 4]]
    many = pa.array([np.arange(500, dtype=np.int32)] * 2000)
    begun = time.process_time()
    flat = list(bpe.id_lists(many))
    between = time.process_time()
    assert flat == many.to_pylist()
    assert 2 * (between - begun) < time.process_time() - between


def test_decode_of_odd_ids(spark, own):
    rows = [(1, [5, None, 6]), (2, None), (3, []), (4, [7, 10 ** 6, -1])]
    got = {r.doc_id: r.decoded for r in decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {1: own.decode([5, 6]), 2: None, 3: "", 4: own.decode([7])}
