import glob
import gzip
import random
from collections import defaultdict

from siftlog.llm.warc import digest32, manifest, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, shard string"


def expected(rows):
    groups = defaultdict(list)
    for i, (page_id, _, html, _) in enumerate(rows):
        groups[html or ""].append((page_id, i))
    want = []
    for html, members in groups.items():
        known = [p for p, _ in members if p is not None]
        first = max(known) if known else None
        stored = False
        for p, _ in members:
            payload = html.encode()
            head = p == first and not stored
            stored |= head
            want.append((p, len(payload), digest32(payload), "response" if head else "revisit", None if head else first))
    return sorted(want, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = ["", None, "<p>é</p>", "x" * 300_000, *("page %d" % i for i in range(30))]
    rows = [(i * 7919, f"http://h/{i} ü", rng.choice(texts), "s") for i in range(400)]
    rows += [(7919, "http://h/1", rows[1][2], None), (None, None, "only null"), (None, None, "only null"), (None, "u\nx", "page 3")]
    rows = [(*r, None)[:4] for r in rows]
    folder = f"file://{tmp_path}/a"
    write_archives(spark.createDataFrame(rows, SCHEMA).repartition(5), folder, roll_bytes=2000, shard_bytes=40_000)
    back = read_archives(spark, folder)
    assert got(back) == expected(rows)
    stored = {(r.page_id, r.payload) for r in back.collect() if r.record_type == "response"}
    assert {t for _, t in stored} == {r[2] or "" for r in rows}
    names = [r.name for r in manifest(spark, folder).collect()]
    files = sorted(glob.glob(f"{tmp_path}/a/*.warc.gz"))
    assert len(names) == len(set(names)) == len(files) > 5
    # the same files again, from other partitions
    write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/b", roll_bytes=2000, shard_bytes=40_000)
    for f in files:
        with open(f, "rb") as x, open(f.replace("/a/", "/b/"), "rb") as y:
            assert x.read() == y.read()
    # any gzip reader can read them
    assert gzip.open(files[0]).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert read_archives(spark, folder).collect() == []


def test_query(spark):
    from siftlog.llm.queries import op8_warc

    rows = [tuple(r) + (None,) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        "page_id", "url", "html").collect()]
    assert got(op8_warc(spark, "/root/testdata/sf0.001")) == expected(rows)
