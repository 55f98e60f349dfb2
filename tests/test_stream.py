from siftlog import search_entries


def test_row_local_search_on_a_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ok\nan error\nfatal error\n")
    lines = spark.readStream.text(str(tmp_path))
    entries = lines.selectExpr("'s' as file_path", "1L as start_line", "1L as end_line", "value as content")
    hits = search_entries(entries, must=["error"], none=["fatal"])
    query = hits.writeStream.format("memory").queryName("stream_hits").start()
    try:
        query.processAllAvailable()
        rows = spark.sql("select content, match_positions[0].offset as at from stream_hits").collect()
    finally:
        query.stop()
    assert [tuple(r) for r in rows] == [("an error", 3)]
