"""The corpus pipeline: quality, near duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return
the columns of ``documents``; each result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm import bpe, jaccard, mixing, personal, quality
from siftlog.llm.columns import table
from siftlog.llm.queries import QUALITY_LEAST, held_out, vocabulary
from siftlog.session import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; null and empty texts are scored like all others."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), use=~held_out())
    return quality.score(docs, model, out="_score").filter(F.col("_score") >= QUALITY_LEAST).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-gram similarity 0.8 join, the one of the smallest id.

    Documents without words have no such links and stay.  Rows of equal id and text count once.  Ids may repeat or be null
    (which counts as the largest): of one id's texts, each is judged by itself, and of linked ones a single one stays.
    """
    of_doc = jaccard.groups(docs, words=5, percent=80)
    rows = of_doc.groupBy("n", "group", "id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.filter("n > 0").groupBy("group").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "rows")).alias("first")).select("first.id", "first.text_hash", "first.rows")
    kept = written(spark, first.unionByName(rows.filter("n = 0").select("id", "text_hash", "rows")), "kept")
    same = docs["doc_id"].eqNullSafe(kept["id"]) & (F.xxhash64(docs["text"]) == kept["text_hash"])
    repeated = kept.filter("rows > 1")
    once = docs.join(kept.filter("rows = 1"), same, "left_semi")
    return once if repeated.isEmpty() else once.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; documents without any stay as they are."""
    return personal.masked(docs, personal.train(personal.labelled(docs)))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the last one of a shard's quota perhaps in part."""
    return mixing.mixed_rows(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode(docs, vocabulary(), keep=["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("personal data", masked_documents),
    ("mixing to target weights", mixed_documents),
    ("BPE encoding", encoded_documents),
]

# Compressed sizes, the tagger and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
