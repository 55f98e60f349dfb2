"""One query for each operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm import bpe, jaccard, licenses, merkle, mixing, neighbours, personal, quality, repeats, spelling, topk, toxicity, warc
from siftlog.llm.columns import table, word_count
from siftlog.llm.sql import ORACLE as ORACLE
from siftlog.session import new_folder, written


QUALITY_LEAST = 0.3
TOXIC_LEAST = 0.3


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text decoded from them, as digests."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"])
    made = ids.select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
    )
    return bpe.decode(made, vocabulary(), keep=["doc_id", "n_tokens", "ids_sha256", ]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-grams are at least 85 % alike."""
    return jaccard.components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence each document is, and those its lines name."""
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labelled rows outside the held-out fifth."""
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"), use=~held_out())
    return quality.score(documents, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    documents = table(spark, sf_dir, "documents")
    tagger = personal.train(personal.labelled(documents))
    found = personal.find(documents, tagger, keep=["doc_id"])

    def shown(name):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, personal.KINDS), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    documents = table(spark, sf_dir, "documents")
    sizes = written(spark, documents.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    return mixing.mix(sizes, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files into the shared folder and read back from them."""
    folder = new_folder(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 400 bytes that also start elsewhere, and what shorter passages they share."""
    return repeats.remove(table(spark, sf_dir, "documents"), 400, with_kept=False)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer scores for every hundredth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all documents, their proofs, and what these say after some lengths were changed."""
    documents = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(documents["doc_id"].cast("string")) % 7 == 0, F.lit(False))
    return merkle.manifest(documents, ["doc_id", "source", "lang", "n_chars", "text"], tampered={
        "n_chars": F.when(hit, documents["n_chars"] + 1).otherwise(documents["n_chars"])})


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some misspelt on purpose, with the usual form of each."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows outside the held-out quarter."""
    documents = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), use=~held)
    return toxicity.score(documents, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_LEAST).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_jaccard, op3_licenses, op4_neighbours, op5_quality, op6_personal, op7_mixing, op8_warc, op9_repeats, op10_topk, op11_merkle, op12_spelling, op13_toxicity)}
