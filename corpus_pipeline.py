"""Documents to training sequences: quality, repeated lines, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import line_crf, line_dedup, ngram_join, packing, pii
from orbweave.llm.common import settled

#: No SQL says what a trained field or a tokenizer does.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    chain = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score_quality(docs, chain).where("predicted = 1").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines go; n_chars follows the text.

    A row without an id is a document of its own, after those with one; rows that share
    an id are one document where they share the text too."""
    key, text, no_id = "__line_key__", "__line_text__", F.col("doc_id").isNull()

    def keyed(rows: DataFrame, n) -> DataFrame:
        return rows.withColumn(key, F.struct(no_id.alias("last"), F.col("doc_id").alias("id"), n.alias("n")))

    # Written: a number of a row must not change from one reading to the next.
    numbered = settled(keyed(docs.where(no_id), F.monotonically_increasing_id()))
    rows = keyed(docs.where(~no_id), F.xxhash64("text")).unionByName(numbered)
    new = line_dedup.dedup_lines(rows, id_col=key).select(F.col("doc_id").alias("__line_of__"), F.col("text").alias(text)).dropDuplicates(["__line_of__"])
    joined = rows.drop("text", "n_chars").join(new, F.col(key).eqNullSafe(F.col("__line_of__")))
    return joined.withColumn("text", F.col(text)).withColumn("n_chars", F.length(text).cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates.

    Rows without an id stay, as do the texts of an id that has several: each is its own group."""
    known = docs.where("doc_id is not null")
    texts = known.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    several = settled(texts.where("lo <> hi").select("doc_id"))
    one = known.join(several, "doc_id", "left_anti").select(*docs.columns)
    first = ngram_join.jaccard_components(one).where("doc_id = component_id").select("doc_id")
    kept = one.dropDuplicates(["doc_id"]).join(first, "doc_id", "left_semi").select(*docs.columns)
    unclear = known.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return kept.unionByName(unclear).unionByName(docs.where("doc_id is null"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; n_chars follows the text."""
    return pii.pseudonymise(docs, key=pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece, with the piece's ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("near duplicates", one_of_each_group),
    ("personal data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
    return docs
