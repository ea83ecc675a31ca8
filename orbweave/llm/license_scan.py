"""License notices by diagonal voting.

Every rolling word k-gram of every text is joined by its hash to the positions where it
stands in the notice templates.  A hit votes for one diagonal (position in the text minus
position in the template).  Neighbouring diagonals of one template merge, so that a word
too many or too few does not break a notice, and a merged span counts when it covers
enough of its template.  Short phrases must stand whole on one diagonal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import documents_of
from orbweave.llm.license_texts import TEXTS

#: Fixed values: (label, phrase); each must stand word for word.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Fixed value: what stands between words, after A-Z is lower case.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lowered and no other letter."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN_WORDS), "")


def plain_words(text: str) -> str:
    """The same words of a template, with a space between them."""
    return " ".join(re.split(BETWEEN_WORDS, text.translate(str.maketrans(_UPPER, _LOWER)))).strip()


#: (label, words); enough of each must stand.
NOTICES = [(label, plain_words(text)) for label, text in TEXTS]


def folder_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(label, words) of every text file of a folder, one whole license each, labelled by the file's name.

    For ``notices``: a list of licenses, which is of a size of its own and not the corpus's."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("label"), F.array_join(words_of(F.col("value")), " ").alias("words"))
    return sorted((r["label"].lower(), r["words"]) for r in files.collect())


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """(template, label, exact, n_grams, t_pos, gram, h): the k-grams of all templates.

    Its size is that of the template lists, whatever the corpus."""
    rows = []
    for template, (label, phrase, exact) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        words = phrase.split()
        grams = [words[i : i + k] for i in range(len(words) - k + 1)]
        rows += [(template, label, exact, len(grams), i, g) for i, g in enumerate(grams)]
    table = spark.createDataFrame(rows, "template int, label string, exact boolean, n_grams int, t_pos int, gram array<string>")
    return table.withColumn("h", F.xxhash64(*[F.col("gram")[i] for i in range(k)]))


def scan_licenses(
    docs: DataFrame,
    phrases=PHRASES,
    notices=NOTICES,
    *,
    min_coverage: float = 0.8,
    max_shift: int = 2,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``(per document, spans)``.

    Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the best span's coverage).  Spans: doc_id, template, label, exact, start, end
    (words from 0, end exclusive), coverage.

    A null or empty text has no words, no labels and score 0.  Rows that repeat a doc_id
    must repeat its text; they count once and give one row.  A null doc_id is a key like
    any other.  Further columns are ignored.
    """
    spark = docs.sparkSession
    words = docs.transform(documents_of, id_col, text_col).select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
    )
    grams = words.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        # The last ones have fewer than k words and so match no template.
        F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, k)])).alias("grams"),
    )
    places = grams.select("doc_id", "words", "n_words", F.posexplode_outer("grams").alias("pos", "h"))
    table = template_grams(spark, phrases, notices, k)
    # The templates are a fixed list, so the join never shuffles the text.
    joined = places.join(F.broadcast(table), "h", "left")
    same = F.slice("words", F.col("pos") + 1, k) == F.col("gram")
    votes = (
        joined.where(F.coalesce(F.col("pos"), F.lit(0)).eqNullSafe(0) | F.col("template").isNotNull())
        .select("doc_id", "n_words", "pos", *[F.when(same, F.col(c)).alias(c) for c in ("template", "label", "exact", "n_grams", "t_pos")])
        .groupBy("doc_id", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(
            F.max("n_words").alias("n_words"),
            F.first("label").alias("label"),
            F.first("exact").alias("exact"),
            F.first("n_grams").alias("n_grams"),
            F.count_distinct("t_pos").alias("votes"),
            F.min("pos").alias("lo"),
            F.max("pos").alias("hi"),
        )
    )
    # Neighbouring diagonals: the next one starts at most max_shift away and overlaps or follows closely.
    order = Window.partitionBy("doc_id", "template").orderBy("diagonal", "lo")
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= max_shift) & ~F.col("exact") & (F.col("lo") <= F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)) + k + max_shift)
    chained = votes.withColumn("opens", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = chained.groupBy("doc_id", "template", "chain").agg(
        F.max("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("exact").alias("exact"),
        F.min("lo").cast("long").alias("start"),
        (F.max("hi") + k).cast("long").alias("end"),
        F.least(F.sum("votes") / F.first("n_grams"), F.lit(1.0)).alias("coverage"),
    )
    whole = F.col("template").isNotNull() & F.when(F.col("exact"), F.col("coverage") == 1.0).otherwise(F.col("coverage") >= min_coverage)
    base = whole & F.col("exact")
    joined_labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_doc = spans.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined_labels(F.when(base, F.col("label"))).alias("base_labels"),
        joined_labels(F.when(whole, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(whole, F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return per_doc, spans.where(whole).select("doc_id", "template", "label", "exact", "start", "end", "coverage")
