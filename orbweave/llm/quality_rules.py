"""Quality rules with verdicts on hosts.

Rule failures are counted per host, each host's failure rate is shrunk towards the rate of
all hosts with a beta prior fitted to the hosts themselves (method of moments), and the
host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import settled, space_words


def rule_measures(docs: DataFrame, *, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    One row per row of ``docs``; a null text has no words and no lines."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    staged = base.select("doc_id", "host", text.alias("text"), space_words(F.col("text")).alias("words")).select(
        "doc_id",
        "host",
        "text",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        # The last two have fewer words and so equal no other.
        F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
        .alias("grams"),
    )
    # A document without repeated windows (told by the cheap distinct count) is not sorted.
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    ordered = staged.select(
        "*",
        F.when(repeats, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"),
    )
    hash_at = lambda j: F.get("ordered", j)["h"]
    twice = F.sort_array(
        F.filter(
            F.transform(
                "ordered",
                lambda x, j: F.when((x["h"] == hash_at(j - 1)) | (x["h"] == hash_at(j + 1)), x["i"]),
            ),
            lambda i: i.isNotNull(),
        )
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        twice,
        start,
        lambda s, i: F.struct(i.alias("last"), (s["total"] + F.least(i - s["last"], F.lit(3))).alias("total")),
        lambda s: s["total"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return ordered.select(
        "doc_id",
        "host",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.when(F.col("text").rlike(r"[#*$%&|<>]"), F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).otherwise(0).cast("long").alias("n_symbols"),
        let_lines(lines).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def let_lines(lines):
    """How many of the lines equal an earlier one."""
    return F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1)


def base_failed():
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed():
    """More than a tenth of the characters of words are symbols, or a third of the words are in repeated windows, or no words."""
    return (10 * F.col("n_symbols") > F.col("word_chars")) | (3 * F.col("n_repeat_words") > F.col("n_words")) | (F.col("n_words") == 0)


def host_verdicts(measures: DataFrame, *, spread: float = 1.0) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk) and rejected, one row per host.

    The prior beta(a, b) has the mean and variance of the hosts' own rates, weighted by
    documents; where they do not differ, it weighs as much as the mean host.  A host is
    rejected whose shrunk rate lies more than ``spread`` standard deviations of the prior
    above its mean: few documents pull a rate little, so a small host needs more failures."""
    failed = (base_failed() | soft_failed()).cast("long")
    hosts = measures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        (F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs")).alias("square"),
        F.avg("n_docs").alias("docs"),
    ).select(
        "mean",
        F.when(
            F.col("square") - F.col("mean") ** 2 > 1e-9,
            F.greatest(F.col("mean") * (1 - F.col("mean")) / (F.col("square") - F.col("mean") ** 2) - 1, F.lit(1.0)),
        )
        .otherwise(F.col("docs"))
        .alias("weight"),
    )
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    # The prior is one row by construction.
    most = F.col("mean") + spread * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk > most + 1e-12).alias("rejected"))


def apply_quality_rules(docs: DataFrame, *, spread: float = 1.0, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of each row with base_failed, host_rate, host_rejected and kept.

    Dropped are documents that fail the base rules, and those of a rejected host that fail
    the softer rules; a clean document of a bad host stays.  A null host is a host of its
    own.  Repeated rows are measured and counted each.  Null and empty texts fail.
    """
    measures = settled(rule_measures(docs, host_col=host_col, id_col=id_col, text_col=text_col))
    verdicts = settled(host_verdicts(measures, spread=spread)).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected"))
    joined = measures.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~(F.col("host_rejected") & soft_failed())).alias("kept"),
        "host",
        "host_rejected",
        F.round("host_rate", 9).alias("host_rate"),
    )
