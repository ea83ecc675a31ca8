"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import documents_of, settled


def dedup_lines(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every later occurrence of a run of ``width`` lines.

    Consecutive lines are hashed (128 bits) in overlapping windows; of the places of a
    window, the one with the smallest (doc_id, line) is kept.  The lines that any other place
    covers go, but for those of a kept place: a copy of every repeated window stays whole
    (``p p p p`` becomes ``p p p``).  Windows of white space alone do not count.

    Returns doc_id, n_lines, n_removed (long) and text (string).  A text of fewer lines
    than ``width`` stays as it is; a null text stays null with 0 lines; an empty one has
    one line.  A document whose every line goes keeps its row with an empty text.  Rows
    that repeat a doc_id must repeat its text; each is returned.  Further columns are
    ignored.
    """
    rows = docs.transform(documents_of, id_col, text_col)
    lines = rows.select("doc_id", "text", F.split("text", "\n").alias("lines"))
    n = F.size("lines")
    at = lambda i: [F.get("lines", i + j) for j in range(width)]
    windows = (
        lines.where(n >= width)
        .select(
            "doc_id",
            # Outer: the filter that an inner one implies would be pushed to the scan and split each text per line.
            F.posexplode_outer(
                F.transform(
                    F.sequence(F.lit(0), n - width),
                    lambda i: F.when(
                        F.concat(*at(i)).rlike(r"[^\x20\x09-\x0D]"),
                        F.struct(F.xxhash64(*at(i)).alias("a"), F.xxhash64(F.lit(1), *at(i)).alias("b")),
                    ),
                )
            ).alias("line", "h"),
        )
        .where("h is not null")
        .select("doc_id", "line", "h.a", "h.b")
    )
    # Places are counted and reduced before the shuffle, so a window in a third of all
    # documents is one row per task.  The repeated ones are written out: the join to them
    # then has an exchange on either side, and a frequent window is split over tasks.
    repeated = settled(
        windows.groupBy("a", "b")
        .agg(F.count("*").alias("places"), F.min(F.struct("doc_id", "line")).alias("first"))
        .where("places > 1")
        .select("a", "b", "first")
    )
    covered = (
        windows.join(repeated, ["a", "b"])
        .withColumn("again", ~F.struct("doc_id", "line").eqNullSafe(F.col("first")))
        .groupBy("doc_id")
        .agg(F.collect_set(F.when(F.col("again"), F.col("line"))).alias("starts"), F.collect_set(F.when(~F.col("again"), F.col("line"))).alias("firsts"))
        .where(F.size("starts") > 0)
    )
    gone = covered.select(F.col("doc_id").alias("gone_id"), "starts", "firsts")
    spread = lambda c: F.flatten(F.transform(c, lambda s: F.sequence(s, s + (width - 1))))
    merged = F.array_except(spread("starts"), spread("firsts"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    return (
        rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
        .select("doc_id", "text", F.when(F.col("starts").isNotNull(), merged).alias("covered"))
        .select("doc_id", "text", "covered", F.split("text", "\n").alias("lines"))
        .select(
            "doc_id",
            F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
            F.when(F.col("covered").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
            .alias("text"),
        )
        .withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
        .withColumn("n_removed", F.greatest("n_removed", F.lit(0)).cast("long"))
    )
