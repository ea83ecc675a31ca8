"""Weighted edges between nodes, from rows, matrices and attention heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.bits import float_bits, float_of_bits
from orbweave.functions.geometry import AXES

FLOAT, INTEGER = "float", "integer"


def weight_edges(links: DataFrame, points: DataFrame, *, kind: str = FLOAT) -> DataFrame:
    """(source_id, target_id, kind, bits, length, x, y, z, m) of ``links`` (source_id, target_id, weight).

    An edge is a line between its ends: ``length`` is planar, x to m are its middle.  A float
    weight is kept as its 32 bits, an integer as itself.  Links to unknown points are left out."""
    if kind not in (FLOAT, INTEGER):
        raise ValueError(f"weights are {FLOAT} or {INTEGER}, not {kind}")
    ends = lambda p: points.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in AXES])
    bits = float_bits(F.col("weight").cast("float")).cast("long") if kind == FLOAT else F.col("weight").cast("long")
    both = links.join(ends("source"), "source_id").join(ends("target"), "target_id")
    apart = lambda c: (F.col(f"source_{c}") - F.col(f"target_{c}")) * (F.col(f"source_{c}") - F.col(f"target_{c}"))
    return both.select("source_id", "target_id", F.lit(kind).alias("kind"), bits.alias("bits"), F.sqrt(apart("x") + apart("y")).alias("length"), *[((F.col(f"source_{c}") + F.col(f"target_{c}")) / 2).alias(c) for c in AXES])


def weight_values(edges: DataFrame) -> DataFrame:
    """``edges`` with ``weight``, read back from their bits."""
    value = F.when(F.col("kind") == FLOAT, float_of_bits(F.col("bits").cast("int")).cast("double")).when(F.col("kind") == INTEGER, F.col("bits").cast("double"))
    return edges.withColumn("weight", value)


def matrix_edges(rows: DataFrame, ids: DataFrame, *, threshold: float = 0.01, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, target_id, weight, ...) of a matrix's cells of at least ``threshold``.

    ``rows`` are (row, weights, ...) with an array of weights each; ``ids`` (place, id) name
    rows and columns, and cells without a name are left out.  ``keep`` are further columns of
    ``rows``, such as layer, head and model."""
    cells = rows.select("row", *keep, F.posexplode("weights").alias("col", "weight")).where(F.abs(F.col("weight").cast("double")) >= threshold)
    named = lambda c, name: ids.select(F.col("place").alias(c), F.col("id").alias(name))
    return cells.join(named("row", "source_id"), "row").join(named("col", "target_id"), "col").select("source_id", "target_id", F.col("weight").cast("double").alias("weight"), *keep)


def strengths(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, strength): the sum of the weights between two nodes."""
    return edges.groupBy("source_id", "target_id").agg(F.sum("weight").alias("strength"))


def propagated(edges: DataFrame, active: DataFrame, steps: int = 1) -> DataFrame:
    """(node, value) after ``steps`` steps from ``active`` (node, value) along (parent, child, weight).

    In each step a node's value is the sum of its parents' values times the weights."""
    from orbweave.functions.store import settled

    for _ in range(steps):
        active = settled(active.join(edges, active["node"] == edges["parent"]).groupBy(F.col("child").alias("node")).agg(F.sum(F.col("value") * F.col("weight")).alias("value")))
    return active
