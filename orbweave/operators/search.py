"""Nearest neighbours, radius, box and range searches over (id, ..., x, y, z, m)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.curve import curve_key, unsigned
from orbweave.functions.geometry import AXES, closeness, distance, planar_distance, project_code
from orbweave.functions.store import settled


def checked(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"a limit must be from 1 to {most}, not {n}")
    return n


def _xyzm() -> list[Column]:
    return [F.col(c) for c in AXES]


def nearest_planar(points: DataFrame, at, k: int = 10) -> DataFrame:
    """The k nearest by the first two ordinates; ties by id."""
    checked(k, 1000)
    return points.withColumn("distance", planar_distance(_xyzm(), at)).orderBy("distance", "id").limit(k)


def nearest_seed(points: DataFrame, code: int, k: int = 10) -> DataFrame:
    """The k planar neighbours of where a code point is projected, itself among them if it is stored."""
    checked(k, 1000)
    if not 0 <= code <= 0x10FFFF:
        raise ValueError(f"{code} is no code point")
    return nearest_planar(points, project_code(F.lit(code).cast("long")), k)


def nearest(points: DataFrame, at, k: int = 10, *, type_id=None) -> DataFrame:
    """2k candidates by planar distance, of which the k nearest in all four ordinates."""
    checked(k, 10_000)
    found = points if type_id is None else points.where(F.col("type_id") == type_id)
    found = found.withColumn("d2", planar_distance(_xyzm(), at)).orderBy("d2", "id").limit(2 * k)
    return found.withColumn("distance", distance(_xyzm(), at)).orderBy("distance", "id").limit(k).drop("d2")


def within(points: DataFrame, at, radius: float, *, limit: int = 1000, type_id=None) -> DataFrame:
    """Everything within a radius in all four ordinates, nearest first."""
    checked(limit, 100_000)
    if radius <= 0:
        raise ValueError("a radius must be positive")
    found = points if type_id is None else points.where(F.col("type_id") == type_id)
    # The planar bound is a plain comparison: where x and y are columns of a file it reaches the scan.
    box = (F.col("x").between(at[0] - radius, at[0] + radius)) & (F.col("y").between(at[1] - radius, at[1] + radius))
    return found.where(box).withColumn("distance", distance(_xyzm(), at)).where(F.col("distance") <= radius).orderBy("distance", "id").limit(limit)


def within_planar(points: DataFrame, at, radius: float, *, min_z: float | None = None, max_z: float | None = None) -> DataFrame:
    """A planar radius with an open or closed range of z."""
    found = points.withColumn("distance", planar_distance(_xyzm(), at)).where(F.col("distance") <= radius)
    found = found if min_z is None else found.where(F.col("z") >= min_z)
    return found if max_z is None else found.where(F.col("z") <= max_z)


def in_box(points: DataFrame, low, high, *, dims: str = "xy") -> DataFrame:
    """Points in a closed box of the named ordinates."""
    for k, c in enumerate(AXES):
        if c in dims:
            points = points.where(F.col(c).between(low[k], high[k]))
    return points


def by_type(points: DataFrame, type_id, limit: int = 100) -> DataFrame:
    checked(limit, 10_000)
    return points.where(F.col("type_id") == type_id).orderBy("id").limit(limit)


def in_curve_range(rows: DataFrame, start: tuple[int, int], end: tuple[int, int], *, limit: int | None = None) -> DataFrame:
    """Rows whose 128-bit key (hk, lk: unsigned order keys) lies in [start, end], in order."""
    key = F.struct("hk", "lk")
    bound = lambda p: F.struct(F.lit(p[0]).cast("long").alias("hk"), F.lit(p[1]).cast("long").alias("lk"))
    # The first word alone prunes files of a table written by save_keyed; the pair decides.
    found = rows.where(F.col("hk").between(start[0], end[0])).where((key >= bound(start)) & (key <= bound(end)))
    return found if limit is None else found.orderBy("hk", "lk", "id").limit(checked(limit, 10_000))


def after(rows: DataFrame, cursor: tuple[int, int, int] | None, end: tuple[int, int], size: int = 1000) -> DataFrame:
    """The next ``size`` rows (id, hk, lk) on the curve strictly after ``cursor`` (hk, lk, id), up to ``end``.

    The id is part of the cursor, so rows of equal keys are not lost between pages."""
    key = F.struct("hk", "lk", "id")
    found = rows.where(F.col("hk") <= end[0]).where(F.struct("hk", "lk") <= F.struct(F.lit(end[0]).cast("long").alias("hk"), F.lit(end[1]).cast("long").alias("lk")))
    if cursor is not None:
        found = found.where(F.col("hk") >= cursor[0]).where(key > F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for v, c in zip(cursor, ("hk", "lk", "id"))]))
    return found.orderBy("hk", "lk", "id").limit(checked(size, 10_000))


def pages(rows: DataFrame, start: tuple[int, int], end: tuple[int, int], size: int = 1000) -> Iterator[list]:
    """All rows between two places of the curve, both included, a page at a time."""
    key = F.struct("hk", "lk")
    held = rows.where(key >= F.struct(F.lit(start[0]).cast("long").alias("hk"), F.lit(start[1]).cast("long").alias("lk")))
    cursor = None
    while page := after(held, cursor, end, size).collect():
        yield page
        last = page[-1]
        cursor = (last["hk"], last["lk"], last["id"])


def adjacent(keyed: DataFrame) -> DataFrame:
    """(id, next_id, distance): each point and the one after it on the curve, in all four ordinates.

    Points are ranged over tasks by their key; the first of each range follows the last of the
    one before, so no task sees more than its range and one row a range."""
    ranged = settled(keyed.select("id", "hk", "lk", *AXES).repartitionByRange("hk", "lk", "id").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("hk", "lk", "id")
    point = F.struct("id", *AXES)
    inner = ranged.withColumn("n", F.lead(point).over(order))
    whole = F.struct("hk", "lk", "id", *AXES)
    ends = ranged.groupBy("part").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    seams = ends.select("last", F.lead("first").over(Window.orderBy("part")).alias("n")).where("n is not null")  # a row a range
    cols = lambda p: [F.col(f"{p}.{c}") for c in AXES]
    within_ranges = inner.where("n is not null").select("id", F.col("n.id").alias("next_id"), distance([F.col(c) for c in AXES], cols("n")).alias("distance"))
    return within_ranges.unionByName(seams.select(F.col("last.id").alias("id"), F.col("n.id").alias("next_id"), distance(cols("last"), cols("n")).alias("distance")))


def near_on_curve(keyed: DataFrame, at, span: int, k: int = 10) -> DataFrame:
    """The k nearest in all four ordinates among points whose first word lies within ``span`` of the target's.

    The curve keeps places together but not always: a heuristic that reads little, no exact search."""
    target = keyed.sparkSession.range(1).select(unsigned(curve_key(*[F.lit(float(v)) for v in at])["high"]).alias("hk")).first()["hk"]
    low, high = max(target - span, -(1 << 63)), min(target + span, (1 << 63) - 1)
    return keyed.where(F.col("hk").between(low, high)).withColumn("distance", distance(_xyzm(), at)).orderBy("distance", "id").limit(checked(k, 10_000))


def regions(keyed: DataFrame, bits: int = 16) -> DataFrame:
    """(region, n, min_x, min_y, max_x, max_y): points by the first ``bits`` bits of their key, with their box."""
    region = F.shiftright("hk", 64 - bits)
    return keyed.groupBy(region.alias("region")).agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def density(points: DataFrame, cell: float) -> DataFrame:
    """(cell_x, cell_y, n): points a square cell."""
    return points.groupBy(F.floor(F.col("x") / cell).alias("cell_x"), F.floor(F.col("y") / cell).alias("cell_y")).agg(F.count("*").alias("n"))


def in_both_boxes(points: DataFrame, a, b) -> DataFrame:
    """Points in two boxes, each (low, high), at once."""
    return in_box(in_box(points, *a), *b)


def similar_to(points: DataFrame, id_: int, k: int = 10) -> DataFrame:
    """The planar neighbours of a stored point, without itself; an unknown id is an error."""
    checked(k, 1000)
    target = points.where(F.col("id") == id_).select(*[F.col(c).alias(f"t{c}") for c in AXES]).limit(1)
    if target.isEmpty():
        raise KeyError(id_)
    # One row by its key: the broadcast is bounded.
    found = points.where(F.col("id") != id_).join(F.broadcast(target))
    return found.withColumn("distance", planar_distance(_xyzm(), [F.col(f"t{c}") for c in AXES])).orderBy("distance", "id").limit(k).drop(*[f"t{c}" for c in AXES])


def _halves(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits of space as a binary tree in an array: the axis and the bound of each node, at medians of the widest axis."""
    axis, bound, held = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), {0: sample}
    for node in range(len(axis)):
        some = held.pop(node)
        if len(some):
            axis[node] = int(np.argmax(np.ptp(some, axis=0)))
            bound[node] = np.median(some[:, axis[node]])
        right = some[:, axis[node]] > bound[node]
        held[2 * node + 1], held[2 * node + 2] = some[~right], some[right]
    return axis, bound


def nearest_of_each(points: DataFrame, queries: DataFrame, k: int = 10, *, query_block: int = 4096, point_block: int = 8192) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of each query point in all four ordinates.

    Space is halved at medians of a bounded sample into cells of about ``point_block`` points.
    A query meets its own cell; its k-th distance there bounds the others, so it meets just
    those whose box lies as near.  The sample only places the bounds: every point is in a cell,
    and the result is exact.  Cells with more points or queries than a block are dealt further."""
    checked(k, 10_000)
    spark, n = points.sparkSession, points.count()
    depth = max(0, (-(-n // point_block) - 1).bit_length())
    xyzm = [F.col(c).cast("double").alias(c) for c in AXES]
    axis, bound = _halves(np.zeros((0, 4)), 0)
    if depth:
        share = max(1, n >> 16)
        some = points.select(*xyzm).where(F.pmod(F.xxhash64(*AXES), F.lit(share)) == 0).limit(1 << 17).toPandas().to_numpy(float)
        axis, bound = _halves(some[~np.isnan(some).any(axis=1)], depth)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p, node = pdf[list(AXES)].to_numpy(float), np.zeros(len(pdf), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (p[np.arange(len(p)), axis[node]] > bound[node])
            yield pdf.assign(cell=np.where(np.isnan(p).any(axis=1), -1, node))

    shape = f"id {points.schema['id'].dataType.simpleString()}, x double, y double, z double, m double, cell long"
    held = settled(points.select("id", *xyzm).mapInPandas(placed, shape))
    asked = settled(queries.select("id", *xyzm).mapInPandas(placed, shape))
    # A row a cell; the cell of points that lack an ordinate has no box.
    boxes = held.groupBy("cell").agg(F.count("*").alias("n"), *[F.min(c) for c in AXES], *[F.max(c) for c in AXES]).toPandas()
    cells, low, high = boxes["cell"].to_numpy(), boxes.iloc[:, 2:6].to_numpy(float), boxes.iloc[:, 6:10].to_numpy(float)

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("id", kind="stable")  # a stable order of distances then breaks ties by id
        who, p = held["id"].to_numpy(), held[list(AXES)].to_numpy(float)
        out = [pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype({"query_id": "int64", "id": "int64"})]
        for lo in range(0, len(asked) if len(p) else 0, 256):
            some = asked.iloc[lo : lo + 256]
            q = some[list(AXES)].to_numpy(float)
            d2 = np.zeros((len(q), len(p)))
            for c in range(4):
                d2 += (p[None, :, c] - q[:, None, c]) ** 2
            d = np.sqrt(d2)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(some["id"].to_numpy(), order.shape[1]), "id": who[order].ravel(), "distance": np.take_along_axis(d, order, 1).ravel()}))
        return pd.concat(out, ignore_index=True)

    def met(pairs: DataFrame) -> DataFrame:
        """(query_id, id, distance) of queries and the cells that they meet."""
        n_asked = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}
        sizes = [(int(c), -(-int(m) // point_block), -(-n_asked[c] // query_block)) for c, m in zip(cells, boxes["n"], strict=True) if c in n_asked]
        sized = F.broadcast(spark.createDataFrame(sizes, "cell long, points int, queries int"))  # a row a cell
        deal = lambda n: F.pmod(F.xxhash64("id", *AXES), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = held.join(sized, "cell").select("id", *AXES, "cell", deal("points").alias("i"), every("queries").alias("j"))
        right = pairs.join(sized, "cell").select("id", *AXES, "cell", deal("queries").alias("j"), every("points").alias("i"))
        return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(run, "query_id long, id long, distance double")

    def best(part: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return part.withColumn("rank", rank).where(F.col("rank") <= k)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, (1 << 20) // max(1, len(cells)))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                some = pdf.iloc[lo : lo + step]
                q, reach = some[list(AXES)].to_numpy(float), some["reach"].to_numpy(float)
                gap2 = np.zeros((len(q), len(cells)))
                for c in range(4):
                    gap2 += np.maximum(0, np.maximum(low[None, :, c] - q[:, None, c], q[:, None, c] - high[None, :, c])) ** 2
                gap = np.where(cells == -1, np.inf, np.sqrt(gap2) * (1 - 1e-9))
                at, cell = np.nonzero(~(gap > reach[:, None]) & (cells[None, :] != some["cell"].to_numpy()[:, None]))
                yield some.iloc[at][["id", *AXES]].assign(cell=cells[cell])

    first = settled(best(met(asked)).drop("rank"))
    reach = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("reach"))
    bounded = asked.join(reach, F.col("id") == F.col("query_id"), "left").select("id", *AXES, "cell", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    further = settled(bounded.mapInPandas(others, shape))
    return best(first.unionByName(met(further)))


def compared(points: DataFrame, a: int, b: int) -> DataFrame:
    """Similarity 1 / (1 + d) and midpoint of two stored points."""
    pick = lambda id_, c: F.max(F.when(F.col("id") == id_, F.col(c)))
    both = points.where(F.col("id").isin(a, b)).agg(*[pick(i, c).alias(f"{c}{n}") for n, i in (("1", a), ("2", b)) for c in AXES])
    left, right = ([F.col(f"{c}{n}") for c in AXES] for n in "12")
    return both.select(closeness(planar_distance(left, right)).alias("similarity"), *[((p + q) / 2).alias(f"mid_{c}") for c, p, q in zip(AXES, left, right, strict=True)])
