"""Attention, inference and generation by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geometry import AXES, closeness, distance, head_distance, planar_distance
from orbweave.operators.search import checked


def _of(id_: int, points: DataFrame, prefix: str) -> DataFrame:
    """One stored point under other names; an unknown id is an error."""
    found = points.where(F.col("id") == id_).select(*[F.col(c).alias(prefix + c) for c in AXES]).limit(1)
    if found.isEmpty():
        raise KeyError(id_)
    return found


def _cols(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in AXES]


def attention(points: DataFrame, query: int, keys: list[int], *, metric: str = "planar") -> DataFrame:
    """(id, distance, weight): 1 / (1 + d) of each key, normalised; unknown keys are left out."""
    d = (planar_distance if metric == "planar" else distance)(_cols(), _cols("q"))
    # The keys are a list of the caller's: all weights fit one partition.
    raw = points.where(F.col("id").isin(*keys)).join(F.broadcast(_of(query, points, "q"))).select("id", d.alias("distance")).withColumn("raw", closeness(F.col("distance")))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.join(F.broadcast(total)).select("id", "distance", (F.col("raw") / F.col("total")).alias("weight"))


def multi_head_attention(points: DataFrame, query: int, keys: list[int], heads: int = 4) -> DataFrame:
    """(id, weight): weights of each head's plane, summed and normalised again."""
    rows = points.where(F.col("id").isin(*keys)).join(F.broadcast(_of(query, points, "q"))).withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))))
    d = head_distance(F.col("head"), {c: F.col(c) for c in AXES}, {c: F.col("q" + c) for c in AXES})
    raw = rows.select("id", "head", closeness(d).alias("raw"))
    per_head = raw.join(F.broadcast(raw.groupBy("head").agg(F.sum("raw").alias("total"))), "head").withColumn("w", F.col("raw") / F.col("total"))
    summed = per_head.groupBy("id").agg(F.sum("w").alias("w"))
    return summed.join(F.broadcast(summed.agg(F.sum("w").alias("all")))).select("id", (F.col("w") / F.col("all")).alias("weight"))


def related(points: DataFrame, id_: int, radius: float = 0.1, limit: int = 20) -> DataFrame:
    """(id, distance, confidence) within a planar radius, without itself."""
    checked(limit, 1000)
    rows = points.where(F.col("id") != id_).join(F.broadcast(_of(id_, points, "q"))).withColumn("distance", planar_distance(_cols(), _cols("q")))
    return rows.where(F.col("distance") <= radius).orderBy("distance", "id").limit(limit).select("id", "distance", closeness(F.col("distance")).alias("confidence"))


def related_typed(points: DataFrame, id_: int, radius: float = 0.1, limit: int = 20) -> DataFrame:
    """(id, type_id, distance, confidence): the same of compositions, with their types."""
    checked(limit, 1000)
    rows = points.where(F.col("id") != id_).join(F.broadcast(_of(id_, points, "q"))).withColumn("distance", planar_distance(_cols(), _cols("q")))
    return rows.where(F.col("distance") <= radius).orderBy("distance", "id").limit(limit).select("id", "type_id", "distance", closeness(F.col("distance")).alias("confidence"))


#: What a constant or composition can be given as.
TARGETS = ("embedding", "text", "hilbert", "coordinates")


def constant_as(constants: DataFrame, target: str) -> DataFrame:
    """(id, said) of constants (id, kind, value, x, y, z, m): its four ordinates, its character
    (of code points alone), its place on the curve, or its ordinates by name."""
    from orbweave.functions.curve import curve_key
    from orbweave.functions.text import character

    if target == "embedding":
        return constants.select("id", F.array(*_cols()).alias("said"))
    if target == "text":
        return constants.select("id", F.when(F.col("kind") == 0, character(F.col("value"))).alias("said"))
    if target == "hilbert":
        return constants.select("id", curve_key(*_cols()).alias("said"))
    if target == "coordinates":
        return constants.select("id", F.struct(*AXES).alias("said"))
    raise ValueError(f"{target} is none of {', '.join(TARGETS)}")


def composition_embeddings(relations: DataFrame, points: DataFrame) -> DataFrame:
    """(composition_id, embedding): x of each child in order, repeats kept."""
    from orbweave.operators.graph import child_paths

    return child_paths(relations, points).select("composition_id", F.transform("path", lambda p: p["x"]).alias("embedding"))


def mapped_paths(paths: DataFrame, body, kind: str) -> DataFrame:
    """(composition_id, path, hash, kind, source) of (composition_id, path): ``body`` of every point.

    ``body`` takes and gives a struct(x, y, z, m).  The new composition is addressed by its
    kind, its points and the one that it came from."""
    new = F.transform("path", body)
    said = F.array_join(F.transform(new, lambda p: F.concat_ws(",", *[p[c].cast("string") for c in AXES])), ";")
    return paths.select("composition_id", new.alias("path"), F.sha2(F.concat_ws("|", F.lit(kind), F.col("composition_id").cast("string"), said), 256).alias("hash"), F.lit(kind).alias("kind"), F.col("composition_id").alias("source"))


def generated_composition(constants: DataFrame, ids: list[int], kind: str = "generated") -> tuple[DataFrame, DataFrame]:
    """``(composition, relations)`` of constants in the order of ``ids``, each once.

    The composition is (hash, kind, children, shape, x, y, z, m) with the mean of its points.
    An id that is given twice or not known is an error."""
    from orbweave.functions.geometry import centroid, path_kind
    from orbweave.functions.text import composition_hash, seed_hash

    if not ids or len(set(ids)) != len(ids):
        raise ValueError("ids must be given, each once")
    place = F.create_map(*[F.lit(v) for k, i in enumerate(ids) for v in (i, k)])
    rows = constants.where(F.col("id").isin(*ids)).select(place[F.col("id")].alias("position"), seed_hash(F.col("kind"), F.col("value")).alias("child"), F.struct(*AXES).alias("point"))
    parts = rows.agg(F.array_sort(F.collect_list(F.struct("position", "child", "point"))).alias("parts"))  # as many as ids
    if (found := parts.select(F.size("parts")).first()[0]) != len(ids):
        raise KeyError(f"{len(ids) - found} of the ids are not known")
    kids = F.transform("parts", lambda p: F.named_struct(F.lit("hash"), p["child"], F.lit("multiplicity"), F.lit(1)))
    path = F.transform("parts", lambda p: p["point"])
    one = parts.select(composition_hash(kids).alias("hash"), F.lit(kind).alias("kind"), F.size("parts").alias("children"), path_kind(path).alias("shape"), centroid(path).alias("c"))
    relations = parts.select(composition_hash(kids).alias("parent"), F.explode("parts").alias("p")).select("parent", "p.position", "p.child", F.lit(True).alias("is_constant"), F.lit(1).cast("long").alias("multiplicity"))
    return one.select("hash", "kind", "children", "shape", "c.*"), relations


def gaps(rows: DataFrame, high: int, *, span: int = 1000, most: int = 100) -> DataFrame:
    """Midpoints of neighbours on the curve that lie more than ``span`` apart.

    ``rows`` are (id, hk, lk, x, y, z, m) with signed keys in unsigned order; the first
    ``most`` rows whose high word is within one of ``high`` are looked at."""
    near = rows.where(F.col("hk").between(high - 1, high + 1)).orderBy("hk", "lk", "id").limit(checked(most, 10_000))
    order = Window.orderBy("hk", "lk", "id")  # over at most ``most`` rows
    following = near.select("*", *[F.lead(c).over(order).alias(f"n_{c}") for c in ("hk", "lk", *AXES)]).where("n_hk is not null")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gap = F.when(F.col("hk") == F.col("n_hk"), wide("n_lk") - wide("lk")).otherwise(F.lit(str((1 << 64) - 1)).cast("decimal(38,0)"))
    return (
        following.withColumn("gap", gap)
        .where(F.col("gap") > span)
        .select("id", *[((F.col(c) + F.col(f"n_{c}")) / 2).alias(c) for c in AXES], F.least(F.lit(1.0), F.lit(float(span)) / F.col("gap").cast("double")).alias("confidence"))
    )


def next_of(points: DataFrame, context: list[int], n: int = 5) -> DataFrame:
    """(rank, id, distance, probability): what lies nearest the context's centre moved by its last step."""
    known = points.where(F.col("id").isin(*context))
    at = lambda id_, c: F.max(F.when(F.col("id") == id_, F.col(c)))
    last, before = context[-1], context[-2] if len(context) > 1 else context[-1]
    aim = known.agg(*[(F.avg(c) + at(last, c) - at(before, c)).alias("q" + c) for c in "xy"])
    rows = points.where(~F.col("id").isin(*context)).join(F.broadcast(aim)).withColumn("distance", planar_distance(_cols(), [F.col("qx"), F.col("qy")]))
    return ranked(rows, n)


def analogy(points: DataFrame, a: int, b: int, c: int, n: int = 5) -> DataFrame:
    """(rank, id, distance, probability): a is to b as c is to these."""
    at = lambda id_, k: F.max(F.when(F.col("id") == id_, F.col(k)))
    aim = points.where(F.col("id").isin(a, b, c)).agg(*[(at(c, k) + at(b, k) - at(a, k)).alias("q" + k) for k in AXES])
    rows = points.where(~F.col("id").isin(a, b, c)).join(F.broadcast(aim)).withColumn("distance", planar_distance(_cols(), _cols("q")))
    return ranked(rows, n)


def ranked(rows: DataFrame, n: int) -> DataFrame:
    best = rows.orderBy("distance", "id").limit(checked(n, 1000))
    order = Window.orderBy("distance", "id")  # over n rows
    return best.select(F.row_number().over(order).alias("rank"), "id", "distance", closeness(F.col("distance")).alias("probability"))
