"""Joins, counts and walks over relations (composition_id, position, multiplicity, child_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.search import checked


def parents_of(compositions: DataFrame, relations: DataFrame, children: list[int], limit: int = 100) -> DataFrame:
    """Compositions that refer to any of the children."""
    checked(limit, 10_000)
    found = relations.where(F.col("child_id").isin(*children)).select(F.col("composition_id").alias("id")).distinct()
    return compositions.join(found, "id", "left_semi").orderBy("id").limit(limit)


def parents_of_either(compositions: DataFrame, relations: DataFrame, *, constants: list = (), parts: list = (), limit: int = 100) -> DataFrame:
    """Compositions that refer to any of the constants or of the compositions ``parts``.

    ``relations`` have child_constant_id and child_composition_id, one of them null."""
    checked(limit, 10_000)
    of = lambda c, ids: relations.where(F.col(c).isin(*ids)).select(F.col("composition_id").alias("id"))
    found = of("child_constant_id", constants).unionByName(of("child_composition_id", parts)).distinct()
    return compositions.join(found, "id", "left_semi").orderBy("id").limit(limit)


def child_ids(relations: DataFrame) -> DataFrame:
    """(composition_id, position, is_constant, child_id): the one child of each relation; those without one are left out."""
    child = F.coalesce("child_constant_id", "child_composition_id")
    return relations.where(child.isNotNull()).select("composition_id", "position", F.col("child_constant_id").isNotNull().alias("is_constant"), child.alias("child_id"))


def with_types(compositions: DataFrame, types: DataFrame) -> DataFrame:
    """Each composition with the name of its type (``types``: id, name), null where it has none."""
    return compositions.join(types.select(F.col("id").alias("type_id"), F.col("name").alias("type")), "type_id", "left")


def existing(rows: DataFrame, id_) -> DataFrame:
    """The row of an id; an unknown id is an error."""
    found = rows.where(F.col("id") == id_).limit(1)
    if found.isEmpty():
        raise KeyError(id_)
    return found


def child_paths(relations: DataFrame, points: DataFrame) -> DataFrame:
    """(composition_id, path): the points of each composition's children in order, repeats kept.

    ``points`` are (id, x, y, z, m); children without a point are left out."""
    known = relations.select("composition_id", "position", F.col("child_id").alias("id")).join(points.select("id", "x", "y", "z", "m"), "id")
    parts = known.groupBy("composition_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "x", "y", "z", "m"))).alias("parts"))
    return parts.select("composition_id", F.transform("parts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["m"].alias("m"))).alias("path"))


def geometry_stats(relations: DataFrame, points: DataFrame) -> DataFrame:
    """(composition_id, kind, length, x, y): what line or point a composition's children make, its planar length and centre."""
    from orbweave.functions.geometry import path_centre, path_kind, path_length

    paths = child_paths(relations, points).withColumn("centre", path_centre(F.col("path")))
    return paths.select("composition_id", path_kind(F.col("path")).alias("kind"), path_length(F.col("path")).alias("length"), F.col("centre.x").alias("x"), F.col("centre.y").alias("y"))


def reference_counts(compositions: DataFrame, relations: DataFrame) -> DataFrame:
    """Each composition with its number of relations, 0 where none."""
    counts = relations.groupBy(F.col("composition_id").alias("id")).agg(F.count("*").alias("refs"))
    return compositions.join(counts, "id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


def composition_stats(relations: DataFrame) -> DataFrame:
    return relations.groupBy("composition_id").agg(F.count("*").alias("rows"), F.count_distinct("child_id").alias("children"), F.sum("multiplicity").alias("total"))


def difference(relations: DataFrame, a: int, b: int) -> DataFrame:
    """(side, child_id): what only a has, only b has, and both have."""
    kids = relations.where(F.col("composition_id").isin(a, b)).groupBy("child_id").agg(F.max((F.col("composition_id") == a).cast("int")).alias("in_a"), F.max((F.col("composition_id") == b).cast("int")).alias("in_b"))
    return kids.select(F.when(F.col("in_b") == 0, "only_a").when(F.col("in_a") == 0, "only_b").otherwise("shared").alias("side"), "child_id")


def usage(relations: DataFrame, n: int = 10) -> DataFrame:
    """The children with most relations."""
    return relations.groupBy("child_id").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "child_id").limit(n)


def endpoints(relations: DataFrame) -> DataFrame:
    """The first two children of each composition, side by side."""
    at = lambda p: F.max(F.when(F.col("position") == p, F.col("child_id")))
    return relations.where(F.col("position").isin(1, 2)).groupBy("composition_id").agg(at(1).alias("source_id"), at(2).alias("target_id"))


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """(node, depth): everything below the roots with its least depth, level by level.

    ``edges`` are (parent, child), ``roots`` (node).  A node that was met is not followed
    again, so cycles end."""
    from orbweave.functions.store import settled

    level = roots.select("node").distinct().withColumn("depth", F.lit(0))
    seen = settled(level)
    front = seen
    for depth in range(1, max_depth + 1):
        new = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        front = settled(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def chain(edges: DataFrame, root, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(nodes, links)`` of a walk down from ``root`` along (parent, position, child).

    Nodes are (node, depth, path): the least depth, and of the shortest ways the first by
    position, as an array; ``orderBy("path")`` is the order in which a walk depth first meets
    them.  Links are (parent, position, child) out of every node above ``max_depth``, those to
    nodes that were met before included."""
    from orbweave.functions.store import settled

    edges = settled(edges.select("parent", "position", "child"))
    front = settled(edges.sparkSession.createDataFrame([(root,)], f"node {edges.schema['parent'].dataType.simpleString()}").select("node", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path")))
    seen, links = front, None
    for depth in range(1, max_depth + 1):
        met = settled(front.join(edges, front["node"] == edges["parent"]).select("parent", "position", "child", F.concat("path", F.array(F.col("position").cast("int"))).alias("path")))
        out = met.select("parent", "position", "child")
        links = out if links is None else links.unionByName(out)
        new = met.groupBy(F.col("child").alias("node")).agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "path")
        front = settled(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen, links


def shortest_ways(edges: DataFrame, source, target, max_depth: int = 8) -> DataFrame:
    """(node, depth) along a shortest way from ``source`` to ``target``, the first by position of equals; none where there is none."""
    nodes, _ = chain(edges, source, max_depth)
    end = nodes.where(F.col("node") == target).select(F.col("path").alias("whole")).limit(1)  # one row at most
    on_way = F.slice("whole", F.lit(1), F.size("path")) == F.col("path")
    return nodes.join(F.broadcast(end), F.size("path") <= F.size("whole")).where(on_way).select("node", "depth")
