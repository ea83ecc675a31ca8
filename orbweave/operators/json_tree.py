"""JSON documents as nodes, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.store import settled
from orbweave.functions.text import code_points, json_escaped

#: The kinds of nodes.
KINDS = ("object", "array", "string", "integer", "float", "boolean", "null")


def _kind(v: Column) -> Column:
    said = F.schema_of_variant(v)
    return (
        F.when(said.startswith("OBJECT"), "object")
        .when(said.startswith("ARRAY"), "array")
        .when(said == "STRING", "string")
        .when(said == "BIGINT", "integer")
        .when(said == "BOOLEAN", "boolean")
        .when(said == "VOID", "null")
        .otherwise("float")
    )


def json_nodes(docs: DataFrame, *, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """(doc_id, path, parent, depth, place, key, kind, value, json): every object, array and scalar of each document.

    ``path`` is as in ``$.a[1].b`` (other keys than words as ``["..."]``), ``depth`` is 0 at the root; ``place`` counts among the parent's children, keys in
    order; containers have no value.  Integers that fit 64 bits are integers, all other
    numbers floats.  The kind is stored, so that no array is taken for an object later.
    A null document, or one that is no JSON, has no nodes.  One level is read after the other."""
    spark = docs.sparkSession
    variant = F.try_parse_json(F.col(json_col))
    front = docs.select(F.col(id_col).alias("doc_id"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("key"), variant.alias("v")).where("v is not null")
    levels = []
    while True:
        level = settled(front.withColumn("kind", _kind(F.col("v"))).withColumn("json", F.when(~F.col("kind").isin("object", "array"), F.to_json("v"))))
        value = F.when(F.col("kind").isin("object", "array", "null"), None).otherwise(F.variant_get("v", "$", "string"))
        levels.append(level.select("doc_id", "path", "parent", F.lit(len(levels)).alias("depth"), "place", "key", "kind", value.alias("value"), "json"))
        inner = level.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            break
        told = inner.alias("p").lateralJoin(spark.tvf.variant_explode(F.col("p.v").outer()).alias("c"))
        word = F.col("c.key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        name = F.when(word, F.concat(F.lit("."), F.col("c.key"))).when(F.col("p.kind") == "object", F.concat(F.lit("["), json_escaped(F.col("c.key")), F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("c.pos").cast("string"), F.lit("]")))
        front = told.select(F.col("p.doc_id"), F.concat("p.path", name).alias("path"), F.col("p.path").alias("parent"), F.col("c.pos").alias("place"), F.col("c.key").alias("key"), F.col("c.value").alias("v"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def json_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, json) from :func:`json_nodes`: keys in order, no spaces.

    The deepest containers are spelt first; a container's children are one group, as they are one row of the document."""
    spelt = settled(nodes.select("doc_id", "path", "parent", "place", "key", "kind", "json", "depth"))
    open_ = spelt.where("json is null").select("doc_id", "path", "parent", "place", "key", "kind", "depth")
    done = spelt.where("json is not null").select("doc_id", "parent", "place", "key", "json", "depth")
    deepest = spelt.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest, -1, -1):
        here = open_.where(F.col("depth") == depth)
        kids = done.where(F.col("depth") == depth + 1).groupBy("doc_id", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.struct("place", "key", "json"))).alias("kids"))
        both = here.join(kids, ["doc_id", "path"], "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<struct<place:int,key:string,json:string>>")))
        member = F.array_join(F.transform("kids", lambda k: F.concat(json_escaped(k["key"]), F.lit(":"), k["json"])), ",")
        item = F.array_join(F.transform("kids", lambda k: k["json"]), ",")
        text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), member, F.lit("}"))).otherwise(F.concat(F.lit("["), item, F.lit("]")))
        done = done.unionByName(settled(both.select("doc_id", "parent", "place", "key", text.alias("json"), "depth")))
    return done.where("depth = 0").select("doc_id", "json")


def json_primitives(nodes: DataFrame) -> DataFrame:
    """(kind, value): the distinct characters (as code points), integers, floats and truth values of all documents."""
    chars = nodes.where("kind = 'string'").select(F.explode(F.array_distinct(code_points(F.col("value")))).alias("c")).select(F.lit("character").alias("kind"), F.col("c").cast("string").alias("value"))
    return chars.unionByName(nodes.where("kind in ('integer', 'float', 'boolean')").select("kind", "value")).distinct()
