"""The registered queries of the engine, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import geometry
from orbweave.functions.geometry import BANDS, HIGH_BAND, HIGH_FROM, OTHER_BAND
from orbweave.operators import graph, ingest, meaning, search
from orbweave.plans import content, space  # noqa: F401  they register their queries
from orbweave.plans.registry import QUERIES, SQL, registered, rounded
from orbweave.sources.tables import compositions, points, relations, table
from orbweave.streaming import events as streams

_POINTS = "points AS (SELECT vec_id AS id, label::BIGINT AS type_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS m FROM embeddings)"
_AT = (0.5, 0.5, 0.5, 0.5)
_D2 = "sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5))"
_D4 = "sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) + (z - 0.5) * (z - 0.5) + (m - 0.5) * (m - 0.5))"
_Q2 = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
_Q4 = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) + (p.m - q.m) * (p.m - q.m))"
_KEYS = [2, 3, 5, 8, 13, 21, 34]


@registered(f"WITH {_POINTS}, near AS (SELECT *, {_D2} AS d2 FROM points ORDER BY d2, id LIMIT 20) SELECT id, type_id, round({_D4}, 9) AS distance FROM near ORDER BY {_D4}, id LIMIT 10")
def knn_planar_4d_rerank(spark, d):
    return rounded(search.nearest(points(spark, d), _AT, 10).select("id", "type_id", "distance"), "distance")


@registered(f"WITH {_POINTS} SELECT id, round({_D2}, 9) AS distance FROM points ORDER BY {_D2}, id LIMIT 25")
def knn_seed(spark, d):
    return rounded(search.nearest_planar(points(spark, d), _AT, 25).select("id", "distance"), "distance")


@registered(f"WITH {_POINTS}, near AS (SELECT *, {_D2} AS d2 FROM points WHERE type_id = 3 ORDER BY d2, id LIMIT 20) SELECT id, round({_D4}, 9) AS distance FROM near ORDER BY {_D4}, id LIMIT 10")
def knn_typed(spark, d):
    return rounded(search.nearest(points(spark, d), _AT, 10, type_id=3).select("id", "distance"), "distance")


@registered(f"WITH {_POINTS}, pairs AS (SELECT q.id AS query_id, p.id, {_Q4} AS dist FROM points p, points q WHERE q.id % 20 = 0) SELECT query_id, id, round(dist, 9) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM pairs) WHERE rank <= 10")
def knn_batch(spark, d):
    p = points(spark, d)
    return rounded(search.nearest_of_each(p, p.where("id % 20 = 0"), 10), "distance")


@registered(f"WITH {_POINTS} SELECT id, round({_D4}, 9) AS distance FROM points WHERE {_D4} <= 1.2 ORDER BY {_D4}, id LIMIT 1000")
def radius_constants(spark, d):
    return rounded(search.within(points(spark, d), _AT, 1.2).select("id", "distance"), "distance")


@registered(f"WITH {_POINTS} SELECT id, round({_D4}, 9) AS distance FROM points WHERE type_id = 2 AND {_D4} <= 1.2 ORDER BY {_D4}, id LIMIT 1000")
def radius_compositions_typed(spark, d):
    return rounded(search.within(points(spark, d), _AT, 1.2, type_id=2).select("id", "distance"), "distance")


@registered(f"WITH {_POINTS}, q AS (SELECT * FROM points WHERE id = 7) SELECT p.id, round({_Q2}, 9) AS distance FROM points p, q WHERE p.id <> 7 ORDER BY {_Q2}, p.id LIMIT 10")
def similar_compositions(spark, d):
    return rounded(search.similar_to(points(spark, d), 7).select("id", "distance"), "distance")


@registered(f"WITH {_POINTS} SELECT id FROM points WHERE x BETWEEN -0.1 AND 0.2 AND y BETWEEN -0.2 AND 0.1")
def bbox_xy(spark, d):
    return search.in_box(points(spark, d), (-0.1, -0.2, 0, 0), (0.2, 0.1, 0, 0)).select("id")


@registered(f"WITH {_POINTS} SELECT id FROM points WHERE x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.1 AND 0.3 ORDER BY id LIMIT 1000")
def region_render(spark, d):
    return search.in_box(points(spark, d), (-0.2, -0.2, -0.1, 0), (0.2, 0.2, 0.3, 0), dims="xyz").select("id").orderBy("id").limit(1000)


@registered(f"WITH {_POINTS} SELECT id, round({_D2}, 9) AS distance FROM points WHERE {_D2} <= 0.7 AND z >= 0")
def radius_z_window(spark, d):
    return rounded(search.within_planar(points(spark, d), _AT, 0.7, min_z=0.0).select("id", "distance"), "distance")


@registered(f"WITH {_POINTS} SELECT id, type_id FROM points WHERE type_id = 1 ORDER BY id LIMIT 100")
def by_type(spark, d):
    return search.by_type(points(spark, d), 1).select("id", "type_id")


@registered(f"WITH {_POINTS}, q AS (SELECT * FROM points WHERE id = 2), p AS (SELECT * FROM points WHERE id = 1) SELECT round(1.0 / (1.0 + {_Q2}), 9) AS similarity, round((p.x + q.x) / 2, 9) AS mid_x, round((p.y + q.y) / 2, 9) AS mid_y, round((p.z + q.z) / 2, 9) AS mid_z, round((p.m + q.m) / 2, 9) AS mid_m FROM p, q")
def model_compare(spark, d):
    return rounded(search.compared(points(spark, d), 1, 2), "similarity", "mid_x", "mid_y", "mid_z", "mid_m")


_BAND = "CASE " + " ".join(f"WHEN c BETWEEN {a} AND {b} THEN {v}" for a, b, v in BANDS) + f" WHEN c >= {HIGH_FROM} THEN {HIGH_BAND} ELSE {OTHER_BAND} END"
_CODES = "codes AS (SELECT DISTINCT unicode(unnest(string_split(text, '')))::BIGINT AS c FROM documents WHERE text <> '')"
_ANGLES = f"""angles AS (SELECT c, least(greatest(({_BAND} + 0.5) * {geometry.BAND!r}::DOUBLE + ((c % 1000) / 100000.0::DOUBLE) * {geometry.BAND!r}::DOUBLE * 0.1::DOUBLE, 0.001), {geometry.PI - 0.001!r}::DOUBLE) AS psi,
 least(greatest(fmod((c % 10000) * {geometry.GOLDEN!r}::DOUBLE, {geometry.PI!r}::DOUBLE), 0.001), {geometry.PI - 0.001!r}::DOUBLE) AS theta, fmod(c * {geometry.GOLDEN!r}::DOUBLE * 1.5::DOUBLE, {geometry.TWO_PI!r}::DOUBLE) AS phi FROM codes)"""


def _codes(spark, d):
    texts = table(spark, d, "documents").where("text <> ''")
    return texts.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).distinct().select(F.ascii("ch").cast("long").alias("c"))


@registered(f"WITH {_CODES}, {_ANGLES} SELECT c, round(sin(psi) * sin(theta) * cos(phi), 9) AS x, round(sin(psi) * sin(theta) * sin(phi), 9) AS y, round(sin(psi) * cos(theta), 9) AS z, round(cos(psi), 9) AS m FROM angles")
def project_codepoints(spark, d):
    return rounded(_codes(spark, d).select("c", *[p.alias(n) for p, n in zip(geometry.project_code(F.col("c")), "xyzm", strict=True)]), *"xyzm")


_R = "relations AS (SELECT l_orderkey AS composition_id, l_linenumber AS position, l_quantity::BIGINT AS multiplicity, l_partkey AS child_id FROM lineitem)"
_C = "compositions AS (SELECT o_orderkey AS id, o_orderstatus AS type_id FROM orders)"


@registered(f"WITH {_R}, {_C} SELECT id, type_id FROM compositions WHERE id IN (SELECT composition_id FROM relations WHERE child_id = 42) ORDER BY id LIMIT 100")
def backlinks_constant(spark, d):
    return graph.parents_of(compositions(spark, d), relations(spark, d), [42])


@registered(f"WITH {_R}, {_C} SELECT id, type_id FROM compositions WHERE id IN (SELECT composition_id FROM relations WHERE child_id IN (1, 7, 99)) ORDER BY id LIMIT 1000")
def backlinks_set(spark, d):
    return graph.parents_of(compositions(spark, d), relations(spark, d), [1, 7, 99], 1000)


@registered(f"WITH {_R}, {_C} SELECT id, type_id, coalesce(n, 0)::BIGINT AS refs FROM compositions LEFT JOIN (SELECT composition_id AS id, count(*) AS n FROM relations GROUP BY 1) USING (id)")
def refcount_left_join(spark, d):
    return graph.reference_counts(compositions(spark, d), relations(spark, d))


@registered(f"WITH {_R} SELECT composition_id, count(*) AS rows, count(DISTINCT child_id) AS children, sum(multiplicity)::BIGINT AS total FROM relations GROUP BY 1")
def composition_stats(spark, d):
    return graph.composition_stats(relations(spark, d))


@registered(f"WITH {_R}, k AS (SELECT child_id, max((composition_id = 1)::INT) AS a, max((composition_id = 2)::INT) AS b FROM relations WHERE composition_id IN (1, 2) GROUP BY 1) SELECT CASE WHEN b = 0 THEN 'only_a' WHEN a = 0 THEN 'only_b' ELSE 'shared' END AS side, child_id FROM k")
def composition_difference(spark, d):
    return graph.difference(relations(spark, d), 1, 2)


@registered(f"WITH {_R} SELECT child_id, count(*) AS uses FROM relations GROUP BY 1 ORDER BY uses DESC, child_id LIMIT 20")
def pattern_usage(spark, d):
    return graph.usage(relations(spark, d), 20)


@registered(f"WITH {_R} SELECT composition_id, max(child_id) FILTER (position = 1) AS source_id, max(child_id) FILTER (position = 2) AS target_id FROM relations WHERE position IN (1, 2) GROUP BY 1")
def edge_endpoints(spark, d):
    return graph.endpoints(relations(spark, d))


@registered("SELECT 'constants' AS name, count(*) AS n FROM embeddings UNION ALL SELECT 'compositions', count(*) FROM orders UNION ALL SELECT 'relations', count(*) FROM lineitem")
def counts(spark, d):
    named = lambda t, n: table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return named("embeddings", "constants").unionByName(named("orders", "compositions")).unionByName(named("lineitem", "relations"))


@registered(f"WITH {_POINTS} SELECT type_id, count(*) AS n, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM points GROUP BY 1")
def aggregate_by_type(spark, d):
    return rounded(points(spark, d).groupBy("type_id").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")), "x", "y")


@registered(f"WITH {_POINTS} SELECT count(*) AS n, coalesce(round(avg(x), 9), 0) AS x, coalesce(round(avg(y), 9), 0) AS y, coalesce(round(avg(z), 9), 0) AS z, coalesce(round(avg(m), 9), 0) AS m FROM points")
def constant_aggregate(spark, d):
    return points(spark, d).agg(F.count("*").alias("n"), *[F.coalesce(F.round(F.avg(c), 9), F.lit(0.0)).alias(c) for c in "xyzm"])


@registered("SELECT coalesce(o_orderstatus, 'untyped') AS type, count(*) AS n FROM orders GROUP BY 1")
def system_stats(spark, d):
    return compositions(spark, d).groupBy(F.coalesce("type_id", F.lit("untyped")).alias("type")).agg(F.count("*").alias("n"))


@registered("SELECT conv_id, max(turn) AS last_turn, count(*) AS turns FROM conversations GROUP BY 1 ORDER BY conv_id DESC LIMIT 50")
def newest_n(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns")).orderBy(F.desc("conv_id")).limit(50)


_EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"""


def _edges(spark, d):
    tag = lambda t, a, p, b, q: table(spark, d, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("parent"), F.concat(F.lit(q), F.col(b).cast("string")).alias("child"))
    return tag("nation", "n_regionkey", "r", "n_nationkey", "n").unionByName(tag("customer", "c_nationkey", "n", "c_custkey", "c")).unionByName(tag("orders", "o_custkey", "c", "o_orderkey", "o")).unionByName(tag("lineitem", "l_orderkey", "o", "l_partkey", "p"))


@registered(f"WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 'r1', 0 UNION SELECT child, depth + 1 FROM walk JOIN edges ON node = parent WHERE depth < 4) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1")
def chain_traversal(spark, d):
    return graph.reachable(_edges(spark, d), spark.createDataFrame([("r1",)], "node string"), 4)


@registered(f"WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 'p42', 0 UNION SELECT parent, depth + 1 FROM walk JOIN edges ON node = child WHERE depth < 4) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1")
def containing_recursive(spark, d):
    back = _edges(spark, d).select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return graph.reachable(back, spark.createDataFrame([("p42",)], "node string"), 4)


_K = ", ".join(map(str, _KEYS))


def _attention_sql(metric: str) -> str:
    return f"WITH {_POINTS}, raw AS (SELECT p.id, {metric} AS dist FROM points p, (SELECT * FROM points WHERE id = 1) q WHERE p.id IN ({_K})), s AS (SELECT sum(1.0 / (1.0 + dist)) AS t FROM raw) SELECT id, round(dist, 9) AS distance, round((1.0 / (1.0 + dist)) / t, 9) AS weight FROM raw, s"


@registered(_attention_sql(_Q2))
def attention_planar(spark, d):
    return rounded(meaning.attention(points(spark, d), 1, _KEYS), "distance", "weight")


@registered(_attention_sql(_Q4))
def attention_4d(spark, d):
    return rounded(meaning.attention(points(spark, d), 1, _KEYS, metric="all"), "distance", "weight")


_HEADS = "CASE h % 4 " + " ".join(f"WHEN {k} THEN sqrt((p.{a} - q.{a}) * (p.{a} - q.{a}) + (p.{b} - q.{b}) * (p.{b} - q.{b}))" for k, (a, b) in enumerate(geometry.HEAD_AXES)) + " END"


@registered(f"WITH {_POINTS}, raw AS (SELECT p.id, h, 1.0 / (1.0 + {_HEADS}) AS w FROM points p, (SELECT * FROM points WHERE id = 1) q, range(0, 4) t(h) WHERE p.id IN ({_K})), n AS (SELECT id, w / sum(w) OVER (PARTITION BY h) AS w FROM raw), s AS (SELECT id, sum(w) AS w FROM n GROUP BY 1) SELECT id, round(w / sum(w) OVER (), 9) AS weight FROM s")
def attention_multihead(spark, d):
    return rounded(meaning.multi_head_attention(points(spark, d), 1, _KEYS), "weight")


@registered(f"WITH {_POINTS}, q AS (SELECT * FROM points WHERE id = 1), r AS (SELECT p.id, {_Q2} AS dist FROM points p, q WHERE p.id <> 1) SELECT id, round(dist, 9) AS distance, round(1.0 / (1.0 + dist), 9) AS confidence FROM r WHERE dist <= 0.1 ORDER BY dist, id LIMIT 20")
def infer_related(spark, d):
    return rounded(meaning.related(points(spark, d), 1), "distance", "confidence")


@registered(f"WITH {_POINTS}, q AS (SELECT avg(x) + max(x) FILTER (id = 9) - max(x) FILTER (id = 6) AS x, avg(y) + max(y) FILTER (id = 9) - max(y) FILTER (id = 6) AS y FROM points WHERE id IN (3, 6, 9)), r AS (SELECT p.id, {_Q2} AS dist FROM points p, q WHERE p.id NOT IN (3, 6, 9)) SELECT row_number() OVER (ORDER BY dist, id)::INT AS rank, id, round(dist, 9) AS distance, round(1.0 / (1.0 + dist), 9) AS probability FROM r ORDER BY dist, id LIMIT 5")
def generate_next(spark, d):
    return rounded(meaning.next_of(points(spark, d), [3, 6, 9]), "distance", "probability")


@registered(f"WITH {_POINTS}, q AS (SELECT max(x) FILTER (id = 4) + max(x) FILTER (id = 3) - max(x) FILTER (id = 2) AS x, max(y) FILTER (id = 4) + max(y) FILTER (id = 3) - max(y) FILTER (id = 2) AS y FROM points), r AS (SELECT p.id, {_Q2} AS dist FROM points p, q WHERE p.id NOT IN (2, 3, 4)) SELECT row_number() OVER (ORDER BY dist, id)::INT AS rank, id, round(dist, 9) AS distance, round(1.0 / (1.0 + dist), 9) AS probability FROM r ORDER BY dist, id LIMIT 5")
def analogy(spark, d):
    return rounded(meaning.analogy(points(spark, d), 2, 3, 4), "distance", "probability")


@registered("WITH k AS (SELECT l_suppkey AS id, l_partkey AS hk, (l_orderkey * 100 + l_linenumber) AS lk, l_quantity AS v FROM lineitem WHERE l_partkey BETWEEN 10 AND 12 ORDER BY 2, 3, 1 LIMIT 100), n AS (SELECT *, lead(hk) OVER o AS nh, lead(lk) OVER o AS nl, lead(v) OVER o AS nv FROM k WINDOW o AS (ORDER BY hk, lk, id)), g AS (SELECT *, CASE WHEN hk = nh THEN (nl - lk)::DOUBLE ELSE 18446744073709551615.0::DOUBLE END AS gap FROM n WHERE nh IS NOT NULL) SELECT id, (v + nv) / 2 AS x, round(least(1.0, 1000.0 / gap), 9)::DOUBLE AS confidence FROM g WHERE gap > 1000")
def gaps(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("hk"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("lk"), *[F.col("l_quantity").alias(c) for c in "xyzm"])
    return rounded(meaning.gaps(rows, 11).select("id", "x", "confidence"), "confidence")


_RUNS = """codes AS (SELECT doc_id, i, unicode(s[i])::BIGINT AS value FROM (SELECT doc_id, string_split(text, '') AS s, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text <> '')),
 marks AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS opens FROM codes),
 islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marks),
 runs AS (SELECT doc_id, (island - 1)::INT AS position, any_value(value) AS value, count(*) AS multiplicity FROM islands GROUP BY doc_id, island)"""


@registered(f"WITH {_RUNS} SELECT * FROM runs")
def ingest_text_rle(spark, d):
    return ingest.text_relations(table(spark, d, "documents").where("text <> ''"))


@registered("SELECT doc_id, text FROM documents WHERE text <> ''")
def reconstruct_text(spark, d):
    return ingest.text_of(ingest.text_relations(table(spark, d, "documents").where("text <> ''")))


@registered("SELECT min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY text")
def dedup_hash(spark, d):
    return ingest.text_compositions(table(spark, d, "documents").where("text <> ''")).select("doc_id")


@registered("WITH codes AS (SELECT doc_id, i, unicode(s[i])::BIGINT AS a, unicode(s[i + 1])::BIGINT AS b FROM (SELECT doc_id, string_split(text, '') AS s, unnest(range(1, length(text))) AS i FROM documents WHERE text <> '')) SELECT a, b, count(*) AS n FROM codes GROUP BY 1, 2")
def digram_counts(spark, d):
    return ingest.digrams(table(spark, d, "documents").where("text <> ''"))


@registered("SELECT event_id, json_extract_string(props, k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)")
def ingest_json_scalars(spark, d):
    e = table(spark, d, "events").where("props is not null")
    return e.select("event_id", F.explode_outer(F.from_json("props", "map<string,string>")).alias("key", "value")).where("key is not null").select("event_id", "value", "key")


@registered("SELECT vec_id AS id, (i - 1)::INT AS position, embedding[i] AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def ingest_embedding(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("position", "value"))


@registered("SELECT vec_id AS id, (i - 1)::INT AS position, embedding[i] AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE abs(embedding[i]::DOUBLE) >= 0.1")
def sparse_tensor(spark, d):
    return ingest.sparse_cells(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 0.1)


@registered("WITH v AS (SELECT abs(unnest(embedding)::DOUBLE) AS a FROM embeddings) SELECT count(*) AS total, count(*) FILTER (a >= 0.1) AS stored, count(*) FILTER (a < 0.1) AS skipped, round(100.0 * (count(*) FILTER (a < 0.1)) / count(*), 9)::DOUBLE AS sparsity FROM v")
def sparsity_stats(spark, d):
    v = table(spark, d, "embeddings").select(F.explode("embedding").alias("v")).select(F.col("v").cast("double").alias("a"))
    skipped = F.sum((F.abs("a") < 0.1).cast("long"))
    return v.agg(F.count("*").alias("total"), (F.count("*") - skipped).alias("stored"), skipped.alias("skipped"), F.round(100.0 * skipped / F.count("*"), 9).cast("double").alias("sparsity"))


@registered("WITH v AS (SELECT abs(unnest(embedding)::DOUBLE) AS a FROM embeddings), r AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS k, count(*) OVER () AS n FROM v) SELECT a AS value FROM r WHERE k = n * 75 // 100")
def percentile_threshold(spark, d):
    v = table(spark, d, "embeddings").select(F.explode("embedding").alias("v")).select(F.abs(F.col("v").cast("double")).alias("value"))
    return ingest.percentile_value(v, 75)


@registered("SELECT vec_id AS id, round(list_sum(list_transform(embedding[1:21], lambda v: v::DOUBLE)) / sqrt(64 / 3.0), 6) AS a, round(list_sum(list_transform(embedding[22:42], lambda v: v::DOUBLE)) / sqrt(64 / 3.0), 6) AS b, round(list_sum(list_transform(embedding[43:64], lambda v: v::DOUBLE)) / sqrt(64 / 3.0), 6) AS c FROM embeddings")
def reduce_3d(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(e.select(F.col("vec_id").alias("id"), *[c.alias(n) for c, n in zip(geometry.thirds(F.col("embedding")), "abc", strict=True)]), *"abc", digits=6)


@registered("SELECT l_suppkey AS source_id, l_partkey AS target_id, sum(l_quantity)::DOUBLE AS strength FROM lineitem GROUP BY 1, 2")
def edge_strength(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id")).agg(F.sum("l_quantity").alias("strength"))


@registered("SELECT l_suppkey AS source_id, l_partkey AS target_id, l_quantity AS weight FROM lineitem WHERE abs(l_quantity) >= 49")
def attention_edges(spark, d):
    return table(spark, d, "lineitem").where(F.abs("l_quantity") >= 49).select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_quantity").alias("weight"))


@registered("WITH t AS (SELECT unnest(string_split(text, ' ')) AS token, doc_id FROM documents), v AS (SELECT token, min(doc_id) AS token_id FROM t WHERE token <> '' GROUP BY 1) SELECT token, token_id, CASE WHEN length(token) = 1 THEN 'character' WHEN regexp_full_match(token, '<0x[0-9A-Fa-f]{2}>') THEN 'byte' ELSE 'piece' END AS kind, CASE WHEN length(token) = 1 THEN unicode(token)::INT END AS code FROM v")
def vocab_classify(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode_outer(F.split("text", " ")).alias("token")).where("token <> ''")
    return ingest.vocabulary(t.groupBy("token").agg(F.min("doc_id").alias("token_id")))


@registered()
def grammar_rules(spark, d):
    return ingest.grammar_rules(table(spark, d, "documents"))


@registered("SELECT count(*) AS n FROM range(0, 1114112) t(c) WHERE c NOT BETWEEN 55296 AND 57343")
def unicode_seed(spark, d):
    return ingest.unicode_seed(spark).where(geometry.is_on_sphere([F.col(c) for c in "xyzm"])).agg(F.count("*").alias("n"))


@registered("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedup(spark, d):
    schema = table(spark, d, "events").schema
    stream = streams.event_stream(spark, f"{d}/events*.parquet", schema)
    once = streams.drained(streams.once_each(stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), "event_id", late="7 days"), "dedup")
    return once.groupBy("event_type").agg(F.count("*").alias("n"))


@registered("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return rounded(streams.tumbling_counts(table(spark, d, "events")), "total", digits=6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
