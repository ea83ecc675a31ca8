"""Queries on space and graphs: the curve, paths, walks, transforms, generated compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import curve, geometry
from orbweave.functions.geometry import BANDS, HIGH_BAND, HIGH_FROM, OTHER_BAND
from orbweave.operators import graph, meaning, search
from orbweave.plans.registry import registered, rounded
from orbweave.sources.tables import compositions, points, relations, table

_POINTS = "points AS (SELECT vec_id AS id, label::BIGINT AS type_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS m FROM embeddings)"
_D4 = "sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) + (z - 0.5) * (z - 0.5) + (m - 0.5) * (m - 0.5))"
_Q = ", ".join(f"floor(least(greatest(({c} + 1) / 2, 0.0), 1.0) * 4294967295.0 + 0.5)::BIGINT" for c in "xyzm")
_SLOTS = " | ".join(f"(((q[((s.axes >> {2 * d}) & 3) + 1] >> b) & 1) << {d})" for d in range(4))
#: The rounds of the curve as one reduction; words are unsigned and come out as signed keys in unsigned order.
_ROUNDS = f"""list_reduce(range(31, -1, -1), lambda s, b: list_transform([xor({_SLOTS}, s.flip)], lambda v: list_transform([xor(v, v >> 1)], lambda g:
 list_transform([CASE WHEN g >= 8 THEN 3 WHEN g >= 4 THEN 2 WHEN g >= 2 THEN 1 ELSE 0 END], lambda t: {{
 'axes': CASE WHEN g IN (0, 15) OR t = 0 THEN s.axes ELSE (s.axes & ~(3 | (3 << (2 * t)))) | ((s.axes >> (2 * t)) & 3) | ((s.axes & 3) << (2 * t)) END,
 'flip': CASE WHEN g IN (0, 15) THEN s.flip ELSE xor(s.flip, 1::BIGINT << (s.axes & 3)) END,
 'high': CASE WHEN b >= 16 THEN s.high * 16 + g ELSE s.high END, 'low': CASE WHEN b < 16 THEN s.low * 16 + g ELSE s.low END}})[1])[1])[1],
 {{'axes': 228::BIGINT, 'flip': 0::BIGINT, 'high': 0::HUGEINT, 'low': 0::HUGEINT}})"""


def _keyed(source: str) -> str:
    """SQL of ``keyed``: the rows of ``source`` with hk and lk."""
    return f"placed AS (SELECT *, [{_Q}] AS q FROM {source}), walked AS (SELECT *, {_ROUNDS} AS k FROM placed), keyed AS (SELECT *, (k.high - 9223372036854775808)::BIGINT AS hk, (k.low - 9223372036854775808)::BIGINT AS lk FROM walked)"


_BAND = "CASE " + " ".join(f"WHEN c BETWEEN {a} AND {b} THEN {v}" for a, b, v in BANDS) + f" WHEN c >= {HIGH_FROM} THEN {HIGH_BAND} ELSE {OTHER_BAND} END"
_CODES = "codes AS (SELECT DISTINCT unicode(unnest(string_split(text, '')))::BIGINT AS c FROM documents WHERE text <> '')"
_ANGLES = f"""angles AS (SELECT c, least(greatest(({_BAND} + 0.5) * {geometry.BAND!r}::DOUBLE + ((c % 1000) / 100000.0::DOUBLE) * {geometry.BAND!r}::DOUBLE * 0.1::DOUBLE, 0.001), {geometry.PI - 0.001!r}::DOUBLE) AS psi,
 least(greatest(fmod((c % 10000) * {geometry.GOLDEN!r}::DOUBLE, {geometry.PI!r}::DOUBLE), 0.001), {geometry.PI - 0.001!r}::DOUBLE) AS theta, fmod(c * {geometry.GOLDEN!r}::DOUBLE * 1.5::DOUBLE, {geometry.TWO_PI!r}::DOUBLE) AS phi FROM codes),
 coded AS (SELECT c AS id, sin(psi) * sin(theta) * cos(phi) AS x, sin(psi) * sin(theta) * sin(phi) AS y, sin(psi) * cos(theta) AS z, cos(psi) AS m FROM angles)"""


def _coded(spark, d):
    """(id, kind, value, x, y, z, m): the code points of all texts as constants."""
    texts = table(spark, d, "documents").where("text <> ''")
    codes = texts.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).distinct().select(F.ascii("ch").cast("long").alias("id"))
    return codes.select("id", F.lit(0).alias("kind"), F.col("id").alias("value"), *[p.alias(n) for p, n in zip(geometry.project_code(F.col("id")), "xyzm", strict=True)])


@registered(f"WITH {_CODES}, {_ANGLES}, {_keyed('coded')} SELECT id AS c, (hk >> 40) AS high FROM keyed")
def curve_codepoints(spark, d):
    """The first 24 bits of each code point's place: sines of two engines may differ in their last bit."""
    return curve.keyed(_coded(spark, d)).select(F.col("id").alias("c"), F.shiftright("hk", 40).alias("high"))


@registered(f"WITH {_POINTS}, {_keyed('points')} SELECT id, hk, lk FROM keyed WHERE hk >= {-(1 << 62)} AND (hk < {1 << 62} OR (hk = {1 << 62} AND lk <= 0)) ORDER BY hk, lk, id LIMIT 1000")
def hilbert_range(spark, d):
    return search.in_curve_range(curve.keyed(points(spark, d)), (-(1 << 62), -(1 << 63)), (1 << 62, 0), limit=1000).select("id", "hk", "lk")


@registered(f"WITH {_POINTS}, {_keyed('points')}, n AS (SELECT *, row_number() OVER (ORDER BY hk, lk, id) AS r FROM keyed) SELECT id, hk, lk FROM n WHERE r > 100 AND r <= 150")
def curve_page(spark, d):
    """The second page of a walk along the curve, after a first one of 100 rows."""
    rows, top = curve.keyed(points(spark, d)).select("id", "hk", "lk"), ((1 << 63) - 1, (1 << 63) - 1)
    last = search.after(rows, None, top, 100).orderBy(F.desc("hk"), F.desc("lk"), F.desc("id")).first()
    return search.after(rows, (last["hk"], last["lk"], last["id"]), top, 50)


@registered(f"WITH {_POINTS}, {_keyed('points')}, n AS (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(z) OVER o AS nz, lead(m) OVER o AS nm, lead(id) OVER o AS next_id FROM keyed WINDOW o AS (ORDER BY hk, lk, id)) SELECT id, next_id, round(sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny) + (z - nz) * (z - nz) + (m - nm) * (m - nm)), 9) AS distance FROM n WHERE next_id IS NOT NULL")
def curve_locality(spark, d):
    return rounded(search.adjacent(curve.keyed(points(spark, d))), "distance")


@registered(f"WITH {_POINTS}, {_keyed('points')} SELECT (hk >> 48) AS region, count(*) AS n, round(min(x), 9) AS min_x, round(max(y), 9) AS max_y FROM keyed GROUP BY 1")
def curve_regions(spark, d):
    return rounded(search.regions(curve.keyed(points(spark, d))).select("region", "n", "min_x", "max_y"), "min_x", "max_y")


_SPAN = 1 << 61


@registered(f"WITH {_POINTS}, {_keyed('points')}, goal AS (SELECT 0 AS id, 0.1::DOUBLE AS x, 0.1::DOUBLE AS y, 0.1::DOUBLE AS z, 0.1::DOUBLE AS m), {_keyed('goal').replace('placed', 'placed2').replace('walked', 'walked2').replace('keyed', 'aim')} SELECT k.id, round(sqrt((k.x - 0.1) * (k.x - 0.1) + (k.y - 0.1) * (k.y - 0.1) + (k.z - 0.1) * (k.z - 0.1) + (k.m - 0.1) * (k.m - 0.1)), 9) AS distance FROM keyed k, aim a WHERE k.hk::HUGEINT BETWEEN a.hk::HUGEINT - {_SPAN} AND a.hk::HUGEINT + {_SPAN} ORDER BY sqrt((k.x - 0.1) * (k.x - 0.1) + (k.y - 0.1) * (k.y - 0.1) + (k.z - 0.1) * (k.z - 0.1) + (k.m - 0.1) * (k.m - 0.1)), k.id LIMIT 10")
def hilbert_prefilter_knn(spark, d):
    return rounded(search.near_on_curve(curve.keyed(points(spark, d)), (0.1, 0.1, 0.1, 0.1), _SPAN).select("id", "distance"), "distance")


@registered(f"WITH {_POINTS}, {_keyed('points')}, q AS (SELECT k.low AS l FROM keyed WHERE id = 7) SELECT id, abs(k.low - l)::DECIMAL(20,0) AS distance FROM keyed, q")
def hilbert_distance(spark, d):
    p = points(spark, d).withColumn("k", curve.curve_key(*[F.col(c) for c in "xyzm"]))
    one = p.where("id = 7").select(F.col("k").alias("q"))  # one row
    return p.join(F.broadcast(one)).select("id", curve.low_word_distance(F.col("k"), F.col("q")).alias("distance"))


_SEED = "q AS (SELECT x AS qx, y AS qy FROM coded WHERE id = 101)"


@registered(f"WITH {_CODES}, {_ANGLES}, {_SEED} SELECT id, round(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), 6) AS distance FROM coded, q ORDER BY round(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), 9), id LIMIT 10")
def knn_code_seed(spark, d):
    return rounded(search.nearest_seed(_coded(spark, d), 101, 10).select("id", "distance"), "distance", digits=6)


@registered(f"WITH {_POINTS} SELECT a.id AS query_id, b.id, rank FROM (SELECT p.id AS pid, q.id AS qid, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) + (p.m - q.m) * (p.m - q.m)), p.id) AS rank FROM points p, points q) r JOIN points a ON a.id = r.qid JOIN points b ON b.id = r.pid WHERE rank <= 5")
def neighbour_table(spark, d):
    p = points(spark, d)
    return search.nearest_of_each(p, p, 5).select("query_id", "id", "rank")


@registered(f"WITH {_POINTS} SELECT id FROM points WHERE x BETWEEN -0.3 AND 0.1 AND y BETWEEN -0.3 AND 0.3 AND x BETWEEN -0.1 AND 0.3 AND y BETWEEN -0.1 AND 0.4")
def two_boxes(spark, d):
    return search.in_both_boxes(points(spark, d), ((-0.3, -0.3, 0, 0), (0.1, 0.3, 0, 0)), ((-0.1, -0.1, 0, 0), (0.3, 0.4, 0, 0))).select("id")


@registered(f"WITH {_POINTS} SELECT floor(x / 0.05)::BIGINT AS cell_x, floor(y / 0.05)::BIGINT AS cell_y, count(*) AS n FROM points GROUP BY 1, 2")
def density_grid(spark, d):
    return search.density(points(spark, d), 0.05)


_CORNERS = [(-0.2, -0.1), (0.1, -0.2), (0.2, 0.15), (-0.05, 0.05), (-0.15, 0.2)]


def _sides() -> str:
    ends = zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])
    return " + ".join(f"(({ay}::DOUBLE > y) <> ({by}::DOUBLE > y) AND x < ({bx - ax!r}::DOUBLE) * (y - ({ay}::DOUBLE)) / ({by - ay!r}::DOUBLE) + ({ax}::DOUBLE))::INT" for (ax, ay), (bx, by) in ends)


@registered(f"WITH {_POINTS} SELECT id FROM points WHERE ({_sides()}) % 2 = 1")
def in_polygon(spark, d):
    return points(spark, d).where(geometry.in_polygon(F.col("x"), F.col("y"), _CORNERS)).select("id")


_PATHS = "paths AS (SELECT vec_id AS id, list_transform(range(1, 17), lambda i: {'x': embedding[i]::DOUBLE, 'y': embedding[i + 16]::DOUBLE}) AS path FROM embeddings)"
_FAR = "list_max(list_transform({a}, lambda s: list_min(list_transform({b}, lambda t: sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y))))))"


def _paths(spark, d):
    """(id, path): sixteen planar points of each vector."""
    at = lambda i: F.get("embedding", i).cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(at(i).alias("x"), at(i + 16).alias("y"))).alias("path"))


def _against(spark, d, id_):
    """Each path with that of one vector: one row is broadcast."""
    p = _paths(spark, d)
    return p.join(F.broadcast(p.where(F.col("id") == id_).select(F.col("path").alias("q"))))


@registered(f"WITH {_PATHS} SELECT p.id, round(greatest({_FAR.format(a='p.path', b='q.path')}, {_FAR.format(a='q.path', b='p.path')}), 9) AS distance FROM paths p, (SELECT path FROM paths WHERE id = 7) q")
def hausdorff_paths(spark, d):
    return rounded(_against(spark, d, 7).select("id", geometry.hausdorff(F.col("path"), F.col("q")).alias("distance")), "distance")


_CELL = "greatest(sqrt((p.x - q[j].x) * (p.x - q[j].x) + (p.y - q[j].y) * (p.y - q[j].y)), coalesce(least(last[j], CASE WHEN j > 1 THEN last[j - 1] END, CASE WHEN j > 1 THEN row[j - 1] END), 0.0))"


@registered(f"WITH {_PATHS} SELECT id, round(list_reduce(path, lambda last, p: list_reduce(range(1, 17), lambda row, j: list_append(row, {_CELL}), []::DOUBLE[]), []::DOUBLE[])[16], 9) AS distance FROM (SELECT p.id, p.path, q.path AS q FROM paths p, (SELECT path FROM paths WHERE id = 7) q)")
def frechet_paths(spark, d):
    return rounded(_against(spark, d, 7).select("id", geometry.frechet(F.col("path"), F.col("q")).alias("distance")), "distance")


def _turn(p: str, q: str, r: str) -> str:
    return f"sign(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"


@registered(f"WITH {_PATHS}, seg AS (SELECT id, path[i] AS a, path[i + 1] AS b FROM (SELECT *, unnest(range(1, 16)) AS i FROM paths)) SELECT DISTINCT s.id FROM seg s, (SELECT * FROM seg WHERE id = 7) t WHERE {_turn('s.a', 's.b', 't.a')} * {_turn('s.a', 's.b', 't.b')} < 0 AND {_turn('t.a', 't.b', 's.a')} * {_turn('t.a', 't.b', 's.b')} < 0")
def crossing_paths(spark, d):
    return _against(spark, d, 7).where(geometry.paths_cross(F.col("path"), F.col("q"))).select("id")


_VECTORS = "SELECT p.id, p.x * q.x + p.y * q.y + p.z * q.z + p.m * q.m AS dot, p.x + q.x AS sum_x, p.m - q.m AS difference_m, p.y * 2.5 AS scaled_y, sqrt(p.x * p.x + p.y * p.y + p.z * p.z + p.m * p.m) AS size FROM points p, (SELECT * FROM points WHERE id = 7) q"


@registered(f"WITH {_POINTS}, v AS ({_VECTORS}) SELECT id, round(dot, 9) AS dot, round(sum_x, 9) AS sum_x, round(difference_m, 9) AS difference_m, round(scaled_y, 9) AS scaled_y, round(p.x / size, 9) AS unit_x FROM v JOIN points p USING (id)")
def vector_functions(spark, d):
    p, axes = points(spark, d), list("xyzm")
    q = p.where("id = 7").select(*[F.col(c).alias(f"q{c}") for c in axes])  # one row
    a, b = [F.col(c) for c in axes], [F.col(f"q{c}") for c in axes]
    rows = p.join(F.broadcast(q)).select(
        "id",
        geometry.dot(F.array(*a), F.array(*b)).alias("dot"),
        geometry.added(a, b)[0].alias("sum_x"),
        geometry.subtracted(a, b)[3].alias("difference_m"),
        geometry.scaled(a, 2.5)[1].alias("scaled_y"),
        geometry.normalized(F.array(*a))[0].alias("unit_x"),
    )
    return rounded(rows, "dot", "sum_x", "difference_m", "scaled_y", "unit_x")


@registered(f"WITH {_POINTS} SELECT type_id, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, round(avg(m), 9) AS m FROM points GROUP BY 1")
def centroids(spark, d):
    paths = points(spark, d).groupBy("type_id").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "z", "m"))).alias("path"))
    return rounded(paths.select("type_id", geometry.centroid(F.col("path")).alias("c")).select("type_id", "c.*"), *"xyzm")


@registered(f"WITH {_POINTS} SELECT id, floor(least(greatest((x + 1) / 2, 0.0), 1.0) * 4294967295.0 + 0.5)::BIGINT AS q, round(x, 6) AS back FROM points")
def quantized_ordinates(spark, d):
    q = geometry.quantized(F.col("x"))
    return points(spark, d).select("id", q.alias("q"), F.round(geometry.dequantized(q), 6).alias("back"))


def _integer_sql(n: str) -> str:
    keep = lambda a: f"least(greatest({a}, 0.001), {geometry.PI - 0.001!r}::DOUBLE)"
    psi = keep(f"CASE WHEN {n} >= 0 THEN {geometry.PI / 4!r}::DOUBLE ELSE {3 * geometry.PI / 4!r}::DOUBLE END + (abs({n}) % 1000) / 10000.0::DOUBLE")
    theta = keep(f"fmod(abs({n}) * {geometry.GOLDEN!r}::DOUBLE, {geometry.PI!r}::DOUBLE)")
    return f"SELECT {n} AS n, {psi} AS psi, {theta} AS theta, fmod(abs({n}) * {geometry.GOLDEN!r}::DOUBLE * 1.6180339887498948482::DOUBLE, {geometry.TWO_PI!r}::DOUBLE) AS phi"


@registered(f"WITH a AS ({_integer_sql('n')} FROM (SELECT o_orderkey - 500 AS n FROM orders)) SELECT n, round(sin(psi) * sin(theta) * cos(phi), 6) AS x, round(sin(psi) * cos(theta), 6) AS z, round(cos(psi), 6) AS m FROM a")
def project_integers(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") - 500).alias("n"))
    p = geometry.project_integer(F.col("n"))
    return rounded(rows.select("n", p[0].alias("x"), p[2].alias("z"), p[3].alias("m")), "x", "z", "m", digits=6)


@registered("SELECT count(*) AS n, count(*) AS on_sphere FROM orders")
def project_floats(spark, d):
    """Prices by the bits of their doubles; every one lies on the sphere."""
    from orbweave.functions.bits import double_bits

    rows = table(spark, d, "orders").select(double_bits(F.col("o_totalprice")).alias("b"))
    sound = geometry.is_on_sphere(geometry.project_double_bits(F.col("b")))
    return rows.agg(F.count("*").alias("n"), F.sum(sound.cast("long")).alias("on_sphere"))


_R = "relations AS (SELECT l_orderkey AS composition_id, l_linenumber AS position, l_quantity::BIGINT AS multiplicity, l_partkey AS child_id FROM lineitem)"
_CHILDREN = f"{_R}, {_POINTS}, kids AS (SELECT composition_id, position, p.* FROM relations r JOIN points p ON p.id = r.child_id)"


@registered(f"WITH {_CHILDREN} SELECT composition_id, list(round(x, 9) ORDER BY position, id) AS embedding FROM kids GROUP BY 1")
def transform_embedding(spark, d):
    e = meaning.composition_embeddings(relations(spark, d), points(spark, d))
    return e.select("composition_id", F.transform("embedding", lambda v: F.round(v, 9)).alias("embedding"))


@registered(f"WITH {_CODES} SELECT c AS id, chr(c::INT) AS said FROM codes")
def transform_text(spark, d):
    return meaning.constant_as(_coded(spark, d), "text")


@registered(f"WITH {_POINTS} SELECT id, [round(x, 9), round(y, 9), round(z, 9), round(m, 9)] AS said FROM points")
def transform_constant(spark, d):
    p = points(spark, d).withColumns({"kind": F.lit(2), "value": F.lit(0)})
    return meaning.constant_as(p, "embedding").select("id", F.transform("said", lambda v: F.round(v, 9)).alias("said"))


@registered(f"WITH {_CHILDREN} SELECT composition_id, list(round(-2 * x, 9) ORDER BY position, id) AS xs, 'mirrored' AS kind, composition_id AS source FROM kids GROUP BY 1")
def trajectory_map(spark, d):
    """Every path mirrored and doubled along x."""
    turned = lambda p: F.struct((-2 * p["x"]).alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["m"].alias("m"))
    new = meaning.mapped_paths(graph.child_paths(relations(spark, d), points(spark, d)), turned, "mirrored")
    return new.select("composition_id", F.transform("path", lambda p: F.round(p["x"], 9)).alias("xs"), "kind", "source")


_IDS = [5, 3, 12, 40]
_SEEDS = ", ".join(f"sha256('2:{i}') || '*1'" for i in _IDS)


@registered(f"WITH {_POINTS} SELECT sha256(concat_ws('|', {_SEEDS})) AS hash, 4 AS children, 'LINESTRING' AS shape, round(avg(x), 9) AS x, round(avg(m), 9) AS m FROM points WHERE id IN (5, 3, 12, 40)")
def generate_composition(spark, d):
    constants = points(spark, d).withColumns({"kind": F.lit(2), "value": F.col("id")})
    one, _ = meaning.generated_composition(constants, _IDS)
    return rounded(one.select("hash", "children", "shape", "x", "m"), "x", "m")


@registered(f"WITH {_CHILDREN}, p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM kids WINDOW w AS (PARTITION BY composition_id ORDER BY position, id)), s AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS w FROM p), g AS (SELECT composition_id, count(*) AS n, coalesce(sum(w), 0.0) AS length, sum(w * (x + px) / 2) AS lx, avg(x) AS ax FROM s GROUP BY 1) SELECT composition_id, CASE WHEN n = 1 THEN 'POINT' ELSE 'LINESTRING' END AS kind, round(length, 6) AS length, round(CASE WHEN length > 0 THEN lx / length ELSE ax END, 6) AS x FROM g")
def composition_geometry(spark, d):
    return rounded(graph.geometry_stats(relations(spark, d), points(spark, d)).select("composition_id", "kind", "length", "x"), "length", "x", digits=6)


_TREE = """edges AS (SELECT 'n' || c_nationkey AS parent, c_custkey::INT AS position, 'c' || c_custkey AS child FROM customer UNION ALL SELECT 'c' || o_custkey, o_orderkey::INT, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || l_orderkey, l_linenumber, 'p' || l_partkey FROM lineitem)"""
_WALK = f"WITH RECURSIVE {_TREE}, walk(node, depth, path) AS (SELECT 'n3', 0, []::INT[] UNION ALL SELECT child, depth + 1, list_append(path, position) FROM walk JOIN edges ON node = parent WHERE depth < 3), met AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"


def _tree(spark, d):
    tag = lambda t, a, p, pos, b, q: table(spark, d, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("parent"), F.col(pos).cast("int").alias("position"), F.concat(F.lit(q), F.col(b).cast("string")).alias("child"))
    return tag("customer", "c_nationkey", "n", "c_custkey", "c_custkey", "c").unionByName(tag("orders", "o_custkey", "c", "o_orderkey", "o_orderkey", "o")).unionByName(tag("lineitem", "l_orderkey", "o", "l_linenumber", "l_partkey", "p"))


@registered(f"{_WALK} SELECT node, depth::INT AS depth, min(path) AS path FROM walk JOIN met USING (node, depth) GROUP BY 1, 2")
def chain_preorder(spark, d):
    return graph.chain(_tree(spark, d), "n3", 3)[0]


@registered(f"{_WALK} SELECT parent, position, child FROM edges JOIN met ON node = parent WHERE depth < 3")
def chain_edges(spark, d):
    return graph.chain(_tree(spark, d), "n3", 3)[1]


@registered(f"{_WALK}, target AS (SELECT min(path) AS whole FROM walk WHERE node = 'p7' AND depth = (SELECT min(depth) FROM walk WHERE node = 'p7')), firsts AS (SELECT node, depth, min(path) AS path FROM walk JOIN met USING (node, depth) GROUP BY 1, 2) SELECT node, depth::INT AS depth FROM firsts, target WHERE whole IS NOT NULL AND path = whole[1:depth]")
def path_between(spark, d):
    return graph.shortest_ways(_tree(spark, d), "n3", "p7", 3)


_BOTH = "both_ways AS (SELECT l_orderkey AS composition_id, l_linenumber AS position, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS child_constant_id, CASE WHEN l_linenumber % 2 = 1 AND l_suppkey % 5 <> 0 THEN l_suppkey END AS child_composition_id FROM lineitem)"


def _both(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("composition_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("child_constant_id"), F.when((F.col("l_linenumber") % 2 == 1) & (F.col("l_suppkey") % 5 != 0), F.col("l_suppkey")).alias("child_composition_id")
    )


@registered(f"WITH {_BOTH} SELECT o_orderkey AS id, o_orderstatus AS type_id FROM orders WHERE o_orderkey IN (SELECT composition_id FROM both_ways WHERE child_composition_id IN (3)) ORDER BY 1 LIMIT 100")
def backlinks_composition(spark, d):
    return graph.parents_of_either(compositions(spark, d), _both(spark, d), parts=[3])


@registered(f"WITH {_BOTH} SELECT o_orderkey AS id, o_orderstatus AS type_id FROM orders WHERE o_orderkey IN (SELECT composition_id FROM both_ways WHERE child_composition_id IN (3, 4) OR child_constant_id IN (42, 43)) ORDER BY 1 LIMIT 1000")
def backlinks_either(spark, d):
    return graph.parents_of_either(compositions(spark, d), _both(spark, d), constants=[42, 43], parts=[3, 4], limit=1000)


@registered(f"WITH {_BOTH} SELECT composition_id, position, child_constant_id IS NOT NULL AS is_constant, coalesce(child_constant_id, child_composition_id) AS child_id FROM both_ways WHERE coalesce(child_constant_id, child_composition_id) IS NOT NULL")
def child_ids(spark, d):
    return graph.child_ids(_both(spark, d))


@registered("SELECT o_orderkey AS id, o_orderstatus AS type_id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS type FROM orders")
def type_lookup(spark, d):
    return graph.with_types(compositions(spark, d), spark.createDataFrame([("F", "finished"), ("O", "open")], "id string, name string")).select("id", "type_id", "type")


@registered("SELECT o_orderkey AS id, o_orderstatus AS type_id FROM orders WHERE o_orderkey = 42")
def point_lookup(spark, d):
    return graph.existing(compositions(spark, d), 42)


_Q2 = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"


@registered(f"WITH {_POINTS}, q AS (SELECT * FROM points WHERE id = 1), r AS (SELECT p.id, p.type_id, {_Q2} AS dist FROM points p, q WHERE p.id <> 1) SELECT id, type_id, round(dist, 9) AS distance, round(1.0 / (1.0 + dist), 9) AS confidence FROM r WHERE dist <= 0.2 ORDER BY dist, id LIMIT 20")
def infer_related_compositions(spark, d):
    return rounded(meaning.related_typed(points(spark, d), 1, 0.2), "distance", "confidence")
