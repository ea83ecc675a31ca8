"""Queries on content: storage, hierarchical texts, JSON, media, tensors, registrations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orbweave.functions import bits, text
from orbweave.functions.store import shared_dir
from orbweave.operators import atoms, ingest, json_tree, media, weights
from orbweave.plans.registry import registered, rounded
from orbweave.sources.formats import tensor_class
from orbweave.sources.tables import points, table


def _texts(spark, d):
    return table(spark, d, "documents").where("text <> ''").select("doc_id", "text")


def _store(spark):
    return atoms.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


_RUNS = """codes AS (SELECT doc_id, i, unicode(s[i])::BIGINT AS value FROM (SELECT doc_id, string_split(text, '') AS s, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text <> '')),
 marks AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS opens FROM codes),
 islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marks),
 runs AS (SELECT doc_id, (island - 1)::INT AS position, any_value(value) AS value, count(*) AS multiplicity FROM islands GROUP BY doc_id, island),
 roots AS (SELECT doc_id, sha256(string_agg(sha256('0:' || value) || '*' || multiplicity, '|' ORDER BY position)) AS hash FROM runs GROUP BY doc_id)"""


@registered("SELECT DISTINCT sha256('0:' || unicode(c)) AS hash, 0 AS kind, unicode(c)::BIGINT AS value FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')")
def store_constants(spark, d):
    store = _store(spark)
    store.add(atoms.flat_content(_texts(spark, d)))
    return store.table("constants")


@registered(f"WITH {_RUNS} SELECT r.hash, 'text' AS kind, count(*)::INT AS children FROM (SELECT hash, min(doc_id) AS doc_id FROM roots GROUP BY 1) r JOIN runs USING (doc_id) GROUP BY 1")
def store_compositions(spark, d):
    """Two ingestions of the same texts store each composition once."""
    store, content = _store(spark), atoms.flat_content(_texts(spark, d))
    store.add(content)
    store.add(content)
    return store.table("compositions")


@registered(f"WITH {_RUNS} SELECT r.hash AS parent, position, sha256('0:' || value) AS child, multiplicity FROM (SELECT hash, min(doc_id) AS doc_id FROM roots GROUP BY 1) r JOIN runs USING (doc_id)")
def store_relations(spark, d):
    store = _store(spark)
    store.add(atoms.flat_content(_texts(spark, d)))
    return store.table("relations").select("parent", "position", "child", "multiplicity")


@registered("SELECT doc_id, text FROM documents WHERE text <> ''")
def hierarchy_roundtrip(spark, d):
    """Texts by their grammars, stored, and spelt from the store again."""
    store, content = _store(spark), atoms.hierarchical_content(_texts(spark, d))
    store.add(content)
    return store.texts(content.roots, whole=True)


@registered("SELECT doc_id, true AS equal, length(text)::BIGINT AS length, length(text)::BIGINT AS exported_length, NULL::INT AS first_difference FROM documents WHERE text <> ''")
def export_verified(spark, d):
    docs = _texts(spark, d)
    return atoms.verified(docs, ingest.text_of(ingest.text_relations(docs)))


@registered(f"WITH {_RUNS} SELECT doc_id, round(length(text)::DOUBLE / n, 9) AS ratio FROM (SELECT doc_id, count(*) AS n FROM runs GROUP BY 1) JOIN documents USING (doc_id)")
def compression_ratio(spark, d):
    docs = _texts(spark, d)
    return rounded(atoms.compression(atoms.flat_content(docs), docs), "ratio")


@registered("WITH t AS (SELECT text FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 1) SELECT DISTINCT 'page' || (doc_id % 7) AS parent FROM documents WHERE text = (SELECT text FROM t)")
def pattern_parents(spark, d):
    """Compositions (here: pages of texts) that hold the composition of a text."""
    docs = _texts(spark, d)
    content = atoms.flat_content(docs)
    held = content.roots.select(F.concat(F.lit("page"), (F.col("doc_id") % 7).cast("string")).alias("parent"), F.col("doc_id").cast("int").alias("position"), F.col("hash").alias("child"), F.lit(False).alias("is_constant"), F.lit(1).cast("long").alias("multiplicity"))
    store = _store(spark)
    store.add(content.beside(held))
    return store.parents_of_text(docs.orderBy("doc_id").first()["text"])


_NAMED = "named AS (SELECT text, count(*) AS uses FROM documents WHERE text <> '' GROUP BY 1 ORDER BY uses DESC, sha256(text) LIMIT 20)"


@registered(f"WITH {_NAMED} SELECT CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS text, uses FROM named")
def pattern_usage_text(spark, d):
    """The texts that are referred to most, shortened."""
    used = _texts(spark, d).groupBy("text").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), F.sha2("text", 256)).limit(20)
    return used.select(text.shortened(F.col("text")).alias("text"), "uses")


_CONV = "conv AS (SELECT conv_id AS doc_id, to_json({'id': conv_id, 'turns': list({'role': role, 'text': text, 'turn': turn} ORDER BY turn)}) AS json FROM conversations GROUP BY conv_id)"


def _conversations_json(spark, d):
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.struct(F.col("doc_id").alias("id"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["turn"].alias("turn"))).alias("turns"))
    return turns.select("doc_id", F.to_json(said, {"ignoreNullFields": "false"}).alias("json"))


@registered(f"""WITH {_CONV}, tree AS (SELECT doc_id, unnest(json_each) AS e FROM (SELECT doc_id, list(t) AS json_each FROM conv, json_tree(json) t GROUP BY doc_id))
 SELECT doc_id, e.fullkey AS path, CASE e.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'integer' END AS kind, e.atom ->> '$' AS value FROM tree""")
def json_decompose(spark, d):
    return json_tree.json_nodes(_conversations_json(spark, d)).select("doc_id", "path", "kind", "value")


@registered(f"WITH {_CONV} SELECT doc_id, json::VARCHAR AS json FROM conv")
def json_roundtrip(spark, d):
    return json_tree.json_texts(json_tree.json_nodes(_conversations_json(spark, d)))


@registered("SELECT DISTINCT 'character' AS kind, unicode(c)::VARCHAR AS value FROM (SELECT unnest(string_split(s, '')) AS c FROM (SELECT text AS s FROM conversations UNION ALL SELECT role FROM conversations) WHERE s <> '') UNION SELECT DISTINCT 'integer', conv_id::VARCHAR FROM conversations UNION SELECT DISTINCT 'integer', turn::VARCHAR FROM conversations")
def json_primitives(spark, d):
    return json_tree.json_primitives(json_tree.json_nodes(_conversations_json(spark, d)))


@registered("SELECT doc_id, to_json(text)::VARCHAR AS said FROM documents WHERE text <> ''")
def json_escape(spark, d):
    return _texts(spark, d).select("doc_id", text.json_escaped(F.col("text")).alias("said"))


def _islands(source: str) -> str:
    """SQL of runs of ``source`` (id, part, i, value)."""
    return f"""cells AS ({source}), marks AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY id, part ORDER BY i) THEN 0 ELSE 1 END AS opens FROM cells),
 islands AS (SELECT *, sum(opens) OVER (PARTITION BY id, part ORDER BY i) AS island FROM marks)
 SELECT id, part::INT AS part, (island - 1)::INT AS position, any_value(value)::BIGINT AS value, count(*) AS multiplicity FROM islands GROUP BY id, part, island"""


def _files(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.encode("text", "UTF-8").alias("content"))


@registered("WITH h AS (SELECT item_id AS id, hex(encode(text)) AS h FROM benchmark WHERE text <> ''), " + _islands("SELECT id, (k - 1) // 256 AS part, k AS i, ('0x' || h[2 * k - 1 : 2 * k])::INT AS value FROM (SELECT id, h, unnest(range(1, length(h) // 2 + 1)) AS k FROM h)"))
def ingest_binary_chunks(spark, d):
    return media.flat(media.binary_parts(_files(spark, d), 256))


@registered("SELECT item_id AS id, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS length FROM benchmark WHERE text IS NOT NULL")
def binary_roundtrip(spark, d):
    back = media.binary_of(media.binary_parts(_files(spark, d), 256))
    return back.select("id", text.bytes_hash(F.col("content")).alias("hash"), F.length("content").cast("long").alias("length"))


def _tracks(spark, d):
    samples = F.transform("embedding", lambda v: F.floor(v.cast("double") * 20).cast("short"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), samples.alias("samples"), F.lit(44100).alias("rate"), F.lit(1).alias("channels"), F.lit(16).alias("bits"))


_SAMPLES = "SELECT vec_id AS id, i, floor(embedding[i]::DOUBLE * 20)::INT AS s FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"


@registered("WITH s AS (" + _SAMPLES + "), " + _islands("SELECT id, (i - 1) // 16 AS part, i, s + 32768 AS value FROM s"))
def ingest_audio_frames(spark, d):
    return media.flat(media.audio_parts(_tracks(spark, d), 16))


@registered(f"WITH s AS ({_SAMPLES}) SELECT id, list(s ORDER BY i) AS samples, 44100 AS rate, 1 AS channels, 16 AS bits FROM s GROUP BY id")
def audio_roundtrip(spark, d):
    return media.audio_of(media.audio_parts(_tracks(spark, d), 16)).withColumn("samples", F.col("samples").cast("array<int>"))


def _images(spark, d):
    pixels = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 8).cast("int"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), pixels.alias("pixels"))


_PIXELS = "SELECT vec_id AS id, i, floor((embedding[i]::DOUBLE + 1) * 8)::BIGINT AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"


@registered("WITH s AS (" + _PIXELS + "), " + _islands("SELECT id, (i - 1) // 8 AS part, i, v AS value FROM s"))
def ingest_image_rows(spark, d):
    return media.flat(media.image_parts(_images(spark, d)))


@registered(f"WITH s AS ({_PIXELS}) SELECT id, 8 AS width, 8 AS height, list(v ORDER BY i) AS pixels FROM s GROUP BY id")
def image_roundtrip(spark, d):
    return media.image_of(media.image_parts(_images(spark, d)))


def _films(spark, d):
    image = _images(spark, d)
    return image.select(F.floor(F.col("id") / 10).alias("id"), (F.col("id") % 10).cast("int").alias("frame"), "width", "height", F.lit(23.976).alias("fps"), "pixels")


@registered(f"WITH s AS ({_PIXELS}) SELECT id // 10 AS id, (id % 10)::INT AS frame, 8 AS width, 8 AS height, 23.976::DOUBLE AS fps, list(v ORDER BY i) AS pixels FROM s GROUP BY s.id")
def video_roundtrip(spark, d):
    return media.video_of(media.video_parts(_films(spark, d)))


@registered("WITH s AS (" + _PIXELS + "), " + _islands("SELECT id // 10 AS id, (id % 10) * 8 + (i - 1) // 8 AS part, i, v AS value FROM s"))
def ingest_video_frames(spark, d):
    return media.flat(media.video_parts(_films(spark, d)))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@registered("SELECT vec_id AS id, embedding AS vector FROM embeddings")
def embedding_roundtrip(spark, d):
    return media.vector_of(media.vector_cells(_vectors(spark, d)))


@registered("SELECT vec_id AS id, list_transform(embedding, lambda v: CASE WHEN abs(v::DOUBLE) >= 0.1 THEN v ELSE 0::FLOAT END) AS vector FROM embeddings WHERE len(list_filter(embedding, lambda v: abs(v::DOUBLE) >= 0.1)) > 0")
def sparse_tensor_roundtrip(spark, d):
    return media.vector_of(ingest.sparse_cells(_vectors(spark, d), 0.1), 64)


@registered("WITH v AS (SELECT vec_id AS id, (i - 1)::INT AS position, embedding[i] AS value, abs(embedding[i]::DOUBLE) AS a FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), t AS (SELECT a FROM (SELECT a, row_number() OVER (ORDER BY a) - 1 AS k, count(*) OVER () AS n FROM v) WHERE k = n * 75 // 100) SELECT id, position, value FROM v, t WHERE v.a >= t.a")
def auto_threshold_tensor(spark, d):
    return ingest.above_percentile(_vectors(spark, d), 75)


@registered("SELECT p_name AS name, count(*) AS n, CASE WHEN lower(p_name) LIKE '%embed%' OR lower(p_name) LIKE '%wte%' THEN 'embedding' ELSE 'weight' END AS class FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'Layer.Embed.' || p_brand WHEN p_size % 3 = 1 THEN 'WTE.' || p_brand ELSE p_brand END AS p_name FROM part) GROUP BY 1")
def tensor_classes(spark, d):
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Layer.Embed."), "p_brand")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("WTE."), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n")).withColumn("class", tensor_class(F.col("name")))


@registered("SELECT vec_id AS id, (i - 1)::INT AS position, embedding[i] AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def float_bits_roundtrip(spark, d):
    cells = media.vector_cells(_vectors(spark, d)).withColumn("bits", bits.float_bits(F.col("value")))
    return cells.select("id", "position", bits.float_of_bits(F.col("bits")).alias("value"))


@registered("WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents) SELECT token, (i - 1)::INT AS position, unicode(token[i])::BIGINT AS code FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM t WHERE length(token) > 1)")
def vocab_parts(spark, d):
    tokens = table(spark, d, "documents").select(F.explode_outer(F.split("text", " ")).alias("token")).where("token <> ''").distinct()
    return ingest.vocabulary_parts(tokens.withColumn("token_id", F.lit(0)))


_SESSION = "sha256('session|{\"conv_id\":' || conv_id || '}')"
_TURN = "sha256('turn|{\"conv_id\":' || conv_id || ',\"turn\":' || turn || '}')"


@registered(f"SELECT DISTINCT conv_id, {_SESSION} AS node FROM conversations")
def register_sessions(spark, d):
    return atoms.registered_nodes(table(spark, d, "conversations").select("conv_id"), "session", ["conv_id"])


@registered(f"SELECT DISTINCT {_SESSION} AS parent, turn AS position, {_TURN} AS child FROM conversations")
def turn_edges(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    return atoms.turn_edges(atoms.registered_nodes(rows.select("conv_id"), "session", ["conv_id"]), atoms.registered_nodes(rows, "turn", ["conv_id", "turn"]), "conv_id", "turn")


_ENDS = "SELECT DISTINCT l_suppkey AS source_id, l_partkey AS target_id, l_quantity AS weight FROM lineitem"
_P = "points AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS m FROM embeddings)"


def _links(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_quantity").alias("weight")).distinct()


@registered(f"WITH {_P}, e AS ({_ENDS}) SELECT source_id, target_id, 'float' AS kind, weight::DOUBLE AS weight, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS length, round((a.x + b.x) / 2, 9) AS x, round((a.m + b.m) / 2, 9) AS m FROM e JOIN points a ON a.id = source_id JOIN points b ON b.id = target_id")
def weight_edges(spark, d):
    edges = weights.weight_values(weights.weight_edges(_links(spark, d), points(spark, d)))
    return rounded(edges.select("source_id", "target_id", "kind", "weight", "length", "x", "m"), "length", "x", "m")


@registered(f"WITH {_P}, e AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS target_id, l_linenumber AS weight FROM lineitem) SELECT source_id, target_id, weight::DOUBLE AS weight FROM e JOIN points a ON a.id = source_id JOIN points b ON b.id = target_id")
def edge_weight(spark, d):
    whole = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("weight")).distinct()
    return weights.weight_values(weights.weight_edges(whole, points(spark, d), kind="integer")).select("source_id", "target_id", "weight")


@registered("SELECT vec_id * 1000 AS source_id, (i - 1) * 1000 AS target_id, embedding[i]::DOUBLE AS weight, label AS head FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id < 64) WHERE abs(embedding[i]::DOUBLE) >= 0.05 AND i - 1 < 60")
def attention_matrix(spark, d):
    """The first 64 vectors as one 64 x 64 matrix with a head for each row; columns from 60 on have no name."""
    rows = table(spark, d, "embeddings").where("vec_id < 64").select(F.col("vec_id").alias("row"), F.col("embedding").alias("weights"), F.col("label").alias("head"))
    named = spark.range(64).select(F.col("id").alias("place"), (F.col("id") * 1000).alias("id"))
    kept = weights.matrix_edges(rows, named, threshold=0.05, keep=("head",))
    return kept.where("target_id < 60000")


@registered("WITH s AS (SELECT l_partkey AS node, sum(l_discount) AS value FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY 1) SELECT l_orderkey AS node, round(sum(value * l_tax), 6) AS value FROM s JOIN lineitem ON node = l_partkey GROUP BY 1")
def forward_propagation(spark, d):
    """From three suppliers over parts to orders."""
    li = table(spark, d, "lineitem")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = li.select(tag("s", "l_suppkey").alias("parent"), tag("p", "l_partkey").alias("child"), F.col("l_discount").alias("weight")).unionByName(
        li.select(tag("p", "l_partkey").alias("parent"), tag("o", "l_orderkey").alias("child"), F.col("l_tax").alias("weight"))
    )
    active = spark.createDataFrame([("s1", 1.0), ("s2", 1.0), ("s3", 1.0)], "node string, value double")
    return rounded(weights.propagated(edges, active, 2).select(F.substring("node", 2, 20).cast("long").alias("node"), "value"), "value", digits=6)
