"""Invariants and golden values of the engine."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import bits, curve, geometry, store, text
from orbweave.operators import atoms, graph, ingest, json_tree, meaning, media, search, weights
from orbweave.sources import formats
from orbweave.streaming import events

FIVE = [(1, 0.1), (2, 0.12), (3, 0.15), (4, 0.9), (5, 0.5)]
GOLDEN = {
    0x20: (-0.385206127, 0.657285964, 0.130930227, 0.634388427, 11464197896706882545, 2923883838403658330),
    0x41: (0.021732033, 0.415642793, -0.221346523, 0.881915248, 16617912168456865873, 5822606943639400311),
    0x4E00: (-0.232632166, -0.303707682, -0.918694424, -0.098206290, 1063623284899838556, 11097459238853310485),
    0x10FFFF: (0.307002872, -0.903348238, -0.073714949, -0.290305534, 1992331760680677934, 7124762025814623341),
}


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([(i, v, v, v, v) for i, v in FIVE], "id long, x double, y double, z double, m double")


def test_projection_and_curve(spark):
    df = spark.createDataFrame([(c,) for c in GOLDEN], "c long")
    p = df.select("c", *[x.alias(n) for x, n in zip(geometry.project_code(F.col("c")), "xyzm")])
    rows = p.select("*", curve.curve_of(*[F.col(n) for n in "xyzm"]).alias("k")).select("*", curve.point_of(F.col("k.high"), F.col("k.low")).alias("back")).collect()
    for r in rows:
        *xyzm, high, low = GOLDEN[r["c"]]
        assert [round(r[n], 9) for n in "xyzm"] == pytest.approx(xyzm, abs=1e-9)
        assert (r["k"]["high"] % 2**64, r["k"]["low"] % 2**64) == (high, low)
        assert [r["back"][n] for n in "xyzm"] == pytest.approx(xyzm, abs=1e-8)


def test_attention(five):
    planar = {r["id"]: r["weight"] for r in meaning.attention(five, 1, [2, 3, 4, 5]).collect()}
    assert planar == pytest.approx({2: 0.322623258, 3: 0.309839463, 5: 0.211887022, 4: 0.155650257}, abs=1e-8)
    whole = {r["id"]: r["weight"] for r in meaning.attention(five, 1, [2, 3, 4, 5], metric="all").collect()}
    assert whole == pytest.approx({2: 0.342087077, 3: 0.323427782, 5: 0.197650311, 4: 0.136834831}, abs=1e-8)
    assert sum(r["weight"] for r in meaning.multi_head_attention(five, 1, [2, 3, 4, 5]).collect()) == pytest.approx(1)


def test_related_and_analogy(spark, five):
    assert [r["id"] for r in meaning.related(five, 1, 0.2).collect()] == [2, 3]
    points = spark.createDataFrame([(30, 0.1), (31, 0.3), (32, 0.5), (33, 0.69), (34, 0.0)], "id long, v double").select("id", F.col("v").alias("x"), F.col("v").alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("m"))
    assert meaning.analogy(points, 30, 31, 32, 1).first()["id"] == 33


def test_limits(five):
    for bad in (0, -1, 1001):
        with pytest.raises(ValueError):
            search.nearest_planar(five, (0, 0), bad)
    with pytest.raises(ValueError):
        search.within(five, (0, 0, 0, 0), 0)


def test_batch_of_neighbours_is_each_alone(five):
    batch = search.nearest_of_each(five, five, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in batch if r["rank"] == 1] == [(i, i) for i, _ in FIVE]
    assert len(batch) == 10


def test_batch_of_neighbours_has_no_limit_of_queries(spark):
    rng = np.random.default_rng(9)
    at = np.round(rng.random((10_500, 4)), 2)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double, m double")
    got = search.nearest_of_each(rows.where("id < 50"), rows, 3, point_block=9).collect()
    d = np.sqrt(((at[:, None] - at[None, :50]) ** 2).sum(2).round(9))
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert len(got) == 3 * len(at)
    assert max(abs(r["distance"] - d[r["query_id"], near[r["query_id"], r["rank"] - 1]]) for r in got) < 1e-6


def test_chain(spark):
    edges = spark.createDataFrame([(100, 101), (101, 102), (102, 103), (103, 104), (104, 100)], "parent long, child long")
    root = spark.createDataFrame([(100,)], "node long")
    assert {(r["node"], r["depth"]) for r in graph.reachable(edges, root, 2).collect()} == {(100, 0), (101, 1), (102, 2)}
    assert graph.reachable(edges, root, 9).count() == 5


def test_text_round_trip(spark):
    texts = ["aaa", "abc", "aaabbbcccabc", "日本語 ελ 😀😀", "\t\n  x", "a" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ingest.text_relations(docs)
    assert {r["doc_id"]: r["text"] for r in ingest.text_of(rows).collect()} == dict(enumerate(texts))
    assert rows.where("doc_id = 0").count() == 1 and rows.where("doc_id = 1").count() == 3


def test_hash_tells_order_and_multiplicity(spark):
    docs = spark.createDataFrame([(0, "ab"), (1, "ba"), (2, "aab"), (3, "ab")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ingest.text_compositions(docs).collect()) == [0, 1, 2]


def test_doubles_with_equal_low_words_differ(spark):
    bits = [struct.unpack("<q", struct.pack("<d", v))[0] for v in (0.5, 1.0, 1.5, 2.0)]
    rows = spark.createDataFrame([(b,) for b in bits], "b long").select(text.seed_hash(F.lit(2), F.col("b")).alias("h"))
    assert rows.distinct().count() == 4


def test_grammar():
    assert ingest.grammar(list("abcabcabc")) == ([("R1", "a", "b", 3), ("R2", "R1", "c", 3), ("R3", "R2", "R2", 2)], ["R3", "R2"])
    assert ingest.grammar(list("banana")) == ([("R1", "a", "n", 2)], ["b", "R1", "R1", "a"])
    assert ingest.grammar(list("aaaaa")) == ([("R1", "a", "a", 4)], ["R1", "R1", "a"])


def test_vocabulary(spark):
    rows = ingest.vocabulary(spark.createDataFrame([("a", 0), ("<0x0A>", 1), ("the", 2)], "token string, token_id int")).collect()
    assert [(r["kind"], r["code"]) for r in sorted(rows, key=lambda r: r["token_id"])] == [("character", 97), ("byte", 10), ("piece", None)]


def test_tensor_and_wav(spark, tmp_path):
    head = json.dumps({"t": {"dtype": "F32", "shape": [4], "data_offsets": [0, 16]}}).encode()
    data = struct.pack("<Q", len(head)) + head + np.array([1, 0, -3, 4], np.float32).tobytes()
    (tmp_path / "a.safetensors").write_bytes(data)
    rows = formats.read_tensors(spark.read.format("binaryFile").load(str(tmp_path)), threshold=1e-6).orderBy("position").collect()
    assert [(r["position"], r["value"]) for r in rows] == [(0, 1), (2, -3), (3, 4)]
    wav = b"RIFF\0\0\0\0WAVEfmt \20\0\0\0\1\0" + struct.pack("<HIIHH", 1, 44100, 88200, 2, 16) + b"data\4\0\0\0" + struct.pack("<hh", -1, 12345)
    rate, channels, bits, samples = formats.wav_samples(wav)
    assert (rate, channels, bits, samples.tolist()) == (44100, 1, 16, [-1, 12345])


def test_percentile(spark):
    v = spark.createDataFrame([(float(i % 7),) for i in range(100)], "value double")
    assert ingest.percentile_value(v, 75).first()["value"] == sorted(i % 7 for i in range(100))[75]


def test_curve_key_is_the_walk(spark):
    rng = np.random.default_rng(1)
    at = [(-1.0, 1.0, 0.0, 0.5), (1.0, 1.0, 1.0, 1.0), (-1.0,) * 4, (float("nan"), 9.0, -9.0, 0.1), *map(tuple, rng.uniform(-1, 1, (200, 4)).tolist())]
    df = spark.createDataFrame(at, "x double, y double, z double, m double")
    cols = [F.col(c) for c in "xyzm"]
    rows = df.select(curve.curve_key(*cols).alias("a"), curve.curve_of(*cols).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and len({r["a"] for r in rows}) == len(at)


def test_pages_give_each_row_once(spark):
    rows = spark.createDataFrame([(i, i // 7, 3 if i % 7 < 5 else 4) for i in range(40)], "id long, hk long, lk long")
    got = [r["id"] for page in search.pages(rows, (1, 3), (4, 3), 4) for r in page]
    assert got == [i for i in range(40) if (1, 3) <= (i // 7, 3 if i % 7 < 5 else 4) <= (4, 3)]


def test_saved_keys_are_read_by_range(spark, tmp_path):
    points = spark.range(200).select("id", *[(F.sin(F.col("id") * k)).alias(c) for k, c in enumerate("xyzm", 1)])
    curve.save_keyed(points, str(tmp_path / "k"))
    back = spark.read.parquet(str(tmp_path / "k"))
    assert search.in_curve_range(back, (-(1 << 63), -(1 << 63)), ((1 << 63) - 1, (1 << 63) - 1)).count() == 200
    assert search.adjacent(back).count() == 199


def test_unknown_ids_are_errors(five, spark):
    for call in (lambda: meaning.attention(five, 99, [1]), lambda: search.similar_to(five, 99), lambda: graph.existing(five, 99), lambda: meaning.related(five, 99)):
        with pytest.raises(KeyError):
            call()
    constants = five.withColumns({"kind": F.lit(2), "value": F.col("id")})
    with pytest.raises(ValueError):
        meaning.generated_composition(constants, [1, 1])
    with pytest.raises(KeyError):
        meaning.generated_composition(constants, [1, 77])
    one, kids = meaning.generated_composition(constants, [3, 1])
    again, _ = meaning.generated_composition(constants, [1, 3])
    assert one.first()["hash"] != again.first()["hash"] and kids.count() == 2 and one.first()["shape"] == "LINESTRING"


def test_chain_is_depth_first(spark):
    edges = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, 4), (3, 0, 4), (3, 1, 5), (4, 0, 1)], "parent long, position int, child long")
    nodes, links = graph.chain(edges, 1, 5)
    assert [r["node"] for r in nodes.orderBy("path").collect()] == [1, 2, 4, 3, 5] and links.count() == 6
    assert {(r["node"], r["depth"]) for r in graph.shortest_ways(edges, 1, 5).collect()} == {(1, 0), (3, 1), (5, 2)}
    assert graph.shortest_ways(edges, 5, 1).count() == 0


def test_store_takes_content_once(spark, tmp_path):
    texts = ["aaa", "abcabcabc", "abcabc", "", None, "日本😀", "abcabcabc", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = atoms.Store(spark, str(tmp_path / "s"))
    counts = lambda: [stored.table(n).count() for n in atoms.SCHEMAS]
    flat = atoms.flat_content(docs)
    stored.add(flat)
    first = counts()
    stored.add(flat)
    stored.add(atoms.flat_content(docs.where("doc_id < 3")))
    assert counts() == first and first[1] == 5
    kept = {i: t for i, t in enumerate(texts) if t}
    assert {r["doc_id"]: r["text"] for r in stored.texts(flat.roots).collect()} == kept
    tree = atoms.hierarchical_content(docs)
    stored.add(tree)
    second = counts()
    stored.add(atoms.hierarchical_content(docs))
    assert counts() == second
    assert {r["doc_id"]: r["text"] for r in stored.texts(tree.roots).collect()} == kept
    roots = {r["doc_id"]: r["hash"] for r in flat.roots.collect()}
    assert stored.exists(roots[0]) and not stored.exists("0" * 64) and roots[1] == roots[6]
    assert [(r["position"], r["multiplicity"]) for r in stored.children(roots[0]).collect()] == [(0, 3)]
    with pytest.raises(KeyError):
        stored.children("0" * 64)
    with pytest.raises(ValueError):
        stored.parents_of_text("")


def test_json_both_ways(spark):
    docs = ['{"b":[1,2.5,{"c":null,"a":true}],"a":"x\\"y\\n","e":{},"l":[],"k.z":{"w":9}}', '["k",["s",1]]', '"plain"', "12345678901234567890", "no json", None, "[[[[1]]]]"]
    nodes = json_tree.json_nodes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, json string"))
    back = {r["doc_id"]: json.loads(r["json"]) for r in json_tree.json_texts(nodes).collect()}
    assert back == {i: json.loads(docs[i]) for i in (0, 1, 2, 3, 6)}
    kinds = {(r["doc_id"], r["path"]): r["kind"] for r in nodes.collect()}
    assert kinds[0, "$.b[0]"] == "integer" and kinds[0, "$.b[1]"] == "float" and kinds[3, "$"] == "float" and kinds[0, "$.e"] == "object" and kinds[0, '$["k.z"].w'] == "integer"
    assert ("float", "2.5") in {tuple(r) for r in json_tree.json_primitives(nodes).collect()}


def test_media_both_ways(spark):
    contents = [b"\0\0\0\1\1\1\2\2\2", b"", bytes(range(256)) * 40, None]
    files = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "id long, content binary")
    parts = media.binary_parts(files)
    assert {r["id"]: bytes(r["content"]) for r in media.binary_of(parts).collect()} == {i: c for i, c in enumerate(contents) if c is not None}
    assert [(r["value"], r["multiplicity"]) for r in media.flat(parts).where("id = 0").orderBy("position").collect()] == [(0, 3), (1, 3), (2, 3)]
    tracks = spark.createDataFrame([(1, [-32768, -5, -5, 32767], 44100, 2, 16)], "id long, samples array<short>, rate int, channels int, bits int")
    cut = media.audio_parts(tracks, 3)
    assert media.audio_of(cut).first()["samples"] == [-32768, -5, -5, 32767]
    assert [(r["part"], r["value"], r["multiplicity"]) for r in media.flat(cut).orderBy("part", "position").collect()] == [(0, 0, 1), (0, 32763, 2), (1, 65535, 1)]
    images = spark.createDataFrame([(1, 2, 2, [9, 9, 9, 8])], "id long, width int, height int, pixels array<int>")
    assert media.flat(media.image_parts(images)).count() == 3 and media.image_of(media.image_parts(images)).first()["pixels"] == [9, 9, 9, 8]
    films = images.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("frame"), "width", "height", F.lit(29.97).alias("fps"), "pixels")
    assert [(r["frame"], r["fps"], r["pixels"]) for r in media.video_of(media.video_parts(films)).orderBy("frame").collect()] == [(k, 29.97, [9, 9, 9, 8]) for k in (0, 1)]


def test_bits(spark):
    values = [0.0, -0.0, 1.5, -2.25, 3e-40, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    r = rows.select(bits.double_of_bits(bits.double_bits(F.col("v"))).alias("d"), bits.float_of_bits(bits.float_bits(F.col("v").cast("float"))).alias("f"), "v").collect()
    assert all(x["d"] == x["v"] and x["f"] == np.float32(x["v"]) for x in r)
    one = spark.range(1).select(bits.rate_of(bits.fixed_rate(F.lit(29.97))).alias("r"), bits.epoch_seconds(F.lit("1970-01-02 00:00:00").cast("timestamp")).alias("e"), bits.sample_of(bits.sample_code(F.lit(-7))).alias("s")).first()
    assert (one["r"], one["e"], one["s"]) == (29.97, 86400, -7)


def test_text_functions(spark):
    pairs = [("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("", "x"), ("日本😀x", "日本😀y")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(text.first_difference(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in rows] == [None, 2, 2, 0, 3]
    kids = F.array(F.struct(F.lit("h").alias("hash"), F.lit(1).alias("multiplicity"), F.lit(True).alias("is_constant")))
    other = F.array(F.struct(F.lit("h").alias("hash"), F.lit(1).alias("multiplicity"), F.lit(False).alias("is_constant")))
    h = spark.range(1).select(text.typed_composition_hash(kids, F.lit("a")).alias("a"), text.typed_composition_hash(kids, F.lit("b")).alias("b"), text.typed_composition_hash(other, F.lit("a")).alias("c")).first()
    assert len({h["a"], h["b"], h["c"]}) == 3
    assert spark.range(1).select(text.shortened(F.lit("x" * 101))).first()[0] == "x" * 100 + "..."


def test_path_functions(spark):
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0))])
    flat = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 1.0), (5.0, 1.0))])
    r = spark.range(1).select(geometry.path_length(line).alias("n"), geometry.path_centre(line).alias("c"), geometry.paths_cross(line, flat).alias("cross"), geometry.hausdorff(line, flat).alias("h"), geometry.frechet(line, flat).alias("f")).first()
    assert r["n"] == 6 and (round(r["c"]["x"], 9), round(r["c"]["y"], 9)) == (round(16 / 6, 9), round(2 / 6, 9)) and r["cross"] and r["h"] == pytest.approx(2**0.5) and r["f"] >= r["h"]
    assert not spark.range(1).select(geometry.paths_cross(flat, flat).alias("x")).first()["x"]


def test_weights(spark, five):
    links = spark.createDataFrame([(1, 2, 0.1), (1, 99, 0.5)], "source_id long, target_id long, weight double")
    edge = weights.weight_values(weights.weight_edges(links, five)).collect()
    assert [(r["target_id"], r["weight"]) for r in edge] == [(2, float(np.float32(0.1)))]
    with pytest.raises(ValueError):
        weights.weight_edges(links, five, kind="text")
    rows = spark.createDataFrame([(0, [0.5, -0.001], 3), (1, [-0.2, 0.9], 4)], "row int, weights array<double>, head int")
    ids = spark.createDataFrame([(0, 10), (1, 11)], "place int, id long")
    assert {tuple(r) for r in weights.matrix_edges(rows, ids, keep=("head",)).collect()} == {(10, 10, 0.5, 3), (11, 10, -0.2, 4), (11, 11, 0.9, 4)}


def test_files_by_kind(spark, tmp_path):
    wav = b"RIFF\0\0\0\0WAVEfmt \20\0\0\0\1\0" + struct.pack("<HIIHH", 1, 44100, 88200, 2, 16) + b"data\4\0\0\0" + struct.pack("<hh", -1, 12345)
    for name, data in {"a.txt": b"h\xc3\xa9", "b.json": b"[1]", "c.WAV": wav, "d.wav": b"RIFF", "e.png": b"\x89", "f.bin": b"\0\1"}.items():
        (tmp_path / name).write_bytes(data)
    kinds = formats.taken_in(spark, str(tmp_path))
    assert {k: v.count() for k, v in kinds.items()} == {"text": 1, "json": 1, "audio": 2, "image": 1, "binary": 1}
    assert kinds["text"].first()["text"] == "hé"
    sound = {r["path"][-5:]: r for r in kinds["audio"].collect()}
    assert sound["c.WAV"]["samples"] == [-1, 12345] and sound["d.wav"]["error"]


def test_tensors_by_ranges(spark, tmp_path):
    v = np.arange(-50, 50, dtype=np.float32)
    head = json.dumps({"wte.x": {"dtype": "F32", "shape": [100], "data_offsets": [0, 400]}, "b": {"dtype": "BF16", "shape": [2], "data_offsets": [400, 404]}, "i": {"dtype": "I64", "shape": [0], "data_offsets": [404, 404]}}).encode()
    (tmp_path / "a.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + v.tobytes() + struct.pack("<HH", 0x3F80, 0xC000))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    assert formats.tensor_ranges(files, step=64).count() == 8
    cells = formats.read_tensors(files)
    whole = {r["tensor"]: (r["class"], r["vector"]) for r in formats.tensor_vectors(cells).collect()}
    assert whole == {"wte.x": ("embedding", v.tolist()), "b": ("weight", [1.0, -2.0])}
    assert formats.read_tensors(files, threshold=49).where("tensor = 'wte.x'").count() == 3
    places = cells.where("tensor = 'b'").select("position", "value", F.lit(1).alias("id"))
    moved = places.withColumn("position", F.col("position") + 1)
    assert ingest.sparse_hash(places).first()["hash"] != ingest.sparse_hash(moved).first()["hash"]


def test_batches_add_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, "x") for i in range(5 * k, 5 * k + 8)], "id long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), "id long, v string", files_per_trigger=1)
    sink = str(tmp_path / "out")
    query = events.micro_batches(stream, lambda batch, n: events.merge_new(batch, sink, "id"), str(tmp_path / "log"))
    query.awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 18 == out.select("id").distinct().count() and len(query.recentProgress) >= 3
    events.merge_new(spark.createDataFrame([(1, "y"), (99, "z"), (99, "z")], "id long, v string"), sink, "id")
    assert spark.read.parquet(sink).count() == 19


def test_scratch_tables_go(spark):
    with store.Scratch(spark) as scratch:
        kept = store.settled(scratch.settled(spark.range(5)).where("id > 1"))
        folder = scratch.folders[0]
    import os

    assert kept.count() == 3 and not os.path.exists(folder.removeprefix("file:"))
