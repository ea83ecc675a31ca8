"""What the operators send through shuffles and hold in memory."""

import numpy as np

from orbweave.functions.text import code_points, composition_hash, hash_of_text, run_array, seed_hash
from orbweave.functions import store as store_of_tables
from orbweave.operators import ingest
from pyspark.sql import functions as F

TEXTS = ["aaa b\n\nc", "héé😀😀\u2028é", "x" * 70_000 + "yz", "ab" * 40_000, "a"]


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_grammar_of_few_symbols_is_counted_without_sorting(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc "), 300)) for _ in range(5)] + ["aaaa", "ab", "a", ""]
    sorted_ = [ingest.grammar(list(t), dense=0) for t in texts]
    monkeypatch.setattr(np, "unique", None)
    assert [ingest.grammar(list(t)) for t in texts] == sorted_


def test_a_grammar_ends_where_no_pair_comes_twice(spark):
    """No rule is cut off, by whichever way pairs are counted; the first rules are those of a grammar cut short."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh "), 2000)), "the cat in the hat " * 3, "a" * 9, "ab" * 7, ""]
    expected = []
    for i, t in enumerate(texts):
        rules, seq = ingest.grammar(list(t))
        assert (rules, seq) == ingest.grammar(list(t), few=-1) == ingest.grammar(list(t), few=10**6)
        assert all(seq[k : k + 2] not in [seq[j : j + 2] for j in range(k)] for k in range(1, len(seq) - 1))
        cut = ingest.grammar(list(t), 30, few=-1)
        assert cut[0] == rules[:30] and cut == ingest.grammar(list(t), 30)
        expected += [(i, k, a, b, n, len(seq)) for k, (_, a, b, n) in enumerate(rules, 1)]
    assert len(expected) > 150
    assert sorted(map(tuple, ingest.grammar_rules(_docs(spark, texts)).collect())) == expected


def test_runs_are_found_without_a_function_per_character(spark):
    rows = ingest.text_relations(_docs(spark))
    assert "lambda" not in _plan(rows).lower()
    got = [(r["position"], r["value"], r["multiplicity"]) for r in rows.where("doc_id = 1").orderBy("position").collect()]
    assert got == [(0, 104, 1), (1, 233, 2), (2, 0x1F600, 2), (3, 0x2028, 1), (4, 233, 1)]
    assert rows.where("doc_id = 2").count() == 3 and rows.where("doc_id = 3").count() == 80_000


def test_hash_of_a_text_is_that_of_its_runs(spark):
    docs = _docs(spark, ["aab", "é😀😀", "q" * 12 + "\n"]).select("doc_id", "text", code_points(F.col("text")).alias("c"))
    kids = F.transform(run_array(F.col("c")), lambda p: F.struct(seed_hash(F.lit(0), p["value"]).alias("hash"), p["multiplicity"].alias("multiplicity")))
    assert all(hash_of_text(r["text"])[0] == r["h"] for r in docs.select("text", composition_hash(kids).alias("h")).collect())
    assert "lambda" not in _plan(ingest.text_compositions(_docs(spark))).lower()


def test_rows_that_lie_together_are_spelt_before_the_shuffle(spark):
    """A text of one batch is one piece; in any other order, texts are the same."""
    rows = ingest.text_relations(_docs(spark, ["abcab", "a😀a", "zz" * 50])).coalesce(1)
    pieces = rows.select("doc_id", F.col("position").cast("long"), "value", "multiplicity").mapInArrow(ingest._said, "doc_id long, position long, said string")
    assert pieces.count() == 3
    texts = {0: "abcab", 1: "a😀a", 2: "zz" * 50}
    for order in (["doc_id", "position"], [F.desc("position")], [F.rand(3)]):
        assert {r["doc_id"]: r["text"] for r in ingest.text_of(rows.orderBy(*order)).collect()} == texts
    odd = spark.createDataFrame([(1 << 60, 0, 97, 2), ((1 << 60) + 1, 1, 98, 1), (1 << 60, 1, None, 3), (1 << 60, 2, 99, 0), (None, 0, 100, 1)], "doc_id long, position int, value long, multiplicity long").coalesce(1)
    assert {r["doc_id"]: r["text"] for r in ingest.text_of(odd).collect()} == {1 << 60: "aa", (1 << 60) + 1: "b", None: "d"}


def test_whole_compositions_are_not_compared_by_row(spark, tmp_path):
    """Relations of texts go into the store without a shuffle of each; a call cut short is made whole."""
    from orbweave.operators import atoms

    docs = _docs(spark, ["aab", "aab", "é😀😀 b", "q" * 12 + "\n"])
    content = atoms.flat_content(docs)
    assert set(content.wholes.columns) == {"parent", "text"}
    store = atoms.Store(spark, str(tmp_path / "s"))
    cut = content.relations.where("position = 0")
    store._add_rows("relations", cut)
    for _ in range(2):
        store.add(content)
        assert store.table("relations").count() == 2 + 4 + 2 == store.table("relations").select("parent", "position").distinct().count()
        assert store.table("compositions").count() == 3 and store.table("constants").count() == 7
    store.add(content.beside(cut.withColumn("parent", F.lit("page"))))
    assert store.table("relations").count() == 9 and store.table("relations").where("parent = 'page'").count() == 1
    assert sorted(r["text"] for r in store.texts(content.roots).collect()) == sorted(r["text"] for r in docs.collect())


def test_only_what_others_are_made_of_takes_rounds(spark, tmp_path, monkeypatch):
    """Rows of a root are folded and spelt in one pass after the rounds."""
    from orbweave.operators import atoms

    docs = _docs(spark, ["the cat in the hat the cat", "banana bandana", "abcabcabc" * 20, "zz", "a", "xyz"])
    content = atoms.hierarchical_content(docs)
    store = atoms.Store(spark, str(tmp_path / "t"))
    store.add(content)
    seen, plain = [], atoms._spelt_by
    monkeypatch.setattr(atoms, "_spelt_by", lambda s, k: seen.append({r["parent"] for r in s.collect()}) or plain(s, k))
    for whole in (True, False):
        seen.clear()
        got = store.texts(content.roots, whole=whole)
        assert {r["doc_id"]: r["text"] for r in got.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
        assert not any(seen[-1] & s for s in seen[:-1]) and seen[-1] <= {r["hash"] for r in content.roots.collect()}


def test_deep_compositions_are_spelt_in_few_rounds(spark, tmp_path, monkeypatch):
    """Eleven rules that stand in each other are not eleven rounds; texts are dealt out whatever the file's parts."""
    from orbweave.operators import atoms

    docs = _docs(spark, ["ab" * 2048 + "c", "ab" * 1500, "abcabd" * 3])
    content = atoms.hierarchical_content(docs.coalesce(1))
    store = atoms.Store(spark, str(tmp_path / "d"))
    store.add(content)
    calls, plain = [], atoms.settled
    monkeypatch.setattr(atoms, "settled", lambda df, **how: calls.append(1) or plain(df, **how))
    got = store.texts(content.roots, whole=True)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(calls) < 12
    dealt = store_of_tables.dealt(docs.coalesce(1), "doc_id")
    assert dealt.rdd.getNumPartitions() == 4


def test_relations_of_texts_are_kept_nested(spark, tmp_path):
    """One row for up to 4096 places, told as rows and looked for as if it were those."""
    from orbweave.operators import atoms

    docs = _docs(spark, ["aab", "ab" * 5000 + "é", "q" * 9])
    content = atoms.flat_content(docs)
    store = atoms.Store(spark, str(tmp_path / "n"))
    store.add(content)
    assert store._read("relations").isEmpty() and store._read("stretches").count() == 1 + 3 + 1
    rows = store.table("relations")
    assert rows.count() == 2 + 10_001 + 1 == rows.select("parent", "position").distinct().count()
    codes = {r["hash"]: r["value"] for r in store.table("constants").collect()}
    by_doc = content.roots.withColumnRenamed("hash", "parent").join(rows, "parent").select("doc_id", "position", "child", "multiplicity").collect()
    assert sorted((r[0], r[1], codes[r[2]], r[3]) for r in by_doc) == sorted(map(tuple, ingest.text_relations(docs).collect()))
    assert {r["doc_id"]: r["text"] for r in store.texts(content.roots).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    roots = {r["doc_id"]: r["hash"] for r in content.roots.collect()}
    assert {r["parent"] for r in store.parents_of_text("q").collect()} == {roots[2]} and store.children(roots[1]).count() == 10_001
    store.add(content.beside(spark.createDataFrame([("page", 0, roots[0], False, 1), (roots[0], 0, "other", True, 1)], rows.schema)))
    assert store.table("relations").count() == rows.count() + 1
    assert [r["parent"] for r in store.parents_of_text("aab").collect()] == ["page"]


def test_a_query_meets_only_cells_in_reach(spark):
    """Exact as all pairs are, ties and points without an ordinate included."""
    from orbweave.operators import search

    rng = np.random.default_rng(5)
    p = np.round(rng.normal(size=(400, 4)), 1)
    p[:60] = p[0]
    rows = [(i, *map(float, r)) for i, r in enumerate(p)] + [(400, None, 0.0, 0.0, 0.0), (401, 9.0, 9.0, 9.0, 9.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, m double")
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.nearest_of_each(points, points, 5, point_block=40, query_block=30).collect()}
    whole = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    for q in range(len(rows)):
        d = np.sqrt(sum((whole[:, c] - whole[q, c]) ** 2 for c in range(4)))
        assert [got[q, r] for r in range(1, 6)] == np.argsort(d, kind="stable")[:5].tolist()
    axis, bound = search._halves(p, 3)
    assert len(axis) == len(bound) == 7
