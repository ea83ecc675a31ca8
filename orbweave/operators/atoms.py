"""Content-addressed storage: constants, compositions and relations, each stored once.

* constants (hash, kind, value)
* compositions (hash, kind, children): ``children`` is their number
* relations (parent, position, child, is_constant, multiplicity)

Relations of whole compositions are kept as stretches: a row holds the relations of up to
``_STRETCH`` neighbouring positions, nested, and names each of its children once.  They are told
as rows when they are read as such.

A composition is addressed by what it is made of, so equal content from any document or
run has one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.store import dealt, settled
from orbweave.functions.text import character, code_hash, code_points, hash_of_names, seed_hash, text_hash
from orbweave.operators.ingest import UNICODE, new_only, rounds

SCHEMAS = {
    "constants": "hash string, kind int, value long",
    "compositions": "hash string, kind string, children int",
    "relations": "parent string, position int, child string, is_constant boolean, multiplicity long",
}
_STRETCHES = "parent string, position int, kids array<string>, constant array<boolean>, seq array<int>, times array<long>"
_STRETCH = 1 << 12
#: Fixed value: texts and stretches take about half of what they take with the session's default.
_CODEC = "zstd"
_KEYS = {"constants": ["hash"], "compositions": ["hash"], "relations": ["parent", "position"]}


class Content:
    """The three tables of what was taken in, and ``roots`` (doc_id, hash).

    Most relations are better not told as rows at once: ``wholes`` has the rows (parent, ...) of
    each composition, once, and ``nested`` gives them as stretches.  ``rows`` are relations beside
    those."""

    def __init__(self, constants: DataFrame, compositions: DataFrame, rows: DataFrame | None, roots: DataFrame, wholes: DataFrame | None = None, nested: Callable[[DataFrame], DataFrame] | None = None):
        self.constants, self.compositions, self.rows, self.roots, self.wholes, self.nested = constants, compositions, rows, roots, wholes, nested

    @property
    def relations(self) -> DataFrame:
        if self.wholes is None:
            return self.rows
        told = _rows_of(self.nested(self.wholes))
        return told if self.rows is None else told.unionByName(self.rows)

    def beside(self, rows: DataFrame) -> Content:
        """The same content with further relations."""
        return Content(self.constants, self.compositions, rows if self.rows is None else self.rows.unionByName(rows), self.roots, self.wholes, self.nested)


def checked_text(text: str, most: int = 10_000_000) -> str:
    """A text from a caller: neither empty nor too long."""
    if not text:
        raise ValueError("an empty text has no content")
    if len(text) > most:
        raise ValueError(f"a text may have {most} characters, not {len(text)}")
    return text


def _constants(docs: DataFrame, kind: int = UNICODE) -> DataFrame:
    values = docs.select(F.explode(F.array_distinct(code_points(F.col("text")))).alias("value")).distinct()
    return values.select(seed_hash(F.lit(kind), F.col("value")).alias("hash"), F.lit(kind).alias("kind"), F.col("value").cast("long").alias("value"))


def _lists(ends: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


class _Stretches:
    """Stretches that are put together, and told as batches of bounded size."""

    def __init__(self, size: int = 1 << 20):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.parents, self.positions, self.kids, self.constant, self.seq, self.times = [], [], [], [], [], []
        self.kid_ends, self.ends = [0], [0]

    def add(self, parent: str, kids: list[str], constant: list[bool], seq: np.ndarray, times: np.ndarray) -> None:
        """A composition; of a long one each stretch names its own children."""
        for lo in range(0, len(seq), _STRETCH):
            part, named = seq[lo : lo + _STRETCH], range(len(kids))
            if len(seq) > _STRETCH:
                named, part = np.unique(part, return_inverse=True)
            self.parents.append(parent)
            self.positions.append(lo)
            self.kids += [kids[k] for k in named]
            self.constant += [constant[k] for k in named]
            self.seq.append(part)
            self.times.append(times[lo : lo + _STRETCH])
            self.kid_ends.append(len(self.kids))
            self.ends.append(self.ends[-1] + len(part))

    def full(self) -> bool:
        return self.ends[-1] >= self.size or len(self.kids) >= self.size

    def told(self) -> pa.RecordBatch:
        flat = lambda parts, kind: pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind))
        columns = [pa.array(self.parents, pa.string()), pa.array(self.positions, pa.int32()), _lists(self.kid_ends, pa.array(self.kids, pa.string())), _lists(self.kid_ends, pa.array(self.constant, pa.bool_()))]
        columns += [_lists(self.ends, flat(self.seq, np.int32)), _lists(self.ends, flat(self.times, np.int64))]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, ["parent", "position", "kids", "constant", "seq", "times"])


def _runs_nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(parent, text) as stretches of the text's runs."""
    found = _Stretches()
    for batch in batches:
        for parent, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            values, seq = np.unique(codes[starts], return_inverse=True)
            found.add(parent, [code_hash(v, UNICODE) for v in values.tolist()], [True] * len(values), seq, np.diff(starts, append=len(codes)))
            if found.full():
                yield found.told()
    yield found.told()


def flat_content(docs: DataFrame) -> Content:
    """Texts as runs of code points; null and empty texts have no content and no root.

    What is written and shuffled are texts, not the hashes of their characters.  They are dealt
    out first, as a file may come as one task however many there are."""
    docs = dealt(docs.where("text <> ''").select("doc_id", "text"), "doc_id")
    hashed = settled(docs.select("doc_id", "text", text_hash(F.col("text")).alias("told")).select("doc_id", "text", "told.hash", "told.children", "told.characters"), codec=_CODEC)
    constants = _constants(hashed.select(F.col("characters").alias("text")))
    compositions = hashed.dropDuplicates(["hash"]).select("hash", F.lit("text").alias("kind"), "children")
    wholes = hashed.dropDuplicates(["hash"]).select(F.col("hash").alias("parent"), "text")
    return Content(constants, compositions, None, hashed.select("doc_id", "hash"), wholes, lambda texts: texts.select("parent", "text").mapInArrow(_runs_nested, _STRETCHES))


def _hash_of(kids: list[tuple[str, int]]) -> str:
    """The same as :func:`orbweave.functions.text.composition_hash`."""
    return hashlib.sha256("|".join(f"{h}*{m}" for h, m in kids).encode()).hexdigest()


def hierarchical_content(docs: DataFrame, max_rules: int = 30) -> Content:
    """Texts by the rules of their grammars; documents share the rules that spell the same.

    The root of a text is the run-length form of what its rules leave; where that is a single
    rule used once, the rule itself is the root, and a single character is a constant."""
    docs = dealt(docs.where("text <> ''").select("doc_id", "text"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, roots, kept = _Stretches(), [], set()

        def add(kids: list[tuple[tuple[str, bool], int]]) -> tuple[str, bool]:
            """A rule of one or two children."""
            of = _hash_of([(kid[0], times) for kid, times in kids])
            if of not in kept:
                kept.add(of)
                once = list(dict.fromkeys(kid for kid, _ in kids))  # different rules may spell the same
                found.add(of, [h for h, _ in once], [c for _, c in once], np.array([once.index(kid) for kid, _ in kids]), np.array([times for _, times in kids]))
            return of, False

        def whole(known: list[tuple[str, bool]], symbols: np.ndarray, times: np.ndarray) -> str:
            """The root of runs of symbols."""
            if len(symbols) == 1 and times[0] == 1:
                return known[symbols[0]][0]
            kinds, at = np.unique(symbols, return_inverse=True)
            once: dict = {}
            at = np.array([once.setdefault(known[k], len(once)) for k in kinds.tolist()])[at]
            kids = list(once)
            runs, places = np.unique(at << 32 | times, return_inverse=True)
            of = hash_of_names([f"{kids[r >> 32][0]}*{r & 0xFFFFFFFF}".encode() for r in runs.tolist()], places)
            if of not in kept:
                kept.add(of)
                found.add(of, [h for h, _ in kids], [c for _, c in kids], at, times)
            return of

        def told(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            """The stretches, then a row for each document."""
            part, n = found.told(), len(roots)
            names = [*part.schema.names, "doc_id", "characters"]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, id_type), pa.nulls(part.num_rows, pa.string())], names)
            ids, hashes, characters = (pa.array([r[k] for r in roots], kind) for k, kind in enumerate((id_type, pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays([hashes, *(pa.nulls(n, f.type) for f in list(part.schema)[1:]), ids, characters], names)
            roots.clear()
            kept.clear()

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, codes = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
                known = [(code_hash(v, UNICODE), True) for v in values.tolist()]
                rules, rest = rounds(codes.astype(np.int64), len(known), max_rules)
                for left, right, _ in rules:
                    known.append(add([(known[left], 2)] if left == right else [(known[left], 1), (known[right], 1)]))
                starts = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
                root = whole(known, rest[starts], np.concatenate([starts[1:], [len(rest)]]) - starts)
                roots.append((doc_id, root, "".join(map(chr, values.tolist()))))
                if found.full():
                    yield from told(batch.schema[0].type)
            yield from told(batch.schema[0].type)

    told = settled(docs.mapInArrow(run, f"{_STRETCHES}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, characters string"), codec=_CODEC)
    ends = told.where("seq is null")
    parts = told.where("seq is not null").drop("doc_id", "characters")
    wholes = parts.dropDuplicates(["parent", "position"])
    sizes = parts.select("parent", "position", F.size("seq").alias("n")).dropDuplicates(["parent", "position"]).groupBy("parent").agg(F.sum("n").cast("int").alias("children"))
    compositions = sizes.select(F.col("parent").alias("hash"), F.lit("text").alias("kind"), "children")
    return Content(_constants(ends.select(F.col("characters").alias("text"))), compositions, None, ends.select("doc_id", F.col("parent").alias("hash")), wholes, lambda whole: whole)


def _rows_of(stretches: DataFrame) -> DataFrame:
    """The relations of stretches: each place names one of the distinct children."""
    each = stretches.select("parent", "position", "kids", "constant", "times", F.posexplode("seq").alias("i", "k"))
    return each.select("parent", (F.col("position") + F.col("i")).alias("position"), F.get("kids", F.col("k")).alias("child"), F.get("constant", F.col("k")).alias("is_constant"), F.get("times", F.col("i")).alias("multiplicity"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(parent, position, child, is_constant, multiplicity) as stretches:
    neighbouring rows of one parent at consecutive positions, their distinct children told once."""
    for batch in batches:
        parent, position, child, constant, times = batch.columns
        if not batch.num_rows:
            continue
        same = pc.and_(pc.equal(parent[1:], parent[:-1]), pc.equal(pc.subtract(position[1:], position[:-1]), 1))
        opens = np.concatenate([[True], ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)])
        starts, stretch = np.flatnonzero(opens), np.cumsum(opens) - 1
        coded = child.dictionary_encode()
        n = max(1, len(coded.dictionary))
        kinds, where, at = np.unique(stretch * n + coded.indices.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        first = np.searchsorted(kinds, np.arange(len(starts) + 1) * n)
        ends, begin = [*starts, batch.num_rows], pa.array(starts)
        seq = pa.array((at - first[stretch]).astype(np.int32))
        columns = [parent.take(begin), position.take(begin), _lists(first, coded.dictionary.take(pa.array(kinds % n))), _lists(first, constant.take(pa.array(where))), _lists(ends, seq), _lists(ends, times)]
        yield pa.RecordBatch.from_arrays(columns, ["parent", "position", "kids", "constant", "seq", "times"])


def _spelt_by(stretches: DataFrame, spelt: DataFrame) -> DataFrame:
    """(parent, said) of stretches by ``spelt`` (child, said); null where a child is not spelt."""
    asked = stretches.select("parent", "position", F.posexplode("kids").alias("k", "child"))
    words = asked.join(spelt, "child", "left").groupBy("parent", "position").agg((F.count("*") == F.count("said")).alias("known"), F.array_sort(F.collect_list(F.struct("k", "said"))).alias("words"))
    piece = F.when(F.col("known"), F.expr("array_join(transform(seq, (k, i) -> repeat(words[k].said, int(times[i]))), '')"))
    pieces = stretches.select("parent", "position", "seq", "times").join(words, ["parent", "position"]).select("parent", "position", piece.alias("piece"))
    parts = pieces.groupBy("parent").agg((F.count("*") == F.count("piece")).alias("known"), F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("parts"))
    return parts.select("parent", F.when(F.col("known"), F.array_join(F.transform("parts", lambda p: p["piece"]), "")).alias("said"))


def _joined(word: Column) -> Column:
    """What a word (array of said, ref, times) says; null while it names a composition."""
    return F.when(~F.exists(word, lambda w: w["ref"].isNotNull()), F.array_join(F.transform(word, lambda w: w["said"]), ""))


def _words(inner: DataFrame, spelt: DataFrame) -> DataFrame:
    """(parent, said) of stretches that name each other, ``spelt`` (child, said) given.

    In each round every name is replaced by the word it has so far, names and all, so what is
    n compositions deep is spelt in about log2(n) rounds."""
    rows = _rows_of(inner).join(spelt, "child", "left")
    part = F.struct(F.expr("repeat(said, int(multiplicity))").alias("said"), F.when(F.col("said").isNull(), F.col("child")).alias("ref"), F.when(F.col("said").isNull(), F.col("multiplicity").cast("int")).otherwise(1).alias("times"))
    grouped = lambda parts: F.array_sort(F.collect_list(parts))
    words = rows.select("parent", F.struct("position", part.alias("part")).alias("p")).groupBy("parent").agg(F.transform(grouped("p"), lambda p: p["part"]).alias("word"))
    waiting, done, last = settled(words.select("parent", "word", _joined(F.col("word")).alias("said"))), None, None
    while True:
        ready = waiting.where("said is not null").select("parent", "said")
        done = ready if done is None else done.unionByName(ready)
        waiting = waiting.where("said is null").select("parent", "word")
        if (left := waiting.count()) == 0:
            return done
        if left == last:
            raise ValueError("relations form a cycle or lack constants")
        last = left
        none = F.lit(None).cast("string")
        by = waiting.select(F.col("parent").alias("name"), F.col("word").alias("by")).unionByName(done.select(F.col("parent").alias("name"), F.array(F.struct("said", none.alias("ref"), F.lit(1).alias("times"))).alias("by")))
        each = waiting.select("parent", F.posexplode("word").alias("i", "w")).join(by, F.col("w.ref") == F.col("name"), "left")
        said = F.expr("array(struct(repeat(by[0].said, w.times) as said, cast(null as string) as ref, 1 as times))")
        part = F.when(F.col("by").isNull(), F.array("w")).when((F.size("by") == 1) & F.expr("by[0].ref is null"), said).otherwise(F.flatten(F.expr("array_repeat(by, w.times)")))
        word = each.select("parent", F.struct("i", part.alias("part")).alias("p")).groupBy("parent").agg(F.flatten(F.transform(grouped("p"), lambda p: p["part"])).alias("word"))
        waiting = settled(word.select("parent", "word", _joined(F.col("word")).alias("said")))


def _named(stretches: DataFrame) -> DataFrame:
    """(parent): the compositions that stretches are made of, once each."""
    return stretches.select(F.explode(F.expr("filter(kids, (k, i) -> not constant[i])")).alias("parent")).distinct()


class Store:
    """The three tables in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for name, schema in (SCHEMAS | {"stretches": _STRETCHES}).items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_STRETCHES if name == "stretches" else SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def table(self, name: str) -> DataFrame:
        return self._read(name) if name != "relations" else self._read(name).unionByName(_rows_of(self._read("stretches")))

    def _relations_of(self, parents: DataFrame) -> DataFrame:
        """The relations of ``parents`` (parent); only theirs are told as rows."""
        found = lambda name: self._read(name).join(parents, "parent", "left_semi")
        return found("relations").unionByName(_rows_of(found("stretches")))

    def add(self, content: Content) -> None:
        """Append what is not stored yet.  A call that was cut short is made whole by another one:
        compositions are written after what they are made of, each row by its own key."""
        self._add_rows("constants", content.constants)
        if content.wholes is not None:
            self._add_wholes(content)
        if content.rows is not None:
            self._add_rows("relations", content.rows)
        self._add_rows("compositions", content.compositions)

    def _add_rows(self, name: str, rows: DataFrame) -> None:
        keys = _KEYS[name]
        rows = rows.select(*self._read(name).columns).dropDuplicates(keys)
        if name == "relations":  # of the stored rows only those that may meet a new one are compared
            rows = settled(rows)
            stored = self._relations_of(rows.select("parent").distinct())
        else:
            stored = self.table(name)
        rows.join(stored.select(*keys), keys, "left_anti").write.mode("append").option("compression", _CODEC).parquet(f"{self.folder}/{name}")

    def _add_wholes(self, content: Content) -> None:
        """Relations of compositions that are not stored, as stretches where none of theirs is:
        they are compared by composition.  Only where some are stored as rows and the composition
        is not, as after a call that was cut short, rows are compared."""
        done = self.table("compositions").select(F.col("hash").alias("parent")).unionByName(self._read("stretches").select("parent"))
        new, rows = content.wholes.join(done, "parent", "left_anti"), self._read("relations")
        if not rows.isEmpty():
            begun = settled(rows.select("parent").distinct().join(new.select("parent"), "parent", "left_semi"))
            told = settled(_rows_of(content.nested(new.join(begun, "parent", "left_semi"))))
            new = new.join(begun, "parent", "left_anti")
            told.join(rows.select("parent", "position"), ["parent", "position"], "left_anti").select(*rows.columns).write.mode("append").option("compression", _CODEC).parquet(f"{self.folder}/relations")
        content.nested(new).write.mode("append").option("compression", _CODEC).parquet(f"{self.folder}/stretches")

    def ids_of(self, hashes: DataFrame) -> DataFrame:
        """``hashes`` (hash) with ``stored``: whether a constant or composition has it."""
        known = self.table("constants").select("hash").unionByName(self.table("compositions").select("hash")).withColumn("stored", F.lit(True))
        return hashes.join(known.distinct(), "hash", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))

    def exists(self, hash_: str) -> bool:
        return not self.ids_of(self.spark.createDataFrame([(hash_,)], "hash string")).where("stored").isEmpty()

    def children(self, parent: str) -> DataFrame:
        """(position, child, is_constant, multiplicity) of one composition, in order; an unknown one is an error."""
        found = self.table("relations").where(F.col("parent") == parent).drop("parent").orderBy("position")
        if found.isEmpty():
            raise KeyError(parent)
        return found

    def _stretches(self, parents: DataFrame | None = None) -> DataFrame:
        """The relations of ``parents`` (parent), or all, as stretches; those of given parents once each."""
        rows, nested = self._read("relations"), self._read("stretches")
        if parents is not None:
            nested = nested.join(parents, "parent", "left_semi").dropDuplicates(["parent", "position"])
            rows = rows.join(parents, "parent", "left_semi").dropDuplicates(["parent", "position"])
        told = rows.select("parent", "position", "child", "is_constant", "multiplicity").mapInArrow(_folded, _STRETCHES)
        return nested.unionByName(told)

    def _below(self, roots: DataFrame, max_rounds: int) -> DataFrame:
        """The stretches of everything that ``roots`` (hash) are made of."""
        asked = met = settled(roots.select(F.col("hash").alias("parent")).distinct())
        level = whole = settled(self._stretches(asked))
        for _ in range(max_rounds):
            asked = settled(_named(level).join(met, "parent", "left_anti"))  # each once: rows may fold otherwise another time
            level, met = settled(self._stretches(asked)), met.unionByName(asked)
            if level.isEmpty():
                break
            whole = whole.unionByName(level)
        return whole

    def texts(self, roots: DataFrame, *, whole: bool = False, max_rounds: int = 64) -> DataFrame:
        """(doc_id, text) of ``roots`` (doc_id, hash).

        Compositions that others are made of are spelt first, what documents share once; all
        others follow in one pass.  With ``whole`` the store is not searched for what lies below
        the roots first, which pays where they are most of it."""
        stretches = self._stretches() if whole else self._below(roots, max_rounds)
        kids = settled(_named(stretches))
        spelt = settled(self.table("constants").where(F.col("kind") == UNICODE).dropDuplicates(["hash"]).select(F.col("hash").alias("child"), character(F.col("value")).alias("said")))
        spelt = spelt.unionByName(_words(stretches.join(kids, "parent", "left_semi"), spelt).withColumnRenamed("parent", "child"))
        ends = settled(_spelt_by(stretches.join(kids, "parent", "left_anti"), spelt))
        if not ends.where("said is null").isEmpty():
            raise ValueError("relations lack constants or compositions")
        spelt = spelt.unionByName(ends.withColumnRenamed("parent", "child"))
        return roots.join(spelt.withColumnRenamed("child", "hash"), "hash").select("doc_id", F.col("said").alias("text"))

    def parents_of_text(self, text: str) -> DataFrame:
        """(parent): compositions that hold the flat composition of a text, or its one constant; nothing is stored."""
        codes = [ord(c) for c in checked_text(text)]
        kids: list[list[int]] = []
        for c in codes:
            if kids and kids[-1][0] == c:
                kids[-1][1] += 1
            else:
                kids.append([c, 1])
        seeds = [(hashlib.sha256(f"{UNICODE}:{c}".encode()).hexdigest(), m) for c, m in kids]
        hash_ = seeds[0][0] if len(codes) == 1 else _hash_of(seeds)
        rows = self._read("relations").where(F.col("child") == hash_).select("parent")
        return rows.unionByName(self._read("stretches").where(F.array_contains("kids", hash_)).select("parent")).distinct()


def verified(original: DataFrame, exported: DataFrame) -> DataFrame:
    """(doc_id, equal, length, exported_length, first_difference): an export against its originals (doc_id, text)."""
    from orbweave.functions.text import first_difference

    both = original.select("doc_id", F.col("text").alias("a")).join(exported.select("doc_id", F.col("text").alias("b")), "doc_id", "left")
    return both.select("doc_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"), F.length("a").cast("long").alias("length"), F.length("b").cast("long").alias("exported_length"), first_difference(F.col("a"), F.col("b")).alias("first_difference"))


def compression(content: Content, docs: DataFrame) -> DataFrame:
    """(doc_id, ratio): characters over the children of the root; 1 where it has none."""
    sizes = content.roots.join(content.compositions.select("hash", "children"), "hash", "left")
    return sizes.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").select("doc_id", F.when(F.coalesce("children", F.lit(0)) > 0, F.col("n") / F.col("children")).otherwise(1.0).alias("ratio"))


def registered_nodes(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``node``, the hash of their kind and metadata: equal metadata is one node, no two kinds share one."""
    told = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.withColumn("node", F.sha2(F.concat_ws("|", F.lit(kind), told), 256)).dropDuplicates(["node"])


def turn_edges(sessions: DataFrame, turns: DataFrame, key: str, order: str) -> DataFrame:
    """(parent, position, child): each session's turns in order; both have ``node`` and ``key``."""
    return turns.select(key, F.col("node").alias("child"), F.col(order).alias("position")).join(sessions.select(key, F.col("node").alias("parent")), key).select("parent", "position", "child")


def stored_once(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Constants or compositions to store: those of ``rows`` that ``store`` lacks, once each."""
    return new_only(rows, store)
