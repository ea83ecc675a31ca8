"""What is stored of texts, media, vectors, tensors and vocabularies, and how it comes back."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geometry import project_code
from orbweave.functions.store import dealt, settled
from orbweave.functions.text import code_points, run_strings, text_hash

#: The kinds of constants.
UNICODE, INTEGER, FLOAT, BYTE, BOOLEAN, NULL = range(6)


def text_relations(docs: DataFrame) -> DataFrame:
    """(doc_id, position, value, multiplicity): the run-length code points of each text."""
    each = docs.select("doc_id", F.posexplode(run_strings(F.col("text"))).alias("position", "run"))
    return each.select("doc_id", "position", F.ascii("run").cast("long").alias("value"), F.length("run").cast("long").alias("multiplicity"))


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one text at consecutive positions become one piece, under its first position."""
    for batch in batches:
        doc, position, value, times = batch.columns
        if not batch.num_rows:
            continue
        known = pc.and_(value.is_valid(), times.is_valid()).to_numpy(zero_copy_only=False)
        times = np.where(known, np.maximum(pc.fill_null(times, 0).to_numpy(), 0), 0)
        codes = np.repeat(pc.fill_null(value, 0).to_numpy(), times).astype("<u4")
        same = pc.and_(pc.equal(doc[1:], doc[:-1]), pc.equal(pc.subtract(position[1:], position[:-1]), 1))
        starts = np.flatnonzero(np.concatenate([[True], ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)]))
        text, ends = codes.tobytes().decode("utf-32-le"), np.concatenate([[0], np.cumsum(times)])
        bounds = [*ends[starts].tolist(), len(text)]
        pieces = pa.array([text[lo:hi] for lo, hi in zip(bounds, bounds[1:])], pa.string())  # noqa: B905
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([doc.take(at), position.take(at), pieces], ["doc_id", "position", "said"])


def text_of(relations: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, position, value, multiplicity).

    Rows that lie together are spelt before they are dealt by text, so what is shuffled is
    about the texts themselves; rows in any other order are spelt one by one and give the same."""
    rows = relations.select("doc_id", F.col("position").cast("long").alias("position"), F.col("value").cast("long").alias("value"), F.col("multiplicity").cast("long").alias("multiplicity"))
    pieces = rows.mapInArrow(_said, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, position long, said string")
    parts = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "said"))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text"))


def text_compositions(docs: DataFrame) -> DataFrame:
    """(hash, doc_id): one composition for equal texts, under its least document."""
    return docs.select("doc_id", text_hash(F.col("text"))["hash"].alias("hash")).groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


def new_only(rows: DataFrame, store: DataFrame, key: str = "hash") -> DataFrame:
    """Rows whose content is not stored yet, once each."""
    return rows.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def sparse_cells(vectors: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """(id, position, value): the components of at least the threshold, at their own places."""
    cells = vectors.select("id", F.posexplode("vector").alias("position", "value"))
    return cells.where(F.abs(F.col("value").cast("double")) >= threshold)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, token_id, kind, code): a character, a byte (<0xNN>) or a longer piece."""
    is_byte = F.col("token").rlike("^<0x[0-9A-Fa-f]{2}>$")
    return tokens.select(
        "token",
        "token_id",
        F.when(F.length("token") == 1, "character").when(is_byte, "byte").otherwise("piece").alias("kind"),
        F.when(F.length("token") == 1, F.ascii("token")).when(is_byte, F.conv(F.regexp_extract("token", "^<0x([0-9A-Fa-f]{2})>$", 1), 16, 10).cast("int")).alias("code"),
    )


def unicode_seed(spark, stop: int = 0x110000) -> DataFrame:
    """(id, x, y, z, m) of every code point but the surrogates."""
    codes = spark.range(stop).where("id not between 55296 and 57343")
    return codes.select("id", *[c.alias(n) for c, n in zip(project_code(F.col("id")), "xyzm", strict=True)])


def digrams(docs: DataFrame) -> DataFrame:
    """(a, b, n): adjacent code points of all texts, overlaps counted."""
    codes = docs.select(code_points(F.col("text")).alias("codes"))
    pairs = codes.select(F.explode_outer(F.transform("codes", lambda c, i: F.struct(c.alias("a"), F.get("codes", i + 1).alias("b")))).alias("p")).where("p.b is not null")
    return pairs.groupBy(F.col("p.a").cast("long").alias("a"), F.col("p.b").cast("long").alias("b")).agg(F.count("*").alias("n"))


def _rounds_by_place(seq: list[int], n: int, most: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """At most ``most`` further rounds of :func:`grammar` on ``seq`` of symbols under ``n``: (left, right, uses) and what is left.

    The places of each pair are kept, so a round costs what it replaces and not the length of the
    text.  Pairs gain places only in the round that makes one of their symbols; later their count
    falls and their first place moves on, so what a heap holds of them is put right when it comes up."""
    end, found = len(seq), []
    base = n + end
    sym, after, before = [*seq, -1], [*range(1, end + 1)], [*range(-1, end)]  # before the first and after the last stands -1
    places, begins = defaultdict(list), {}
    for i in range(end - 1):
        places[sym[i] * base + sym[i + 1]].append(i)
    counts = {k: len(v) for k, v in places.items()}
    heap = [(-len(v), v[0], k) for k, v in places.items() if len(v) > 1]
    heapq.heapify(heap)
    while heap and len(found) < most:
        told, first, key = heap[0]
        if (uses := counts[key]) < 2:
            heapq.heappop(heap)
            continue
        (left, right), at, lo = divmod(key, base), places[key], begins.get(key, 0)
        while sym[at[lo]] != left or sym[after[at[lo]]] != right:
            lo += 1
        if told != -uses or first != at[lo]:
            begins[key] = lo
            heapq.heapreplace(heap, (-uses, at[lo], key))
            continue
        heapq.heappop(heap)
        new, met = n + len(found), set()
        found.append((left, right, uses))
        for i in at[lo:]:
            if sym[i] != left or sym[j := after[i]] != right:
                continue
            p, q = before[i], after[j]
            sym[i], sym[j], after[i] = new, -2, q
            if p >= 0:
                counts[sym[p] * base + left] -= 1
                k = sym[p] * base + new
                places[k].append(p)
                counts[k] = counts.get(k, 0) + 1
                met.add(k)
            if q < end:
                before[q] = i
                counts[right * base + sym[q]] -= 1
                k = new * base + sym[q]
                places[k].append(i)
                counts[k] = counts.get(k, 0) + 1
                met.add(k)
        counts[key] = 0
        del places[key]
        for k in met:
            if counts[k] > 1:
                heapq.heappush(heap, (-counts[k], places[k][0], k))
    return found, [s for s in sym if s >= 0]


def rounds(seq: np.ndarray, n: int, most_rules: int, *, dense: int = 1 << 16, few: int = 4) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """:func:`grammar` of symbols numbered under ``n``: (left, right, uses) of the symbols from ``n`` on, and what is left."""
    rules: list[tuple[int, int, int]] = []
    while len(rules) < most_rules:
        pairs = seq[:-1] * n + seq[1:]
        if n * n <= dense:  # few symbols: all their pairs are places of one array
            counts = np.bincount(pairs)
            if not counts.size or (most := counts.max()) < 2:
                break
            at = int(np.argmax(counts[pairs] == most))
        else:
            _, first, counts = np.unique(pairs, return_index=True, return_counts=True)
            if not counts.size or (most := counts.max()) < 2:
                break
            at = first[counts == most].min()
        if most <= few + len(seq) * few // 1000:
            found, rest = _rounds_by_place(seq.tolist(), n, most_rules - len(rules))
            return rules + found, np.array(rest, np.int64)
        left, right = seq[at], seq[at + 1]
        hits = np.flatnonzero(pairs == pairs[at])
        if left == right:  # of a run of the same symbol every second pair
            opens = np.flatnonzero(np.diff(hits, prepend=-2) > 1)
            hits = hits[(hits - np.repeat(hits[opens], np.diff(opens, append=len(hits)))) % 2 == 0]
        kept = np.ones(len(seq), bool)
        kept[hits + 1] = False
        seq[hits] = n
        seq = seq[kept]
        rules.append((int(left), int(right), int(most)))
        n += 1
    return rules, seq


def grammar(symbols: list, max_rules: int | None = None, **ways) -> tuple[list[tuple], list]:
    """Rules (name, left, right, uses) and the sequence left of a text.

    Each round replaces the pair that is counted most (the first met of equals, at least
    twice, overlaps counted), left to right, until no pair comes twice; ``max_rules`` ends it
    sooner.  Pairs are counted in an array of all pairs of symbols while those are at most
    ``dense``, else by sorting; once none comes more often than ``few`` times and ``few`` per
    1000 symbols, by their places.  The rules are the same."""
    number: dict = {}
    seq = np.fromiter((number.setdefault(s, len(number)) for s in symbols), np.int64, len(symbols))
    found, rest = rounds(seq, len(number), len(symbols) if max_rules is None else max_rules, **ways)
    names = [*number, *(f"R{k}" for k in range(1, len(found) + 1))]
    return [(f"R{k}", names[left], names[right], uses) for k, (left, right, uses) in enumerate(found, 1)], [names[i] for i in rest.tolist()]


def grammar_rules(docs: DataFrame, max_rules: int | None = None) -> DataFrame:
    """(doc_id, rule, left, right, uses, length) of each text's whole grammar, or of its first ``max_rules``.

    Texts are dealt out first, as a file may come as one task however many there are."""
    columns = ["doc_id", "rule", "left", "right", "uses", "length"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                rules, seq = grammar(list(text or ""), max_rules)
                rows += [(doc_id, k, a, b, n, len(seq)) for k, (_, a, b, n) in enumerate(rules, 1)]
                if len(rows) > 1 << 16:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return dealt(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id long, rule int, left string, right string, uses long, length long")


def percentile_value(values: DataFrame, percent: float) -> DataFrame:
    """The value at place floor(n * percent / 100) of the ascending values.

    Only counts by value are ordered: partial sums run over distinct values per range."""
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    parts = settled(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))  # once: ranges must not change
    sums = parts.groupBy("part").agg(F.sum("n").alias("s"))  # a row a range
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("all"))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    placed = parts.withColumn("upto", run).join(F.broadcast(before), "part").withColumn("upto", F.col("upto") + F.col("before"))
    return placed.where(F.col("upto") > F.least(F.floor(F.col("all") * percent / 100), F.col("all") - 1)).agg(F.min("value").alias("value"))


def above_percentile(vectors: DataFrame, percent: float) -> DataFrame:
    """(id, position, value): the components whose size is at least that at ``percent`` of all."""
    sizes = vectors.select(F.explode("vector").alias("v")).select(F.abs(F.col("v").cast("double")).alias("value"))
    threshold = percentile_value(sizes, percent).select(F.col("value").alias("threshold"))  # one row
    cells = vectors.select("id", F.posexplode("vector").alias("position", "value"))
    return cells.join(F.broadcast(threshold)).where(F.abs(F.col("value").cast("double")) >= F.col("threshold")).select("id", "position", "value")


def sparse_hash(cells: DataFrame) -> DataFrame:
    """(id, hash) of (id, position, value): places count, so equal values elsewhere are another tensor."""
    parts = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("parts"))
    return parts.select("id", F.sha2(F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["position"].cast("string"), p["value"].cast("string"))), "|"), 256).alias("hash"))


def vocabulary_parts(tokens: DataFrame) -> DataFrame:
    """(token, position, code): the characters of each longer piece, in order and without runs."""
    pieces = vocabulary(tokens).where("kind = 'piece'").select("token", F.posexplode(code_points(F.col("token"))).alias("position", "code"))
    return pieces.select("token", "position", F.col("code").cast("long").alias("code"))
