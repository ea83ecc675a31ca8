"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word n-grams.  In one order of all n-grams, rare ones first, two
sets of at least the wanted similarity share ``l`` of the first ``n - need + l`` of each
for every ``l``, where ``need`` is the smallest overlap a set of ``n`` can link with.  A
document whose prefix is estimated to meet many others gets a larger ``l``: a longer
prefix, of which correspondingly more must be shared before a pair is verified.

If the other set is no smaller than ``n``, the ``l`` lie even among the first ``n - even + l``
of this one, ``even`` being the smallest overlap with such a set: the n-grams that a set *leads*.
Pairs are generated only where the smaller of the two leads, so that text which many
documents share brings none together that have enough words of their own.

1. One pass counts n-grams in a sketch of fixed size (the order needs only estimates) and
   signs each set; documents with equal sets are one from here on.
2. Prefix postings are dealt by n-gram.  Each group of sets is tied to a pivot, its least
   member, instead of to all pairs; frequent n-grams are salted by their estimated count.
3. (set, pivot) pairs are verified exactly and contracted to components.
4. Groups which still span several components are finished exactly.  Pairs of small ones
   are generated, filtered by the shared-prefix count and size, and verified.  In large ones
   blocks of sets of about equal sizes meet: their prefixes are held against each other by
   ids, and the texts of what passes are compared within the block; only links come out.

Step 4 is what makes the result whole: a pair left out of it lies within one component.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Scratch, documents_of, settled
from orbweave.llm.components import components

#: Counters of the sketch: its size does not depend on the corpus.
SKETCH_BITS = 20
SLICES = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    """Hashes of words; a worker keeps them from text to text and starts anew beyond ``most``."""

    most = 400_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_digest(word)
        return h


_hash_of = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams, A-Z lowered.

    A text of fewer words is one n-gram; one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.frombuffer(b"".join(map(_hash_of.__getitem__, found)), np.uint64)
    w = min(width, len(words))
    n = len(words) - w + 1
    grams = np.full(n, w, np.uint64)
    for j in range(w):
        grams = grams * _STEP + words[j : j + n]
    hashes = np.sort(_mixed(grams))
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]


def _least_overlap(n: int, percent: int) -> int:
    """The smallest overlap with which a set of n can link: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _even_overlap(n: int, percent: int) -> int:
    """The smallest overlap with which a set of n can link with one of n or more."""
    return -(-2 * percent * n // (100 + percent))


def _signed(width: int):
    """doc_id, n, sid of each document, then this partition's sketch in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        for batch in batches:
            ns, sids, fresh, held = [], [], [], 0
            for text in batch.column("text"):
                s = shingles(text.as_py(), width)
                ns.append(len(s))
                sid = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                sids.append(sid if len(s) else None)
                if len(s) and sid not in seen:
                    seen.add(sid)
                    fresh.append(s >> np.uint64(64 - SKETCH_BITS))
                    held += len(s)
                if held > 1 << 21:
                    counts += np.bincount(np.concatenate(fresh), minlength=len(counts)).astype(np.uint32)
                    fresh, held = [], 0
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=len(counts)).astype(np.uint32)
            k = len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=["doc_id", "n", "sid", "slice", "counts"],
            )
        if seen:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, pa.int64())] * 3 + [pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "n", "sid", "slice", "counts"]
            )

    return run


def _summed(pdf):
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
    for blob in pdf["counts"]:
        raw = zlib.decompress(blob)
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(total) else np.uint64)
    return pdf.iloc[:1].assign(counts=[zlib.compress(total.tobytes(), 1)])[["part", "slice", "counts"]]


def _sketch(signed: DataFrame) -> np.ndarray:
    """The whole corpus's counters.  Slices are summed in two steps; what reaches the driver has a fixed size."""
    parts = signed.where("slice is not null").select((F.xxhash64("counts") % 256).cast("int").alias("part"), "slice", "counts")
    schema = "part int, slice int, counts binary"
    once = parts.groupBy("slice", "part").applyInPandas(_summed, schema)
    twice = once.withColumn("part", F.lit(0)).groupBy("slice").applyInPandas(_summed, schema)
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for row in twice.collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    return out.reshape(-1)


def prefix_of(s: np.ndarray, counts: np.ndarray, usual: int, percent: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The prefix of a set with the estimated counts there, how many of it must be shared, and
    within how many of its first n-grams they lie if the other set is no smaller.

    Rare n-grams come first: by the power of two of their estimate, then by hash."""
    estimate = counts[s >> np.uint64(64 - SKETCH_BITS)]
    level = np.frexp(estimate.astype(np.float64))[1]
    order = np.lexsort((s, level))
    n = len(s)
    need, even = _least_overlap(n, percent), _even_overlap(n, percent)
    # What the lists that this document leads hold beyond the sketch's usual filling: the pairs that they would give.
    cost = int(np.maximum(estimate[order[: n - even + 1]].astype(np.int64) - 2 * usual, 0).sum())
    # Up to a hundredth and, at more than an eighth of a pair an n-gram, a twenty-fifth of the set further (a quarter of a short one).
    more = min(need, 1 + n // 100 + min(max(n // 25, min(n // 4, 4)), 8 * cost // n))
    chosen = order[: n - need + more]
    return s[chosen], estimate[chosen], more, n - even + more


_POSTED = {"h": pa.int64(), "salt": pa.int32(), "sid": pa.int64(), "n": pa.int32(), "more": pa.int32(), "leads": pa.bool_()}
_GROUPED = _POSTED | {"pivot": pa.int64(), "pivot_n": pa.int32()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}


def _ddl(columns: dict) -> str:
    return ", ".join(f"{name} {_SQL[t]}" for name, t in columns.items())


def _postings(sketch, usual: int, width: int, percent: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for batch in batches:
            columns: list[list] = [[] for _ in _POSTED]
            for text in batch.column("text"):
                s = shingles(text.as_py(), width)
                sid = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                h, estimate, more, lead = prefix_of(s, counts, usual, percent)
                over = np.maximum(estimate.astype(np.int64) - 2 * usual, 0) // hot + 1
                same = lambda v: np.full(len(h), v)
                salt = np.where(over > 1, sid % over, -1)  # -1: not salted
                for column, v in zip(columns, (h.view(np.int64), salt, same(sid), same(len(s)), same(more), np.arange(len(h)) < lead), strict=True):
                    column.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(columns, _POSTED.values(), strict=True)], names=list(_POSTED))

    return run


def _pivoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of two sets or more and parts of salted groups, each row with its group's pivot.

    Rows come sorted by group and pivot rank; the pivot is the first, so that nothing but
    the group at hand's first row and a row that waits for a second is kept."""
    key, pivot, waits = None, None, None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(_POSTED))]
        h, salt, sid, n = cols[:4]
        if not len(h):
            continue
        # A set may be posted by several partitions: equal rows follow each other.
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
        fresh = np.ones(len(h), bool)
        fresh[1:] = new[1:] | (sid[1:] != sid[:-1])
        first = (h[0], salt[0])
        carried = key == first
        new[0] = not carried
        if carried and last_sid == sid[0]:
            fresh[0] = False
        starts = np.flatnonzero(new)
        owner = np.searchsorted(starts, np.arange(len(h)), "right") - 1
        p, pn = np.empty(len(h), np.int64), np.empty(len(h), np.int32)
        inside = owner >= 0
        p[inside], pn[inside] = sid[starts[owner[inside]]], n[starts[owner[inside]]]
        if carried:
            p[~inside], pn[~inside] = pivot[2], pivot[3]
        out = fresh & (sid != p)
        # The pivot itself is told with the first other member.
        tell = np.zeros(len(h), bool)
        led = owner[out & inside]
        tell[starts[np.unique(led)]] = True
        tell[starts[salt[starts] >= 0]] = True  # alone in its salt, but perhaps not in its n-gram
        if carried and waits is not None and (out & ~inside).any():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*waits, waits[2], waits[3]), _GROUPED.values(), strict=True)], names=list(_GROUPED))
            waits = None
        out |= tell
        yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in cols] + [pa.array(p[out]), pa.array(pn[out])], names=list(_GROUPED))
        if len(starts):
            at = starts[-1]
            key, pivot = (h[at], salt[at]), tuple(c[at].item() for c in cols)
            waits = None if tell[at] else pivot
        last_sid = sid[-1]


def _verified(width: int, percent: int):
    """Of rows (a, b, a_text, b_text), those of at least the wanted similarity.  Rows of one a follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, at, bt in zip(batch.column("a"), batch.column("a_text"), batch.column("b_text"), strict=True):
                if a.as_py() != last:
                    last, of = a.as_py(), shingles(at.as_py(), width)
                other = shingles(bt.as_py(), width)
                both = len(np.intersect1d(of, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(of) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(scratch: Scratch, pairs: DataFrame, texts: DataFrame, width: int, percent: int, split: int = 256) -> DataFrame:
    """The pairs (a, b) of sids that link, verified on their texts.

    Many pairs may have the same a, a pivot: they are dealt to a part for every ``split`` of
    them, each with a copy of its text, so that no text is in one task with all of them."""
    texts = texts.select(F.col("sid").alias("t_sid"), F.col("text").alias("t_text"))
    parts = scratch.settled(pairs.groupBy("a").agg(F.ceil(F.count("*") / split).cast("int").alias("parts")))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    of_b = dealt.join(texts, F.col("b") == F.col("t_sid")).select("a", "b", "part", F.col("t_text").alias("b_text"))
    of_a = parts.join(texts, F.col("a") == F.col("t_sid")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("t_text").alias("a_text"))
    return of_b.join(of_a, ["a", "part"]).select("a", "b", "a_text", "b_text").mapInArrow(_verified(width, percent), "a long, b long")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of the one side shares with each of the other."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    both = np.zeros((len(left), len(right)), np.float64)
    if not sizes[0].sum() or not sizes[1].sum():
        return both.astype(np.int64)
    n = sizes[0].sum()
    _, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    most = int(code.max()) + 1
    shared = (np.bincount(code[:n], minlength=most) > 0) & (np.bincount(code[n:], minlength=most) > 0)
    column = np.cumsum(shared) - 1
    sides = []
    for side, codes in zip(sizes, (code[:n], code[n:]), strict=True):
        owner, on = np.repeat(np.arange(len(side)), side), shared[codes]
        at = column[codes[on]]
        order = np.argsort(at, kind="stable")
        sides.append((owner[on][order], at[order]))
    step = 4096
    for lo in range(0, int(shared.sum()), step):
        dense = []
        for (owner, at), size in zip(sides, (len(left), len(right)), strict=True):
            some = slice(*np.searchsorted(at, (lo, lo + step)))
            m = np.zeros((size, step), np.float32)
            m[owner[some], at[some] - lo] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    return both.astype(np.int64)


def _halves(pdf) -> tuple[np.ndarray, np.ndarray]:
    side = pdf["side"].to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


_BLOCK = ["h", "size_class", "kind", "i", "j"]
_BLOCK_DDL = "h long, size_class int, kind int, i int, j int"


def _block_candidates(percent: int):
    """The sets of a block that may link with one of the other side, by ids alone.

    Rows hold the n-grams of a set's prefix.  A pair must share as many of them as the less
    demanding of the two asks for, and with what lies behind the prefixes enough to link.
    It is told in the least n-gram of those where it meets, so that it is compared once."""

    def run(pdf):
        left, right = _halves(pdf)
        hs = [np.asarray(x, np.int64) for x in pdf["hs"]]
        n, more, of = (pdf[c].to_numpy() for c in ("n", "more", "component"))
        shared = _shared([hs[k] for k in left], [hs[k] for k in right])
        here = pdf["h"].iloc[0]
        led = [np.asarray(pdf["led"].iloc[k], np.int64) for k in left]
        earlier = _shared([x[x < here] for x in led], [hs[k][hs[k] < here] for k in right])
        behind = -(-percent * n // 100) - more
        x, y = left[:, None], right[None, :]
        ok = (earlier == 0) & (shared >= np.minimum(more[x], more[y])) & (of[x] != of[y]) & (100 * n[x] >= percent * n[y]) & (n[x] <= n[y])
        ok &= (100 + percent) * (shared + np.maximum(behind[x], behind[y])) >= percent * (n[x] + n[y])
        stay = np.concatenate([left[ok.any(1)], right[ok.any(0)]])
        return pdf.iloc[stay][[*_BLOCK, "side", "sid", "component"]]

    return run


def _block_links(width: int, percent: int):
    """Links between the two sides of a block, as many as join the components that they join."""

    def run(pdf):
        import pandas as pd

        sets = [shingles(t, width) for t in pdf["text"]]
        left, right = _halves(pdf)
        sizes = np.array([len(s) for s in sets], np.int64)
        both = _shared([sets[k] for k in left], [sets[k] for k in right])
        union = sizes[left][:, None] + sizes[right][None, :] - both
        sid, of = pdf["sid"].to_numpy(), pdf["component"].to_numpy()
        ok = (100 * both >= percent * union) & (union > 0) & (of[left][:, None] != of[right][None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        out = []
        for i, j in np.argwhere(ok):
            x, y = find(of[left[i]]), find(of[right[j]])
            if x != y:
                root[x] = y
                out.append((sid[left[i]], sid[right[j]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _large_group_links(scratch: Scratch, rows: DataFrame, placed: DataFrame, texts: DataFrame, width: int, percent: int, block: int, held: int) -> DataFrame:
    """Links between components within n-grams of many sets.  ``rows``: h, sid, n, more, leads, component.

    Of each n-gram, the sets that it leads (``leads``) meet the others that are no smaller and
    not too large, in blocks of about equal sizes; what lies in the n-gram's largest component
    meets only what lies outside it.  A first pass holds the ids of prefixes against each
    other; the texts of those sets alone that a pair of it passes go to the second."""
    ratio = max(100 / percent, 1.01)
    by_part = rows.groupBy("h", "component").agg(F.count("*").alias("size"))
    main = scratch.settled(by_part.groupBy("h").agg(F.max(F.struct("size", "component")).alias("main")).select("h", F.col("main.component").alias("main")))
    known = rows.join(main, "h").select(
        "h", "sid", "n", "more", "leads", "component", (F.col("component") != F.col("main")).alias("outside"), F.floor(F.log("n") / F.log(F.lit(ratio)) + 1e-9).cast("int").alias("size_class")
    )
    known = scratch.settled(known)
    counts = known.groupBy("h", "size_class").agg(
        *[F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in (("l_out", F.col("leads") & F.col("outside")), ("l_in", F.col("leads") & ~F.col("outside")), ("r_out", F.col("outside")), ("r_all", F.lit(True)))]
    )
    # A set of one class meets its own and the next one; a block is dealt by n-grams held as well as by sets.
    others = counts.unionByName(counts.withColumn("size_class", F.col("size_class") - 1)).groupBy("h", "size_class").agg(F.sum("r_out").alias("r_out"), F.sum("r_all").alias("r_all"))
    each = F.greatest(F.lit(8), F.least(F.lit(block), F.floor(F.lit(held) / F.pow(F.lit(ratio), F.col("size_class") + 2))))
    plan = counts.select("h", "size_class", "l_out", "l_in").join(others, ["h", "size_class"]).select(
        "h", "size_class", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("l_out").alias("l"), F.col("r_all").alias("r")), F.struct(F.lit(1).alias("kind"), F.col("l_in").alias("l"), F.col("r_out").alias("r")))).alias("p"), each.alias("each")
    )
    plan = scratch.settled(
        plan.where("p.l > 0 and p.r > 0").select("h", "size_class", "p.kind", F.ceil(F.col("p.l") / F.col("each")).cast("int").alias("lefts"), F.ceil(F.col("p.r") / F.col("each")).cast("int").alias("rights"))
    )
    asked = known.join(plan.select("h").distinct(), "h", "left_semi").select("sid").distinct()
    in_plan = plan.select("h").distinct().withColumn("big", F.lit(True))
    marked = placed.join(asked, "sid", "left_semi").join(in_plan, "h", "left")
    prefixes = scratch.settled(marked.groupBy("sid").agg(F.collect_list("h").alias("hs"), F.collect_list(F.when(F.col("big") & F.col("leads"), F.col("h"))).alias("led")))
    full = known.join(prefixes, "sid").withColumn("deal", F.xxhash64(F.lit(7), "sid"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    kept = ["sid", "n", "more", "component", "hs", "led"]
    left = full.where("leads").join(plan, ["h", "size_class"]).where("(kind = 0) = outside")
    left = left.select("h", "size_class", "kind", F.pmod("deal", "lefts").cast("int").alias("i"), every("rights").alias("j"), F.lit(0).alias("side"), *kept)
    right = full.withColumn("size_class", F.explode(F.array("size_class", F.col("size_class") - 1))).join(plan, ["h", "size_class"]).where("kind = 0 or outside")
    right = right.select("h", "size_class", "kind", every("lefts").alias("i"), F.pmod("deal", "rights").cast("int").alias("j"), F.lit(1).alias("side"), *kept)
    both = left.unionByName(right)
    near = scratch.settled(both.groupBy(*_BLOCK).applyInPandas(_block_candidates(percent), f"{_BLOCK_DDL}, side int, sid long, component long"))
    return near.join(texts, "sid").groupBy(*_BLOCK).applyInPandas(_block_links(width, percent), "a long, b long")


def jaccard_components(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 75,
    hot: int = 2000,
    large: int = 64,
    block: int = 512,
    held: int = 1 << 21,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, n_links), one row per distinct document.

    Documents link when 100 * |intersection| >= percent * |union| of their n-gram sets;
    component_id is the smallest doc_id reachable.  ``n_links`` counts the verified links
    of the document's set that the contraction kept.  ``hot`` is the estimated count from
    which an n-gram's group is dealt to several tasks, ``large`` the sets from which a
    group's pairs are compared in blocks, ``block`` their size in sets and ``held`` in n-grams;
    none changes a result.

    Null and empty texts have no n-grams and link with nothing.  Rows that repeat a doc_id
    must repeat its text and give one row; a null doc_id is dropped, as it can name no
    component.  Further columns are ignored.  Sets are told apart by 64-bit digests.
    """
    rows = docs.transform(documents_of, id_col, text_col).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = rows.sparkSession
    signed = settled(rows.mapInArrow(_signed(width), "doc_id long, n long, sid long, slice int, counts binary"))
    signed_docs = signed.where("slice is null").select("doc_id", "n", "sid")
    with Scratch(spark) as scratch:
        counts = _sketch(signed)
        usual = int(np.median(counts)) + 1
        sketch = spark.sparkContext.broadcast(counts)
        postings = rows.select("text").mapInArrow(_postings(sketch, usual, width, percent, hot), _ddl(_POSTED))
        # The pivot of a group is the least of a fixed shuffle of its sids: mostly the same in all groups of the same sets.
        dealt = postings.repartition("h", "salt").sortWithinPartitions("h", "salt", "sid")
        grouped = scratch.settled(dealt.mapInArrow(_pivoted, _ddl(_GROUPED)))

        sets = signed_docs.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
        wanted = scratch.settled(grouped.select("sid").distinct().join(sets, "sid").select("sid", F.col("rep").alias("w_id")))
        texts = scratch.settled(rows.join(wanted, F.col("doc_id") == F.col("w_id")).select("sid", "text").dropDuplicates(["sid"]))

        fits = lambda x, y: (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))
        # A pair that shares little with its pivot is left to step 4, which counts all that it shares.
        to_pivot = (
            grouped.where("sid <> pivot")
            .where(fits("n", "pivot_n"))
            .groupBy(F.col("pivot").alias("a"), F.col("sid").alias("b"))
            .agg(F.count("*").alias("met"), F.first("n").alias("n"))
            .where("16 * met >= n")
            .select("a", "b")
        )
        # The pivots of a salted n-gram are tied to the least of them.
        salted = grouped.where("sid = pivot").groupBy("h").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a < z").select("h", "a")
        across = grouped.where("sid = pivot").join(salted, "h").where("sid <> a").select("a", F.col("sid").alias("b"))
        pairs = scratch.settled(to_pivot.unionByName(across).distinct())
        links = scratch.settled(_links(scratch, pairs, texts, width, percent))
        first = scratch.settled(components(links, scratch))

        # What is left: n-grams whose sets lie in several components, one of them led by it.
        placed = grouped.select("h", "sid", "n", "more", "leads").join(first.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        placed = scratch.settled(placed)
        spanning = scratch.settled(
            placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("leads").alias("led"), F.count("*").alias("size")).where("lo < hi and led").select("h", "size")
        )
        open_rows = scratch.settled(placed.join(spanning, "h"))
        in_large = open_rows.where(F.col("size") > large).drop("size")
        from_large = scratch.settled(_large_group_links(scratch, in_large, placed, texts, width, percent, block, held))

        in_small = open_rows.where(F.col("size") <= large)
        x, y = (in_small.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("sid", "n", "more", "leads", "component")]) for k in "xy")
        # A pair that meets in an n-gram of a large group was compared there; all others share as many as they must in small ones.
        crossing = (
            x.where("leads_x")
            .join(y, "h")
            .where("component_x <> component_y and (n_x < n_y or (n_x = n_y and sid_x < sid_y))")
            .where(fits("n_x", "n_y"))
            .groupBy("sid_x", "sid_y")
            .agg(F.count("*").alias("shared"), F.first(F.least("more_x", "more_y")).alias("wanted"))
            .where("shared >= wanted")
            .select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b"))
            .join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        )
        crossing = scratch.settled(crossing)
        more_links = scratch.settled(_links(scratch, crossing, texts, width, percent))
        joined = links.unionByName(more_links).unionByName(from_large)
        whole = scratch.settled(components(joined, scratch))

        degree = joined.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        of_set = sets.join(whole.select(F.col("node").alias("sid"), "component"), "sid", "left").select("sid", "rep", F.coalesce("component", "sid").alias("component"))
        of_set = scratch.settled(of_set)
        least = of_set.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = settled(of_set.join(least, "component").join(degree.select(F.col("node").alias("sid"), "n_links"), "sid", "left").select("sid", "component_id", "n_links"))
    return (
        signed_docs.groupBy("doc_id")
        .agg(F.max("n").alias("n_shingles"), F.max("sid").alias("sid"))
        .join(named, "sid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("sid").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
