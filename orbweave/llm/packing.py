"""Packing by lexical retrieval.

Documents are tokenized, cut into whole windows, and their rests packed: each shard has a
BM25 index over the token ids of the whole documents; the longest unused rest seeds a
window, is scored on all terms of its document, and its best-scoring unused neighbours
fill it, the last one cut where the window ends.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import parts

END = 1
#: Bytes of a chunk beyond which it is split by itself.
LONG = 1024
#: Bytes of text, and rows, that are encoded together; one row may have more.
BYTES, ROWS = 8_000_000, 2048


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable ones
    themselves, the others those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Token ids of texts; what stands between two spaces is encoded once for all texts of a call.

    The pre-tokenizer ties a space to the character after it, so a text may be cut before
    every space that a character other than white space follows.  The vocabulary is that of
    the tokenizers file; tiktoken merges by its ranks, to the same ids in a fifth of the time.
    The file's added tokens are cut out first, the leftmost and longest of them, and have
    their own ids.  Where one takes white space or word ends into account, or is looked for
    in normalized text, texts that hold an added token are left to the library."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        added = told.get("added_tokens") or []
        self.added_ids = {t["content"]: np.array([t["id"]], np.uint32) for t in added}
        either = "|".join(map(re.escape, sorted(self.added_ids, key=len, reverse=True)))
        self.added = re.compile(f"({either or '(?!)'})")
        self.plain = not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or (t.get("normalized") and told.get("normalizer")) for t in added)
        byte_of = {c: b for b, c in byte_characters().items()}
        ranks = {}
        for token, i in self.library.get_vocab().items():
            if all(c in byte_of for c in token) and token not in self.added_ids:
                ranks[bytes(byte_of[c] for c in token)] = i
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.merge, self.merge_all = encoding._encode_single_piece, encoding.encode_ordinary
        self.split = regex.compile(pattern).findall
        self.width = np.zeros(max(ranks.values(), default=0) + 1, np.int64)  # bytes of each token
        self.width[list(ranks.values())] = [len(t) for t in ranks]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.added.split(t) for t in texts]  # what lies between added tokens, and at odd places these
        if not self.plain:
            cut = [c if len(c) == 1 else ["", t] for c, t in zip(cut, texts, strict=True)]
        between = iter(self._encode_plain([s for c in cut for s in c[::2]]))

        def other(s: str) -> np.ndarray:
            return self.added_ids[s] if self.plain else np.array(self.library.encode(s, add_special_tokens=False).ids, np.uint32)

        return [next(between) if len(c) == 1 else np.concatenate([other(s) if k % 2 else next(between) for k, s in enumerate(c)]) for c in cut]

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)])
        joined = b"".join(data)
        at = _cuts(np.frombuffer(joined, np.uint8), starts)
        bounds = np.append(at, len(joined))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
        ids, counts = self._encode_chunks(chunks.dictionary)
        which = chunks.indices.to_numpy()
        counts, begin = counts[which], (np.cumsum(counts) - counts)[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = ids[np.repeat(begin - ends[:-1], counts) + np.arange(ends[-1])]
        of_text = ends[np.searchsorted(at, starts)]
        return [ids[i:j] for i, j in zip(of_text, of_text[1:], strict=False)]

    def _encode_chunks(self, chunks: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in order, and how many each has.

        Chunks that begin with a space and no more white space are merged as one text, and
        its tokens dealt out by their bytes; the others, and long ones, on which tiktoken's
        pattern may overflow its stack, are split and merged one by one."""
        bounds = np.frombuffer(chunks.buffers()[1], np.int64)[: len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        sizes = np.diff(bounds)
        tied = (sizes > 1) & (sizes <= LONG)
        tied[tied] = _tied(data, bounds[:-1][tied])
        counts = np.zeros(len(chunks), np.int64)
        together = np.array(self.merge_all(data[: bounds[-1]][np.repeat(tied, sizes)].tobytes().decode()), np.uint32)
        upto = np.searchsorted(np.cumsum(self.width[together]), np.cumsum(sizes[tied]), side="left") + 1
        counts[tied] = np.diff(upto, prepend=0)
        alone = [[i for t in self.split(c.decode()) for i in self.merge(t)] for c in chunks.filter(pa.array(~tied)).to_pylist()]
        counts[~tied] = [len(c) for c in alone]
        ids = np.empty(counts.sum(), np.uint32)
        of_tied = np.repeat(tied, counts)
        ids[of_tied] = together
        ids[~of_tied] = [i for c in alone for i in c]
        return ids, counts


def _tied(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a space and then no white space stand at each place of UTF-8 bytes.

    The lead bytes C2, E1, E2 and E3 count as white space, as some characters of theirs are."""
    after = data[at + 1]
    return (data[at] == 32) & (after > 32) & (after != 0xC2) & ((after < 0xE1) | (after > 0xE3))


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts that begin at ``starts``, the last of which is their end."""
    spaces = np.flatnonzero(data[:-1] == 32)
    begins = np.zeros(len(data), bool)
    begins[spaces[_tied(data, spaces)]] = True
    begins[starts[starts > 0] - 1] = False  # what follows is another text
    begins[starts[starts < len(data)]] = True
    return np.flatnonzero(begins)


class Index:
    """BM25 of a shard's token sequences for some of them as queries, all terms counted.

    The ``dense`` terms of most sequences are a matrix, which is read for many queries at
    once; all others are postings by term, of which a query reads those of its own."""

    def __init__(self, items: list[np.ndarray], k1: float = 1.2, b: float = 0.75, dense: int = 1024):
        found = [np.unique(i, return_counts=True) for i in items]
        self.terms = [t for t, _ in found]
        lengths = np.array([len(i) for i in items], np.int64)
        sizes = np.array([len(t) for t, _ in found], np.int64)
        self.n = len(items)
        term = np.concatenate([t for t, _ in found]).astype(np.int64) if found else np.empty(0, np.int64)
        tf = np.concatenate([c for _, c in found]) if found else term
        df = np.bincount(term)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lengths / max(lengths.mean(), 1)) if self.n else lengths
        owner = np.repeat(np.arange(self.n), sizes)
        weight = tf * (k1 + 1) / (tf + norm[owner]) * idf[term]
        often = np.argsort(-df, kind="stable")[:dense]
        self.column = np.full(len(df), -1)
        self.column[often] = np.arange(len(often))
        column = self.column[term]
        self.matrix = np.zeros((self.n, len(often)))
        self.matrix[owner[column >= 0], column[column >= 0]] = weight[column >= 0]
        self.rows = np.arange(self.n)
        rare = (column < 0) & (df[term] > 1)  # a term of one sequence alone is in no pair's score
        order = np.argsort(term[rare], kind="stable")
        self.docs, self.weights = owner[rare][order], weight[rare][order]
        self.first = np.searchsorted(term[rare][order], np.arange(len(df) + 1))

    def leave(self, alive: np.ndarray) -> None:
        """Once a quarter of the sequences is used up, their rows of the matrix go."""
        stay = alive[self.rows]
        if 4 * stay.sum() < 3 * len(stay):
            self.rows, self.matrix = self.rows[stay], self.matrix[stay]

    def scores(self, queries: list[int]) -> np.ndarray:
        """The score of every sequence that is left for each of ``queries``, sequences themselves (queries x sequences)."""
        terms = [self.terms[q] for q in queries]
        asked = np.zeros((self.matrix.shape[1], len(terms)))
        for q, t in enumerate(terms):
            column = self.column[t]
            asked[column[column >= 0], q] = 1
        out = np.zeros((len(terms), self.n))
        out[:, self.rows] = (self.matrix @ asked).T
        for q, t in enumerate(terms):
            begin, size = self.first[t], self.first[t + 1] - self.first[t]
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            out[q] += np.bincount(self.docs[at], self.weights[at], minlength=self.n)
        return np.round(out, 9)  # sums of the same terms in another order are a tie


def pack_shard(lengths: list[int], items: list[np.ndarray], window: int, ahead: int = 32, some: int = 64) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length); each id of each item stands in exactly one.

    ``items`` are the terms that retrieval goes by, all of each sequence, however much of
    it is left to place.  Sequences of more than a window give whole windows first; every
    window but the last is full.  A window takes, from the whole ranking for its seed, the
    neighbours that fit as a whole, then the best of the others cut; where none with a
    positive score is left, the longest rests go on.  ``ahead`` seeds are scored and ``some``
    neighbours are ranked at a time; neither changes a window."""
    out, rests = [], []
    for i, n in enumerate(lengths):
        out += [[(i, s, window)] for s in range(0, n - window + 1, window)]
        if n % window:
            rests.append((i, n - n % window, n % window))
    row = [r[0] for r in rests]
    index = Index([items[i] for i in row])
    start, left = np.array([r[1] for r in rests], np.int64), np.array([r[2] for r in rests], np.int64)
    order = np.argsort(-left, kind="stable")
    at, alive = 0, left.copy()  # alive: ids that are not placed
    known: dict[int, np.ndarray] = {}
    while True:
        while at < len(order) and not alive[order[at]]:
            at += 1
        if at == len(order):
            return out
        seed = order[at]
        space, pieces = window, []

        def place(k: int, n: int) -> None:
            nonlocal space
            pieces.append((row[k], int(start[k]), n))
            start[k] += n
            alive[k] -= n
            space -= n

        if seed not in known:
            # The next seeds, as far as no window takes them before, are scored together.
            next_seeds = [k for k in order[at : at + 4 * ahead].tolist() if alive[k]][:ahead]
            index.leave(alive > 0)
            known = dict(zip(next_seeds, index.scores(next_seeds), strict=True))
        scores = known[seed]
        place(seed, int(alive[seed]))
        near = (scores > 0) & (alive > 0)
        while space and len(fit := np.flatnonzero(near & (alive <= space))):
            if len(fit) > some:  # the best of them first, with all that tie with the last
                fit = fit[scores[fit] >= np.partition(scores[fit], -some)[-some]]
            fit = fit[np.argsort(-scores[fit], kind="stable")]
            for k in fit[: np.searchsorted(np.cumsum(alive[fit]), space, side="right")].tolist():
                place(k, int(alive[k]))
            near &= alive > 0
        if space and near.any():  # all are longer than what is free
            place(int(np.argmax(np.where(near, scores, 0))), space)
        while space:
            while at < len(order) and not alive[order[at]]:
                at += 1
            if at == len(order):
                break
            place(order[at], int(min(space, alive[order[at]])))
        out.append(pieces)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    *,
    window: int = 2048,
    shard_docs: int = 2048,
    shard_tokens: int = 4_000_000,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    A document's ids are those of its text and END after them; null and empty texts are
    END alone.  A shard is closed at ``shard_docs`` documents or ``shard_tokens`` ids, so
    that its index fits a task however the table grows; only its last sequence is not
    full.  Repeated rows are packed each; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, pattern)
        sequence = TaskContext.get().partitionId() << 40
        ids: list = []
        items: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, ids, items, held
            rows: list[list] = [[] for _ in range(8)]
            for pieces in pack_shard([len(x) for x in items], [x[:-1] for x in items], window):  # END is no term
                offset = 0
                for k, s, n in pieces:
                    part = items[k][s : s + n]
                    values = (ids[k], s, n, zlib.crc32(part.astype("<u4").tobytes()), len(items[k]), sequence, offset, part.astype(np.int32) if with_ids else None)
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                    offset += n
                sequence += 1
            arrays = [pa.array(c, pa.int64()) for c in rows[:7]] + ([pa.array(rows[7], pa.list_(pa.int32()))] if with_ids else [])
            ids, items, held = [], [], 0
            yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for part in _parts(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, tokens in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids.append(doc_id)
                    items.append(np.append(tokens, np.uint32(END)))
                    held += len(items[-1])
                    if len(items) >= shard_docs or held >= shard_tokens:
                        yield from flush()
        if items:
            yield from flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} long" for n in names[:7]) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch by parts of at most ROWS rows and BYTES of text, or of one row."""
    return parts(batch, ROWS, BYTES)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, pattern)
    return _encoders[path]
