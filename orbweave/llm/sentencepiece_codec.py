"""SentencePiece encoding and decoding by a forward pass over a trie of marked words.

Each batch's distinct marked words are sorted, which is the order of a depth-first walk of
their trie; the forward states of a shared prefix are kept from one word to the next.  For
merges, words are cut further where two characters meet that no piece holds side by side:
no merge joins them, so what lies between has the same pieces in every word.

For a unigram vocabulary the state of a prefix is the score of its best path and the last
piece on it: Viterbi, with the scores reused across words that share the prefix.

For a merge vocabulary (BPE) the best-scoring path is not the segmentation that merging
gives.  There the state of a prefix is the last piece of that prefix's own segmentation: it
is the one piece that ends there and follows its predecessor's state without merging
differently, so it is found from the states of shorter prefixes, as in a Viterbi pass, and
the result equals the merges exactly.  Beside it a prefix keeps the longest of its endings
with which a piece begins: the pieces that end there are among that one's own endings.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import parts

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


#: Fixed values of the format: places in a model file, the kinds of models, and what an unknown character costs.
TRAINER, NORMALIZER, MODEL_TYPE, CHARSMAP, REMOVE_SPACES = 2, 3, 3, 2, 4
UNIGRAM, MERGES = 1, 2
UNKNOWN_COST = 10.0

#: What is kept of neighbouring pieces, and of a character after an ending; beyond, it is found anew.
PAIRS, MOVES = 200_000, 200_000

#: Longer pieces are looked up by their last three characters; of any others only two lengths are left.
TAIL, SHORT = 3, (2, 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers, and the bytes of all others."""
    at = 0

    def integer() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = integer()
        if key & 7 == 0:
            yield key >> 3, integer()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or integer()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces and scores of a model file, with the forward pass over them.

    Unigram and merge vocabularies without a normalization of their own are read."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        told = [(k, dict(_fields(v))) for k, v in _fields(p.serialized_model_proto()) if k in (TRAINER, NORMALIZER)]
        self.kind = next((v.get(MODEL_TYPE, UNIGRAM) for k, v in told if k == TRAINER), UNIGRAM)
        changes = next((v for k, v in told if k == NORMALIZER), {})
        if self.kind not in (UNIGRAM, MERGES) or changes.get(CHARSMAP) or changes.get(REMOVE_SPACES, 1):
            raise ValueError("only unigram and merge vocabularies that leave texts as they are")
        n = p.vocab_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        special = [p.is_unknown(i) or p.is_control(i) or p.is_unused(i) or p.is_byte(i) for i in range(n)]
        self.ids = {self.pieces[i]: i for i in range(n) if not special[i]}
        self.scores = {self.pieces[i]: p.get_score(i) for i in range(n) if not special[i]}
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(n) if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if p.is_control(i) or p.is_unknown(i)}
        # What each id says alone; bytes beyond ASCII say something only together.
        self.alone = ["" if i in self.control else chr(self.byte_of[i]) if i in self.byte_of else x for i, x in enumerate(self.pieces)]
        self.partial = {i for i, b in self.byte_of.items() if b > 127}
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            ends.setdefault(piece[-TAIL:], {1, 2}).add(len(piece))
        # How long the pieces are that end with three characters, the longest first.
        self.sizes = {tail: tuple(sorted(of, reverse=True)) for tail, of in ends.items() if len(tail) == TAIL}
        self.apart = self._cut_between()
        # What each id says alone, and then in front of a text, where a space is left out; and which of these must be looked at with others.
        said = [x.replace(MARK, " ") for x in self.alone]
        self.said = pa.array(said + [x.removeprefix(" ") for x in said], pa.large_string())
        self.together = np.array([i in self.partial for i in range(n)] + [i in self.partial or not x for i, x in enumerate(said)])
        self._prefixes = {p[:k] for p in self.ids for k in range(len(p) + 1)}
        self._nodes: dict[str, tuple[dict, tuple, str]] = {"": ({}, (), "")}
        self._moves = self._pairs = 0
        self._halves: dict[str, tuple[str, str] | tuple[()] | None] = {}
        self.unknown = p.unk_id()
        self.unknown_score = np.float32(np.float32(min(self.scores.values(), default=0.0)) - np.float32(UNKNOWN_COST))

    def merged(self, word: str, until: int = 1) -> list[str]:
        """The segmentation by merges: the best-scoring pair of neighbours, the left one of equals,
        again and again while there are more than ``until`` parts."""
        parts = list(word)
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _cut_between(self) -> np.ndarray:
        """Of any two bytes side by side in a text with spaces for marks, whether it is cut between them:
        a word begins with the second one, or no piece holds both."""
        joined = np.ones((256, 256), bool)
        if self.kind == MERGES and self.bytes:  # without bytes, neighbours that are no pieces are one unknown
            joined[:] = False
            spelt = (p.replace(MARK, " ").encode() for p in self.ids)
            pairs = {b[k : k + 2] for b in spelt for k in range(len(b) - 1)}
            joined.ravel()[np.frombuffer(b"".join(pairs), ">u2")] = True
            joined[:, 0x80:0xC0] = True  # inside a character
        joined[np.arange(256) != 32, 32] = False
        return ~joined.ravel()

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where what is segmented alone begins in the bytes of texts that begin at ``starts``, the last of which is their end."""
        begins = np.zeros(len(data), bool)
        begins[1:] = self.apart[data[:-1].astype(np.uint16) << 8 | data[1:]]
        begins[starts[starts < len(data)]] = True
        return np.flatnonzero(begins)

    def _follows(self, left: str, right: str, known: dict[str, bool]) -> bool:
        """Whether two pieces side by side stay as they are; kept with the others that precede the right one."""
        if self._pairs > PAIRS:
            for _, ends, _ in self._nodes.values():
                for _, _, of in ends:
                    of.clear()
            self._pairs = 0
        self._pairs += 1
        fits = known[left] = not left or self._apart(left, right)
        return fits

    def _moved(self, node: tuple[dict, tuple, str], char: str) -> tuple[dict, tuple, str]:
        """Where a character leads: to the longest ending with which a piece begins.

        A node holds where it leads, the pieces of more than one character that end with it and that
        merging gives (their size and what is known of those before them), the longest first, and its text."""
        text = node[2] + char
        while text not in self._prefixes:
            text = text[1:]
        if (found := self._nodes.get(text)) is None:
            ends = (self.pieces[self.ids[text[k:]]] for k in range(len(text) - 1) if text[k:] in self.ids)
            found = self._nodes[text] = ({}, tuple((len(p), p, {}) for p in ends if self._made_of(p) is not None or self.merged(p) == [p]), text)
        if self._moves > MOVES:
            for moves, _, _ in self._nodes.values():
                moves.clear()
            self._moves = 0
        self._moves += 1
        node[0][char] = found
        return found

    def _made_of(self, piece: str) -> tuple[str, str] | tuple[()] | None:
        """The halves that merging joins last into a piece, each made before it; none of a single
        character; None where merging does not give the piece, or joins it out of order."""
        if piece not in self._halves:
            halves = tuple(self.merged(piece, 2)) if len(piece) > 1 else ()
            if halves:
                whole = self.scores.get(piece)
                before = lambda h: len(h) == 1 or (self.scores[h] > whole and self._made_of(h) is not None)
                if whole is None or len(halves) != 2 or not all(map(before, halves)):
                    halves = None
            self._halves[piece] = halves
        return self._halves[piece]

    def _apart(self, left: str, right: str) -> bool:
        """``merged(left + right) == [left, right]``, from the order in which either was made.

        Back in time, the later made of the two pieces beside the boundary is taken apart: they merge
        if what they spell scores better than what took their place (equals: the left one)."""
        if self._made_of(left) is None or self._made_of(right) is None:
            return self.merged(left + right) == [left, right]
        limit, ties = -np.inf, False
        while True:
            joined = self.scores.get(left + right)
            if joined is not None and (joined > limit or (ties and joined == limit)):
                return False
            a, b = self._made_of(left), self._made_of(right)
            if not a and not b:
                return True
            if a and (not b or self.scores[left] < self.scores[right]):
                limit, ties, left = self.scores[left], False, a[1]
            else:
                limit, ties, right = self.scores[right], True, b[0]

    def forward(self, words: list[str]) -> dict[str, list[str]]:
        """The segmentation of each word.  The words must be sorted."""
        return self._best(words) if self.kind == UNIGRAM else self._merges(words)

    def _best(self, words: list[str]) -> dict[str, list[str]]:
        """Viterbi over the trie: the state of a prefix is its best score and the size of the last piece.

        Of equal scores the longer last piece counts; scores are 32-bit numbers, as in the library."""
        out, last = {}, ""
        best, size_of = [np.float32(0)], [0]
        for word in words:
            k, most = 0, min(len(last), len(word))
            while k < most and last[k] == word[k]:
                k += 1
            del best[k + 1 :], size_of[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                score, chosen = None, 1
                for size in self.sizes.get(word[max(end - TAIL, 0) : end], SHORT):
                    if size > end:
                        continue
                    own = self.scores.get(word[end - size : end])
                    if own is None:
                        if size > 1:
                            continue
                        own = self.unknown_score
                    total = best[end - size] + np.float32(own)
                    if score is None or total > score:
                        score, chosen = total, size
                best.append(score)
                size_of.append(chosen)
            last, parts, end = word, [], len(word)
            while end:
                parts.append(word[end - size_of[end] : end])
                end -= size_of[end]
            out[word] = parts[::-1]
        return out

    def _merges(self, words: list[str]) -> dict[str, list[str]]:
        out, last, states, path = {}, "", [""], [self._nodes[""]]
        for word in words:
            k, most = 0, min(len(last), len(word))
            while k < most and last[k] == word[k]:
                k += 1
            del states[k + 1 :], path[k + 1 :]
            node = path[k]
            for end, char in enumerate(word[k:], k + 1):
                if (to := node[0].get(char)) is None:
                    to = self._moved(node, char)
                node, found = to, char
                for size, piece, known in node[1]:
                    left = states[end - size]
                    if (fits := known.get(left)) is None:
                        fits = self._follows(left, piece, known)
                    if fits:
                        found = piece
                        break
                states.append(found)
                path.append(node)
            last, parts, end = word, [], len(word)
            while end:
                parts.append(states[end])
                end -= len(states[end])
            out[word] = parts[::-1]
        return out

    def ids_of(self, parts: list[str]) -> list[int]:
        """Ids of pieces; what is no piece is spelt in its UTF-8 bytes, or unknown (once for
        neighbours) where the vocabulary has no bytes."""
        out = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        text = self._with_bytes(ids).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of ids that lie one after another: one text's begin at each of ``bounds``, the last of which is their end."""
        if len(ids) and ids.max() >= len(self.pieces):
            raise IndexError("an id beyond the vocabulary")
        full = np.flatnonzero(bounds[:-1] < bounds[1:])
        at = ids.astype(np.int64)
        at[bounds[full]] += len(self.pieces)
        said = self.said.take(pa.array(at))
        ends = np.frombuffer(said.buffers()[1], np.int64)[: len(at) + 1][bounds].astype(np.int32)
        texts = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(ends), said.buffers()[2] or pa.py_buffer(b"")])
        together = self.together[at]
        if not together.any():
            return texts
        texts = texts.to_pylist()
        for k in full[np.logical_or.reduceat(together, bounds[full])]:
            texts[k] = self.decode(ids[bounds[k] : bounds[k + 1]].tolist())
        return pa.array(texts, pa.string())

    def _with_bytes(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(self.alone[i])
        return "".join(out) + held.decode(errors="replace")


def marked_words(text: str) -> list[str]:
    """The words of a text with its spaces as marks, one more in front.  No piece spans two of them."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


_models: dict[str, tuple[PieceModel, dict[str, bytes]]] = {}
#: What is segmented alone whose ids a worker keeps from part to part; beyond, it starts anew.
KEPT_WORDS = 250_000
#: Texts that are encoded at once, and their bytes, or one text.
ROWS, BYTES = 1024, 4_000_000


def _model(path: str) -> tuple[PieceModel, dict[str, bytes]]:
    if path not in _models:
        _models[path] = (PieceModel(path), {})
    return _models[path]


def _ids_of_texts(model: PieceModel, kept: dict[str, bytes], texts: pa.Array) -> pa.ListArray:
    marked = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    marked = pc.binary_join_element_wise(pc.if_else(pc.equal(marked, none), none, space), marked, none)
    bounds = np.frombuffer(marked.buffers()[1], np.int64)[: len(marked) + 1]
    data = marked.buffers()[2] or pa.py_buffer(b"")
    at = model.cuts(np.frombuffer(data, np.uint8)[: bounds[-1]], bounds)
    units = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, bounds[-1])), data]).dictionary_encode()
    words = units.dictionary.to_numpy(zero_copy_only=False).tolist()
    new = [w for w in words if w not in kept]
    if len(kept) + len(new) > KEPT_WORDS:
        kept.clear()
        new = words
    for word, parts in model.forward(sorted(w.replace(" ", MARK) for w in new)).items():
        kept[word.replace(MARK, " ")] = array("i", model.ids_of(parts)).tobytes()
    blobs = pa.array([kept[w] for w in words], pa.large_binary()).take(units.indices)
    ends = np.frombuffer(blobs.buffers()[1], np.int64)[: len(at) + 1] // 4
    null = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
    offsets = pa.array(ends[np.searchsorted(at, bounds)].astype(np.int32), mask=null if texts.null_count else None)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(blobs.buffers()[2] or b"", np.int32)[: ends[-1]]))


def _texts_of_ids(model: PieceModel, ids: pa.ListArray) -> pa.Array:
    counts = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    texts = model.decode_all(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]))
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), texts) if ids.null_count else texts


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the piece ids of each text, one row per row; with ``decoded`` also ``text``, what the ids say.

    A null text gives null ids, an empty one none.  Further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = _model(model_path)
        for batch in batches:
            # Long texts make small parts, so that a batch's ids stay bounded.
            for part in parts(batch, ROWS, BYTES):
                ids = _ids_of_texts(model, kept, part.column(1))
                columns = [part.column(0).cast(pa.int64()), ids] + [_texts_of_ids(model, ids)] * decoded
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text): the text of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts_of_ids(model, part.column(1))], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
