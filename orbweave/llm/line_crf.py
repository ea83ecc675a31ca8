"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are its own and those of the lines before and
after it.  The field is trained on documents whose lines all carry the document's label;
forward-backward gives each line's probability of being good, their mean weighted by
length is the document's, and a logistic curve fitted on the same documents calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

N_OWN = 14


def line_features(line: str, seen: set[str]) -> list[float]:
    data = line.encode("utf-8", "surrogatepass")
    n, words = max(len(data), 1), line.split()
    w = len(words)
    count = lambda chars: (len(data) - len(data.translate(None, chars))) / n
    again = sum(map(str.__eq__, words, words[1:]))
    repeated = line in seen and w > 0
    seen.add(line)
    return [
        1.0,
        np.log1p(w),
        min(n / (w + 1), 40) / 10,
        count(b"#*$%&<>"),
        count(b"|"),
        count(b"!?"),
        count(b"0123456789"),
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        count(b"abcdefghijklmnopqrstuvwxyz"),
        len(set(words)) / w if w else 0.0,
        again / w if w else 0.0,
        float(line.rstrip()[-1:] in {".", "!", "?"}),
        float(w <= 2),
        float(repeated),
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, lengths); a null or empty text is one empty line."""
    lines, seen = (text or "").split("\n"), set()
    own = np.array([line_features(line, seen) for line in lines])
    edge = np.zeros((1, N_OWN))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])]), np.array([max(len(line), 1) for line in lines], float)


class Chain:
    """Weights of the field and of the calibration, and what they say of documents."""

    def __init__(self):
        k = 3 * N_OWN
        self.mean, self.scale = np.zeros(k), np.ones(k)
        self.weights, self.moves = np.zeros(k), np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """The score of good over bad of each line."""
        return ((x - self.mean) / self.scale) @ self.weights

    def marginals(self, score: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """P(good) of each line, the expected moves and log Z, by forward-backward.

        All documents go a line at a time together, longest first."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        emit = np.stack([np.zeros(len(score)), score], 1)
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), "left")  # documents with more than t lines
        if longest:
            ahead[starts] = emit[starts]
        for t in range(1, longest):
            at = starts[: active[t]] + t
            before = ahead[at - 1]
            ahead[at] = emit[at] + np.logaddexp(before[:, :1] + self.moves[0], before[:, 1:] + self.moves[1])
        for t in range(longest - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            after = emit[at + 1] + back[at + 1]
            back[at] = np.logaddexp(after[:, :1] + self.moves[:, 0], after[:, 1:] + self.moves[:, 1])
        total = np.logaddexp(*(ahead + back).T)
        good = np.exp((ahead + back)[:, 1] - total)
        inner = np.ones(len(score), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        pairs = ahead[at - 1][:, :, None] + self.moves + (emit + back)[at][:, None, :] - total[at][:, None, None]
        return good, np.exp(pairs).sum(0), total[starts].sum()

    def raw(self, x: np.ndarray, lengths: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        good, _, _ = self.marginals(self.emissions(x), starts, sizes)
        p = np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def line_marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """P(good) of each line of each text."""
        if not texts:
            return []
        parts = [document_features(t)[0] for t in texts]
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes)
        good, _, _ = self.marginals(self.emissions(np.vstack(parts)), ends - sizes, sizes)
        return np.split(good, ends[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        parts = [document_features(t) for t in texts]
        sizes = np.array([len(x) for x, _ in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        raw = self.raw(np.vstack([x for x, _ in parts]), np.concatenate([n for _, n in parts]), starts, sizes)
        return 1 / (1 + np.exp(-(self.slope * raw + self.shift)))

    def fit(self, texts: list[str | None], labels: np.ndarray, *, steps: int = 80, rate: float = 0.15, decay: float = 1e-3) -> Chain:
        """Gradient ascent (Adam) on the mean log-likelihood of the lines' labels."""
        if not texts or len(set(labels.tolist())) < 2:
            return self
        parts = [document_features(t) for t in texts]
        sizes = np.array([len(x) for x, _ in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x, lengths = np.vstack([p for p, _ in parts]), np.concatenate([n for _, n in parts])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.mean[0], self.scale[0] = 0, 1
        z = (x - self.mean) / self.scale
        y = np.repeat(labels.astype(float), sizes)
        # Each document weighs the same, and either label as much as the other.
        share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))
        weight = np.repeat(share / sizes, sizes)
        moved = np.zeros((2, 2))
        moved[0, 0], moved[1, 1] = ((share * (sizes - 1) / sizes)[labels == k].sum() for k in (0, 1))
        m = [np.zeros_like(self.weights), np.zeros((2, 2))]
        v = [np.zeros_like(self.weights), np.zeros((2, 2))]
        for step in range(1, steps + 1):
            good, pairs, _ = self.marginals(z @ self.weights, starts, sizes)
            g = [z.T @ (weight * (y - good)) - decay * self.weights, moved - pairs / max(pairs.sum(), 1e-9) * moved.sum() - decay * self.moves]
            for k, now in enumerate((self.weights, self.moves)):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                now += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        raw = self.raw(x, lengths, starts, sizes)
        for _ in range(50):  # Newton steps of the logistic curve
            p = 1 / (1 + np.exp(-(self.slope * raw + self.shift)))
            r = p * (1 - p) + 1e-9
            grad = np.array([((labels - p) * raw).sum() - 1e-2 * (self.slope - 1), (labels - p).sum()])
            hess = np.array([[(r * raw * raw).sum() + 1e-2, (r * raw).sum()], [(r * raw).sum(), r.sum() + 1e-3]])
            move = np.clip(np.linalg.solve(hess, grad), -1, 1)
            self.slope, self.shift = max(self.slope + move[0], 1e-3), self.shift + move[1]
        return self


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3."""
    return F.crc32(doc_id.cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = 1500) -> Chain:
    """A field fitted on at most ``max_docs`` labelled documents outside fold 1.

    The sample is the first by a hash of the id; it is what reaches the driver."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 1))
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Chain().fit([r["text"] for r in rows], np.array([r["quality"] for r in rows], np.int64))


def score_quality(docs: DataFrame, chain: Chain) -> DataFrame:
    """The columns of ``docs`` (with doc_id and text) with score and predicted, one row per row.

    ``docs`` may hold any further columns except score and predicted, which are replaced.
    Null and empty texts are scored as one empty line."""
    kept = docs.drop("score", "predicted")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                score = chain.scores(part.column(part.schema.get_field_index("text")).to_pylist())
                arrays = [*part.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def label_lines(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, good, label): each line's number from 0, its marginal and whether that is
    at least a half.  A null or empty text is one empty line; repeated rows are labelled each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("line", IntegerType()), StructField("good", DoubleType()), StructField("label", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                goods = chain.line_marginals(part.column(1).to_pylist())
                sizes = np.array([len(g) for g in goods])
                good = np.concatenate(goods)
                line = np.arange(len(good)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(len(goods)), sizes))), pa.array(line, pa.int32()), pa.array(good), pa.array((good >= 0.5).astype(np.int32))], names=["doc_id", "line", "good", "label"]
                )

    return rows.mapInArrow(run, schema)
