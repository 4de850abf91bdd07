"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. A line's score for a label is linear in its own features and in those of
the line before and behind it; neighbouring labels have a transition score. Forward and backward sums give
each line's probability of being good; a document's quality is their mean, weighted by line length.

Training needs labels by document only: all lines of a sampled document carry its label, and the chain's
conditional likelihood, with a penalty on squared weights, is climbed in full batches. What is bounded is
the sample: about docs_per_label whole documents of each label, chosen by a hash of doc_id among rows that
aren't held out. Every document is scored whole, by itself.

What comes to the driver for training are the features of the sample's lines, so it grows with the length of
sampled documents but not with the table.

Defined results. A document with both labels is learnt from under both. Of rows that share a doc_id each is
learnt from, under the id's label. A null text is as an empty one: one empty line, which is scored like any other. If no
labelled row (or only one label) is there, every score is the share of label 1 (0.5 without any). Repeated
rows are scored each. Rows without doc_id are scored and never learnt from. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.langid import held_out

THRESHOLD = 0.3
BATCH_ROWS = 512

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"#*$%&|<>", b"!", b".,;:?", b"=\"'()[]{}/\\_-+@~^`", bytes(range(128, 256)))
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
#: Of a line by itself; a line's whole vector also has its neighbours' and a constant.
N_OWN = 15
N_FEATURES = 3 * N_OWN + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths (with the line's end), and the number of lines of each text."""
    sizes, n_lines, words, kinds, short, again = [], [], [], [], [], []
    for text in texts:
        lines = text.split(b"\n")
        n_lines.append(len(lines))
        seen = set()
        for line in lines:
            sizes.append(len(line) + 1)
            own = line.split()
            words.append(len(own))
            kinds.append(len(set(own)))
            short.append(sum([len(w) < 4 for w in own]))
            again.append(line in seen)
            seen.add(line)
    size = np.array(sizes)
    data = _CLASS[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts = np.cumsum(size) - size
    count = np.stack([np.add.reduceat(data == c, starts, dtype=np.int64) for c in range(len(_CLASSES))], 1).astype(np.float32)
    words, kinds, short = (np.array(x, np.float32) for x in (words, kinds, short))
    letters = count[:, 0] + count[:, 1] + count[:, 8] / 2
    black = np.maximum(size - 1 - count[:, 3], 1)
    some = np.maximum(words, 1)
    last = data[starts + np.maximum(size - 2, 0)]
    own = np.stack([
        count[:, 0] / np.maximum(letters, 1), count[:, 2] / black, count[:, 4] / black, np.minimum(1, count[:, 4] / some), np.minimum(1, count[:, 5] / some),
        count[:, 6] / some, count[:, 7] / black, count[:, 8] / black, np.log1p(words) / 5, np.where(words > 0, kinds / some, 1),
        np.minimum(2, letters / some / 10), short / some, (last == 6).astype(np.float32), np.array(again, np.float32), words == 0,
    ], 1).astype(np.float32)
    ends = np.cumsum(n_lines)
    first, final = np.zeros(len(size), bool), np.zeros(len(size), bool)
    first[ends - np.array(n_lines)] = True
    final[ends - 1] = True
    before, behind = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first] = 0
    behind[final] = 0
    x = np.concatenate([own, before, behind, np.stack([first, final, np.ones(len(size), bool)], 1).astype(np.float32)], 1)
    return x, size.astype(np.float64), np.array(n_lines)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


class Chain:
    """Weights of the two labels (0 bad, 1 good) and of their transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, constant: float | None = None):
        self.weights, self.moves, self.constant = weights, moves, constant

    def sums(self, x: np.ndarray, n_lines: np.ndarray):
        """Forward and backward log sums of all lines, for chains of different lengths at once."""
        score = x @ self.weights
        starts = np.cumsum(n_lines) - n_lines
        order = np.argsort(-n_lines, kind="stable")
        length, at = n_lines[order], starts[order]
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # chains of more than t lines
        forward, backward = score.copy(), np.zeros_like(score)
        for t in range(1, length[0]):
            i = at[: live[t]] + t
            forward[i] += _logsum(forward[i - 1][:, :, None] + self.moves, 1)
        for t in range(length[0] - 1, 0, -1):
            i = at[: live[t]] + t
            backward[i - 1] = _logsum(self.moves + (score[i] + backward[i])[:, None, :], 2)
        total = _logsum(forward[starts + n_lines - 1], 1)
        return score, forward, backward, total

    def good(self, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Each line's probability of label 1."""
        _, forward, backward, total = self.sums(x, n_lines)
        return np.exp(forward[:, 1] + backward[:, 1] - np.repeat(total, n_lines))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x, size, n_lines = line_features(texts)
        starts = np.cumsum(n_lines) - n_lines
        good = self.good(x, n_lines)
        return np.clip(np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts), 0, 1)


def fit(x: np.ndarray, n_lines: np.ndarray, label: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> Chain:
    """Climbs the mean conditional log-likelihood of documents, each with as much weight as another."""
    if len(label) == 0 or label.min() == label.max():
        return Chain(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), float(label.mean()) if len(label) else 0.5)
    x = x.astype(np.float64)
    line_label = np.repeat(label, n_lines)
    share = np.repeat(1 / n_lines, n_lines) / len(label)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(n_lines) - n_lines] = False  # lines with one before them
    second = np.flatnonzero(inner)
    gold = np.eye(2)[line_label]
    w, m = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    state = [np.zeros_like(p) for p in (w, w, m, m)]
    for step in range(1, rounds + 1):
        chain = Chain(w, m)
        score, forward, backward, total = chain.sums(x, n_lines)
        total = np.repeat(total, n_lines)
        p = np.exp(forward + backward - total[:, None])
        pair = np.exp(forward[second - 1][:, :, None] + m + (score[second] + backward[second])[:, None, :] - total[second, None, None])
        seen = gold[second - 1][:, :, None] * gold[second][:, None, :]
        grads = [x.T @ ((gold - p) * share[:, None]) - penalty * w, ((seen - pair) * share[second, None, None]).sum(0) - penalty * m]
        for i, (value, g) in enumerate(zip((w, m), grads)):
            a, b = state[2 * i], state[2 * i + 1]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            value += 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Chain(w, m)


def learn(docs: DataFrame, labels: DataFrame, docs_per_label: int = 1500) -> Chain:
    """A chain from docs (doc_id, text) and labels (doc_id, quality 0 or 1) of rows that aren't held out."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    have = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    scale = 1 << 20
    share = F.when(F.col("quality") == 1, min(scale, scale * docs_per_label // have.get(1, 1) + 1)).otherwise(min(scale, scale * docs_per_label // have.get(0, 1) + 1))
    # about docs_per_label ids of each label, whatever the table's size, so they may be broadcast
    picked = F.broadcast(marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, _, n_lines = line_features(batch.column(1).cast(pa.binary()).to_pylist())
                rows = [x[e - n : e].tobytes() for e, n in zip(np.cumsum(n_lines), n_lines)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(picked, "doc_id").select("doc_id", "text", "quality")
    found = sample.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, x binary").toArrow()
    # in one order whatever the partitions, so that equal tables give equal weights
    found = sorted(zip(*(c.to_pylist() for c in found.columns)), key=lambda r: (r[0], r[1], r[2]))
    xs = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in found]
    label = np.array([r[1] for r in found], np.int64)
    weight = np.concatenate(xs) if xs else np.zeros((0, N_FEATURES), np.float32)
    return fit(weight, np.array([len(x) for x in xs], np.int64), label)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).cast(pa.binary()).to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
