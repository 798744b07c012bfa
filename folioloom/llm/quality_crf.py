"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are shares of its bytes and words and those of the lines before and after; the
chain has a weight for each pair of labels that follow each other. Labels are of documents, so training first takes every
line's label from its document, then lets the field itself clear lines of bad documents that it finds good, and fits again.
A document's badness is the mean of its lines' marginals by forward-backward, weighted by their lengths; logistic
regression makes that a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .learn import fit_logistic, held_out, logistic, sample
from .wordhash import SPACE, Words, chunks, mix

#: Bounds of what is learned from: texts of either label and their characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 10_000
#: The least score that predicts 1.
THRESHOLD = 0.3
STEPS, CLEAR_ROUNDS = 80, 1
_CLASS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": np.isin(np.arange(256), list(b"#*$%&<>@^~=_+\\{}[]")),
    "bar": np.arange(256) == ord("|"),
    "shout": np.isin(np.arange(256), list(b"!?")),
    "stop": np.isin(np.arange(256), list(b".,;:")),
    "wide": np.arange(256) >= 128,
}
N_OWN = len(_CLASS) + 8


class Lines:
    """Features, lengths and bounds by document of all lines with a word of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        self.n_words = np.diff(words.first)
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        line = np.searchsorted(starts, words.starts, "right") - 1
        kept = np.unique(line)
        line = np.searchsorted(kept, line)
        begin = starts[kept] if len(kept) else np.zeros(0, np.int64)
        n = len(begin)
        self.bounds = np.searchsorted(begin, offsets)
        if not n:
            self.x, self.length = np.zeros((0, 3 * N_OWN + 1)), np.zeros(0)
            return
        doc = np.searchsorted(self.bounds, np.arange(n), "right") - 1
        stop = np.minimum(np.r_[starts[1:], len(data)][kept], offsets[doc + 1])
        sums = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][np.stack([begin, stop])], axis=0)[0]
        self.length = np.maximum(sums(~SPACE[data]), 1).astype(float)
        hashes = words.hashes()
        count = np.bincount(line, minlength=n).astype(float)
        own = [sums(flags[data]) / self.length for flags in _CLASS.values()]
        again = np.zeros(len(line), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((hashes, line))
        distinct = np.ones(len(line), bool)
        distinct[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
        own += [np.bincount(line, again, n) / count, 1 - np.bincount(line[order], distinct, n) / count]
        # a line's words in their order as one number; a line equal to an earlier or later one of its document
        place = np.arange(len(line)) - np.r_[0, np.cumsum(count)[:-1]].astype(np.int64)[line]
        whole = np.zeros(n, np.uint64)
        np.add.at(whole, line, mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.lexsort((whole, doc))
        same = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twin = np.zeros(n, bool)
        twin[order[1:][same]] = twin[order[:-1][same]] = True
        mean = self.length / count
        first = data[words.starts]
        own += [twin.astype(float), np.log1p(count) / 5, np.minimum(mean, 20) / 10, (mean < 3).astype(float), np.bincount(line, _CLASS["upper"][first], n) / count, (count <= 2).astype(float)]
        own = np.column_stack([np.asarray(f, float) for f in own])
        # shares near 0 and near 1 differ in kind: their roots, so that a few per cent count
        own[:, : len(_CLASS) + 2] = np.sqrt(np.clip(own[:, : len(_CLASS) + 2], 0, 1))
        before, after = np.zeros_like(own), np.zeros_like(own)
        inner = doc[1:] == doc[:-1]
        before[1:][inner], after[:-1][inner] = own[:-1][inner], own[1:][inner]
        self.x = np.column_stack([own, before, after, np.ones(n)])


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, bounds: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is bad and, by document pair counts, the expected label pairs; documents advance line by line together."""
    n = len(unary)
    u = np.column_stack([np.zeros(n), unary])
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # documents with more than k lines
    if longest:
        forward[start[: alive[0]]] = u[start[: alive[0]]]
    for k in range(1, longest):
        at = start[: alive[k]] + k
        f = forward[at - 1]
        forward[at] = u[at] + np.column_stack([_log_add(f[:, 0] + chain[0, j], f[:, 1] + chain[1, j]) for j in (0, 1)])
    for k in range(longest - 2, -1, -1):
        at = start[: alive[k + 1]] + k
        b = backward[at + 1] + u[at + 1]
        backward[at] = np.column_stack([_log_add(b[:, 0] + chain[i, 0], b[:, 1] + chain[i, 1]) for i in (0, 1)])
    both = forward + backward
    bad = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = np.zeros((2, 2))
    if len(left):
        total = _log_add(both[left, 0], both[left, 1])
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = np.exp(forward[left, i] + chain[i, j] + u[left + 1, j] + backward[left + 1, j] - total).sum()
    return bad, pairs


@dataclass
class Model:
    scale: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    calibration: np.ndarray

    def scores(self, lines: Lines) -> np.ndarray:
        bad, _ = marginals(lines.x / self.scale @ self.weights, lines.bounds, self.chain)
        return logistic(document_features(bad, lines), self.calibration)


def document_features(bad: np.ndarray, lines: Lines) -> np.ndarray:
    """Length-weighted badness of each document (a half without lines) and its log-odds."""
    doc = np.repeat(np.arange(len(lines.bounds) - 1), np.diff(lines.bounds))
    n = len(lines.bounds) - 1
    weight, part = np.bincount(doc, lines.length, n), np.bincount(doc, lines.length * bad, n)
    mean = np.where(weight > 0, part / np.maximum(weight, 1), 0.5)
    odds = np.log((mean + 0.01) / (1.01 - mean))
    return np.column_stack([mean, odds, np.minimum(np.log1p(lines.n_words), 3)])


def fit(texts: list[tuple[str, int]]) -> Model:
    """The field and its calibration, from texts and labels (1: good) on the driver."""
    texts = texts or [("", 1)]
    data = np.frombuffer("".join(t for t, _ in texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t, _ in texts])]
    lines = Lines(data, offsets)
    y_doc = np.array([1 - y for _, y in texts], float)
    doc = np.repeat(np.arange(len(texts)), np.diff(lines.bounds))
    y, x = y_doc[doc], lines.x
    scale = np.maximum(x.std(axis=0), 0.05) if len(x) else np.ones(x.shape[1])
    scale[-1] = 1
    x = x / scale
    w, chain = np.zeros(x.shape[1]), np.zeros((2, 2))
    left = np.flatnonzero(doc[1:] == doc[:-1])
    for turn in range(CLEAR_ROUNDS + 1):
        seen = np.array([[((y[left] == i) & (y[left + 1] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
        m = v = np.zeros(x.shape[1] + 4)
        for step in range(1, STEPS + 1):
            bad, pairs = marginals(x @ w, lines.bounds, chain)
            slope = np.r_[x.T @ (y - bad), (seen - pairs).ravel()] / max(len(y), 1) - 1e-4 * np.r_[w, chain.ravel()]
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, chain = w + move[:-4], chain + move[-4:].reshape(2, 2)
        bad, _ = marginals(x @ w, lines.bounds, chain)
        if turn < CLEAR_ROUNDS and len(y):
            worst = np.full(len(texts), -1.0)
            np.maximum.at(worst, doc, bad)
            y = ((y_doc[doc] == 1) & ((bad > 0.2) | (bad == worst[doc]))).astype(float)
    bad, _ = marginals(x @ w, lines.bounds, chain)
    return Model(scale, w, chain, fit_logistic(document_features(bad, lines), 1 - y_doc))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """``docs`` with held_out, score (0 to 1, higher: good likelier) and predicted, over whole texts.

    Labels of held-out rows are never read. A null or empty text has no lines and scores by its lack of words; repeated rows
    score alike; an empty table gives an empty result. Columns of these names in ``docs`` are replaced.
    """
    model = fit(sample(docs, labels.where(~held_out(folds, fold)), "quality", SAMPLE_ROWS, SAMPLE_CHARS))
    rest = docs.drop("held_out", "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                scores = model.scores(Lines(data, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, "score"])

    scored = rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("held_out", held_out(folds, fold)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
