"""A bounded sample of labelled documents, and logistic regression on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int) -> F.Column:
    """crc32 of the doc_id's digits, modulo ``folds``, is ``fold``; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows_each: int, longest: int) -> list[tuple[str, int]]:
    """At most ``rows_each`` texts (of at most ``longest`` characters) of either label, the first by a hash of their doc_id.

    labels: those that may be learned from. Rows with a null label, doc_id or text are left out; the smallest of several labels holds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    mark = F.xxhash64("doc_id")
    # twice as many as needed, as some have no text of that length
    picked = [known.where(F.col("y") == y).orderBy(mark, "doc_id").limit(2 * rows_each) for y in (0, 1)]
    few = F.broadcast(picked[0].union(picked[1]))  # at most 4 * rows_each rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text").between(1, longest))
    rows = texts.join(few, "doc_id")
    out = []
    for y in (0, 1):
        out += [(r["text"], y) for r in rows.where(F.col("y") == y).orderBy(mark, "doc_id", "text").limit(rows_each).select("text").collect()]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the constant's) by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = ridge * len(x) * np.r_[np.ones(x.shape[1] - 1), 0] + 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step / max(1, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
