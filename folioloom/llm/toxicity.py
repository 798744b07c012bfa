"""Toxicity by compression distance: windows of words against two zstandard dictionaries.

The ordinary dictionary is trained on windows of ordinary texts. The toxic one holds the same bytes at the same distance
and, before them, toxic text, which is chosen here and not by the library's trainer (that one finds far fewer toxic texts): the words or beginnings of words of toxic texts that ordinary texts hold far less often. So
an ordinary window compresses to much the same length with either, and a window that the toxic one shortens holds something
of what it alone has. Every window is compressed with both. Windows are single words (after a passage that both know) and runs of six; a document's counts of
windows by bytes saved give its score through thresholds calibrated by logistic regression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .learn import fit_logistic, held_out, logistic, sample

#: Bounds of what is learned from: texts of either label and their characters.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
#: The least probability that predicts 1.
THRESHOLD = 0.7
RUN, LEVEL, CORE_BYTES, TOXIC_BYTES, MOST_SAVED = 6, 6, 8000, 2000, 8
#: Single words whose saving a task remembers; then it forgets them all.
CACHE_WORDS = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def stems(word: bytes) -> list[bytes]:
    """The word with spaces around, and its beginnings of four to ten bytes."""
    begun = b" " + word
    return [begun + b" ", *(begun[:k] for k in range(5, min(len(begun), 11) + 1))]


def toxic_text(texts: list[tuple[str, int]]) -> bytes:
    """What stands in toxic texts far more often than in ordinary ones, the most frequent last."""
    seen, n = (Counter(), Counter()), [0, 0]
    for text, y in texts:
        n[y] += 1
        seen[y].update({s for w in set(words_of(text)) for s in stems(w)})
    odds = {s: math.log((c + 0.5) / (n[1] + 1)) - math.log((seen[0][s] + 0.5) / (n[0] + 1)) for s, c in seen[1].items() if c >= max(3, 0.02 * n[1])}
    mark = {s: x for s, x in odds.items() if x > 2.5}
    found: Counter = Counter()
    for text, y in texts:
        if y:
            for w in words_of(text):
                if own := [s for s in stems(w) if s in mark]:
                    found[max(own, key=lambda s: (mark[s], len(s)))] += 1
    chosen = sorted(found, key=lambda s: (-found[s], s))
    return b"".join(reversed(chosen))[-TOXIC_BYTES:]


class Windows:
    """Bytes that the toxic dictionary saves on the windows of a text."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        how = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(ordinary, dict_type=raw), **how)
        self.two = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(toxic + ordinary, dict_type=raw), **how)
        self.lead, self.known = ordinary[-120:-80], {}
    def saved(self, windows: list[bytes]) -> list[int]:
        if not windows:
            return []
        a, b = self.one.multi_compress_to_buffer(windows), self.two.multi_compress_to_buffer(windows)
        return [len(a[i]) - len(b[i]) for i in range(len(windows))]

    def features(self, text: str | None) -> np.ndarray:
        """Of both kinds of windows, how many save 1, 2, ... bytes, by the root of their number and at all, and the most saved."""
        words, out = words_of(text), []
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(set(words))
        self.known.update(zip(new, self.saved([self.lead + b" " + w + b" " for w in new])))
        singles = list(map(self.known.__getitem__, words))
        runs = self.saved([b" " + b" ".join(words[k : k + RUN]) + b" " for k in range(0, len(words), RUN)])
        for saved, n in ((singles, len(words)), (runs, len(words) / RUN)):
            d = np.clip(np.array(saved or [0]), 0, MOST_SAVED)
            counts = np.bincount(d, minlength=MOST_SAVED + 1)[1:]
            out += [np.log1p(counts), counts / math.sqrt(max(n, 1)), [d.max(), np.sort(d)[-3:].sum()]]
        return np.concatenate([*out, [math.log1p(len(words))]])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    scale: np.ndarray

    def scores(self, texts: list[str | None], windows: Windows) -> np.ndarray:
        return logistic(np.array([windows.features(t) for t in texts]) / self.scale, self.weights)


def fit(texts: list[tuple[str, int]]) -> Model:
    """From texts and labels on the driver: the dictionaries on one half, the thresholds on the other, so that these see unread texts."""
    order = sorted(range(len(texts)), key=lambda i: (i * 2654435761) % 2**32)
    for_words, for_weights = [texts[i] for i in order[::2]], [texts[i] for i in order[1::2]]
    plain = [w for t, y in for_words if not y for w in [words_of(t)]]
    runs = [b" " + b" ".join(w[i : i + RUN]) + b" " for w in plain for i in range(0, len(w), RUN)]
    runs = [runs[i * len(runs) // 20_000] for i in range(20_000)] if len(runs) > 20_000 else runs
    try:
        ordinary = zstandard.train_dictionary(CORE_BYTES, runs).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on
        ordinary = b"".join(runs)[-CORE_BYTES:] or b" " * 200
    toxic = toxic_text(for_words)
    windows = Windows(ordinary, toxic)
    rows = for_weights if len({y for _, y in for_weights}) == 2 else texts
    x, y = np.array([windows.features(t) for t, _ in rows] or [windows.features("")]), np.array([y for _, y in rows] or [0])
    scale = np.maximum(x.std(axis=0), 1e-6)
    return Model(ordinary, toxic, fit_logistic(x / scale, y, ridge=3e-3), scale)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted, over whole texts.

    Labels of held-out rows are never read. A null or empty text scores what no words score; repeated rows score alike; an
    empty table gives an empty result. Columns of these names in ``docs`` are replaced.
    """
    model = fit(sample(docs, labels.where(~held_out(folds, fold)), "toxic", SAMPLE_ROWS, SAMPLE_CHARS))
    rest = docs.drop("held_out", "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(model.ordinary, model.toxic)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            scores = np.concatenate([model.scores([t.as_py()], windows) for t in texts]) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    scored = rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("held_out", held_out(folds, fold)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
