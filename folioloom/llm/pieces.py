"""SentencePiece encoding and decoding of whole texts, many words at once with numpy.

Words of equal length advance together as one matrix of code points. Substrings are known by the difference of prefix hashes
and looked up in the sorted keys of the pieces. For a unigram file, ``viterbi`` goes from one end to the next: vectorised
maxima over all pieces that end there give each word's best score, and their places are stored as backpointers. A BPE file
fixes the order of merges instead, and the best sum of its scores is another segmentation (README has the share), so
``merges`` takes for all words at once the highest-scored pair, the leftmost of equals, until none is a piece.
Characters that no piece has become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .wordhash import CHUNK_BYTES, mix

SPACE = "▁"
#: Words whose ids a worker remembers; then it forgets them all. Longer words are merged one by one.
CACHE_WORDS, LONG = 300_000, 96
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)
_NONE = -np.inf


def prefixes(codes: np.ndarray) -> np.ndarray:
    """Two prefix hashes of each row of code points: shape (2, rows, length + 1)."""
    out = np.zeros((2, codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(2):
        for j in range(codes.shape[1]):
            out[k, :, j + 1] = out[k, :, j] * _BASE[k] + codes[:, j] + np.uint64(1)
    return out


def code_points(words: list[str]) -> np.ndarray:
    """A row for each word; all have one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


class Pieces:
    """The pieces of a SentencePiece file, sorted by the hash of their characters."""

    def __init__(self, pieces: list[str], scores: list[float], ids: list[int], byte_ids: list[int], unknown: int, unigram: bool):
        self.longest = max(map(len, pieces), default=1)
        self.power = np.array([[pow(int(b), k, 2**64) for k in range(max(self.longest, LONG) + 2)] for b in _BASE], np.uint64)
        key = np.zeros(len(pieces), np.uint64)
        length = np.array([len(p) for p in pieces])
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            codes = code_points([pieces[i] for i in own])
            key[own] = self.key(prefixes(codes), np.arange(len(own)), np.zeros(len(own), np.int64), np.full(len(own), n))
        order = np.argsort(key, kind="stable")
        self.keys, self.ids = key[order], np.array(ids, np.int64)[order]
        self.scores = np.array(scores, float)[order]
        self.rank = {p: (s, i) for p, s, i in zip(pieces, scores, ids)}
        self.bytes, self.unknown, self.unigram = byte_ids, unknown, unigram
        joined = {c for p in pieces if len(p) > 1 for c in p}
        #: ASCII characters that stand in no longer piece are words by themselves
        self.alone = "".join(chr(c) for c in range(128) if chr(c) not in joined and chr(c) != " ")
        one = re.escape(self.alone)
        self.units = re.compile(f"[{one}]|{SPACE}*[^{SPACE}{one}]+|{SPACE}+" if one else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(n)) else []
        # BPE files number their merges: whole, falling scores
        unigram = any(sp.get_score(i) % 1 for i in plain)
        out = cls([sp.id_to_piece(i) for i in plain], [sp.get_score(i) for i in plain], plain, byte_ids, sp.unk_id(), unigram)
        out.texts = [b"" if sp.is_control(i) else bytes((byte_ids.index(i),)) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        return out

    def key(self, prefix: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        one, two = (prefix[k, row, end] - prefix[k, row, start] * self.power[k, n] for k in range(2))
        return mix(mix(one) + two)

    def probe(self, prefix: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of substrings among the sorted pieces, -1 for those that are none."""
        fine = end - start <= self.longest
        key = self.key(prefix, row, start, np.where(fine, end, start + 1))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(fine & (self.keys[at] == key), at, -1)

    def score(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.scores[np.maximum(at, 0)], _NONE)

    def merges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the pieces of words of one length and how many there are, by merging the best pair of each word at a time."""
        n, length = codes.shape
        prefix = prefixes(codes)
        cut = np.tile(np.arange(length + 1), (n, 1))
        count = np.full(n, length)
        pair = np.full((n, length), _NONE)
        for k in range(length - 1):
            every = np.arange(n)
            pair[:, k] = self.score(self.probe(prefix, every, np.full(n, k), np.full(n, k + 2)))
        todo = np.arange(n)
        while len(todo):
            best = pair[todo].argmax(axis=1)
            fine = pair[todo, best] > _NONE
            todo, best = todo[fine], best[fine]
            if not len(todo):
                break
            # the cut between the two goes; what is behind moves up
            column = np.arange(length)
            moved = np.minimum(column + (column > best[:, None]), length)
            cut[todo, :length] = cut[todo[:, None], moved]
            pair[todo, : length - 1] = pair[todo[:, None], np.minimum(moved, length - 1)[:, : length - 1]]
            pair[todo, length - 1] = _NONE
            count[todo] -= 1
            for k in (best - 1, best):
                fits = (k >= 0) & (k + 1 < count[todo])
                row, at = todo[fits], k[fits]
                pair[row, at] = self.score(self.probe(prefix, row, cut[row, at], cut[row, at + 2]))
                pair[todo[~fits & (k >= 0)], k[~fits & (k >= 0)]] = _NONE
        return cut, count

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, and number, of the pieces with the best sum of scores, the longest last piece of equals; an unknown character scores ten under the least piece."""
        n, length = codes.shape
        prefix, every = prefixes(codes), np.arange(n)
        best, back = np.full((n, length + 1), _NONE), np.zeros((n, length + 1), np.int64)
        best[:, 0] = 0
        unknown = self.scores.min() - 10
        for end in range(1, length + 1):
            first = max(0, end - self.longest)
            score = np.full((n, end - first), _NONE)
            for start in range(first, end):
                own = self.score(self.probe(prefix, every, np.full(n, start), np.full(n, end)))
                score[:, start - first] = best[:, start] + (np.maximum(own, unknown) if end - start == 1 else own)
            pick = score.argmax(axis=1)
            best[:, end], back[:, end] = score[every, pick], first + pick
        # all words follow their backpointers together, from the end; then each row is turned round
        cut, count, at = np.full((n, length + 1), length), np.zeros(n, np.int64), np.full(n, length)
        while (todo := np.flatnonzero(at > 0)).size:
            at[todo] = back[todo, at[todo]]
            count[todo] += 1
            cut[todo, count[todo]] = at[todo]
        column = np.arange(length + 1)
        return cut[every[:, None], np.maximum(count[:, None] - column, 0)], count

    def merged_long(self, word: str) -> list[int]:
        """``merges`` for one long word, by a heap of pairs."""
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and end[b] - a <= self.longest and (found := self.rank.get(word[a : end[b]])):
                heapq.heappush(heap, (-found[0], a, end[a], end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, middle, stop = heapq.heappop(heap)
            if end[a] != middle or middle >= n or end[middle] != stop:
                continue
            b = middle
            end[a], after[a] = stop, after[b]
            end[b] = -1
            if after[b] < n:
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        cuts, a = [0], 0
        while a < n:
            a = end[a]
            cuts.append(a)
        return cuts

    def ids_of(self, word: str, cuts: list[int]) -> bytes:
        out = []
        for a, b in zip(cuts, cuts[1:]):
            found = self.rank.get(word[a:b])
            out += [found[1]] if found else [self.bytes[x] for x in word[a:b].encode()] if self.bytes else [self.unknown]
        return np.array(out, "<i4").tobytes()

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, own in by_length.items():
            if length > LONG and not self.unigram:
                self.known.update((w, self.ids_of(w, self.merged_long(w))) for w in own)
                continue
            codes = code_points(own)
            cut, count = (self.viterbi if self.unigram else self.merges)(codes)
            row = np.repeat(np.arange(len(own)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = self.probe(prefixes(codes), row, cut[row, k], cut[row, k + 1])
            ids = self.ids[np.maximum(place, 0)].astype("<i4").tobytes()
            ends = np.concatenate([[0], 4 * np.cumsum(count)]).tolist()
            self.known.update(zip(own, (ids[a:b] for a, b in zip(ends, ends[1:]))))
            for i in np.unique(row[place < 0]):  # holds characters that no piece has
                self.known[own[i]] = self.ids_of(own[i], cut[i, : count[i] + 1].tolist())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; a null or empty text has none."""
        parts = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = {w for own in parts for w in own if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = {w for own in parts for w in own}
        self.learn(list(new))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, own)), "<i4") for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, the mark for a space as a space, without the one put before the text."""
        text = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def loaded(model_file: str) -> Pieces:
    """A worker's pieces, kept from task to task."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces.load(model_file)
    return _LOADED[model_file]


def sized_slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHUNK_BYTES characters with the row of the first; a longer text is alone."""
    row, own, size = 0, [], 0
    for k, value in enumerate(texts):
        text = value.as_py()
        if own and size + len(text or "") > CHUNK_BYTES // 2:
            yield row, own
            row, own, size = k, [], 0
        own.append(text)
        size += len(text or "")
    if own:
        yield row, own


def encoded(docs: DataFrame, model_file: str, keep_text: bool = False) -> DataFrame:
    """``docs`` with ids (array<int>), n_tokens, ids_crc32 (of little-endian 32-bit ids) and round_trip, without text unless ``keep_text``.

    round_trip: the ids decode to the text, its marks for a space (U+2581) as spaces. A null text has no ids and is true;
    repeated rows have equal ids; an empty table gives an empty result. Columns of these names in ``docs`` are replaced.
    """
    rest = docs.drop("ids", "n_tokens", "ids_crc32", "round_trip")
    kept = [c for c in rest.columns if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            columns = [batch.schema.get_field_index(c) for c in kept]
            for row, texts in sized_slices(batch.column(at)):
                ids = pieces.encode(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                same = [pieces.decode(x) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts)]
                own = [batch.column(k).slice(row, len(texts)) for k in columns]
                new = [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*own, *new], names=[*kept, "ids", "n_tokens", "ids_crc32", "round_trip"])

    new = StructType.fromDDL("ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")
    return rest.mapInArrow(run, StructType([*rest.select(*kept).schema.fields, *new.fields]))


def decoded(encodings: DataFrame, model_file: str) -> DataFrame:
    """``encodings`` with the text that their ids decode to; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = pa.array([pieces.decode(np.array(x.as_py() or [], np.int64)) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    rest = encodings.drop("text")
    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("text", StringType())]))
