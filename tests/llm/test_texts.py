import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import mixing, preferences, rules, winnowing
from folioloom.llm.pieces import SPACE, Pieces, encoded, loaded
from folioloom.llm.queries import tokenizer
from folioloom.llm.quality_crf import marginals, quality
from folioloom.llm.sstable import Reader, encoder, read_shards, write_shards
from folioloom.llm.toxicity import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "é", "a b c", "The the THE", "x" * 3000, "Σς İ <|endoftext|> don't it's ½²", "漢字 🙂 a\x1cb", "﻿bom  two  spaces\n\nline"]


def labelled(spark, bad, good, seed=3):
    """Documents of plain words, of which every third has ``bad(rng)`` among them."""
    rng, rows = random.Random(seed), []
    plain = ["".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    for k in range(240):
        words = [rng.choice(plain) for _ in range(60)]
        rows.append((k, bad(rng, words) if k % 3 == 0 else good(words), int(k % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    return docs, rows


def insulted(rng, words):
    for _ in range(8):
        words[rng.randrange(60)] = rng.choice(["grumblewort", "snivelgit", "blatherskite"])
    return " ".join(words)


def test_toxicity_on_held_out_documents(spark):
    docs, rows = labelled(spark, insulted, " ".join)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and len(got) == len(rows) + len(ODD)
    assert np.mean([(got[r[0]].score > 0.5) == bool(r[2]) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity(docs, flipped).collect()} == {k: r.score for k, r in got.items()}
    assert toxicity(docs.where("false"), labels).count() == 0


def test_quality_on_held_out_documents(spark):
    docs, rows = labelled(spark, lambda rng, w: "\n".join(" | ".join(f"{x}%%%" for x in w[k : k + 6]) for k in range(0, 60, 6)), lambda w: " ".join(w[:30]) + ".\n" + " ".join(w[30:]))
    labels = spark.createDataFrame([(r[0], 1 - r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out for r in held) and len(got) == len(rows) + len(ODD)
    assert np.mean([got[r[0]].predicted == 1 - r[2] for r in held]) > 0.9
    assert quality(docs.where("false"), labels).count() == 0


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    unary, bounds, chain = rng.normal(size=9), np.array([0, 4, 4, 5, 9]), rng.normal(size=(2, 2))
    bad, pairs = marginals(unary, bounds, chain)
    want, want_pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(bounds, bounds[1:]):
        n, total, own, own_pairs = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            p = math.exp(sum(u for u, v in zip(unary[a:b], y) if v) + sum(chain[i, j] for i, j in zip(y, y[1:])))
            total += p
            own += p * np.array(y, float)
            for i, j in zip(y, y[1:]):
                own_pairs[i, j] += p
        want[a:b] = own / total
        want_pairs += own_pairs / total
    assert np.allclose(bad, want) and np.allclose(pairs, want_pairs)


def test_base_counts(spark):
    texts = ODD + ["a b c d e a b c d e f", "x x x x x x x", "l1\nl1\n\n \nl2\nl1 ", "a#b*c $ <|>", " ".join(["p q r s t u"] * 3)]
    frame = spark.createDataFrame([(k, t, None, "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judged(frame).collect()}
    for k, t in enumerate(texts):
        words = WORD.findall(t or "")
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(twice))
        row = got[k]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (len(words) < 10 or 100 * len(twice) > 20 * len(words)) and not (row.base_failed and row.kept)
    assert rules.judged(frame.where("false")).count() == 0


def test_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), encoder(path)
    rng = random.Random(2)
    signs = "abcDEFéÉñßΣς'’.,!?-_*&|<>#0123²½ \t\n 　́̈İıﬁǅʰあ漢🙂\x1c\x85the "
    texts = [t or "" for t in ODD] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert [np.frombuffer(own(t), "<u4").tolist() for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards_hold_all_documents_and_find_each(spark, tmp_path):
    import pyarrow.fs as pafs

    rows = [(k * 7 - 50, t) for k, t in enumerate(ODD * 3)] + [(None, "null id"), (6, "twice"), (6, "twice")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    path = tokenizer("word_bpe_49k.json")
    files = write_shards(frame, path, 1)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in read_shards(files).collect()))
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(np.frombuffer(encoder(path)(text or ""), "<u4"), np.uint32(1)).astype("<u4")
        want.append((doc_id is not None, doc_id or 0, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(x[1:2] + x[3:] for x in got) == sorted(x[1:2] + x[3:] for x in want) and [x[2] for x in sorted(got, key=lambda x: x[2])] == [x[2] for x in want]
    found = 0
    for row in files.collect():
        system, place = pafs.FileSystem.from_uri(row.path)
        reader = Reader(system.open_input_file(place), row.n_bytes)
        found += len(reader.get(6)) + len(reader.get(None))
        assert reader.get(10**12) == []
    assert found >= 3
    assert read_shards(write_shards(frame.where("false"), path, 1)).count() == 0


def test_fingerprints_by_hand(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (2, 9, 30, 200)] + ["one"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "last")], "doc_id long, text string").withColumn("n_chars", F.lit("clash"))
    got = {r.doc_id: r for r in winnowing.fingerprints(frame).collect()}
    numbers = {r.doc_id: r for r in winnowing.fingerprints(frame).withColumn("u", winnowing.units(F.coalesce("text", F.lit("")))).withColumn("g", winnowing.grams(F.col("u"))).collect()}
    for k, r in numbers.items():
        g, size = [x >> 24 for x in r.g], winnowing.WINDOW
        picked = set()
        for i in range(max(1, len(g) - size + 1) if g else 0):
            window = g[i : i + size]
            picked.add(i + max(j for j, x in enumerate(window) if x == min(window)))
        assert [(x >> 24, 2**24 - 1 - (x & (2**24 - 1))) for x in got[k].fingerprint] == [(g[p], p) for p in sorted(picked)]
    assert got[3].fingerprint == got[len(texts) - 1].fingerprint
    edited = {r.doc_id: r for r in winnowing.edited_likeness(frame).collect()}
    order = [*sorted(range(len(texts)), reverse=True), None]
    full = dict(enumerate(texts)) | {None: "last"}
    for a, b in zip(order, order[1:] + order[:1]):
        t, other = full[a] or "", full[b] or ""
        third = len(t) // 3
        assert edited[a].edited_sha256 == hashlib.sha256((t[: len(t) - third] + other[:third]).encode()).hexdigest()
    assert winnowing.edited_likeness(frame.where("false")).count() == 0


def test_fingerprints_hold_at_every_length_and_writing(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = [" ".join(word() for _ in range(n)) for n in (13, 20, 27, 200)] + ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300))]
    rows = [x for k, t in enumerate(long) for x in ((2 * k + 1, t), (2 * k, ""))]
    got = {r.doc_id: r for r in winnowing.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1].near_edited > 0.3 and got[2 * k + 1].near_next == 0 for k in range(len(long)))
    bounds = list(range(0, 2000, 3))
    ids = spark.range(-5, 2010, 7).select(F.col("id").alias("x")).select("x", winnowing.below(bounds, F.col("x")).alias("n")).collect()
    assert all(r.n == sum(b < r.x for b in bounds) for r in ids)


def test_ranges_of_ids_hand_on_their_first_row(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 3)
    ids = [5, 1, 9, 9, 30, 31, 32, 100, -4, 77, 78, None]
    frame = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = [r.text for r in sorted(frame.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text))]
    assert {(r.text, r.next_text) for r in winnowing.with_next(frame, ["text"]).collect()} == set(zip(rows, rows[1:] + rows[:1]))


def test_pieces_as_the_library_has_them(spark):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer("piece_bpe_32k.model")
    library, own = SentencePieceProcessor(model_file=path), loaded(path)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abc theé▁ \n\t<0x>s漢🙂̈'.,01") for _ in range(rng.choice([3, 10, 40, 300]))) for _ in range(800)] + ["theand" * 300]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode(t) for t in texts]
    assert [own.decode(x) for x in own.encode(texts)] == [t.replace(SPACE, " ") for t in texts]
    frame = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = encoded(frame, path).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows) and len(rows) == len(ODD)
    assert encoded(frame.where("false"), path).count() == 0


def test_viterbi_is_the_best_of_all_segmentations():
    rng = random.Random(6)
    names = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"a", "b"})
    table = Pieces(names, [-rng.random() * 5 - len(n) for n in names], list(range(len(names))), [], 99, True)
    score = {p: s for p, s in zip(names, [table.rank[n][0] for n in names])}
    least = min(score.values()) - 10

    def value(cuts, w):
        total = 0.0
        for a, b in zip(cuts, cuts[1:]):
            piece = w[a:b]
            total += score.get(piece, least if b - a == 1 else -math.inf)
        return total

    words = ["".join(rng.choice("abc") for _ in range(7)) for _ in range(30)]
    from folioloom.llm.pieces import code_points

    cut, count = table.viterbi(code_points(words))
    for i, w in enumerate(words):
        every = [[0, *[k + 1 for k in range(6) if code >> k & 1], 7] for code in range(64)]
        assert math.isclose(value(cut[i, : count[i] + 1].tolist(), w), max(value(c, w) for c in every))


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 1, "assistant", "bad"), (1, 0, "user", "q"), (4, 0, "user", None), (5, 0, "user", None), (7, 0, None, "alone"), (None, 0, "user", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.preferences(preferences.paired(frame)).collect()}
    assert got[0].prompt == "<|user|>\nq<|end|>\n" and got[0].chosen == "<|assistant|>\ngood<|end|>\n"
    start, end = map(int, got[0].rejected_mask.split(":"))
    assert got[0].rejected[start:end] == "bad<|end|>"
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].chosen is None and got[3].rejected == "<||>\nalone<|end|>\n" and set(got) == {0, 2, 3}
    assert preferences.preferences(preferences.paired(frame.where("false"))).count() == 0


def test_other_answers_to_the_same_prompt(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a1"), (0, 2, "user", "q2"), (0, 3, "assistant", "a2"), (0, 4, "user", "thanks"), (1, 0, "user", "z"), (1, 1, "assistant", "other")]
    turns += [(2, 0, "user", "no answer"), (3, 0, "assistant", "late"), (4, 0, "user", "x"), (5, 0, "user", "y"), (7, 0, "assistant", "alone")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.preferences(preferences.answered_otherwise(frame)).collect()}
    assert got[0].n_prompt_turns == 3 and got[0].rejected == "<|assistant|>\nother<|end|>\n" and got[0].chosen.startswith("<|assistant|>\na2")
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].rejected) == (1, "", "<|assistant|>\nlate<|end|>\n")
    assert got[2].rejected is None and got[3].chosen is None and got[3].rejected.endswith("alone<|end|>\n")


def test_op6_is_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    mine = preferences.preferences(preferences.answered_otherwise(spark.read.parquet(f"{folder}/conversations.parquet"))).orderBy("pair_id").collect()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    theirs = duck.sql(f"SELECT {', '.join(mine[0].__fields__)} FROM ({preferences.SQL}) ORDER BY pair_id").fetchall()
    assert [tuple(r) for r in mine] == theirs and max(r.n_prompt_turns for r in mine) > 2


def exact(n, k, d):
    return [math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) for x in range(min(k, d) + 1)]


@pytest.mark.parametrize("n, k, d", [(10, 4, 5), (30, 29, 7), (5, 5, 2), (7, 0, 3), (200, 60, 100), (9, 3, 0)])
def test_draws_follow_the_hypergeometric_distribution(spark, n, k, d):
    rows = spark.range(401).select(((F.col("id") + 0.5) / 401).alias("u"))
    got = [r[0] for r in rows.select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(d), F.col("u")).alias("x"), "u").orderBy("u").collect()]
    cumulated, want = np.cumsum(exact(n, k, d)), []
    for i in range(401):
        want.append(int(np.searchsorted(cumulated, (i + 0.5) / 401 - 1e-12)))
    assert sum(a != b for a, b in zip(got, want)) <= 1


def test_shards_add_up_to_the_quotas(spark):
    quotas = spark.createDataFrame([("a", 1001), (None, 10), ("b", 0), ("", 77)], "source string, quota long")
    rows = mixing.shard_quotas(quotas, 8).collect()
    per = {}
    for r in sorted(rows, key=lambda r: r.shard):
        assert r.first == per.get(r.source, 0)
        per[r.source] = per.get(r.source, 0) + r.quota
    assert per == {"a": 1001, None: 10, "b": 0, "": 77}
    assert {sum(r.quota for r in rows if r.shard == s) for s in range(8)} <= {136, 137}


def test_words_go_to_the_shards_that_the_tree_gives_them(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * (k % 13)), ("b", "a", "b", None)[k % 4] if k % 9 else "c") for k in range(300)], "doc_id long, text string, source string")
    rows = mixing.taken_words(docs, block=1, shards=8).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = mixing.slim(docs)
    goals = mixing.goals(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST, 1)
    full = {r.source: r.full for r in goals.collect()}
    want = {(r.source, r.shard): r.quota for r in mixing.shard_quotas(goals.select("source", "quota"), 8).collect()}
    got = dict.fromkeys(want, 0)
    for r in rows:
        parts = [tuple(map(int, p.split(":"))) for p in r.by_shard.split(",") if p]
        assert sum(n for _, n in parts) == r.taken and [s for s, _ in parts] == sorted({s for s, _ in parts})
        for shard, n in parts:
            got[source[r.doc_id], shard] += n
    once = [k for k in want if not full[k[0]]]
    assert once and any(full.values()) and all(got[k] == want[k] for k in once)
    # a source that goes in whole has its drawn blocks beside its whole passes
    for s in (s for s in full if full[s]):
        assert sum(got[s, k] - want[s, k] for k in range(8)) == full[s] * sum(r.size for r in rows if source[r.doc_id] == s)


def test_blocks_are_permuted(spark):
    counts = spark.createDataFrame([(b, s) for b in (1, 2, 3, 7, 10, 50, 331) for s in ("a", None)], "blocks long, source string")
    rows = counts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("place", mixing.drawn(F.col("block"))).collect()
    for blocks, source in {(r.blocks, r.source) for r in rows}:
        places = [r.place for r in sorted(rows, key=lambda r: r.block) if (r.blocks, r.source) == (blocks, source)]
        assert sorted(places) == list(range(blocks))
        if blocks > 40:
            steps = [(b - a) % blocks for a, b in zip(places, places[1:])]
            assert max(map(steps.count, steps)) < blocks / 3


def test_mix_of_long_texts_and_clashing_columns(spark):
    rows = [(k, f"t{k} " * (40_000 if k == 3 else 90), "s0" if k % 2 else "s1") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["size", "start", "place", "shard", "target", "full", "quota", "blocks", "source_size", "ends", "taken", "_mark", "_row", "_p", "_text"]
    clash = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    out = mixing.mixed(clash)
    assert out.columns == [c for c in clash.columns if c not in ("shard", "place")] + ["shard", "place"]
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    per = {}
    for r in out.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names if n not in ("shard", "place"))
        assert set(r.text.split()) == {f"t{r.doc_id}"}
        per[r.doc_id] = per.get(r.doc_id, 0) + len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == per


def test_mix_reaches_its_targets(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        n = rng.randint(0, 300)
        rows.append((k, " ".join(rng.choice("abcdef") for _ in range(n)), rng.choice(["s0", "s0", "s1", "s2", None]), 5))
    rows += [(1000, None, "s9", 1), (1001, "", None, 1), (None, "x y", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place long")
    taken = mixing.taken_words(docs, block=16).collect()
    again = {r.doc_id: r.taken for r in mixing.taken_words(docs.repartition(3), block=16).collect()}
    by = {d: s for d, _, s, _ in rows}
    sizes = {}
    for r in taken:
        assert r.size == len(WORD.findall(dict((x[0], x[1]) for x in rows)[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size and again[r.doc_id] == r.taken
        own = sizes.setdefault(by[r.doc_id], [0, r.target, 0, r.source_size])
        own[0] += r.taken
        own[2] += r.size
    total, order = sum(x[2] for x in sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}, list(order)
    left = 1.5 * total
    while True:  # by hand: those over their stop stop, the others share what is left
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s][2]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s][2]
            left -= target[s]
            open_.remove(s)
    for s, (got, want, size, own) in sizes.items():
        assert own == size and math.isclose(want, target[s], abs_tol=1e-6) and abs(got - want) <= 16
    words = {}
    for r in mixing.mixed(docs, block=16).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text or ""))
    assert {d: words.get(d, 0) for d in again} == again
    assert mixing.taken_words(docs.where("false")).count() == 0
