"""Mixing sources to target weights by a splitting tree, with DataFrame functions only.

A source's documents stand in an order given by a hash, and their words in that order are cut into blocks of ``BLOCK_WORDS``.
A target sets how many of a source's blocks the mix takes: the whole source as often as it goes into the target, and an
exact quota of its blocks once more. The quotas go down a binary tree over the output shards: each node hands half of its
blocks to its left child, and how many of each source those are is drawn from the multivariate hypergeometric distribution,
a source at a time. Each leaf then draws disjoint runs of its sources' permuted blocks and shuffles them by a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checked, written

#: Words a block, the fewest shards (a power of two), words a shard at about which there are twice as many, documents that a prefix sum takes together.
BLOCK_WORDS, SHARDS, SHARD_WORDS, BUCKET_DOCS = 256, 16, 4_000_000, 1024
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rounds of a block's permutation, and the most steps until a number lies among the blocks: each step misses with a chance of one in their root.
ROUNDS, STEPS = 2, 40
#: Standard deviations around the mean within which a draw is made: beyond, doubles hold no probability.
REACH = 12
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size: words of the whole text (long), 0 for a null one."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``, one for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a target stops at ``most``
    times its source's size, and the excess goes to the others by weight until none is above: every source gets the lesser of
    its stop and its weight times one level. With sources by stop / weight, the level is the first at which the next holds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # a row a source from here on
    ranked = per.withColumn("_k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("_k") - 1) % len(weights)).cast("int")).cast("double")
    ranked = ranked.withColumn("_w", weight).withColumn("_stop", most * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("_stop") / F.col("_w"), "_k")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_stop").over(before), F.lit(0.0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / rest)
    # the first source whose stop is above the level sets it; without one, all stop
    ranked = ranked.withColumn("_level", F.coalesce(F.min(F.when(F.col("_stop") >= F.col("_level") * F.col("_w"), F.struct(F.col("_stop") / F.col("_w"), "_k", "_level"))).over(everything)["_level"], F.lit(float("inf"))))
    return ranked.select("source", "source_size", F.least("_stop", F.col("_level") * F.col("_w")).alias("target"))


def hypergeometric(total: F.Column, marked: F.Column, drawn: F.Column, u: F.Column) -> F.Column:
    """How many of ``drawn`` from ``total``, of which ``marked`` are marked, are marked, at the probability ``u``.

    The probabilities of all counts within REACH deviations of the mean, from the mode outwards as ratios; the first count
    whose cumulated share reaches u.
    """
    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    low, high = F.greatest(F.lit(0.0), d - (n - k)), F.least(k, d)
    mode = F.least(F.greatest(F.floor((d + 1) * (k + 1) / (n + 2)).cast("double"), low), high)
    spread = REACH * F.sqrt(F.greatest(d * k * (n - k) * (n - d) / F.greatest(n * n * (n - 1), F.lit(1.0)), F.lit(1.0))) + 8
    first, last = F.greatest(low, F.ceil(mode - spread)), F.least(high, F.floor(mode + spread))
    state = lambda x, p, s: F.struct(x.cast("double").alias("x"), p.alias("p"), s.alias("s"))
    once = lambda value, then: F.get(F.transform(F.array(value), then), 0)  # a value that steps read is made once

    def count(c: F.Column) -> F.Column:
        # p(x + 1) / p(x)
        up = lambda x: (c["k"] - x) * (c["d"] - x) / ((x + 1) * (c["n"] - c["k"] - c["d"] + x + 1))
        start = state(c["mode"], F.lit(1.0), F.lit(0.0))
        below = F.aggregate(
            F.sequence(F.lit(1), F.greatest((c["mode"] - c["first"]).cast("int"), F.lit(1))),
            start,
            lambda a, i: F.when(a["x"] > c["first"], state(a["x"] - 1, a["p"] / up(a["x"] - 1), a["s"] + a["p"] / up(a["x"] - 1))).otherwise(a),
        )
        above = F.aggregate(
            F.sequence(F.lit(1), F.greatest((c["last"] - c["mode"]).cast("int"), F.lit(1))),
            start,
            lambda a, i: F.when(a["x"] < c["last"], state(a["x"] + 1, a["p"] * up(a["x"]), a["s"] + a["p"] * up(a["x"]))).otherwise(a),
        )

        def walk(t: F.Column) -> F.Column:
            # from the lowest count on, while the sum stays under the share u of all
            steps = F.sequence(F.lit(0), (c["last"] - c["first"]).cast("int"))
            lowest = state(t["below"]["x"], t["below"]["p"], t["below"]["p"])
            return F.aggregate(steps, lowest, lambda a, i: F.when((a["s"] < t["goal"]) & (a["x"] < c["last"]), state(a["x"] + 1, a["p"] * up(a["x"]), a["s"] + a["p"] * up(a["x"]))).otherwise(a))["x"]

        sums = once(F.struct(below.alias("below"), above.alias("above")), lambda t: F.struct(t["below"].alias("below"), (u * (t["below"]["s"] + t["above"]["s"] + 1)).alias("goal")))
        return once(sums, walk)

    bounds = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), mode.alias("mode"), first.alias("first"), last.alias("last"))
    return F.when((d <= 0) | (k <= 0), F.lit(0)).when(k >= n, drawn).otherwise(once(bounds, count)).cast("long")


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``(source, shard, first, quota)``: each shard's exact quota of each source's blocks, from rows ``(source, quota)``.

    Shares of a node's sources are drawn in turn: of the blocks not yet passed, how many of this source's fall in what the left
    child still has to get. first: blocks of the source in the shards before, where the shard's own run begins.
    """
    # the draws of a node depend on each other in the order of the sources: one array of a node, an entry a source
    node = quotas.select("source", F.col("quota").cast("long").alias("quota")).groupBy().agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "quota"))).alias("own")
    ).select(F.lit(0).alias("shard"), "own")
    width = shards
    while width > 1:
        total = F.aggregate("own", F.lit(0).cast("long"), lambda a, s: a + s["quota"])
        node = node.withColumn("total", total).withColumn("half", F.floor(F.col("total") / 2).cast("long"))
        draw = lambda s, rest, need: hypergeometric(rest, s["quota"], need, F.pmod(F.xxhash64(s["name"], s["none"], F.col("shard"), F.lit(width), F.lit(seed)), F.lit(2**52)) / float(2**52))
        acc = lambda rest, need, left: F.struct(rest.cast("long").alias("rest"), need.cast("long").alias("need"), left.alias("left"))

        def step(a: F.Column, s: F.Column) -> F.Column:
            with_draw = F.transform(F.array(draw(s, a["rest"], a["need"])), lambda x: acc(a["rest"] - s["quota"], a["need"] - x, F.concat(a["left"], F.array(x))))
            return F.get(with_draw, 0)

        node = node.withColumn("left", F.aggregate("own", acc(F.col("total"), F.col("half"), F.array().cast("array<bigint>")), step)["left"])
        side = lambda value: F.zip_with("own", "left", lambda s, x: F.struct(s["name"].alias("name"), s["none"].alias("none"), value(s, x).alias("quota")))
        both = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), side(lambda s, x: x).alias("own")), F.struct((F.col("shard") * 2 + 1).alias("shard"), side(lambda s, x: s["quota"] - x).alias("own"))
        )
        node = node.select(F.explode(both).alias("n")).select("n.shard", "n.own")
        width //= 2
        if shards // width in (16, 256, 4096):  # so many nodes are not one task's
            node = node.repartition("shard")
    flat = node.select("shard", F.explode("own").alias("s")).select(F.when(~F.col("s.none"), F.col("s.name")).alias("source"), "shard", F.col("s.quota").alias("quota"))
    before = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def slim(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, source, size, _mark)``, written once: what targets, starts and draws need of the documents. _mark: the hash that orders a source."""
    return written(marked(sized(docs.select("doc_id", "source", "text")), seed).select("doc_id", "source", "size", "_mark"), "sizes")


def marked(docs: DataFrame, seed: int = 0) -> DataFrame:
    return docs.withColumn("_mark", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)))


def plan(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK_WORDS) -> DataFrame:
    """``rows`` (with doc_id, source, size and _mark) with start, source_size, target, full, quota and blocks of their source.

    The mix takes the source ``full`` times, and ``quota`` of its ``blocks`` blocks once more. start: words of the source
    before the document. Documents fall into buckets of a source by their hash; a bucket's start is a sum over buckets, a
    document's one inside its bucket, so no task holds a source. sizes: ``slim`` of the same documents.
    """
    buckets = max(1, sizes.count() // BUCKET_DOCS)
    bucket = F.pmod(F.shiftright("_mark", 20), F.lit(buckets))
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sizes.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    starts = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source", "_bucket").orderBy("_mark", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_bucket", bucket).withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(checked(starts), rows["source"].eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    rows = rows.withColumn("start", F.col("_base") + F.col("_in")).drop("_mark", "_bucket", "_source", "_b", "_base", "_in")
    goal = goals(sizes, weights, share, most, block).withColumnRenamed("source", "_source")
    return rows.join(checked(goal), rows["source"].eqNullSafe(F.col("_source"))).drop("_source")


def goals(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, block: int) -> DataFrame:
    """``(source, source_size, target, full, blocks, quota)``."""
    goal = targets(sizes.select("source", "size"), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    goal = goal.withColumn("full", full).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    part = F.round((F.col("target") - F.col("full") * F.col("source_size")) / block).cast("long")
    return goal.withColumn("quota", F.when(F.col("full") >= most, 0).otherwise(F.least(F.greatest(part, F.lit(0)), F.col("blocks"))).cast("long"))


def drawn(block: F.Column) -> F.Column:
    """Place of a block in its source's permutation: a block is drawn if this is under the quota.

    Two coordinates of a rectangle that hardly exceeds the blocks are shifted in turn by hashes of each other, and numbers
    beyond the blocks are shifted again, so the places are a permutation with no rows beside each other.
    """
    a = F.greatest(F.ceil(F.sqrt(F.col("blocks").cast("double"))), F.lit(1)).cast("long")
    b = F.ceil(F.col("blocks") / F.greatest(a, F.lit(1))).cast("long")
    hashed = lambda x, k: F.xxhash64(x, F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(k))

    def shuffled(x: F.Column) -> F.Column:
        u, v = F.floor(x / b).cast("long"), F.pmod(x, b)
        for k in range(ROUNDS):
            u = F.pmod(u + hashed(v, 2 * k), a)
            v = F.pmod(v + hashed(u, 2 * k + 1), b)
        return u * b + v

    steps = F.sequence(F.lit(1), F.least(a, F.lit(STEPS)).cast("int"))
    return F.aggregate(steps, shuffled(block.cast("long")), lambda x, i: F.when(x < F.col("blocks"), x).otherwise(shuffled(x)))


def pieces(block: int) -> F.Column:
    """Of each block under a document: its place in the permutation and the document's words in it (from word, number)."""
    last = F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor(last / block))

    def piece(b: F.Column) -> F.Column:
        begin = F.greatest(b * block, F.col("start"))
        end = F.least((b + 1) * block, F.col("start") + F.col("size"))
        return F.struct(drawn(b).alias("place"), (begin - F.col("start")).alias("word"), (end - begin).alias("n"))

    return F.when(F.col("size") > 0, F.transform(numbers, piece))


def draws(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, block: int, shards: int | None) -> DataFrame:
    """``rows`` (with doc_id, source, size and _mark) as ``plan`` gives them, with taken: structs (shard, word, n, copy) of what the mix takes.

    A document's whole passes go to shards by a hash; its drawn blocks go to the shards in whose runs of its source's blocks
    their places lie, as the splitting tree dealt these; neighbouring blocks of one shard are one piece. A document of no
    words is taken once. shards: a power of two; None: as many as SHARD_WORDS asks for.
    """
    if shards is None:
        words = share * (sizes.agg(F.sum("size")).first()[0] or 0)
        shards = SHARDS
        while shards * SHARD_WORDS < words:
            shards *= 2
    rows = plan(rows, sizes, weights, share, most, block)
    quotas = shard_quotas(goals(sizes, weights, share, most, block).select("source", "quota"), shards)
    ends = quotas.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", (F.col("first") + F.col("quota")).alias("end")))).alias("ends"))
    ends = written(ends.withColumnRenamed("source", "_source"), "ends")  # the tree is drawn once
    rows = rows.join(checked(ends), rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    copies = F.greatest(F.col("full"), (F.col("size") == 0).cast("long")).cast("int")
    whole = F.transform(F.sequence(F.lit(1), copies), lambda k: F.struct(
        F.pmod(F.xxhash64("doc_id", "start", k, F.lit(11)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("word"), F.col("size").alias("n"), k.cast("long").alias("copy")))
    none = F.array().cast("array<struct<shard:int,word:bigint,n:bigint,copy:bigint>>")
    whole = F.when(copies > 0, whole).otherwise(none)
    shard_of = lambda place: F.size(F.filter("ends", lambda e: e["end"] <= place))
    mine = F.transform(F.filter(pieces(block), lambda p: p["place"] < F.col("quota")), lambda p: F.struct(shard_of(p["place"]).alias("shard"), p["word"].alias("word"), (p["word"] + p["n"]).alias("end")))

    def joined(all_: F.Column) -> F.Column:
        """Pieces that go on where the one before ends, in the same shard, as one."""
        goes_on = lambda i: F.coalesce((F.get(all_, i - 1)["shard"] == F.get(all_, i)["shard"]) & (F.get(all_, i - 1)["end"] == F.get(all_, i)["word"]), F.lit(False))
        heads = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: ~goes_on(i))
        piece = lambda h, last: F.struct(F.get(all_, h)["shard"].alias("shard"), F.get(all_, h)["word"].alias("word"), (F.get(all_, last)["end"] - F.get(all_, h)["word"]).alias("n"), F.lit(0).cast("long").alias("copy"))
        return F.get(F.transform(F.array(heads), lambda hs: F.transform(hs, lambda h, j: piece(h, F.coalesce(F.get(hs, j + 1), F.size(all_)) - 1))), 0)

    part = F.when((F.col("size") > 0) & (F.col("quota") > 0), F.get(F.transform(F.array(mine), lambda m: F.when(F.size(m) > 0, joined(m)).otherwise(none)), 0)).otherwise(none)
    return rows.withColumn("taken", F.concat(whole, part))


def taken_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK_WORDS, shards: int | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, by_shard)``: words of each document that the mix takes, repeats counted, summed over its shards' draws.

    by_shard tells where they went: ``shard:words`` in order of shards, with commas between.

    A null text has no words; a null source is one of its own; equal rows are drawn apart only by where they stand; an empty
    table gives an empty result. Reruns agree, as every draw hangs on hashes.
    """
    sizes = slim(docs)
    rows = draws(sizes, sizes, weights, share, most, block, shards).withColumnRenamed("taken", "_taken")
    taken = F.aggregate("_taken", F.lit(0).cast("long"), lambda total, p: total + p["n"])
    shard = F.array_sort(F.array_distinct(F.transform("_taken", lambda p: p["shard"])))
    words = lambda k: F.aggregate(F.filter("_taken", lambda p: p["shard"] == k), F.lit(0).cast("long"), lambda total, p: total + p["n"])
    by_shard = F.array_join(F.transform(shard, lambda k: F.concat(k.cast("string"), F.lit(":"), words(k).cast("string"))), ",")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), by_shard.alias("by_shard"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK_WORDS, shards: int | None = None) -> DataFrame:
    """The mix itself: ``docs`` with shard and place, one row for each document or piece of one that the mix takes.

    text holds the piece's words with what parts them, and n_chars (if there) follows it. Each shard's rows stand in the
    order of place, a hash. Columns of docs may have any names; only shard and place are replaced if docs has them.
    """
    columns = [c for c in docs.columns if c not in ("shard", "place")]
    sizes = slim(docs)
    # the rows' own columns are kept in one struct, beside those that the plan needs
    packed = marked(sized(docs.select(F.struct(*columns).alias("_row"), "doc_id", "source", "text"))).drop("text")
    rows = draws(packed, sizes, weights, share, most, block, shards)
    # a text is parted into words once, for all its pieces
    words = F.regexp_extract_all(F.col("_row")["text"], F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    with_text = lambda p, text: F.struct(p["shard"].alias("shard"), p["word"].alias("word"), p["copy"].alias("copy"), text.alias("text"))
    cut = F.get(F.transform(F.array(words), lambda w: F.transform("taken", lambda p: with_text(p, F.when(p["n"] == F.col("size"), F.col("_row")["text"]).otherwise(F.array_join(F.slice(w, (p["word"] + 1).cast("int"), p["n"].cast("int")), ""))))), 0)
    uncut = F.transform("taken", lambda p: with_text(p, F.col("_row")["text"]))
    parted = F.exists("taken", lambda p: p["n"] != F.col("size"))
    rest = F.struct(*(F.col("_row")[c].alias(c) for c in columns if c != "text")).alias("_rest")
    out = rows.select(rest, "doc_id", "start", F.explode(F.when(parted, cut).otherwise(uncut)).alias("_p"))
    out = out.select("_rest", F.col("_p.text").alias("_text"), F.col("_p.shard").alias("_shard"), F.xxhash64("doc_id", "start", "_p.copy", "_p.word", F.lit(13)).alias("_place"))
    out = out.repartition("_shard").sortWithinPartitions("_shard", "_place")

    def column(name: str) -> F.Column:
        if name == "text":
            return F.col("_text").alias("text")
        if name == "n_chars":
            return F.coalesce(F.length("_text"), F.lit(0)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col("_rest")[name].alias(name)

    return out.select(*map(column, columns), F.col("_shard").alias("shard"), F.col("_place").alias("place"))
