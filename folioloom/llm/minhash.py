"""Near-duplicate documents by bottom-k sketches of their shingle sets.

One hash function orders all shingles, and a document keeps the ``k`` smallest of its set. Documents with equal sets are
one class, held by its smallest doc_id. Inverted lists over the retained values generate overlaps between classes: each
class is listed only under the rarest of its values, as many as two sketches that overlap enough must share one. The
``k`` smallest of the union of two sketches estimate the similarity and filter pairs; the rest are confirmed on the
full sets, made again from the texts.

Long lists are not expanded into all pairs. The members of a list are compared with its centre, the member whose
values most others have. What does not link to the centre may still link to another member; the two then share most of
what sets them apart from the centre, so such members meet in lists of a second kind, of a centre and a value that only
one of centre and member holds. What all members share stands in none of these lists, and a value that one member alone
has makes none, so a large group of copies that do not link costs no pairs. Lists with members far from the centre have
another centre, with which all of them are compared. So no link between components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BROADCAST_PAIRS, beside_centres, dropped, small_batches, unpacked, written
from .wordhash import Words, chunks, shingles

#: Values that a sketch retains. Two sets at a similarity of 0.8 share under OVERLAP of the 64 smallest of their union with a chance of 1e-8.
K, OVERLAP = 64, 32
#: Lists up to this length give all their pairs; the longer ones meet by differences from a centre.
SHORT_LIST = 6
#: Common values of two sketches below which a similarity of 0.52 has a chance of 1e-4: the pair is far.
NEAR = 18


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """``(doc_id, n_shingles, set_key, sketch)`` of each document's set of shingles of ``words`` lower-cased words.

    Fewer words make one shingle of them all; a text without words (or null) has the empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                found = Words(data, offsets)
                grams, bounds = shingles(found.hashes(), found.first, words, short=True)
                sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                kept = [s[:k] for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                values = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(values))],
                    names=["doc_id", "n_shingles", "set_key", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def listed(sets: DataFrame, k: int = K, overlap: int = OVERLAP) -> DataFrame:
    """Inverted lists ``(value, doc, n, apart)`` of the classes ``(doc, n, sketch)`` under the rarest of their values.

    A link needs 0.8 n common values of a set of n, so where both sets are surely retained whole, the floor(0.2 n) + 1 rarest
    of each hold a common one. Two larger sets' sketches have ``overlap`` common values, and more than that by far most
    often, so of the rarest k - overlap + 1 many are common; these are listed with the value that follows in the sketch,
    which two documents of common phrases seldom share too. apart: how far from others, by the
    classes that have its values: the least is in the middle of a group. Sets between (0.8 k to k) are listed both ways, so linked sets
    meet in one. What a third of all documents share is never among the rarest but where it is half a document.
    """
    after = F.arrays_zip(F.col("sketch").alias("value"), F.slice("sketch", F.lit(2), F.size("sketch")).alias("after"))
    values = sets.where("n >= 4").select("doc", "n", F.inline(after))
    shared = values.groupBy("value").agg(F.count("*").alias("listed")).where("listed > 1")
    own = values.join(shared, "value").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("listed", "value", "after"))).alias("own"))
    alone = F.least("n", F.lit(k)) - F.size("own")
    apart = -F.aggregate("own", F.lit(0.0), lambda total, v: total + F.log2(v["listed"])) / F.least("n", F.lit(k))
    parts = []
    for need, some, key in (
        (F.floor(F.col("n") / 5) + 1, F.col("n") <= k, F.xxhash64("v.value")),
        (F.least("n", F.lit(k)) - overlap + 1, (F.col("n") > int(0.8 * k)) & F.col("v.after").isNotNull(), F.xxhash64("v.value", "v.after")),
    ):
        # values that one class alone has count among the rarest but make no list
        rarest = F.slice("own", F.lit(1), F.greatest(need - alone, F.lit(0)).cast("int"))
        parts.append(own.select("doc", "n", apart.alias("apart"), F.explode(rarest).alias("v")).where(some).select(key.alias("value"), "doc", "n", "apart"))
    lists = parts[0].union(parts[1])
    several = lists.groupBy("value").agg(F.count("*").alias("c")).where("c > 1").select("value")
    return lists.join(several, "value")


def similar(a: str = "na", b: str = "nb") -> F.Column:
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def estimated(pairs: DataFrame, sets: DataFrame, least: int, k: int = K) -> DataFrame:
    """``pairs (a, b, long)`` with na, nb, d and diff where the sketches are the full sets; of the others those that the estimate lets pass.

    The k smallest values of the sketches' union hold at least ``least`` common ones. d: size of the symmetric difference,
    null where only the texts tell; diff: its values, where ``long``.
    """
    sa = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    sb = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    few = pairs.count() <= BROADCAST_PAIRS  # then the sketches of all others need not move
    ids = F.broadcast(pairs) if few else pairs
    both = sa.join(ids, "a").join(sb.join(F.broadcast(pairs.select("a", "b")) if few else pairs.select("a", "b"), "b"), ["a", "b"])
    both = both.withColumn("common", F.array_intersect("sa", "sb"))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    d = F.col("na") + F.col("nb") - 2 * F.size("common")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    passes = F.when(whole, (3 * d <= F.col("na") + F.col("nb")) | F.lit(not least)).otherwise(F.size(F.array_intersect(union, "common")) >= least)
    diff = F.when(whole & F.col("long"), F.array_except(F.concat("sa", "sb"), "common"))
    return both.where(passes).select("a", "b", "long", "na", "nb", F.when(whole, d).alias("d"), diff.alias("diff"))


def compared(pairs: DataFrame, docs: DataFrame, words: int, far: bool) -> DataFrame:
    """``(a, b, long, na, nb, d, diff)`` on full sets, of ``pairs (a, b, long)``; diff only where ``long``, and near or ``far``. b is the centre whose text waits for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in unpacked(batches):
            for part, data, offsets in chunks(batch):
                found = Words(data, offsets)
                grams, bounds = shingles(found.hashes(), found.first, words, short=True)
                rows = []
                for i, (centre, salt, a, long) in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)))):
                    own = np.unique(grams[bounds[i] : bounds[i + 1]])
                    if a is None:
                        held = [*held, own] if last == (centre, salt) else [own]
                        last = (centre, salt)
                        continue
                    # of several texts of one doc_id the nearest counts
                    d, c = min(((len(own) + len(c) - 2 * len(np.intersect1d(own, c, assume_unique=True)), k) for k, c in enumerate(held)), default=(None, None))
                    if d is not None:
                        near = long and (far or 3 * d <= len(own) + len(held[c]))
                        rows.append((a, centre, long, len(own), len(held[c]), d, np.setxor1d(own, held[c], assume_unique=True).view(np.int64) if near else None))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["a", "b", "long", "na", "nb", "d", "diff"])

    return beside_centres(pairs.select("a", "b", "long"), docs, "long").mapInArrow(run, "a long, b long, long boolean, na long, nb long, d long, diff array<long>")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, least: int) -> DataFrame:
    """``(a, b, long, na, nb, d, diff)`` of ``pairs (a, b, long)``, written; a link has 9 d <= na + nb.

    Pairs under a similarity of 0.5 are left out, unless ``least`` is 0: no estimate then.
    """
    pairs = written(pairs, "pairs")
    guessed = written(estimated(pairs, sets, least), "estimates")
    dropped(pairs)
    with small_batches(docs.sparkSession):
        told = compared(guessed.where("d is null"), docs, words, not least)
        sure = guessed.where("d is not null").select(*told.columns)
        # equal doc_ids with several texts give several rows
        out = written(sure.union(told).where(F.lit(not least) | (3 * F.col("d") <= F.col("na") + F.col("nb"))), "compared")
    dropped(guessed)
    return out


def with_roots(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    named = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return rows.join(named, node, "left").withColumn(root, F.coalesce(root, node))


def differing(near: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different components that may link, from rows ``(a, b, na, nb, d, diff)`` of members a beside their centre b.

    Two members x and y of a centre have d(x, y) = d(x) + d(y) - 2 c, c being what their differences from the centre have in
    common, and they link if 9 d(x, y) <= n(x) + n(y). So c must reach a bound, and the rarest values of a difference, as many
    as may be missed and one more, hold a common one. Values that one member alone has are counted but never listed.
    """
    named = with_roots(near.where("long").select("a", F.col("b").alias("c"), "na", F.col("nb").alias("nc"), "d", "diff"), roots, "a", "ra")
    open_ = named.groupBy("c").agg(F.min("ra").alias("r0"), F.max("ra").alias("r1")).where("r0 <> r1").select("c")
    each = written(named.join(open_, "c").select("c", "a", "na", "nc", "d", "ra", F.explode("diff").alias("v")), "differences")
    shared = each.groupBy("c", "v").agg(F.count("*").alias("held")).where("held > 1")
    own = each.join(shared, ["c", "v"]).groupBy("c", "a").agg(*(F.first(x).alias(x) for x in ("na", "nc", "d", "ra")), F.sort_array(F.collect_list(F.struct("held", "v"))).alias("own"))
    own = own.withColumn("m", F.size("own"))
    # what two linked members have in common at the least: one of them does not link to the centre, and sizes differ by a quarter
    unlinked = 9 * F.col("d") > F.col("na") + F.col("nc")
    least = F.when(unlinked, F.col("d") - F.floor(F.col("na") / 4)).otherwise(F.ceil((F.col("d") + (F.col("nc") - F.col("na")) / 9) / 2 - 1e-9))
    own = own.withColumn("least", F.greatest(least.cast("int"), F.lit(1))).where("m >= least")
    rows = own.select("c", "a", "na", "d", "ra", "m", F.posexplode(F.slice("own", F.lit(1), F.col("m") - F.col("least") + 1)).alias("at", "o")).withColumn("v", F.col("o.v")).drop("o")
    left = rows.select("c", "v", "a", "na", "ra", F.col("d").alias("da"), F.col("m").alias("ma"), F.col("at").alias("pa"))
    right = rows.select("c", "v", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ra").alias("rb"), F.col("d").alias("db"), F.col("m").alias("mb"), F.col("at").alias("pb"))
    need = F.greatest(F.ceil((F.col("da") + F.col("db") - F.floor((F.col("na") + F.col("nb")) / 9)) / 2), F.lit(1))
    fits = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & similar() & (F.col("pa") + need <= F.col("ma")) & (F.col("pb") + need <= F.col("mb"))
    on = (left["c"] == right["c"]) & (left["v"] == right["v"])
    return left.join(right, on & fits).select("a", "b").distinct()


def within(lists: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of different components of short lists (value, doc, n, root)."""
    left = lists.select("value", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = lists.select("value", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    fits = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & similar()
    return left.join(right, (left["value"] == right["value"]) & fits).select("a", "b").distinct()


def linked(lists: DataFrame, sets: DataFrame, docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """``links (a, b)`` that span all components of the classes, and their ``roots (node, root)``.

    In the first round members that the estimate puts far from their list's centre are left out; in the second one all
    members of the lists that have such ones are compared with a centre.
    """
    links, roots = None, None
    now = lists.withColumn("fresh", F.lit(True))
    for least in (NEAR, 0):
        centre = F.min_by(F.when(F.col("fresh"), F.struct(F.col("doc").alias("c"), F.col("n").alias("nc"))), F.when(F.col("fresh"), F.struct("apart", "doc")))
        size = now.groupBy("value").agg(F.count("*").alias("size"), centre.alias("best"))
        rows = written(now.join(size.select("value", "size", "best.c", "best.nc"), "value"), "rows")
        # sizes further apart than this are below a similarity of 0.5
        apart = (2 * F.col("n") < F.col("nc")) | (2 * F.col("nc") < F.col("n"))
        star = rows.where((F.col("doc") != F.col("c")) & (~apart | F.lit(not least)))
        long = (F.col("size") > SHORT_LIST) | F.lit(not least)
        stars = star.groupBy(F.col("doc").alias("a"), F.col("c").alias("b")).agg(F.max(long).alias("long"))
        near = verified(stars, sets, docs, words, least)
        found = near.where("9 * d <= na + nb").select("a", "b")
        links = found if links is None else links.union(found)
        roots = components(links)
        more = differing(near, roots)
        if least:
            more = more.union(within(with_roots(rows.where((F.col("size") > 2) & (F.col("size") <= SHORT_LIST)), roots, "doc", "root"))).distinct()
        seen = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = verified(more.join(seen, ["a", "b"], "left_anti").withColumn("long", F.lit(False)), sets, docs, words, OVERLAP)
        links = links.union(more.where("9 * d <= na + nb").select("a", "b"))
        roots = components(links)
        if least:
            # members near the centre are done; those of 0.72 or less may also link to one that is far from it
            met = near.select(F.col("a").alias("doc"), F.col("b").alias("c"), (F.col("d") <= 0.16 * (F.col("na") + F.col("nb"))).alias("close")).groupBy("doc", "c").agg(F.max("close").alias("close"))
            rest = rows.where((F.col("size") > SHORT_LIST) & (F.col("doc") != F.col("c"))).join(met, ["doc", "c"], "left")
            rest = rest.where("close is null or not close").withColumn("fresh", F.col("close").isNull())
            rest = with_roots(rest.select("value", "doc", "n", "apart", "fresh"), roots, "doc", "root")
            open_ = rest.groupBy("value").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("fresh").alias("some")).where("some and r0 <> r1")
            now = written(rest.join(open_.select("value"), "value").drop("root"), "open")
        dropped(rows)
    return links, roots


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, n_links)`` for each row of ``docs (doc_id, text)``; other columns are ignored.

    Two documents link if 100 * intersection >= 80 * union of their shingle sets; component_id is the smallest doc_id that
    links reach, the document's own included; kept marks that one. n_links: links that joined the document's class to
    others (a spanning part of all links). Null or empty texts have no shingles and link with nothing. Equal texts, ties and
    repeated rows share a class; rows that repeat a doc_id with other texts share one component: one of the texts is listed, and all are compared.
    A null doc_id links with nothing and is kept, with a null component. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        made = written(sketches(plain, words), "sketches")
    full = made.where("set_key is not null and doc_id is not null")
    reps = full.groupBy("set_key").agg(F.min("doc_id").alias("doc"))
    member = written(full.select("doc_id", "set_key").join(reps, "set_key").select("doc_id", F.col("doc").alias("class")).distinct(), "classes")
    heads = member.where("doc_id = class").select(F.col("doc_id").alias("doc"))
    sets = written(
        full.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch").join(heads, "doc").dropDuplicates(["doc"]), "sets"
    )
    lists = written(listed(sets), "lists")
    links, roots = linked(lists, sets, plain, words)
    for done in (lists, sets):
        dropped(done)
    count = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    named = member.join(roots.withColumnRenamed("node", "class"), "class", "left").join(count, "class", "left")
    named = named.groupBy("doc_id").agg(F.min(F.coalesce("root", "class")).alias("root"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    out = made.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
