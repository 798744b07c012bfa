"""A trie of conversation prefixes, with sums over subtrees by pointer jumping.

A node is a distinct sequence of a conversation's first turns. Its digest is the exclusive or of hashes of (place, turn), so
the digests of a long conversation's prefixes are made in chunks; with its depth it keys the node, and the digest without
the last turn keys the parent. Counts of leaves and savings rise to all ancestors in rounds: in round k each node sends the
sum over what lies less than 2^k below it to its ancestor 2^k above, and then points twice as far, so that a tree of depth d takes log2 d rounds.

Turns without conv_id belong to no conversation. A null role or text counts as empty. Turns are ordered by turn (nulls
first), equal ones by the MD5 of ``<bytes of role>:<role><text>``; repeated rows stay. Other columns are ignored. Without a conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered
from .shared import dropped, written

#: Turns whose digests one task makes in a row, and range of conv_ids whose list is made at once.
CHUNK, IDS = 1024, 1024


def turns_of(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, a, b, n_bytes)``: each conversation's turns in order, as two longs of the turn's digest and the bytes of its text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    hashed = named.select("conv_id", "turn", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("d"), F.octet_length("text").cast("long").alias("n_bytes"))
    out = numbered(hashed, "conv_id", "turn", "d")
    return out.select("conv_id", "pos", F.xxhash64("d").alias("a"), F.xxhash64(F.lit(1), "d").alias("b"), "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the conversation at the next lower multiple of five: ``(conv_id, depth, a, b, n_bytes)`` and ``(conv_id, n_turns)``.

    Of h = crc32(conv_id) mod 9 turns, as many as that conversation has come first, then a conversation's own turns after its first h.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    base = turns.where("conv_id % 5 = 0 and pos <= 8").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n_bytes"))).alias("head"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("of", F.expr("conv_id - conv_id % 5"))
    headed = sizes.join(base.withColumnRenamed("conv_id", "of"), "of", "left").withColumn("head", F.expr("slice(head, 1, h)")).withColumn("k", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    headed = headed.withColumn("k", F.greatest("k", F.lit(0))).select("conv_id", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    headed = written(headed, "headed")
    first = headed.select("conv_id", F.explode("head").alias("t"), "n_turns").select("conv_id", F.col("t.pos").alias("depth"), "t.a", "t.b", "t.n_bytes", "n_turns")
    own = turns.join(headed.select("conv_id", "h", "k", "n_turns"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "n_bytes", "n_turns")
    return first.unionByName(own), headed.select("conv_id", "n_turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows (conv_id, depth, a, b, n_bytes, ..)`` with the digest (xa, xb) of the turns up to each and that of the turns before it (pa, pb)."""
    chunk = F.floor((F.col("depth") - 1) / CHUNK)
    rows = rows.withColumns({"ha": F.xxhash64("depth", "a", "b"), "hb": F.xxhash64("b", "depth", "a"), "chunk": chunk}).drop("a", "b")
    rows = written(rows, "rebuilt")
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # chunks after a conversation's first, of which most conversations have none
    full = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("ha").alias("sa"), F.bit_xor("hb").alias("sb"))
    full = full.withColumns({"sa": F.bit_xor("sa").over(earlier), "sb": F.bit_xor("sb").over(earlier)}).where("chunk > 0")
    made = rows.withColumns({"xa": F.bit_xor("ha").over(so_far), "xb": F.bit_xor("hb").over(so_far)}).join(full, ["conv_id", "chunk"], "left")
    made = made.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(s, F.lit(0))) for c, s in (("xa", "sa"), ("xb", "sb"))})
    return made.withColumns({"pa": F.col("xa").bitwiseXOR(F.col("ha")), "pb": F.col("xb").bitwiseXOR(F.col("hb"))}).drop("ha", "hb", "sa", "sb", "chunk")


def _ids_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each (xa, xb, depth) over its pieces, which come in order; only the running hash is kept."""
    key, running, out = None, None, []
    for batch in batches:
        for xa, xb, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("xa", "xb", "depth", "ids"))):
            if (xa, xb, depth) == key:
                running.update(b",")
            else:
                if key:
                    out.append((*key, running.hexdigest()))
                key, running = (xa, xb, depth), hashlib.sha256()
            running.update(piece.encode())
        if len(out) >= 10_000:
            yield _hash_rows(out)
            out = []
    if key:
        out.append((*key, running.hexdigest()))
    yield _hash_rows(out)


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["xa", "xb", "depth", "ends"])


def ends(last: DataFrame) -> DataFrame:
    """``(xa, xb, depth, ends)``: the SHA-256 of the comma-joined conv_ids, in order, of the conversations that end at a node, from ``(xa, xb, depth, conv_id)``.

    Lists are made for ranges of 1,024 conv_ids, and one hash runs over a node's lists in order, so a node where very many end is never one list.
    """
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = last.groupBy("xa", "xb", "depth", F.floor(F.col("conv_id") / IDS).alias("range")).agg(piece.alias("ids"))
    dealt = pieces.repartition("xa", "xb", "depth").sortWithinPartitions("xa", "xb", "depth", "range")
    return dealt.mapInArrow(_ids_hashed, "xa long, xb long, depth long, ends string")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """``(conv_id, depth, leaves, saved)`` that nodes below bring to each node of ``nodes (conv_id, depth, up, leaves, saved)``; up: the parent's conv_id, and its depth is one less.

    Pointer jumping: after round k a node's sums hold all that lies less than 2^(k+1) below it, and ``up`` names its ancestor that far above. Nodes
    nearer to the root than that have nobody to send to and drop out, so rounds shrink. Each round is a written table.
    """
    active, brought, step = nodes.where("depth >= 1"), [], 1
    while step <= deepest:
        sent = active.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        sent = written(sent, "sent")
        brought.append(sent)
        step *= 2
        if step <= deepest:
            got = sent.select("conv_id", "depth", F.col("leaves").alias("l"), F.col("saved").alias("s"))
            far = active.where(F.col("depth") >= step).join(got, ["conv_id", "depth"], "left")
            far = far.select("conv_id", "depth", F.col("up").alias("via"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
            hop = active.select(F.col("conv_id").alias("via"), F.col("depth").alias("at"), "up")
            far = far.join(hop, (far["via"] == hop["via"]) & (far["depth"] - step // 2 == hop["at"])).select("conv_id", "depth", "up", "leaves", "saved")
            active = written(far, "jumped")
    if not brought:
        return nodes.select("conv_id", "depth", "leaves", "saved").limit(0)
    out = brought[0]
    for more in brought[1:]:
        out = out.unionByName(more)
    return out.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``rows (conv_id, depth, a, b, n_bytes, n_turns)``; lengths: ``(conv_id, n_turns)`` of all conversations, turnless ones too.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves and saved_tokens (over the subtree), ends_sha256.
    """
    placed = written(prefixes(rows), "prefixes")
    least, convs, deepest = lengths.agg(F.min("conv_id"), F.count("*"), F.max("n_turns")).first()
    made = placed.groupBy("xa", "xb", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.max("n_bytes").alias("n_bytes"))
    root = rows.sparkSession.range(1 if convs else 0).select(*(F.lit(v).cast("long").alias(c) for c, v in (("xa", 0), ("xb", 0), ("depth", 0), ("conv_id", least), ("n_convs", convs), ("pa", None), ("pb", None), ("n_bytes", 0))))
    made = written(made.unionByName(root), "nodes")
    children = made.where("depth > 0").groupBy(F.col("pa").alias("xa"), F.col("pb").alias("xb"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ended = placed.where("depth = n_turns").select("xa", "xb", "depth", "conv_id").unionByName(lengths.where("n_turns = 0").select(F.lit(0).cast("long").alias("xa"), F.lit(0).cast("long").alias("xb"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    made = made.join(children, ["xa", "xb", "depth"], "left").join(ends(ended), ["xa", "xb", "depth"], "left")
    made = written(made.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    # the root is the parent of all nodes of depth one, so they need no join
    parent = made.where("depth > 0").select(F.col("xa").alias("pa"), F.col("xb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"))
    kept = ["conv_id", "depth", "up", "n_convs", "n_children", "n_bytes", "ends"]
    deep = made.where("depth > 1").join(parent, ["pa", "pb", "depth"]).select(kept)
    shallow = made.where("depth <= 1").withColumn("up", F.when(F.col("depth") == 1, F.lit(least).cast("long"))).select(kept)
    own = {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}
    nodes = written(deep.unionByName(shallow).withColumns(own), "edges")
    below = rolled_up(nodes.select("conv_id", "depth", "up", "leaves", "saved"), deepest or 0)
    below = below.select("conv_id", "depth", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    out = nodes.join(below, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.col("up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations (conv_id, turn, role, text)``."""
    return trie(*rebuilt(turns_of(conversations)))


SQL = r"""
WITH s AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, count(*) AS n, c - c % 5 AS base, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
  lambda a, d: list_reduce([xor(a, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc FROM s GROUP BY c),
h AS (SELECT i.*, xor(crc, 4294967295::BIGINT) % 9 AS h, least(xor(crc, 4294967295::BIGINT) % 9, coalesce(b.n, 0)) AS kept FROM ids i LEFT JOIN (SELECT c AS base, n FROM ids) b USING (base)),
t AS (SELECT h.c, s.k AS d, role, text FROM h JOIN s ON s.c = h.base AND s.k <= h.h UNION ALL SELECT h.c, s.k - h.h + h.kept, role, text FROM h JOIN s ON s.c = h.c AND s.k > h.h),
p AS (SELECT c, d, text, string_agg(md5(strlen(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS key FROM t),
l AS (SELECT h.c, coalesce(max(d), 0) AS len FROM h LEFT JOIN t USING (c) GROUP BY h.c),
m AS (SELECT c, d, key, strlen(text) AS bytes FROM p UNION ALL SELECT c, 0, '', 0 FROM h),
g AS (SELECT key, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '') AS ends FROM m JOIN l USING (c) GROUP BY key, d),
e AS (SELECT g.*, q.conv_id AS parent, coalesce(kids, 0) AS kids FROM g LEFT JOIN g q ON q.key = left(g.key, (g.depth::INT - 1) * 32) AND q.depth = g.depth - 1 LEFT JOIN (SELECT left(key, (depth::INT - 1) * 32) AS key, count(*) AS kids FROM g WHERE depth > 0 GROUP BY 1) w ON w.key = g.key),
a AS (SELECT left(key, x::INT * 32) AS key, sum(CAST(kids = 0 AS BIGINT)) AS leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS x FROM e) GROUP BY 1)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM e JOIN a USING (key)
"""
