"""Structure repair, prefix trie and URL filters against brute force, their SQL, and odd inputs."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import pytest

from folioloom.llm import prefix_trie, queries, turn_repair, url_rules

TURNS = "conv_id long, turn long, role string, text string"
DATA = "/root/testdata/sf0.001"
FINISHED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def place(turn):
    return (0, 0) if turn is None else (1, turn)


def cheapest(rows):
    """Cost, audit and lines of the cheapest repair, by recursion over suffixes with whole strings."""
    allowed = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @lru_cache(None)
    def go(i, state, put):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if put < 3:
            for kind, role in (("u", "user"), ("a", "assistant")):
                if (state, kind) in allowed and (r := go(i, kind, put + 1)):
                    found.append((r[0] + 2, "I" + r[1], (f"{role}:", *r[2])))
        if i < len(rows):
            role, text, fault = rows[i]
            if r := go(i + 1, state, 0):
                found.append((r[0] + 3, "D" + r[1], r[2]))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] and (state, role[:1]) in allowed and (r := go(i + 1, role[:1], 0)):
                    found.append((r[0] + late, "K" + r[1], (f"{role}:{text}", *r[2])))
                for kind, new in (("u", "user"), ("a", "assistant")):
                    if (state, kind) in allowed and (r := go(i + 1, kind, 0)):
                        found.append((r[0] + 2 + late, "R" + r[1], (f"{new}:{text}", *r[2])))
        return min(found) if found else None

    return go(0, "", 0)


def repairs(rows):
    convs, out = defaultdict(list), set()
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        mine, role, text = convs[conv], " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(place(turn), digest(role, text), role, text, turn)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, held in convs.items():
        held.sort(key=lambda v: v[:2])
        seen, known, count = set(), [], Counter()
        for _, _, role, text, _ in held:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            known.append((role, text, fault))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        turns = {v[4] for v in held if v[4] is not None}
        cost, audit, lines = cheapest(tuple(known))
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def nodes(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((place(turn), digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    members, full = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[p] if full[c] == p)).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items()}


def some_turns(seed, n_convs, n):
    rng = random.Random(seed)
    texts = [None, "", "a.", "b", "é!", " ", "Long one? ", "\v\n", "x" * 3000 + ".", " w" * 2000, *(f"t{i}." for i in range(8))]
    return [(rng.choice([None, *range(n_convs)]), rng.choice([None, *range(20)]), rng.choice([None, "user", "assistant", "system", "", "tool", "agent"]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("held, piece, parts", [(2048, 256, 3), (5, 3, 7)])
def test_repairs_are_the_cheapest(spark, monkeypatch, held, piece, parts):
    monkeypatch.setattr(turn_repair, "HELD", held)
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    rows = some_turns(1, 60, 500) + [(900, k % 3, "user", "Same.") for k in range(40)]
    frame = spark.createDataFrame(rows, TURNS).repartition(parts)
    named = frame.withColumnsRenamed({}).selectExpr("*", "1 AS part", "2 AS local", "3 AS d", "4 AS gone")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in turn_repair.repaired_conversations(named).select(FINISHED).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == repairs(rows)


def test_repairs_of_nothing(spark):
    assert turn_repair.repaired_conversations(spark.createDataFrame([], TURNS)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, 0, "user", "Hi.")]
    (row,) = turn_repair.repaired_conversations(spark.createDataFrame(rows, TURNS)).select(FINISHED).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_steps_of_a_repair_are_few():
    rng = random.Random(2)
    marks = "".join(turn_repair.symbol(rng.choice(["user", "assistant", "system", "x"]), rng.choice([0, 0, 1, 2, 3])) for _ in range(3000))
    cost, edits, last = turn_repair.repaired(marks)
    assert len(edits) == 3000 and cost > 0 and last in (0, 1, 2)
    assert turn_repair._step.cache_info().currsize < 2000


def test_nodes_are_all_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = some_turns(3, 12, 400) + [(20, k, "user", f"x{k % 3}") for k in range(60)] + [(21, k, "user", f"x{k % 3}") for k in range(59)] + [(c, 0, "user", "Hello") for c in range(30, 60)]
    frame = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr("*", "1 AS pos", "2 AS xa", "3 AS depth")
    assert {tuple(r) for r in prefix_trie.conversation_trie(frame).select(NODES).collect()} == nodes(rows)


def test_nodes_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    lone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    (root,) = prefix_trie.conversation_trie(spark.createDataFrame([(lone, 1, "user", "Hi.")], TURNS)).select(NODES).collect()
    assert tuple(root) == (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG", "https://example.org/", "http://a.example.org/es/1", "http://example.org/en/1", "http://example.org/en/2", "http://xexample.org/es/1", "ftp://x.com/fr/1?q=://y.org/",
    "http://com/de/1", "http://x.com/de", "http://x.com/DE/1", "http://x.org?a/b", "http://x.org#/es/", "http://org:80/", "http://x.net/es/5?b=1&b=2&c", "://org/", "http://x.org/\nline", "http://y.net/" + "a/" * 5000,
]


def split(url):
    found = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[2]), found[3], found[1]) if found else ("", "", "")


def explicit(host, path):
    fits = [(len(of + start), of + start, verdict) for verdict, of, start in url_rules.RULES if (host == of or host.endswith("." + of)) and path.startswith(start)]
    return max(fits)[1:] if fits else (None, None)


def tokens_of(url):
    host, path, scheme = split(url)
    if not host:
        return frozenset()
    query = re.match(r"(?s).*?://[^?#]*\?([^#]*)", url)
    names = [re.sub("(?s)=.*", "", n) for n in (query[1] if query else "").split("&")][:2]
    words = [re.sub("[0-9]+", "", w) for w in path.split("/")[1:4]]
    return frozenset("s:h:p:q:"[2 * k : 2 * k + 2] + t for k, ts in enumerate(([scheme], host.split(".")[::-1][:5], words, names)) for t in ts if t)


def test_urls_are_judged_as_by_brute_force(spark):
    rng = random.Random(4)
    urls = URLS + [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'm.', ''])}{rng.choice('abc')}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(300)}{rng.choice(['', '?utm=1', '#top'])}" for _ in range(300)]
    rows = [(k if k % 17 else None, u, "x", 1.5) for k, u in enumerate(urls)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, confidence double")
    got = [tuple(r) for r in url_rules.judged(frame).collect()]
    seen = [(tokens_of(u), explicit(*split(u)[:2])[1]) for u in urls if explicit(*split(u)[:2])[0]]
    n, both = Counter(), Counter()
    for tokens, verdict in seen:
        for k in range(1, len(tokens) + 1):
            for combination in itertools.combinations(sorted(tokens), k):
                n[combination] += 1
                both[combination, verdict] += 1
    rules = [(c / n[t], c, len(t), list(t), v) for (t, v), c in both.items() if c >= math.ceil(len(seen) * url_rules.MIN_SUPPORT) and c / n[t] >= url_rules.MIN_CONFIDENCE]
    want = []
    for page, url, *_ in rows:
        host, path, _ = split(url)
        rule, verdict = explicit(host, path)
        fits = [] if rule else [r for r in rules if set(r[3]) <= tokens_of(url)]
        best = max(fits) if fits else None
        want.append((page, host, path, rule, verdict or (best[4] if best else "allow"), best and best[3], best and best[0]))
    assert Counter(map(str, got)) == Counter(map(str, want))
    assert any(w[5] and w[4] == "block" for w in want) and any(w[5] and w[4] == "allow" for w in want)


def test_urls_without_labels(spark):
    frame = spark.createDataFrame([(1, "http://x.net/es/1"), (2, None)], "page_id long, url string")
    assert [(r.page_id, r.rule, r.verdict, r.mined) for r in url_rules.judged(frame).collect()] == [(1, None, "allow", None), (2, None, "allow", None)]
    assert url_rules.judged(frame.where("false")).count() == 0
    labelled = spark.createDataFrame([("http://z.net/es/9", "block")] * 3 + [("http://z.net/en/9", "allow")] * 3 + [("http://z.net/en/9", None)], "url string, verdict string")
    assert [r.verdict for r in url_rules.judged(frame, labelled=labelled).orderBy("page_id").collect()] == ["block", "allow"]


@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_prefix_trie", "op13_url_filters"])
def test_query_is_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.sql(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    got = queries.QUERIES[name](spark, DATA)
    want = db.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    show = lambda row: str(tuple(row))
    assert Counter(map(show, got.select(order).collect())) == Counter(map(show, want.select(*(f'"{c}"' for c in order)).fetchall()))
