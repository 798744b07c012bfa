"""URL filters: explicit rules by host and path, and association rules mined from the URLs that they judge.

Everything here is DataFrame functions and ``pyspark.ml``'s FP-growth. A URL is a set of tokens: its scheme, the labels of
its host, words of its path and names of its query. FP-growth finds token combinations that are frequent among labelled
URLs together with their label; combinations of enough support and confidence are the rules. An inverted index keyed by a
rule's rarest token finds the rules of a URL.

Null or unparsable URLs have empty host and path, no tokens, and the default verdict. Equal URLs get equal answers.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A mined combination stands in this share of the labelled URLs at least, and its label in this share of those that hold it.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: Parts of a URL that make tokens, so at most eleven tokens and 2,047 combinations a URL: labels from the end of a host, segments from the start of a path, names from the start of a query.
HOST_LABELS, SEGMENTS, NAMES = 5, 3, 2
#: The verdict where neither an explicit nor a mined rule fits.
DEFAULT = "allow"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: F.Column) -> F.Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: F.Column) -> F.Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def explicit(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """``(rule, verdict)`` of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: F.Column, host: F.Column, path: F.Column) -> F.Column:
    """Distinct tokens: ``s:`` scheme, ``h:`` labels of the host, ``p:`` segments of the path without their digits, ``q:`` names of the query.

    Segments of digits alone name one page and make no token. The last five labels, first three segments and first two names count.
    """
    scheme = F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, HOST_LABELS)
    words = F.slice(F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "")), 2, SEGMENTS)
    names = F.slice(F.transform(F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&"), lambda s: F.regexp_replace(s, "(?s)=.*", "")), 1, NAMES)
    marked = lambda kind, parts: F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.concat(F.lit(kind), s))
    named = [marked("s:", scheme), marked("h:", labels), marked("p:", words), marked("q:", names)]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.coalesce(F.concat(*named), F.array().cast("array<string>"))))


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``(tokens, verdict, support, confidence)`` of combinations of tokens that go with one label, from all of ``labelled (tokens, verdict)``.

    tokens is sorted, support the number of labelled rows with the tokens and the verdict. FP-growth needs ``min_support`` of the rows
    for a combination, so there are at most 2,047 / min_support rules, however many rows there are. No labelled rows: no rules.
    """
    rows = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    sets = model.freqItemsets
    split = sets.select(F.array_sort(F.filter("items", lambda t: ~t.startswith("verdict="))).alias("tokens"), F.try_element_at(F.filter("items", lambda t: t.startswith("verdict=")), F.lit(1)).alias("verdict"), "freq")
    split = split.where(F.size("tokens") > 0)
    whole = split.where("verdict is null").select("tokens", F.col("freq").alias("n"))
    rules = split.where("verdict is not null").join(whole, "tokens").withColumn("confidence", F.col("freq") / F.col("n"))
    return rules.where(F.col("confidence") >= min_confidence).select("tokens", F.substring("verdict", 9, 1 << 30).alias("verdict"), F.col("freq").alias("support"), "confidence")


def index(rules: DataFrame) -> DataFrame:
    """One row with a map from a token to the rules listed under it: each rule stands once, under its token that fewest rules hold."""
    spread = rules.select("*", F.explode("tokens").alias("token"))
    held = spread.groupBy("token").agg(F.count("*").alias("held"))
    rare = spread.join(held, "token").groupBy("tokens", "verdict", "support", "confidence").agg(F.min(F.struct("held", "token"))["token"].alias("token"))
    listed = rare.groupBy("token").agg(F.collect_list(F.struct("confidence", "support", "tokens", "verdict")).alias("rules"))
    return listed.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index"))


def best(tokens: F.Column, index: F.Column) -> F.Column:
    """The listed rule all of whose tokens are there: highest confidence, then support, then most tokens, then the last in order of tokens; else null."""
    listed = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(index, t)), lambda r: r.isNotNull()))
    fits = F.filter(listed, lambda r: F.size(F.array_except(r["tokens"], tokens)) == 0)
    return F.array_max(F.transform(fits, lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), F.size(r["tokens"]).alias("size"), r["tokens"].alias("tokens"), r["verdict"].alias("verdict"))))


def judged(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``(<keep>, host, path, rule, verdict, mined, confidence)`` of each row of ``pages (url, <keep>)``.

    rule and verdict are those of the longest explicit rule; else rule is null and verdict that of the best mined rule, whose tokens
    are in mined (array) with its confidence; else the default. labelled: ``(url, verdict)`` to mine from; without it, the URLs that explicit rules judge.
    """
    parsed = lambda df, *more: df.select(*more, F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    named = lambda df: df.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    own = [F.col(c) for c in keep]
    rows = named(parsed(pages, *own)).withColumn("found", explicit(F.col("host"), F.col("path"), rules))
    if labelled is None:
        seen = named(parsed(pages).withColumn("found", explicit(F.col("host"), F.col("path"), rules)).where("found is not null")).select("tokens", F.col("found.verdict").alias("verdict"))
    else:
        seen = named(parsed(labelled, "verdict")).where("verdict is not null").select("tokens", "verdict")
    rows = rows.withColumn("index", index(mined(seen)).scalar())
    rows = rows.withColumn("best", F.when(F.col("found").isNull(), best(F.col("tokens"), F.col("index"))))
    verdict = F.coalesce(F.col("found.verdict"), F.col("best.verdict"), F.lit(DEFAULT))
    return rows.select(*keep, "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.col("best.tokens").alias("mined"), F.col("best.confidence").alias("confidence"))


SQL = r"""
WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, of_, start)),
p AS (SELECT *, row_number() OVER () AS id FROM u),
f AS (SELECT id, arg_max(of_ || start, length(of_ || start)) AS rule, arg_max(verdict, length(of_ || start)) AS verdict FROM p JOIN rules ON (host = of_ OR ends_with(host, '.' || of_)) AND starts_with(path, start) GROUP BY id),
k AS (SELECT id, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_concat(
    list_transform(list_filter([regexp_extract(url, '(?s)^(.*?)://', 1)], lambda s: s <> ''), lambda s: 's:' || s),
    list_transform(list_filter(list_reverse(string_split(host, '.'))[1:5], lambda s: s <> ''), lambda s: 'h:' || s),
    list_transform(list_filter(list_transform(string_split(path, '/')[2:4], lambda s: regexp_replace(s, '[0-9]+', '', 'g')), lambda s: s <> ''), lambda s: 'p:' || s),
    list_transform(list_filter(list_transform(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda s: regexp_replace(s, '(?s)=.*', ''))[1:2], lambda s: s <> ''), lambda s: 'q:' || s)))) END AS toks FROM p),
seen AS (SELECT id, verdict, toks FROM f JOIN k USING (id)),
sub AS (SELECT verdict, list_filter(toks, lambda t, i: (m >> (i - 1)) & 1 = 1) AS ante FROM (SELECT verdict, toks, unnest(range(1, 1 << len(toks))) AS m FROM seen)),
n AS (SELECT ante, count(*) AS n FROM sub GROUP BY ante),
r AS (SELECT ante, verdict, count(*) AS support, count(*) / any_value(n) AS confidence FROM sub JOIN n USING (ante) GROUP BY ante, verdict),
ok AS (SELECT * FROM r WHERE support >= (SELECT ceil(count(*) * 0.01::DOUBLE) FROM seen) AND confidence >= 0.8::DOUBLE),
b AS (SELECT id, arg_max({verdict: verdict, ante: ante, confidence: confidence}, (confidence, support, len(ante), ante)) AS best FROM k JOIN ok ON list_has_all(toks, ante) WHERE id NOT IN (SELECT id FROM f) GROUP BY id)
SELECT page_id, host, path, rule, coalesce(f.verdict, best.verdict, 'allow') AS verdict, array_to_string(best.ante, ' ') AS mined, best.confidence AS confidence FROM p LEFT JOIN f USING (id) LEFT JOIN b USING (id)
"""
