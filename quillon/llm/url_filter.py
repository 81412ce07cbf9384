"""URL filters by indexed pattern rules (operator 10, DataFrame functions only).

Every rule is a regular expression over ``host || path`` with the literal tokens
that any matching URL must contain.  A rule is filed under the one of its tokens
that is rarest in the table's URLs; a URL fetches the rules filed under its own
tokens, and only those run their expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are joined instead of looked up in a literal map.
MAP_RULES = 512


@dataclass(frozen=True)
class Rule:
    """``site`` rules come before ``pattern`` rules; among them the longest text wins."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool


def site_rule(text: str, verdict: str) -> Rule:
    """A rule such as ``example.org/es/``: the host and its subdomains, and a path prefix."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    words = [w for w in re.split(r"[^a-z0-9]+", host.translate(str.maketrans(UPPER, LOWER))) if w]
    # the last word of a path prefix can go on in the URL, so it is no whole token
    words += [w for w in re.split(r"[^a-z0-9]+", re.sub(r"[A-Za-z0-9]+$", "", path).translate(str.maketrans(UPPER, LOWER))) if w]
    return Rule(text, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), tuple(dict.fromkeys(words)), True)


def pattern_rule(*words: str, verdict: str = "block") -> Rule:
    """The words next to each other, as whole tokens, anywhere in host or path."""
    text = "-".join(words)
    return Rule(text, verdict, r"(?i)(?:^|[^a-z0-9])" + r"[^a-z0-9]+".join(map(re.escape, words)) + r"(?:$|[^a-z0-9])", tuple(words), False)


SITE_RULES = [site_rule("org/", "allow"), site_rule("example.org/es/", "block"), site_rule("example.org/en/1", "block"), site_rule("com/fr/", "allow"), site_rule("com/de/", "block")]
PATTERN_RULES = [
    *(pattern_rule(w) for w in ("adult", "bets", "betting", "casino", "doubleclick", "escort", "gambling", "jackpot", "porn", "poker", "popunder", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx")),
    *(pattern_rule(*w) for w in (("ads", "track"), ("ad", "server"), ("cheap", "pills"), ("free", "bets"), ("free", "download"), ("link", "farm"), ("payday", "loans"), ("click", "bait"))),
]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(subject: Column) -> Column:
    """The distinct tokens, and '' under which rules without any token are filed."""
    return F.array_union(F.array_distinct(F.split(F.translate(subject, UPPER, LOWER), "[^a-z0-9]+")), F.array(F.lit("")))


def filed(subjects: DataFrame, rules: list[Rule]) -> list[tuple[str, Rule]]:
    """Each rule with its rarest token; the count is over all rows, of the rules' tokens only."""
    words = sorted({w for r in rules for w in r.tokens})
    seen = subjects.select(F.explode(F.array_intersect(tokens_of(F.col("_s")), F.lit(words))).alias("w")).groupBy("w").count() if words else None
    counts = {r["w"]: r["count"] for r in seen.collect()} if seen is not None else {}
    return [(min(r.tokens, key=lambda w: (counts.get(w, 0), w), default=""), r) for r in rules]


def _best(found: Column) -> Column:
    """Of an array of matching rules the one that decides: site rules first, then the longest, then by text."""
    order = F.transform(found, lambda r: F.struct(r["site"].alias("site"), F.length(r["text"]).alias("n"), r["text"].alias("text"), r["verdict"].alias("verdict")))
    return F.array_max(order)


def url_filter(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict, pattern.

    ``rule`` is the longest fitting site rule or null; then the verdict is that
    of the matching pattern rule (named in ``pattern``), else ``default``.  A null
    URL or one without ``://`` has an empty host and path and the default verdict.
    Ids may be null or repeat; every row is judged by its URL alone.  An empty
    table gives an empty result.  Other columns are ignored.

    Up to ``MAP_RULES`` rules are looked up in a literal map, without any shuffle;
    more are joined, by token, to the distinct subjects.
    """
    rules = SITE_RULES + PATTERN_RULES if rules is None else rules
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    rows = rows.withColumn("_s", F.concat("_host", "_path"))
    index = filed(rows, rules)
    judged = (_by_map if len(rules) <= MAP_RULES else _by_join)(rows, index)
    best, site = F.col("_best"), F.coalesce(F.col("_best.site"), F.lit(False))
    return judged.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.when(site, best["text"]).alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
        F.when(~site, best["text"]).alias("pattern"),
    )


RULE = "array<struct<text:string,verdict:string,regex:string,site:boolean>>"


def _by_map(rows: DataFrame, index: list[tuple[str, Rule]]) -> DataFrame:
    by: dict[str, list[Rule]] = {}
    for word, r in index:
        by.setdefault(word, []).append(r)
    if not by:
        return rows.withColumn("_best", F.lit(None).cast("struct<site:boolean,n:int,text:string,verdict:string>"))
    one = lambda r: F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.site).alias("site"))
    held = F.create_map(*[x for word, rs in by.items() for x in (F.lit(word), F.array(*map(one, rs)))])
    mine = F.array_intersect(tokens_of(F.col("_s")), F.lit(sorted(by)))
    fetched = F.flatten(F.transform(mine, lambda w: F.element_at(held, w)))
    return rows.withColumn("_best", _best(F.filter(fetched, lambda r: F.rlike(F.col("_s"), r["regex"]))))


def _by_join(rows: DataFrame, index: list[tuple[str, Rule]]) -> DataFrame:
    spark = rows.sparkSession
    rules = spark.createDataFrame([(w, r.text, r.verdict, r.regex, r.site) for w, r in index], "_w string, text string, verdict string, regex string, site boolean")
    subjects = rows.select("_s").distinct()
    found = subjects.select("_s", F.explode(tokens_of(F.col("_s"))).alias("_w")).join(rules, "_w").filter(F.rlike("_s", F.col("regex")))
    best = found.groupBy("_s").agg(F.max(F.struct("site", F.length("text").alias("n"), "text", "verdict")).alias("_best"))
    return rows.join(best, "_s", "left")


def oracle(rules: list[Rule] | None = None) -> str:
    rules = SITE_RULES + PATTERN_RULES if rules is None else rules
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = reduce(lambda a, b: a + " UNION ALL " + b, (f"SELECT url, {r.site} AS site, {q(r.text)} AS text, {q(r.verdict)} AS verdict FROM u WHERE regexp_matches(s, {q(r.regex)})" for r in rules))
    return rf"""
WITH u AS (SELECT DISTINCT url, host, path, host || path AS s FROM (SELECT url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)),
f AS ({fits}),
b AS (SELECT url, site, text, verdict FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY site DESC, length(text) DESC, text DESC) = 1)
SELECT p.page_id, u.host, u.path, CASE WHEN b.site THEN b.text END AS rule, coalesce(b.verdict, 'allow') AS verdict,
       CASE WHEN NOT b.site THEN b.text END AS pattern
FROM pages p LEFT JOIN u ON u.url IS NOT DISTINCT FROM p.url LEFT JOIN b ON b.url IS NOT DISTINCT FROM p.url
"""
