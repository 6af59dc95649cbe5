"""Operator 12: URL filters by rules that are indexed by their rarest literal token, with DataFrame functions only.

Two kinds of rules. A host rule, like ``example.net/en/``, fits its host and all subdomains if the url's path begins with
the rule's. A pattern has the syntax of published filter lists: plain text found anywhere, ``*`` any run, ``^`` one
separator (no letter, digit or one of ``_.%-``) or the end, ``||`` in front the beginning of the host or of one of its
labels, ``|`` in front the beginning of the host, ``|`` behind the end; ``@@`` in front makes an exception.

A rule's tokens are the runs of a-z and 0-9 that the rule shows whole, so that each url it fits has them. Tokens are
counted over all urls, and each rule is kept under its rarest one. A url's tokens fetch its candidates, and only those run
their regular expression; rules without a token are candidates of every url. Rules are joined in blocks of about BLOCK,
each broadcast, so that no url is shuffled for it and no hot token meets one task; however many blocks there are, every
rule meets every url that has its token.

Host rules come first, the longest of them; then exceptions; then blocking patterns; ties go by length, longest first, and
then by the rule's text. What nothing fits is allowed.

Defined cases: null urls and urls without ``://`` have an empty host and path, which nothing fits; only A-Z are lower-cased, and
of a path for patterns alone; rows that repeat a url are judged alike; without rules all is allowed; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import table, written

#: Rules in a broadcast.
BLOCK = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"
#: A run that neither touches a wildcard nor an open end (marked like one).
WHOLE = "(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"
SPECIAL = r"[\\.+?(){}\[\]$|]"
LABEL, SEPARATOR = r"^(?:[^/?#]*\.)?", r"(?:[^a-z0-9_.%-]|\z)"

HOSTS = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Hosts that sell, advertise or gamble, and pages without prose.
PATTERNS = [
    "||adult-", "||ads-", "||ads.", "||casino-", "||casino.", "||cheap-", "||free-bets.", "||poker-", "||spam-",
    "/wp-login.php", "/login^", "/signup^", "/cart^", "/checkout^", "/search^*q=", "/tag/*/page/", ".zip|", ".exe|", ".pdf|", "^utm_medium=cpc^", "^gclid=",
    "@@||docs.", "@@/help/",
]


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path, and what patterns see: all behind the scheme, lower-cased."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return lowered(part("(?s)^.*?://([^/?#]*)")), part("(?s)^.*?://[^/?#]*([^?#]*)"), lowered(part("(?s)^.*?://(.*)"))


def compiled(rules: DataFrame) -> DataFrame:
    """rules (kind: host or pattern, action: of host rules, rule) -> rule, action, by_host, place (what it comes after), regex, tokens; each once."""
    host = F.col("kind") == "host"
    core = F.regexp_replace(lowered(F.col("rule")), r"^@@", "")
    open_left, open_right = ~(host | core.startswith("|")), ~(~host & core.endswith("|") & (core != "||"))
    text = F.regexp_replace(F.regexp_replace(core, r"^\|\|?", ""), r"\|\z", "")
    literal = lambda c: F.regexp_replace(c, SPECIAL, r"\\$0")
    # of a host rule only the host is lower-cased, and nothing in it is a wildcard
    at = F.instr(F.col("rule"), "/")
    own = F.when(at > 0, F.concat(lowered(F.expr("substring(rule, 1, instr(rule, '/') - 1)")), F.expr("substring(rule, instr(rule, '/'))"))).otherwise(lowered(F.col("rule")))
    plain = F.regexp_replace(literal(own), r"[*^]", r"\\$0")
    wild = F.replace(F.regexp_replace(literal(text), r"\^", "\u0001"), F.lit("*"), F.lit(".*"))
    front = F.when(core.startswith("||"), LABEL).when(core.startswith("|"), "^").otherwise("")
    pattern = F.concat(front, F.replace(wild, F.lit("\u0001"), F.lit(SEPARATOR)), F.when(open_right, "").otherwise(r"\z"))
    marked = F.concat(F.when(open_left, "*").otherwise(""), F.when(host, F.translate(lowered(F.col("rule")), "*", " ")).otherwise(text), F.when(open_right, "*").otherwise(""))
    action = F.when(host, F.col("action")).when(F.col("rule").startswith("@@"), "allow").otherwise("block")
    return rules.where("rule is not null").select(
        "rule", action.alias("action"), host.alias("by_host"),
        F.when(host, 0).when(action == "allow", 1).otherwise(2).alias("place"),
        F.concat(F.lit("(?s)"), F.when(host, F.concat(F.lit(LABEL), plain)).otherwise(pattern)).alias("regex"),
        F.array_distinct(F.regexp_extract_all(marked, F.lit(WHOLE), F.lit(0))).alias("tokens"),
    ).distinct()


def indexed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Compiled rules -> each with the token it is kept under: the rarest by counts (token, n), unseen ones first; '' if it has none."""
    each = rules.select("*", F.explode_outer("tokens").alias("t"))
    each = each.join(counts, each["t"] == counts["token"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("t")))
    return each.groupBy("rule", "action", "by_host", "place", "regex").agg(F.coalesce(rarest["t"], F.lit("")).alias("under"))


def best(urls: DataFrame, rules: DataFrame, block: int = BLOCK) -> DataFrame:
    """urls (url: distinct, not null; n: rows that have it), rules as ``compiled`` takes them -> url, found (rule, action, by_host) of those that something fits."""
    rules, _ = written(compiled(rules), "rules")
    host, path, rest = parts(F.col("url"))
    split = urls.select("url", "n", F.concat(host, path).alias("plain"), rest.alias("rest"))
    split, _ = written(split.where("plain <> '' or rest <> ''").withColumn("tokens", F.array_distinct(F.regexp_extract_all("rest", F.lit(TOKEN), F.lit(0)))), "urls")
    counts = split.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    index, _ = written(indexed(rules, counts), "index")
    blocks = -(-index.count() // block)
    fits = F.when(F.col("by_host"), F.expr("plain rlike regex")).otherwise(F.expr("rest rlike regex"))
    found = []
    for b in range(blocks):
        some = index.where(F.pmod(F.xxhash64("rule", "place"), F.lit(blocks)) == b)
        each = split.select("url", "plain", "rest", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token"))
        found.append(each.join(F.broadcast(some), F.col("token") == F.col("under")).where(fits).select("url", "place", "rule", "action", "by_host"))
    if not found:
        return urls.limit(0).select("url", F.expr("CAST(NULL AS STRUCT<rule: STRING, action: STRING, by_host: BOOLEAN>)").alias("found"))
    first = F.min(F.struct("place", (-F.length("rule")).alias("longest"), "rule", "action", "by_host"))
    return reduce(DataFrame.unionByName, found).groupBy("url").agg(first.alias("f")).select("url", F.struct("f.rule", "f.action", "f.by_host").alias("found"))


def judged(pages: DataFrame, rules: DataFrame, block: int = BLOCK) -> DataFrame:
    """pages (page_id, url), rules (kind, action, rule) -> page_id, host, path, rule (the host rule's), verdict, pattern (the pattern's, where it decided)."""
    rows = pages.select("page_id", "url")
    hits = best(rows.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n")), rules, block).withColumnRenamed("url", "of")
    host, path, _ = parts(F.col("url"))
    by_host = F.col("found.by_host")
    return rows.join(hits, rows["url"] == hits["of"], "left").select(
        "page_id", host.alias("host"), path.alias("path"), F.when(by_host, F.col("found.rule")).alias("rule"), F.coalesce("found.action", F.lit("allow")).alias("verdict"), F.when(~by_host, F.col("found.rule")).alias("pattern")
    )


def rule_table(spark: SparkSession, hosts: Sequence[tuple[str, str]] = HOSTS, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """kind, action, rule: one row a rule. Longer lists come as a table of these columns."""
    rows = [("host", *h) for h in hosts] + [("pattern", "", p) for p in patterns]
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("action"), F.lit(r).alias("rule")) for k, a, r in rows))
    return spark.range(1).select(F.inline(each)) if rows else spark.range(0).selectExpr("'' AS kind", "'' AS action", "'' AS rule")


def op12_rarest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), rule_table(spark))


def regex_of(kind: str, rule: str) -> str:
    """A rule's regular expression, written plainly (for the SQL and the tests)."""
    if kind == "host":
        host, slash, path = rule.partition("/")
        return "(?s)" + LABEL + re.sub(r"[\\.+?(){}\[\]$|*^]", r"\\\g<0>", host.lower() + slash + path)
    rule = rule.removeprefix("@@").lower()
    front, body = (LABEL, rule[2:]) if rule.startswith("||") else ("^", rule[1:]) if rule.startswith("|") else ("", rule)
    back, body = (r"\z", body[:-1]) if body.endswith("|") else ("", body)
    plain = {"*": ".*", "^": SEPARATOR}
    return "(?s)" + front + "".join(plain.get(c) or re.sub(SPECIAL, r"\\\g<0>", c) for c in body) + back


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(0, a, r, regex_of("host", r)) for a, r in HOSTS] + [(1 if p.startswith("@@") else 2, "allow" if p.startswith("@@") else "block", p, regex_of("pattern", p)) for p in PATTERNS]
    values = ", ".join(f"({p}, {quoted(a)}, {quoted(r)}, {quoted(x)})" for p, a, r, x in rows)
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    part = lambda pattern: f"coalesce(regexp_extract(url, '{pattern}', 1), '')"
    return f"""
WITH rules(place, action, rule, regex) AS (VALUES {values}), urls AS (
  SELECT url, {lower(part('(?s)^.*?://([^/?#]*)'))} AS host, {part('(?s)^.*?://[^/?#]*([^?#]*)')} AS path, {lower(part('(?s)^.*?://(.*)'))} AS rest FROM (SELECT DISTINCT url FROM pages) p
), found AS (
  SELECT url, host, path, first(row(place, rule, action) ORDER BY place, length(rule) DESC, rule) FILTER (WHERE regexp_matches(CASE WHEN place = 0 THEN host || path ELSE rest END, regex) AND url LIKE '%://%') AS f
  FROM urls CROSS JOIN rules GROUP BY url, host, path
)
SELECT page_id, host, path, CASE WHEN f[1] = 0 THEN f[2] END AS rule, coalesce(f[3], 'allow') AS verdict, CASE WHEN f[1] > 0 THEN f[2] END AS pattern
FROM pages p JOIN found f ON p.url IS NOT DISTINCT FROM f.url
"""


ORACLE = _oracle()
