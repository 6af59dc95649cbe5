"""Time and token expressions, and plans that read text in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import mail
from tessera.plans.dialect import SPARK, plan
from tessera.plans.messages import messages
from tessera.plans.signals import display, skeleton
from tessera.plans.texts import canonical

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def i18_strict_object(d):
    """The text is at most 200 characters, a JSON object, and repeats no key (flat objects)."""
    keys = d.each(d.every("s", r'"[^"]*" *:'), d.sub("x", " *:$"))
    valid = "try_parse_json(s) IS NOT NULL" if d.name == "spark" else "json_valid(s)"
    cases = """(VALUES (1, '{"a": 1, "b": 2}'), (2, '{"a": 1, "a": 2}'), (3, '[1]'), (4, 'x'), (5, ''), (6, '{"a":')) AS t(id, s)"""
    return f"""SELECT src, id, coalesce(length(s) BETWEEN 1 AND 200 AND {valid} AND {d.like('s', '^[ ]*[{]')} AND {d.size(d.unique(keys))} = {d.size(keys)}, false) AS accepted FROM
      (SELECT 'case' AS src, CAST(id AS BIGINT) AS id, s FROM {cases} UNION ALL SELECT 'event', event_id, props FROM events) x"""


@query
def token_estimate(d):
    """H31"""
    return f"SELECT source, CAST(sum(greatest(1, CAST(ceil({d.bytes('text')} / 4.0) AS BIGINT))) AS BIGINT) AS tokens FROM documents GROUP BY source"


@query
def i1_utc_stamp(d):
    """Fixed-width stamps sort like instants; the local day of each."""
    return f"SELECT event_id, {d.stamp('ts')} AS stamp, CAST({d.local('ts')} AS DATE) AS local_day FROM events"


@query
def i4_month_bounds(d):
    """I4"""
    stamp = "TIMESTAMP_NTZ" if d.name == "spark" else "TIMESTAMP"
    start = f"CAST(date_trunc('month', {d.local('ts')}) AS {stamp})"
    return f"SELECT {d.month(d.local('ts'))} AS month, {d.utc(start)} AS from_utc, {d.utc(f'CAST({start} + INTERVAL 1 MONTH AS {stamp})')} AS to_utc, count(*) AS n FROM events GROUP BY 1, 2, 3"


@query
def i8_deadline_canonical(d):
    """A date is nine o'clock local; beyond a year it is unknown; a reminder half an hour ahead."""
    stamp = "TIMESTAMP_NTZ" if d.name == "spark" else "TIMESTAMP"
    nine = d.utc(f"(CAST(CAST(o_orderdate AS DATE) AS {stamp}) + INTERVAL 9 HOUR)")
    ahead = d.days(f"{stamp} '2000-01-01 00:00:00'", "o_orderdate")
    return f"SELECT o_orderkey, CASE WHEN {ahead} BETWEEN 0 AND 366 THEN {nine} END AS due, CASE WHEN {ahead} BETWEEN 0 AND 366 AND o_orderpriority = '1-URGENT' THEN {nine} - INTERVAL 30 MINUTE END AS remind FROM orders"


@query
def i11_backoff(d):
    """Of each failure the attempt (failures of the user in a row) and the seconds before the next, online and offline."""
    runs = "(SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)"
    tries = f"(SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, run ORDER BY event_id) AS n FROM {runs} r WHERE event_type = 'error')"
    wait = lambda most: f"CAST(least({most}, 5 * power(2, least(n - 1, 6))) AS BIGINT)"
    return f"SELECT user_id, event_id, n AS attempt, {wait(300)} AS delay, {wait(60)} AS offline FROM {tries} t"


@query
def i19_bounded_slice(d):
    """Distinct words of a turn, sorted, the first five."""
    return f"SELECT conv_id, turn, {d.joined(d.cut(d.unique(d.every('text', '[a-z]+')), 5))} AS words FROM conversations"


def page_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H7: visible text, links (of each text and target the first, in order) and hidden text of pages: lengths and hashes."""
    e = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", mail.page_evidence("html").alias("e")).select("page_id", "e", F.col("e.visible").alias("seen"))
    e = e.select("page_id", "e", F.expr(canonical(SPARK, "seen")).alias("visible"))
    listed = F.array_join(F.transform("e.links", lambda x: F.concat(x["text"], F.lit(" -> "), x["href"])), "\n")
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return e.select("page_id", F.length("visible").cast("long").alias("visible"), F.size("e.links").cast("long").alias("links"), F.length("e.hidden").cast("long").alias("hidden"), sha(F.col("visible")).alias("visible_sha"), sha(listed).alias("links_sha"), sha(F.col("e.hidden")).alias("hidden_sha"))


def _pages(d) -> str:
    """The same of pages whose links hold no tags and that hide nothing but their heads and comments, by patterns."""
    put = lambda s, pattern, to="''": f"regexp_replace({s}, '{pattern}', {to}, 'g')"
    plain = lambda s: put(f"replace(replace(replace({s}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34))", "&amp;?", "'&'")
    s = put(put("html", "(?is)<!--.*?-->|<!doctype[^>]*>"), r"(?is)<head\b[^>]*>.*?</head>")
    s = put(put(s, r"(?i)</?(p|div|br|li|tr|h[1-6]|table|ul|ol|section|article|header|footer|blockquote|pre|hr)\b[^>]*>", "chr(10)"), "(?i)</?[a-z][^>]*>")
    links = f"list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>'), lambda x: {plain(put('x', '<a href=.([^>]*).>([^<]*)</a>', chr(39) + chr(92) + '2 -> ' + chr(92) + '1' + chr(39)))})"
    return f"""SELECT page_id, CAST(length(v) AS BIGINT) AS visible, CAST(len(ls) AS BIGINT) AS links, 0::BIGINT AS hidden, sha256(coalesce(v, '')) AS visible_sha, sha256(coalesce(array_to_string(ls, chr(10)), '')) AS links_sha, sha256('') AS hidden_sha FROM (
      SELECT page_id, {canonical(d, f"nfc_normalize({plain(s)})")} AS v, (list_filter(l, lambda x, i: list_position(l, x) = i))[1:{mail.MOST_LINKS}] AS ls FROM (SELECT page_id, html, {links} AS l FROM pages) a) b"""


def a9_raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of six shapes (plain, HTML, alternatives, an attachment, encoded headers, broken) written raw and parsed back."""
    rows = plan(lambda d: f"SELECT id, sender, subject, body, id % 6 AS shape FROM {messages(d)} m")(spark, sf_dir)
    raw = mail.raw_message("id", "sender", "subject", "body", "shape")
    parsed = rows.select("id", "shape", mail.parse_message(raw).alias("m"))
    parsed = parsed.select("id", "shape", "m.subject", "m.kind", F.col("m.body").alias("raw"), "m.warning")
    return parsed.select("id", "shape", "subject", "kind", F.sha2(F.coalesce(F.expr(canonical(SPARK, "raw")), F.lit("")), 256).alias("body"), "warning")


def h1_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 in full, of whole texts: NFC by batch, the rest as expressions."""
    composed = mail.per_part(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), mail.composed, "text string")
    return composed.select("doc_id", F.sha2(F.expr(canonical(SPARK, "text", None)), 256).alias("canonical"))


def h21_numbered_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered masks of the messages, with their senders' names and the way back."""
    rows = plan(lambda d: f"SELECT id, body, {display(d, 'sender')} AS name FROM {messages(d)} m")(spark, sf_dir)
    masked = mail.per_part(rows.select("id", "body", "name"), mail.numbered_row, "masked string, restored boolean, n long")
    return masked.select("id", F.sha2("masked", 256).alias("masked"), "restored", "n")


def h15_full_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H15 in full, with all marks: of the senders' names."""
    rows = plan(lambda d: f"SELECT id, {display(d, 'sender')} AS name FROM {messages(d)} m")(spark, sf_dir)
    return rows.select("id", mail.skeleton("name").alias("skeleton"))


PLANS = {f.__name__: f for f in (page_text_stats, a9_raw_messages, h1_normal_form, h21_numbered_masks, h15_full_skeleton)}

ORACLES = {
    "page_text_stats": _pages,
    "h15_full_skeleton": lambda d: f"SELECT id, {skeleton(d, display(d, 'sender'))} AS skeleton FROM {messages(d)} m",
    # HTML and broken shapes hold fixed text; the others give the normal form of the body
    "a9_raw_messages": lambda d: f"""SELECT id, shape, trim({d.sub('subject', chr(92) + 's+', ' ')}) AS subject, CASE shape WHEN 1 THEN 'html' WHEN 5 THEN 'none' ELSE 'plain' END AS kind,
      {d.sha(f"CASE shape WHEN 1 THEN concat('Seen ', CAST(id AS VARCHAR)) WHEN 5 THEN '' ELSE {canonical(d, 'nfc_normalize(body)')} END")} AS body, CASE shape WHEN 5 THEN 'empty_body' ELSE '' END AS warning FROM (SELECT id, subject, body, id % 6 AS shape FROM {messages(d)} m) x""",
}
