"""Predicates, joins, aggregates, windows, paging and set operations over message tables.

Messages map to the tables at hand: documents and labels are mails and their labels, events the usage and
attempt logs, orders the money ledger, lineitem the actions, conversations the threads. Instants that a
query compares with are constants, never the clock.
"""

from __future__ import annotations

NOW = "TIMESTAMP_NTZ '2001-08-01 00:00:00'"
TOKENS = "CAST(round(value) AS BIGINT)"
AMOUNT = "CAST(round(o_totalprice * 100) AS BIGINT)"
QUERIES = {}


def now(d) -> str:
    return NOW if d.name == "spark" else NOW.replace("_NTZ", "")


def query(f):
    QUERIES[f.__name__] = f
    return f


def latest(d, table: str, key: str, order: str, cols: str = "*") -> str:
    return f"(SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {table}) ranked WHERE rn = 1)"


@query
def latest_event_per_user(d):
    """E1"""
    return f"SELECT user_id, event_id, event_type, ts FROM {latest(d, 'events', 'user_id', 'ts DESC, event_id DESC')} x"


TYPES = ("click", "view", "error", "purchase", "signup", "refund")


@query
def status_counts_zero_filled(d):
    """Of every user every status of the dictionary, the absent ones with 0, in one pass."""
    counts = d.array(*(f"concat('{t}:', CAST(count_if(event_type = '{t}') AS STRING))" for t in TYPES))
    rows = d.exploded(f"(SELECT user_id, {counts} AS cs FROM events GROUP BY user_id)", "user_id", "cs", "c", "at_type")
    return f"SELECT user_id, {d.part(d.split('c', ':'), 1)} AS event_type, CAST({d.part(d.split('c', ':'), 2)} AS BIGINT) AS n FROM {rows} r"


@query
def usage_breakdown_sets(d):
    """D3"""
    return f"""SELECT event_type, user_id, count(*) AS events, CAST(sum({TOKENS}) AS BIGINT) AS tokens, count(*) - count(value) AS unknown
      FROM events GROUP BY GROUPING SETS ((event_type), (user_id), (event_type, user_id), ())"""


@query
def usage_totals_billed_local(d):
    """D4"""
    return f"""SELECT user_id, CAST(sum({TOKENS}) AS BIGINT) AS tokens, CAST(coalesce(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN {TOKENS} END), 0) AS BIGINT) AS billed,
      CAST(coalesce(sum(CASE WHEN event_type NOT IN ('purchase', 'signup') THEN {TOKENS} END), 0) AS BIGINT) AS local FROM events GROUP BY user_id"""


@query
def usage_daily_trend_local(d):
    """A row for each local day, empty ones included."""
    return f"""SELECT CAST(day AS DATE) AS day, CAST(coalesce(n, 0) AS BIGINT) AS events, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens
      FROM (SELECT {d.spread("DATE '2023-12-25'", "DATE '2024-02-10'", "1 DAY")} AS day) s LEFT JOIN
      (SELECT CAST({d.local('ts')} AS DATE) AS local_day, count(*) AS n, sum({TOKENS}) AS tokens FROM events WHERE event_type <> 'view' GROUP BY 1) f ON CAST(s.day AS DATE) = f.local_day"""


@query
def usage_week_window(d):
    """Totals by local week, Monday first, with its bounds in UTC."""
    week = f"date_trunc('week', {d.local('ts')})"
    stamp = "TIMESTAMP_NTZ" if d.name == "spark" else "TIMESTAMP"
    return f"""SELECT CAST(week AS DATE) AS week, {d.utc(f'CAST(week AS {stamp})')} AS starts_at, n, tokens FROM
      (SELECT {week} AS week, count(*) AS n, CAST(sum({TOKENS}) AS BIGINT) AS tokens FROM events GROUP BY 1) x"""


@query
def dashboard_totals(d):
    """NULL-aware counts of corrected and confirmed."""
    return """SELECT count(*) AS total, CAST(sum(CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS labelled,
      CAST(sum(CASE WHEN l.quality IS NOT NULL AND l.quality <> g.guess THEN 1 ELSE 0 END) AS BIGINT) AS corrected,
      CAST(sum(CASE WHEN l.quality IS NOT NULL AND l.quality = g.guess THEN 1 ELSE 0 END) AS BIGINT) AS confirmed
      FROM (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 1 WHEN n_chars > 300 THEN 0 END AS guess FROM documents) g LEFT JOIN labels l ON l.doc_id = g.doc_id"""


@query
def bounded_mean_latest50(d):
    """Malformed numbers don't count; NULL without samples."""
    return f"""SELECT event_type, round(avg(k), 6) AS mean_k, count(k) AS samples FROM (SELECT event_type, {d.try_cast(d.json('props', '$.k'), 'DOUBLE')} AS k,
      row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn <= 50 AND (k IS NULL OR k >= 0) GROUP BY event_type"""


@query
def provider_limited_flag(d):
    """Limited when the newest three attempts all failed with a code of the list (errors stand for them) within fifteen minutes, and when the first may be tried again."""
    return f"""SELECT user_id, count(*) = 3 AND bool_and(event_type IN ('error', 'signup')) AND max(ts) <= min(ts) + INTERVAL 15 MINUTE AS limited, max(ts) AS newest, min(ts) + INTERVAL 15 MINUTE AS next_retry
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn <= 3 GROUP BY user_id"""


@query
def leading_failure_run(d):
    """Newest rows until the first that is no failure."""
    return """SELECT user_id, CAST(coalesce(min(CASE WHEN event_type NOT IN ('error', 'view') THEN rn END), count(*) + 1) - 1 AS BIGINT) AS run
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x GROUP BY user_id"""


LEDGER = f"""(SELECT o_orderkey, o_custkey, n_name AS currency, CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'bill' ELSE 'refund' END AS kind,
  {AMOUNT} AS amount, CAST(o_orderdate AS DATE) AS day, c_name AS merchant FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query
def ledger_totals(d):
    """Bills are no spending; integers only."""
    part = lambda k: f"CAST(coalesce(sum(CASE WHEN kind = '{k}' THEN amount END), 0) AS BIGINT)"
    return f"SELECT currency, count(*) AS n, {part('purchase')} AS spent, {part('refund')} AS refunds, {part('bill')} AS bills, {part('purchase')} - {part('refund')} AS net FROM {LEDGER} l GROUP BY currency"


@query
def ledger_trailing_12m(d):
    """D7"""
    return f"""SELECT {d.month('m')} AS month, CAST(coalesce(spent, 0) AS BIGINT) AS spent FROM (SELECT {d.spread("DATE '2000-09-01'", "DATE '2001-08-01'", "1 MONTH")} AS m) s
      LEFT JOIN (SELECT {d.month('day')} AS of, sum(amount) AS spent FROM {LEDGER} l WHERE kind = 'purchase' GROUP BY 1) f ON f.of = {d.month('s.m')}"""


@query
def primary_currency_mode(d):
    """Ties by name."""
    return f"SELECT currency, n FROM (SELECT currency, count(*) AS n FROM {LEDGER} l GROUP BY currency) x ORDER BY n DESC, currency LIMIT 1"


@query
def top_merchants(d):
    """D9"""
    return f"SELECT merchant, spent FROM (SELECT merchant, CAST(sum(amount) AS BIGINT) AS spent FROM {LEDGER} l WHERE kind = 'purchase' GROUP BY merchant) x ORDER BY spent DESC, merchant LIMIT 10"


GAPS = """(SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"""


@query
def charge_gaps(d):
    """E2"""
    return f"SELECT o_custkey, o_orderkey, {d.days('before', 'o_orderdate')} AS gap FROM {GAPS} g"


def recurring(d) -> str:
    gap = d.days("before", "o_orderdate")
    return f"""(SELECT o_custkey, max(o_orderdate) AS last_at, {d.argmax(AMOUNT, 'o_orderkey')} AS amount, bool_and({gap} BETWEEN 60 AND 120) AND count(before) = 2 AS monthly
      FROM {GAPS} g WHERE rn <= 2 GROUP BY o_custkey)"""


@query
def recurring_customers(d):
    """The last two gaps lie in the band."""
    return f"SELECT o_custkey, last_at, amount FROM {recurring(d)} r WHERE monthly"


@query
def renewal_roll_forward(d):
    """The next renewal in closed form, the amount by month half-even."""
    gap = d.days("last_at", now(d))
    steps = f"greatest(1, CAST(ceil({gap} / 90.0) AS INT))"
    due = f"date_add(CAST(last_at AS DATE), 90 * {steps})" if d.name == "spark" else f"CAST(CAST(last_at AS DATE) + CAST(90 * {steps} AS INTEGER) AS DATE)"
    return f"SELECT o_custkey, {due} AS renews_on, CAST({d.bround('CAST(amount AS DOUBLE) / 3', 0)} AS BIGINT) AS monthly FROM {recurring(d)} r"


@query
def overlap_insights(d):
    """E7"""
    return f"""SELECT p_type, p_brand, count(*) AS parts, {d.listed('p_name')} AS names, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS total
      FROM part GROUP BY p_type, p_brand HAVING count(*) >= 2"""


@query
def trusted_suppliers(d):
    """Two good rows or more and no bad one, or labelled good."""
    return """SELECT l_suppkey FROM lineitem GROUP BY l_suppkey
      HAVING (count_if(l_returnflag = 'A' AND l_quantity > 25) >= 2 AND count_if(l_discount > 0.095 AND l_quantity > 49) = 0) OR max(l_quantity) FILTER (WHERE l_linenumber = 7) >= 50"""


ATTEMPT = "(SELECT user_id, event_id, CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS category FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) e WHERE rn = 1)"


@query
def effective_category(d):
    """A latest attempt hides the stored prediction even if it is NULL; the ledger's plain coalesce beside it."""
    return f"""SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN CAST(l.quality AS STRING) WHEN a.event_id IS NOT NULL THEN a.category ELSE d.lang END AS effective,
      coalesce(CAST(l.quality AS STRING), d.lang) AS plain FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN {ATTEMPT} a ON a.user_id = d.doc_id"""


@query
def needs_review(d):
    """Documents without a category, with the reason."""
    return f"""SELECT d.doc_id, CASE WHEN a.event_id IS NOT NULL THEN 'the last attempt failed' WHEN d.n_chars < 100 THEN 'too short' ELSE 'not classified' END AS reason
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN {ATTEMPT} a ON a.user_id = d.doc_id WHERE l.quality IS NULL AND a.category IS NULL"""


@query
def unscored_backlog(d):
    """Neither labelled nor embedded, newest first."""
    return "SELECT d.doc_id, d.n_chars FROM documents d LEFT ANTI JOIN labels l ON l.doc_id = d.doc_id LEFT ANTI JOIN embeddings e ON e.vec_id = d.doc_id ORDER BY d.doc_id DESC LIMIT 20".replace("LEFT ANTI", "LEFT ANTI" if d.name == "spark" else "ANTI")


@query
def c4_due_scans(d):
    """C4: never scanned, scanned by an older version, or a retry that is due."""
    return """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.quality = 0 OR (l.toxic = 1 AND d.n_chars <= 2000) ORDER BY d.doc_id DESC LIMIT 50"""


@query
def backfill_eligible(d):
    """EXISTS and NOT EXISTS under OR."""
    return """SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
      OR (o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'))"""


@query
def rescore_needed(d):
    """C6"""
    return """SELECT o_orderkey, o_orderstatus FROM orders o WHERE o_orderpriority = '1-URGENT' AND
      (o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 45))"""


@query
def c7_join_latest(d):
    """Rows of the latest attempt joined back, with a nested size test."""
    arr = "concat('[', CASE WHEN event_type = 'view' THEN '' ELSE '1,2' END, ']')"
    return f"""SELECT e.user_id, e.event_id, {d.json_size(arr)} AS size FROM events e JOIN (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id) x
      ON x.user_id = e.user_id AND x.m = e.event_id WHERE {d.json_size(arr)} > 0"""


@query
def current_revision_pending(d):
    """C10"""
    return "SELECT user_id, event_type, event_id FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id, event_type) AS m FROM events) x WHERE event_id = m AND value > 5"


@query
def first_source_provenance(d):
    """C11"""
    return f"SELECT user_id, {d.argmin('event_type', 'event_id')} AS source FROM events WHERE event_type <> 'view' GROUP BY user_id"


@query
def action_page(d):
    """Half-open due range, open ends last, then of the page's actions the counts and the next dates."""
    page = f"""(SELECT o_orderkey, due FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS due FROM orders) x WHERE due IS NULL OR (due >= {now(d)} - INTERVAL 20 DAY AND due < {now(d)})
      ORDER BY due ASC NULLS LAST, o_orderkey LIMIT 60)"""
    return f"SELECT p.o_orderkey, p.due, count(l.l_orderkey) AS reminders, min(l.l_shipdate) AS next_at FROM {page} p LEFT JOIN lineitem l ON l.l_orderkey = p.o_orderkey GROUP BY p.o_orderkey, p.due"


@query
def action_summary(d):
    """Overdue is before now, due soon within seven days."""
    return f"""SELECT l_linestatus AS status, count(*) AS n, CAST(count_if(l_shipdate < {now(d)}) AS BIGINT) AS overdue, CAST(count_if(l_shipdate >= {now(d)} AND l_shipdate < {now(d)} + INTERVAL 7 DAY) AS BIGINT) AS due_soon
      FROM lineitem GROUP BY l_linestatus"""


@query
def priority_queue(d):
    """F3, F5"""
    return """SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END,
      o_orderdate DESC, o_orderkey LIMIT 50"""


@query
def page_with_total(d):
    """a page and the number of rows under the same predicate."""
    return """SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en') AS total, (SELECT count(*) FROM documents WHERE lang = 'en') > 60 AS has_more
      FROM (SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40) p"""


@query
def literal_search(d):
    """B2, B1: wildcards are text; every account's own documents, in one scan."""
    return f"SELECT account, doc_id, word, under FROM (SELECT source AS account, doc_id, {d.has('lower(text)', "lower('The ')")} AS word, {d.has('text', "'_'")} AS under FROM documents) x WHERE word OR under"


@query
def capped_sections(d):
    """Candidates of three kinds, five each, in a fixed order."""
    return f"""SELECT kind, id, happened FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY happened DESC, id) AS rn FROM (
      SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS happened FROM orders UNION ALL SELECT 'item', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem UNION ALL SELECT 'event', event_id, ts FROM events) u) r WHERE rn <= 5"""


@query
def missing_ids(d):
    """G3, A4"""
    return "SELECT doc_id FROM documents WHERE n_chars < 3000 EXCEPT SELECT doc_id FROM labels"


@query
def leakage_check(d):
    """Normalised texts that occur with both labels or in both splits."""
    key = d.sub("lower(trim(text))", r"\s+", " ")
    return f"""SELECT key_hash, count(*) AS n, count(DISTINCT split) AS splits, min(doc_id) AS keeps FROM (SELECT doc_id, {d.sha(key)} AS key_hash, doc_id % 2 AS split FROM documents) x GROUP BY key_hash HAVING count(*) > 1"""


@query
def confusion_matrix(d):
    """Truth by guess, with ABSTAIN."""
    return """SELECT CAST(truth AS STRING) AS truth, CAST(count_if(guess = 1) AS BIGINT) AS guess_1, CAST(count_if(guess = 0) AS BIGINT) AS guess_0, CAST(count_if(guess IS NULL) AS BIGINT) AS abstain FROM
      (SELECT l.quality AS truth, CASE WHEN d.n_chars > 900 THEN 1 WHEN d.n_chars > 200 THEN 0 END AS guess FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x GROUP BY truth"""


GUESS = "(SELECT d.doc_id, l.quality AS truth, CASE WHEN d.n_chars > 900 THEN 1 WHEN d.n_chars > 200 THEN 0 END AS guess, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS after FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query
def class_metrics(d):
    """Zero division is 0; coverage counts abstentions."""
    return f"""SELECT class, tp, round(CASE WHEN said = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / said END, 6) AS prec, round(CASE WHEN there = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / there END, 6) AS recall,
      round(CASE WHEN said + there = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (said + there) END, 6) AS f1, round(coverage, 6) AS coverage FROM
      (SELECT c.class, CAST(count_if(truth = c.class AND guess = c.class) AS BIGINT) AS tp, CAST(count_if(guess = c.class) AS BIGINT) AS said, CAST(count_if(truth = c.class) AS BIGINT) AS there,
      CAST(count(guess) AS DOUBLE) / count(*) AS coverage FROM {GUESS} g CROSS JOIN (VALUES (0), (1), (2)) AS c(class) GROUP BY c.class) m"""


@query
def regressions(d):
    """Joined by key, never by position."""
    return f"SELECT doc_id, CASE WHEN guess = truth THEN 'regressed' ELSE 'improved' END AS change FROM {GUESS} g WHERE guess IS NOT NULL AND (guess = truth) <> (after = truth)"


@query
def latency_percentiles(d):
    """Nearest rank beside the floor index. Values are counted within slices of their range, whose sums tell the slices that hold a rank; only rows of those are ranked."""
    ends = "(SELECT event_type AS kind, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)"
    sliced = f"(SELECT event_type, value, n, CASE WHEN hi > lo THEN CAST(floor((value - lo) / (hi - lo) * 1023) AS BIGINT) ELSE 0 END AS slice FROM events JOIN {ends} e ON event_type = kind WHERE value IS NOT NULL)"
    sums = f"(SELECT event_type, slice, n, count(*) AS c FROM {sliced} a GROUP BY event_type, slice, n)"
    upto = f"(SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY slice) AS upto FROM {sums} b)"
    ranks = ("ceil(0.5 * n)", "ceil(0.95 * n)", "greatest(1, floor(0.95 * n))", "floor((n + 1) / 2.0)", "ceil((n + 1) / 2.0)")
    holds = " OR ".join(f"{r} BETWEEN upto - c + 1 AND upto" for r in ranks)
    held = f"(SELECT event_type AS kind, slice AS at_slice, upto - c AS before FROM {upto} c WHERE {holds})"
    ranked = f"(SELECT event_type, value, n, before + row_number() OVER (PARTITION BY event_type, slice ORDER BY value) AS place FROM {sliced} s JOIN {held} h ON event_type = kind AND slice = at_slice)"
    at = lambda k: f"min(CASE WHEN place >= {ranks[k]} THEN value END)"
    return f"SELECT event_type, {at(0)} AS p50, {at(1)} AS p95_nearest, {at(2)} AS p95_floor, round(({at(3)} + {at(4)}) / 2, 6) AS median FROM {ranked} r GROUP BY event_type"


@query
def thread_state(d):
    """Who spoke last, and how long the user has waited."""
    return f"""SELECT conv_id, CASE WHEN role = 'user' THEN 'waiting' ELSE 'replied' END AS state, turn AS last_turn, CASE WHEN role = 'user' THEN greatest(0, 10 - turn) END AS days_waiting
      FROM {latest(d, 'conversations', 'conv_id', 'turn DESC, role, text')} x"""


@query
def dedupe_fingerprint(d):
    """One row for each fingerprint of a source."""
    return f"SELECT source, fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, source, {d.sha('concat(source, chr(31), text)')} AS fingerprint FROM documents) x GROUP BY source, fingerprint"


@query
def coalescing_upsert(d):
    """The last value that isn't NULL, and when the key was first seen."""
    return f"""SELECT user_id, {d.argmax('value', 'CASE WHEN value > 3 THEN event_id END')} AS last_value, min(ts) AS created_at, max(ts) AS updated_at FROM (SELECT user_id, event_id, ts, value FROM events WHERE value > 3) x GROUP BY user_id"""


@query
def constraint_violations(d):
    """All rules in one pass."""
    rules = {"amount": "o_totalprice > 0 AND o_totalprice < 100000000", "status": "o_orderstatus IN ('F', 'O')", "priority": "length(o_orderpriority) <= 10", "window": "o_orderdate < " + now(d)}
    counts = d.array(*(f"concat('{k}:', CAST(count_if(NOT ({v})) AS STRING))" for k, v in rules.items()))
    rows = d.exploded(f"(SELECT {counts} AS cs FROM orders)", "1 AS one", "cs", "c", "at_rule")
    return f"SELECT {d.part(d.split('c', ':'), 1)} AS rule, CAST({d.part(d.split('c', ':'), 2)} AS BIGINT) AS violations FROM {rows} r"


@query
def a3_point_fetch(d):
    """A3: found and missing keys apart."""
    return "SELECT k.id, d.doc_id IS NOT NULL AS found, d.n_chars FROM (VALUES (1), (5), (77777777), (12)) AS k(id) LEFT JOIN documents d ON d.doc_id = k.id"


@query
def a4_recent_window(d):
    """A4: the last two days of the table, without what was saved."""
    return "SELECT e.event_id FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id WHERE e.ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY AND l.doc_id IS NULL"


@query
def a5_pruned_scan(d):
    """A5, A11"""
    return "SELECT doc_id, lang, source FROM documents"


@query
def a6_thread_read(d):
    """A6"""
    return "SELECT turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn"


@query
def b7_status_in(d):
    """Due retries whose backoff has passed."""
    return f"""SELECT o_orderkey, attempt, least(300, 5 * CAST(power(2, least(greatest(attempt - 1, 0), 6)) AS BIGINT)) AS backoff FROM (SELECT *, o_orderkey % 10 AS attempt FROM orders) x
      WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= {now(d)} AND (attempt = 0 OR o_orderkey % 400 >= least(300, 5 * CAST(power(2, least(greatest(attempt - 1, 0), 6)) AS BIGINT)))"""


@query
def b10_type_repair(d):
    """What is no number becomes 0."""
    raw = "CASE WHEN event_id % 7 = 0 THEN 'soon' ELSE CAST(event_id AS STRING) END"
    return f"SELECT event_id, coalesce({d.try_cast(raw, 'DOUBLE')}, 0) AS next_retry FROM events"


@query
def b11_public_projection(d):
    """An allow-list, integers to booleans, JSON to columns."""
    return f"SELECT event_id, event_type, value > 5 AS large, {d.try_cast(d.json('props', '$.k'), 'BIGINT')} AS k FROM events"


@query
def b12_preview(d):
    """B12"""
    return "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS preview FROM documents"


@query
def b13_dynamic_where(d):
    """One predicate for page and count."""
    where = f"currency = 'NATION_3' AND kind = 'purchase' AND {d.month('day')} = '1998-05'"
    return f"SELECT o_orderkey, amount, (SELECT count(*) FROM {LEDGER} a WHERE {where}) AS total FROM {LEDGER} b WHERE {where} ORDER BY day DESC, o_orderkey LIMIT 10"


@query
def c2_membership_flag(d):
    """C2"""
    return f"SELECT d.doc_id, {d.boolint('l.doc_id IS NOT NULL')} AS in_backfill FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@query
def c12_hydrate_in_order(d):
    """Ranked ids keep their order, the missing drop out."""
    return "SELECT r.pos, d.doc_id, d.lang FROM (VALUES (0, 40), (1, 7), (2, 99999999), (3, 12)) AS r(pos, id) JOIN documents d ON d.doc_id = r.id ORDER BY r.pos"


@query
def c13_lookup_all_resolve(d):
    """A sentence stands only if all its references resolve."""
    return "SELECT s.id, bool_and(d.doc_id IS NOT NULL) AS stands, count(*) AS refs FROM (VALUES ('a', 1), ('a', 2), ('b', 3), ('b', 88888888)) AS s(id, ref) LEFT JOIN documents d ON d.doc_id = s.ref GROUP BY s.id"


@query
def c14_containment_match(d):
    """C14: equal, or one holds the other; the small side is a dictionary."""
    return f"SELECT p_partkey, g.gold FROM part JOIN (VALUES ('ring'), ('small ring'), ('large bolt of steel')) AS g(gold) ON {d.has('p_name', 'g.gold')} OR {d.has('g.gold', 'p_name')}"


@query
def c17_key_set_guard(d):
    """C17"""
    return "SELECT count_if(a.doc_id IS NULL) = 0 AND count_if(b.doc_id IS NULL) = 0 AS equal_sets, CAST(count_if(b.doc_id IS NULL) AS BIGINT) AS only_left FROM (SELECT DISTINCT doc_id FROM documents) a FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id"


@query
def d11_band_summary(d):
    """D11"""
    return """SELECT CAST(count_if(n_chars >= 5000) AS BIGINT) AS high, CAST(count_if(n_chars >= 1000 AND n_chars < 5000) AS BIGINT) AS medium, CAST(count_if(n_chars < 1000) AS BIGINT) AS low,
      greatest(0, (SELECT count(*) FROM orders) - count(*)) AS unscored FROM documents"""


@query
def d20_detection_metrics(d):
    """Empty denominators are 1 for precision and recall, 0 for the false positive rate."""
    return f"""SELECT t.threshold, CAST(count_if(s >= t.threshold AND toxic = 1) AS BIGINT) AS tp, CAST(count_if(s >= t.threshold AND toxic = 0) AS BIGINT) AS fp,
      round(CASE WHEN count_if(s >= t.threshold) = 0 THEN 1 ELSE CAST(count_if(s >= t.threshold AND toxic = 1) AS DOUBLE) / count_if(s >= t.threshold) END, 6) AS prec,
      round(CASE WHEN count_if(toxic = 0) = 0 THEN 0 ELSE CAST(count_if(s >= t.threshold AND toxic = 0) AS DOUBLE) / count_if(toxic = 0) END, 6) AS fpr
      FROM (SELECT l.toxic, d.n_chars % 100 AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x CROSS JOIN (VALUES (40), (70), (1000)) AS t(threshold) GROUP BY t.threshold"""


@query
def d21_extraction_score(d):
    """D21"""
    return f"""SELECT CAST(count_if(guess = 1 AND truth = 1) AS BIGINT) AS tp, CAST(count_if(guess = 1 AND truth = 0) AS BIGINT) AS fp, CAST(count_if((guess IS NULL OR guess = 0) AND truth = 1) AS BIGINT) AS fn,
      CAST(count_if(guess = truth AND after = truth) AS BIGINT) AS both_right FROM {GUESS} g"""


@query
def d22_set_scores(d):
    """Detected names of each brand against gold names, which match if one holds the other."""
    gold = "(VALUES ('ring'), ('bolt'), ('small'), ('nothing')) AS b(g)"
    rows = f"SELECT p_brand, f, g, {d.has('f', 'g')} OR {d.has('g', 'f')} AS hit FROM (SELECT DISTINCT p_brand, p_name AS f FROM part) a CROSS JOIN {gold}"
    share = lambda x: f"round(CAST(count(DISTINCT CASE WHEN hit THEN {x} END) AS DOUBLE) / count(DISTINCT {x}), 6)"
    return f"SELECT p_brand, {share('f')} AS prec, {share('g')} AS recall FROM ({rows}) x GROUP BY p_brand"


@query
def d26_firing_counts(d):
    """D26"""
    return "SELECT signal, quality, count(*) AS n FROM (SELECT quality, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS signal FROM documents d JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT quality, lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id) x GROUP BY signal, quality"


@query
def d27_first_route(d):
    """How many messages each route answers."""
    return f"SELECT route, count(*) AS n, CAST(sum(passed) AS BIGINT) AS passed FROM ({m13_route_failover(d)}) x GROUP BY route"


@query
def d28_diagnostics(d):
    """D28"""
    return "SELECT o_orderstatus, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, 'none') AS error, count(*) AS n FROM orders GROUP BY 1, 2"


@query
def e10_first_seen(d):
    """E10"""
    return "SELECT user_id, first_pos FROM (SELECT user_id, min(event_id) AS first_pos FROM events GROUP BY user_id) x ORDER BY first_pos LIMIT 900"


@query
def e11_running_budget(d):
    """E11"""
    return f"SELECT user_id, event_id, used FROM (SELECT user_id, event_id, CAST(sum({TOKENS}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM events) x WHERE used <= 100"


@query
def e12_duplicate_of(d):
    """E12"""
    return f"SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS keeps, count(*) OVER (PARTITION BY key) AS copies FROM (SELECT doc_id, {d.sha('lower(trim(text))')} AS key FROM documents) x"


@query
def f5_boolean_order(d):
    """F5"""
    return "SELECT doc_id FROM documents ORDER BY (lang = 'de') DESC, (source = 'src1') ASC, doc_id LIMIT 30"


@query
def f11_threshold_grid(d):
    """the best of a grid by a composite objective."""
    return f"""SELECT low, high, score FROM (SELECT g.low, h.high, CAST(count_if(CASE WHEN n >= h.high THEN 1 WHEN n < g.low THEN 0 END = truth) - 2 * count_if(n < g.low AND truth = 1) AS BIGINT) AS score
      FROM (SELECT l.quality AS truth, d.n_chars AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x CROSS JOIN (VALUES (20), (50), (100), (200), (400), (800), (900)) AS g(low) CROSS JOIN (VALUES (900), (1500), (2500), (4000), (8000)) AS h(high) GROUP BY g.low, h.high) y
      ORDER BY score DESC, low, high LIMIT 1"""


@query
def f14_excess_trim(d):
    """of each queue (priority and shard) the oldest beyond the newest two go."""
    return "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 64 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'O') x WHERE rn > 2"


@query
def g2_exclusion_union(d):
    """G2"""
    return "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 100"


@query
def m3_idempotent_ingest(d):
    """A batch replayed twice adds nothing."""
    return "SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM (SELECT event_id, user_id FROM events UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 3 = 0) u) x GROUP BY event_id"


@query
def m6_capacity_admission(d):
    """M6: the newest that the free room takes: a hundred less what is at work, forty at most."""
    return "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rn FROM (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id DESC LIMIT 40) newest) x WHERE rn <= greatest(0, 100 - (SELECT count(*) FROM labels WHERE toxic = 1 AND quality = 0))"


@query
def m7_snooze_expiry(d):
    """M7"""
    return f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate <= {now(d)} - INTERVAL 1000 DAY THEN 'O' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderdate <= {now(d)} - INTERVAL 1000 DAY THEN 2 ELSE 1 END AS revision FROM orders"


@query
def m16_heartbeat(d):
    """M16"""
    return f"SELECT user_id, max(ts) AS beat, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR AS stale FROM events GROUP BY user_id"


@query
def n4_revisions(d):
    """NULL is a withdrawal and stays the current value."""
    return f"SELECT user_id, event_id AS revision, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS label FROM {latest(d, 'events', 'user_id', 'event_id DESC')} x"


@query
def n7_purge(d):
    """An account's messages go, and with them what other tables hold of them; what stays, by table."""
    tables = (("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id"), ("events", "event_id"))
    rows = " UNION ALL ".join(f"SELECT '{t}' AS tbl, CAST({k} AS BIGINT) AS id FROM {t} WHERE {k} IS NOT NULL" for t, k in tables)
    # one anti join of all tables' rows; the side that goes is as large as the account
    return f"SELECT tbl, id FROM ({rows}) r WHERE NOT EXISTS (SELECT 1 FROM documents g WHERE g.source = 'src3' AND g.doc_id = r.id)"


@query
def n9_candidate_counters(d):
    """N9"""
    return "SELECT CAST(count_if(fresh AND ok) AS BIGINT) AS created, CAST(count_if(ok) AS BIGINT) AS accepted, CAST(count_if(NOT ok) AS BIGINT) AS rejected FROM (SELECT row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) = 1 AS fresh, l_quantity >= 5 AS ok FROM lineitem) x"


@query
def n10_requeue(d):
    """N10"""
    return "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'F') AND o_orderpriority <> '5-LOW' THEN 'O' ELSE o_orderstatus END AS status FROM orders"


@query
def n11_group_split(d):
    """Whole groups, by hash."""
    return f"SELECT doc_id, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, {d.bucket('concat(lang, source)', 100)} AS b FROM documents) x"


@query
def n12_personal_subset(d):
    """N12"""
    return f"SELECT label, grp FROM (SELECT label, grp, row_number() OVER (PARTITION BY label ORDER BY {d.sha('concat(CAST(grp AS STRING), chr(31), CAST(label AS STRING))')}) AS rn FROM (SELECT DISTINCT label, vec_id % 40 AS grp FROM embeddings) g) x WHERE rn <= 3"


@query
def k9_ledger_upsert(d):
    """K9: user corrections survive an update."""
    return f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS id, CASE WHEN a.o_orderkey % 5 = 0 THEN a.amount ELSE coalesce(b.amount, a.amount) END AS amount, CASE WHEN b.o_orderkey IS NULL OR a.o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS revision
      FROM (SELECT o_orderkey, {AMOUNT} AS amount FROM orders WHERE o_orderkey % 3 <> 0) a FULL OUTER JOIN (SELECT o_orderkey, {AMOUNT} + 1 AS amount FROM orders WHERE o_orderkey % 4 <> 1) b ON a.o_orderkey = b.o_orderkey"""


@query
def k12_optimistic_correction(d):
    """Only the expected revision is corrected."""
    return "SELECT o.o_orderkey, c.expected = o.o_orderkey % 3 AS applied, CASE WHEN c.expected = o.o_orderkey % 3 THEN c.status ELSE o.o_orderstatus END AS status FROM orders o JOIN (VALUES (1, 1, 'F'), (2, 1, 'O'), (3, 0, 'P')) AS c(id, expected, status) ON c.id = o.o_orderkey"


@query
def k11_subscription_window(d):
    """K11"""
    return f"SELECT o_custkey, last_at FROM {recurring(d)} r WHERE last_at >= {now(d)} - INTERVAL 400 DAY AND {d.days('last_at', now(d))} - 90 <= 45"


@query
def a2_listing_page(d):
    """A2: pages of twenty of the newest messages that aren't on the skip list, each with the token of the next; five pages at most; a token that comes again ends the listing."""
    newest = "(SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id DESC LIMIT 101)"
    paged = f"(SELECT doc_id, n_chars, CAST(floor((row_number() OVER (ORDER BY doc_id DESC) - 1) / 20) AS BIGINT) AS page FROM {newest} n)"
    return f"SELECT doc_id, n_chars, page, CASE WHEN page < 4 AND EXISTS (SELECT 1 FROM {paged} q WHERE q.page = p.page + 1) THEN CAST(min(doc_id) OVER (PARTITION BY page) AS STRING) END AS next_token FROM {paged} p WHERE page < 5"


def chosen(d) -> str:
    """event_id, route, passed: the first of two routes that is up and answers. Recorded answers follow from message and route."""
    code = "CASE (event_id * 7 + route * 13) % 10 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 401 ELSE 200 END"
    tried = f"(SELECT event_id, user_id, ts, route, {code} AS code FROM events CROSS JOIN (VALUES (0), (1)) AS r(route))"
    rested = f"(SELECT *, max(CASE WHEN code = 429 THEN ts END) OVER (PARTITION BY user_id, route ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS throttled FROM {tried} t)"
    up = f"SELECT event_id, min(route) AS r FROM {rested} x WHERE code = 200 AND (throttled IS NULL OR ts >= throttled + INTERVAL 10 MINUTE) GROUP BY event_id"
    return f"(SELECT event_id, CASE r WHEN 0 THEN 'fallback' ELSE 'second' END AS route, CAST(r AS BIGINT) AS passed FROM ({up}) u)"


@query
def m13_route_failover(d):
    """Per message the first route that isn't cooling down and answers; a route that throttled a user rests ten minutes for them; the local route always answers."""
    return f"SELECT event_id, CASE WHEN c.event_id IS NULL THEN 'local' ELSE c.route END AS route, coalesce(c.passed, 2) AS passed FROM (SELECT event_id FROM events) e LEFT JOIN {chosen(d)} c USING (event_id)".replace("c.event_id IS NULL", "c.route IS NULL")


@query
def o11_redteam_layers(d):
    """Of each family of attacks (the messages' turns) how many do harm with no layer, with the rules alone, with the masks alone and with both. An attack lures and leaves the reader something to act on (a link, an address, a number); the rules stop those they find high, the masks those whose reader is left nothing."""
    from tessera.plans import signals
    from tessera.plans.messages import CASES, messages
    from tessera.plans.money import redacted_rows

    lure, act = r"(?i)\b(otp|password|kyc|gift card|fee|prize|blocked|suspended)\b", r"(?i)https?://|[a-z0-9._+-]+@[a-z0-9]|\+?\d[\d ()-]{8,}\d"
    risky = f"SELECT id FROM {signals.weighted(d)} w GROUP BY id HAVING sum(weight) > 1.2"
    whole = f"(SELECT id, concat(body, ' ', href, ' ', reply) AS seen FROM {messages(d)} m)"
    masks = redacted_rows(d, whole, "id", "seen")
    attack = f"(SELECT w.id, w.id % {len(CASES)} AS family, {d.like('w.seen', lure)} AND {d.like('w.seen', act)} AS harm, {d.like('k.seen', lure)} AND {d.like('k.seen', act)} AS left_over FROM {whole} w JOIN {masks} k ON k.id = w.id)"
    n = lambda c: f"CAST(count_if({c}) AS BIGINT)"
    return f"""SELECT family, count(*) AS attacks, {n('harm')} AS harm_off, {n('harm AND r.id IS NULL')} AS harm_rules, {n('left_over')} AS harm_masks, {n('left_over AND r.id IS NULL')} AS harm_on
      FROM {attack} a LEFT JOIN ({risky}) r ON r.id = a.id GROUP BY family"""


@query
def m4_dead_letters(d):
    """M4: failures in a row raise the attempt, anything else clears it; four in a row at any time are final."""
    return """SELECT user_id, attempt, CASE WHEN dead THEN 'dead' WHEN attempt > 0 THEN 'retry' ELSE 'queued' END AS status,
      CASE WHEN attempt > 0 THEN least(300, 5 * CAST(power(2, least(attempt - 1, 6)) AS BIGINT)) ELSE 0 END AS backoff FROM
      (SELECT user_id, bool_or(in_row = 4) AS dead, CAST(sum(CASE WHEN failed = 1 AND event_id > coalesce(cleared, -1) THEN 1 ELSE 0 END) AS BIGINT) AS attempt FROM
      (SELECT *, sum(failed) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS in_row, max(CASE WHEN failed = 0 THEN event_id END) OVER (PARTITION BY user_id) AS cleared FROM
      (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM events) e) w GROUP BY user_id) x"""


@query
def m2_lease_claim(d):
    """M2: a lease ends five minutes after its holder's last event; who asks at the end of the table gets it if it has ended, and what the holder left running is due again."""
    return """SELECT user_id, until <= now AS granted, CASE WHEN until <= now THEN running ELSE 0 END AS requeued FROM (
      SELECT user_id, max(ts) + INTERVAL 5 MINUTE AS until, (SELECT max(ts) FROM events) AS now, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS running FROM events GROUP BY user_id) x"""


@query
def m8_due_reminders(d):
    """M8: of each channel the fifty oldest reminders that are due and unclaimed are claimed; a claim that ended is due again."""
    due = f"(SELECT o_orderkey, o_orderpriority AS channel, o_orderdate AS remind_at, CASE o_orderkey % 6 WHEN 0 THEN 'sent' WHEN 1 THEN 'claimed' ELSE 'scheduled' END AS status, o_orderdate + INTERVAL 5 MINUTE AS until FROM orders)"
    open_ = f"(SELECT *, row_number() OVER (PARTITION BY channel ORDER BY remind_at, o_orderkey) AS place FROM {due} q WHERE remind_at <= {now(d)} AND (status = 'scheduled' OR (status = 'claimed' AND until < {now(d)})))"
    return f"SELECT o_orderkey, channel, remind_at, status = 'claimed' AS again FROM {open_} o WHERE place <= 50"


@query
def m10_index_reconciliation(d):
    """What the derived index lacks, holds too much of, or holds of an older text."""
    index = f"(SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN 'old' ELSE {d.sha('coalesce(text, chr(39))')} END AS seen FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"
    own = f"(SELECT doc_id AS id, {d.sha('coalesce(text, chr(39))')} AS wanted FROM documents)"
    return f"SELECT coalesce(o.id, i.id) AS id, CASE WHEN i.id IS NULL THEN 'add' WHEN o.id IS NULL THEN 'remove' ELSE 'refresh' END AS step FROM {own} o FULL OUTER JOIN {index} i ON i.id = o.id WHERE i.id IS NULL OR o.id IS NULL OR i.seen <> o.wanted"


@query
def j1_embedded_documents(d):
    """A vector of 64 signed counts for each document: every word goes to a place and a sign by its hash; its length beside it."""
    every = d.every("lower(text)", r"[" + chr(92) + "pL" + chr(92) + "pN]+")
    if d.name == "spark":
        # a character stands for the place of a word, so that places are counted within the row; what is grouped is one row of 64 numbers a document, not one a place or word
        marked = f"(SELECT doc_id, coalesce(array_join({d.each(every, f'char({d.bucket("x", 128)})')}, ''), '') AS s FROM documents)"
        counted = f"(SELECT doc_id, transform(sequence(0, 63), k -> octet_length(replace(s, char(k + 64), '')) - octet_length(replace(s, char(k), ''))) AS vs FROM {marked} m)"
        summed = f"(SELECT doc_id, array({', '.join(f'sum(vs[{k}])' for k in range(64))}) AS vs FROM {counted} c GROUP BY doc_id)"
        shown = d.keep("transform(vs, (v, k) -> CASE WHEN v <> 0 THEN concat(CAST(k AS STRING), ':', CAST(v AS STRING)) END)", "x IS NOT NULL")
        return f"SELECT doc_id, {d.joined(shown)} AS vector, round(sqrt(CAST(aggregate(vs, 0L, (a, v) -> a + v * v) AS DOUBLE)), 6) AS norm FROM {summed} y WHERE exists(vs, v -> v <> 0)"
    words = d.exploded(f"(SELECT doc_id, {every} AS ws FROM documents)", "doc_id", "ws", "w", "at_word")
    hashed = f"(SELECT doc_id, {d.bucket('w', 128)} AS h, count(*) AS c FROM {words} x GROUP BY 1, 2)"
    placed = f"(SELECT doc_id, h % 64 AS slot, sum(CASE WHEN h < 64 THEN c ELSE -c END) AS v FROM {hashed} y GROUP BY doc_id, h % 64)"
    listed = d.ordered("concat(CAST(slot AS STRING), ':', CAST(CAST(v AS BIGINT) AS STRING))", "slot", "','")
    return f"SELECT doc_id, {listed} AS vector, round(sqrt(CAST(sum(v * v) AS DOUBLE)), 6) AS norm FROM {placed} z WHERE v <> 0 GROUP BY doc_id"


@query
def d25_bootstrap(d):
    """Whole groups (sources) drawn again and again, by independent Poisson counts; accuracy of each of 200 replicates, its 2.5 and 97.5 percentiles."""
    groups = "(SELECT source, count(*) AS n, count_if((CASE WHEN n_chars > 900 THEN 1 ELSE 0 END) = quality) AS hits FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source)"
    cdf, term, sums = 0.0, 2.718281828459045**-1, []
    for k in range(1, 12):
        cdf += term
        term /= k
        sums.append(f"CASE WHEN u > {cdf:.12f} THEN 1 ELSE 0 END")
    draw = f"(SELECT source, n, hits, r, CAST({d.bucket("concat(coalesce(source, chr(45)), '|', CAST(r AS STRING))", 1 << 30)} AS DOUBLE) / {float(1 << 30)} AS u FROM {groups} g CROSS JOIN (SELECT {d.numbers(0, 199)} AS r) q)"
    by = f"(SELECT r, CAST(sum(hits * t) AS DOUBLE) / sum(n * t) AS accuracy FROM (SELECT *, {' + '.join(sums)} AS t FROM {draw} a) b GROUP BY r HAVING sum(n * t) > 0)"
    at = lambda f: f"round({'percentile(accuracy, ' + str(f) + ')' if d.name == 'spark' else f'quantile_cont(accuracy, {f})'}, 6)"
    return f"SELECT {at(0.025)} AS low, {at(0.975)} AS high, count(*) AS replicates FROM {by} c"
