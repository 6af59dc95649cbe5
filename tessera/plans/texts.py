"""Keys, quotes, names, styles, stamps, JSON and answers over whole tables."""

from __future__ import annotations

from tessera.functions import fixed
from tessera.plans.messages import messages
from tessera.plans.money import text_of
from tessera.plans.signals import address, display, domain, names

QUERIES = {}
#: DuckDB texts of queries that Spark plans in another way.
ORACLES = {}
DAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
STOCK = ("hope this finds you well", "touching base", "please do not hesitate", "at your earliest convenience", "circle back")
TITLES = "mr mrs ms dr prof sir madam".split()
WORDS = r"[\pL\pN_]+(?:['-]+[\pL\pN_]+)*"


def query(f):
    QUERIES[f.__name__] = f
    return f


def key(d, s):
    """Text to look quotes up in: typographic marks plain, case folded, blanks squeezed."""
    marks = "concat(repeat(chr(39), 5), repeat(chr(34), 4), '--- ')"
    plain = f"replace(translate({s}, '{fixed.TYPOGRAPHIC[0]}', {marks}), '…', '...')"
    return f"lower(trim({d.sub(plain, chr(92) + 's+', ' ')}))"


def quoted(d, s):
    """A quote's key without the marks around it."""
    return d.sub(key(d, s), r"^[ \x22.']+|[ \x22.']+$")


def canonical(d, s, most=32000):
    """H1 but NFC: line ends, control and format characters, blanks, empty lines; the first ``most`` characters, or all."""
    nl = "'\\n'" if d.name == "spark" else "chr(10)"
    every = "" if d.name == "spark" else ", 'g'"
    put = lambda x, pattern, to: f"regexp_replace({x}, {d.text(pattern)}, {to}{every})"
    s = put(s, r"\r\n?", nl)
    s = put(s, r"[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}]", "''")
    s = put(s, r"[ \t\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", "' '")
    s = put(put(s, r" ?\n ?", nl), r"\n{3,}", f"concat({nl}, {nl})")
    s = put(s, r"^[ \n]+|[ \n]+$", "''")
    return s if most is None else put(f"substr({s}, 1, {most})", r"[ \n]+$", "''")


@query
def h1_canonical_text(d):
    """H1 on text that is NFC."""
    return f"SELECT doc_id, {d.sha(canonical(d, 'text'))} AS canonical FROM documents"


ORACLES["h1_normal_form"] = lambda d: f"SELECT doc_id, {d.sha(canonical(d, 'nfc_normalize(text)', None))} AS canonical FROM documents"


@query
def h3_grounding_key(d):
    """H3 of every message."""
    return f"SELECT id, {d.sha(key(d, 'concat(subject, chr(10), body)'))} AS k FROM {messages(d)} m"


@query
def h22_quoted_strip(d):
    """A message's own words, up to the first quoted mark."""
    own = d.part(d.resplit("body", r"(?im)^\s*(?:>|on .{6,120} wrote:|-{2,}\s*original message|from: .+@.+)"), 1)
    return f"SELECT id, {d.sha(f'coalesce(trim({own}), {chr(39) * 2})')} AS own, length(body) - length({own}) > 0 AS stripped FROM {messages(d)} m"


@query
def style_profile(d):
    """Words of turns and documents, median and longest."""
    n = lambda c: d.count(f"coalesce({c}, '')", WORDS)
    rows = f"SELECT role AS kind, {n('text')} AS n FROM conversations UNION ALL SELECT lang, {n('text')} FROM documents"
    return f"SELECT kind, count(*) AS texts, round({d.median('n')}, 6) AS median_words, max(n) AS longest FROM ({rows}) x GROUP BY kind"


@query
def d16_greeting_mode(d):
    """The commonest first word of a role's turns, ties by name."""
    return f"SELECT role, word, n FROM (SELECT role, word, n, row_number() OVER (PARTITION BY role ORDER BY n DESC, word) AS rn FROM (SELECT role, {d.first('text', '^[^ ]+')} AS word, count(*) AS n FROM conversations GROUP BY 1, 2) c) r WHERE rn = 1"


@query
def h24_first_name(d):
    """H24"""
    shown = f"CASE WHEN {display(d, 'sender')} <> '' THEN {display(d, 'sender')} ELSE {d.part(d.split('sender', '@'), 1)} END"
    ws = d.keep(d.resplit("name", r"[\s\x22']+"), f"x <> '' AND NOT {d.like('x', '[.]$')} AND lower(x) NOT IN ({names(TITLES)})")
    first = d.sub(f"coalesce({d.part('ws', 1)}, '')", "^,+|,+$")
    return f"SELECT id, name AS display, CASE WHEN {d.has(first, chr(39) + '@' + chr(39))} THEN '' ELSE {first} END AS first_name FROM (SELECT id, name, {ws} AS ws FROM (SELECT id, {d.sub(shown, r'[(\[][^)\]]*[)\]]', ' ')} AS name FROM {messages(d)} m) a) b"


@query
def template_groups(d):
    """Whole subjects without reply marks, with addresses and numbers masked, by domain."""
    s = d.sub(f"lower(trim({d.sub('subject', chr(92) + 's+', ' ')}))", r"^(?:(?:re|fw|fwd)\s*:\s*)+")
    s = d.sub(d.sub(s, r"https?://\S+|\b\S+@\S+\b", " <address> "), r"\b(?:\d[\s._:/-]*){2,}\b", " <number> ")
    s = f"trim({d.sub(s, chr(92) + 's+', ' ')})"
    dom = domain(d, address(d, "sender"))
    whole = f"SELECT id, {dom} AS dom, {s} AS template FROM {messages(d)} m"
    lines = f"SELECT doc_id, source, {s.replace('subject', 'text')} FROM documents"
    return f"SELECT {d.sha(f'concat(dom, chr(31), template)')} AS grp, count(*) AS n, min(id) AS first_id FROM ({whole} UNION ALL {lines}) x GROUP BY 1"


@query
def h28_style_checks(d):
    """What a draft breaks: stock phrases, dashes, exclamation, lists, triads, length, numbers that the source lacks."""
    s = "lower(body)"
    foreign = d.size(d.keep(d.unique(d.each(d.every(s, r"\d[\d:,./-]*"), d.sub("x", "[.,]+$"))), f"x <> '' AND NOT {d.has('source', 'x')}"))
    triad = f"{d.like('body', r'\b\w+, \w+(?: \w+)?,? and \w+\b')} AND {d.like(s, r'\b(?:clear|seamless|efficient|smooth|timely|quick)\b')}"
    n = d.count("body", WORDS)
    rules = {"stock": " OR ".join(d.has(s, f"'{x}'") for x in STOCK), "dash": f"{d.has('body', chr(39) + '—' + chr(39))} OR {d.like('body', ' (--|–) ')}", "exclamation": d.has("body", "'!'"), "list": d.like("body", r"(?m)^\s*(?:[-*•]|\d+[.)])\s+"), "triad": triad, "short": f"{n} < 40", "long": f"{n} > 80", "foreign": f"{foreign} > 0"}
    return f"SELECT id, concat({', '.join(f'CASE WHEN {c} THEN {chr(39)}{k};{chr(39)} ELSE {chr(39)}{chr(39)} END' for k, c in rules.items())}) AS broken FROM (SELECT id, body, lower(concat(subject, ' ', label, ' ', href)) AS source FROM {messages(d)} m) x"


@query
def h33_safe_screen(d):
    """Derived lines that may be shown: no markup, link or forbidden mark, and grounded in the message."""
    line = d.part(d.split("body", "\n") if d.name == "duckdb" else "split(body, '\\n')", 1)
    derived = f"CASE id % 4 WHEN 0 THEN {line} WHEN 1 THEN concat('<b>', subject, '</b>') WHEN 2 THEN subject ELSE 'made up of nothing' END"
    bad = f"{d.like('s', '[<>]')} OR {d.like('s', r'(?i)https?://|www\.')} OR {d.like('lower(s)', 'chain of thought|hidden reasoning|internal reasoning|100% certain|guaranteed classification')}"
    return f"SELECT id, s <> '' AND length(s) <= 200 AND NOT ({bad}) AND {quoted(d, 's')} <> '' AND {d.has(key(d, 'concat(subject, chr(10), body)'), quoted(d, 's'))} AS safe FROM (SELECT id, subject, body, trim({derived}) AS s FROM {messages(d)} m) x"


@query
def i2_legacy_stamp(d):
    """ISO, else day-month-year, else the epoch's day."""
    day, iso = ("date_format(ts, 'dd-MM-yyyy')", "date_format(ts, 'yyyy-MM-dd')") if d.name == "spark" else ("strftime(ts, '%d-%m-%Y')", "strftime(ts, '%Y-%m-%d')")
    s = f"CASE event_id % 4 WHEN 0 THEN {iso} WHEN 1 THEN {day} WHEN 2 THEN 'soon' ELSE concat('2024-13-', lpad(CAST(event_id % 40 AS STRING), 2, '0')) END"
    return f"SELECT event_id, coalesce({d.date('s', '%Y-%m-%d')}, {d.date('s', '%d-%m-%Y')}, DATE '1970-01-01') AS day FROM (SELECT event_id, {s} AS s FROM events) x"


@query
def i7_weekday_deadline(d):
    """The coming day that is named, a week on for "next"; none if several days or another date are named."""
    said = "concat('please do it ', CASE event_id % 9 WHEN 0 THEN 'by Friday' WHEN 1 THEN 'next Monday' WHEN 2 THEN 'Friday or Monday' WHEN 3 THEN 'on Sunday, 5 Nov' WHEN 4 THEN 'soon' WHEN 5 THEN 'on wednesday' WHEN 6 THEN 'Saturday, i.e. saturday' WHEN 7 THEN 'tomorrow or Tuesday' ELSE 'this Thursday' END)"
    found = d.unique(d.each(d.every("said", rf"(?i)\b(?:{'|'.join(DAYS)})\b"), "lower(x)"))
    number = "CASE " + d.part("days", 1) + " " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(DAYS)) + " END"
    today = "extract(DAYOFWEEK FROM CAST(ts AS DATE)) - 1" if d.name == "spark" else "extract(DOW FROM ts)"
    ahead = f"CAST((({number}) - ({today}) + 6) % 7 + 1 + CASE WHEN {d.like('said', r'(?i)\bnext\s')} THEN 7 ELSE 0 END AS INT)"
    due = f"date_add(CAST(ts AS DATE), {ahead})" if d.name == "spark" else f"CAST(CAST(ts AS DATE) + {ahead} AS DATE)"
    other = d.like("said", r"(?i)\b(?:today|tomorrow|tonight|\d{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))")
    return f"SELECT event_id, CASE WHEN {d.size('days')} = 1 AND NOT {other} THEN {due} END AS due FROM (SELECT event_id, ts, said, {found} AS days FROM (SELECT event_id, ts, {said} AS said FROM events) a) b"


@query
def i10_due_at(d):
    """A provider's deadline by its precision: a day is local midnight, a time without zone or a doubtful UTC is local, other zones stay; nulls are unknown, contradictions are refused."""
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")" if d.name == "spark" else "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    value = f"CASE event_id % 8 WHEN 0 THEN substr({iso}, 1, 10) WHEN 1 THEN {iso} WHEN 2 THEN concat({iso}, 'Z') WHEN 3 THEN concat({iso}, '+02:00') WHEN 4 THEN NULL WHEN 5 THEN 'next week' WHEN 6 THEN concat({iso}, '+00:00') ELSE repeat('2', 70) END"
    precision = "CASE event_id % 3 WHEN 0 THEN 'date_only' WHEN 1 THEN 'exact_time' ELSE 'unknown' END"
    day, clock = d.like("v", r"^\d{4}-\d{2}-\d{2}$"), r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"
    zone = d.first("v", r"(Z|[+-]\d{2}:\d{2})$", 1)
    local = f"concat({d.first('v', clock, 1)}, '+05:30')"
    due = f"""CASE WHEN v IS NULL THEN NULL WHEN length(v) > 64 THEN 'refused' WHEN p = 'date_only' AND {day} THEN concat(v, 'T00:00:00+05:30') WHEN p = 'unknown' THEN 'refused' WHEN p = 'exact_time' AND NOT {d.has('v', chr(39) + 'T' + chr(39))} THEN 'refused'
      WHEN {day} THEN concat(v, 'T00:00:00+05:30') WHEN NOT {d.like('v', clock)} THEN 'refused' WHEN {zone} = '' THEN {local} WHEN {zone} IN ('Z', '+00:00') AND p = 'exact_time' AND NOT utc THEN {local} ELSE v END"""
    return f"SELECT event_id, {due} AS due, CASE WHEN v IS NULL THEN 'unknown' ELSE p END AS due_precision FROM (SELECT event_id, {value} AS v, {precision} AS p, event_id % 5 = 0 AS utc FROM events) x"


@query
def i15_json_guard(d):
    """Fields of a guarded JSON text: what is no object or no number gives none."""
    broken = "CASE event_id % 5 WHEN 0 THEN substr(props, 2) WHEN 1 THEN replace(props, ':', ': \"x') ELSE props END"
    valid = f"({'try_parse_json(s) IS NOT NULL' if d.name == 'spark' else 'json_valid(s)'} AND {d.like('s', r'^\s*[{].*[}]\s*$')})"
    return f"SELECT event_id, ok, CASE WHEN ok THEN {d.try_cast(d.json('t', '$.k'), 'DOUBLE')} END AS k FROM (SELECT event_id, {valid} AS ok, CASE WHEN {valid} THEN s ELSE '{{}}' END AS t FROM (SELECT event_id, {broken} AS s FROM events) a) b"


@query
def i16_json_sizes(d):
    """Size of a JSON array of objects, and one of its fields as a column."""
    array = "concat('[', CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('{\"name\": \"', event_type, '\"}, {\"name\": \"u', CAST(user_id AS STRING), '\"}') END, ']')"
    field = "from_json(s, 'array<struct<name:string>>').name" if d.name == "spark" else "CAST(json_extract_string(s, '$[*].name') AS VARCHAR[])"
    return f"SELECT event_id, {d.json_size('s')} AS n, {d.json_size('s')} > 0 AS filled, {d.joined(field, '|')} AS listed FROM (SELECT event_id, {array} AS s FROM events) x"


@query
def i21_ms_tenths(d):
    """I21, I22, I23"""
    now = f"{'TIMESTAMP_NTZ' if d.name == 'spark' else 'TIMESTAMP'} '2024-02-01 00:00:00'"
    return f"SELECT event_id, CAST(ceil(value * 1000 / 100 - 0.000000001) AS BIGINT) AS tenths, {d.days('ts', now)} AS days_until, hour({d.local('ts')}) * 60 + minute({d.local('ts')}) >= 570 AS is_due FROM events"


@query
def g6_link_dedupe(d):
    """The first of each (text, target) of an account, in order of the messages."""
    return f"SELECT account, label, href, min(id) AS first_id, count(*) AS n FROM {messages(d)} m GROUP BY account, label, href"


TURNS = "(SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before FROM conversations)"


@query
def o7_verified_answers(d):
    """An answer stands if one of its quotes of the turn before it is really there; made-up ones (every third) don't count."""
    quote = "CASE WHEN turn % 3 = 0 THEN concat(substr(before, 5, 30), ' so to say') ELSE substr(before, 5, 30) END"
    return f"SELECT conv_id, turn, {quoted(d, 'quote')} <> '' AND {d.has(key(d, 'before'), quoted(d, 'quote'))} AS verified FROM (SELECT *, {quote} AS quote FROM {TURNS} t WHERE role = 'assistant') x"


@query
def o6_tool_totals(d):
    """What the tools say of each account: messages, those that ask for something, spent by currency, high risks; of all amounts and whole texts."""
    from tessera.plans import money, signals

    spent = f"(SELECT account, currency, CAST(sum(amount_minor) AS BIGINT) AS spent, count(*) AS records FROM {money.records(d, whole=True)} r WHERE kind <> 'refund' GROUP BY account, currency)"
    if d.name == "spark":
        # a filter by kind would go down to where the texts are read, and there it would make each text anew for every word that a kind has
        counted = lambda x: f"CASE WHEN kind <> 'refund' THEN {x} END"
        spent = f"(SELECT account, currency, CAST(sum({counted('amount_minor')}) AS BIGINT) AS spent, count({counted('1')}) AS records FROM {money.records(d, whole=True)} r GROUP BY account, currency HAVING count({counted('1')}) > 0)"
    risky = f"(SELECT m.account, count(*) AS risky FROM (SELECT id FROM {signals.weighted(d)} w GROUP BY id HAVING sum(weight) > 2) h JOIN {messages(d)} m ON m.id = h.id GROUP BY m.account)"
    asked = f"count(CASE WHEN {d.like('body', r'(?i)\b(?:by|before|due|renews|update|pay|send|verify|reply)\b')} THEN 1 END)"
    mails = f"(SELECT account, count(*) AS messages, {asked} AS actions FROM {messages(d)} m GROUP BY account)"
    return f"SELECT m.account, m.messages, m.actions, s.currency, s.spent, coalesce(s.records, 0) AS records, coalesce(k.risky, 0) AS risky FROM {mails} m LEFT JOIN {spent} s ON s.account = m.account LEFT JOIN {risky} k ON k.account = m.account"


@query
def o4_tool_search(d):
    """Word and date filters, eight rows; the total is counted apart, so that no task holds all hits."""
    where = f"{d.has(key(d, 'body'), chr(39) + 'account' + chr(39))} AND received >= DATE '2024-01-10' AND received < DATE '2024-02-20'"
    hits = f"(SELECT id, account, received FROM {messages(d)} m WHERE {where})"
    return f"SELECT id, account, received, total FROM (SELECT * FROM {hits} h ORDER BY received DESC, id DESC LIMIT 8) p CROSS JOIN (SELECT count(*) AS total FROM {hits} c) t"


@query
def o8_step_shape(d):
    """Steps that name a known tool and have their arguments."""
    step = "CASE event_id % 5 WHEN 0 THEN concat('{\"tool\": \"search\", \"args\": ', props, '}') WHEN 1 THEN '{\"tool\": \"drop\", \"args\": {}}' WHEN 2 THEN '{\"tool\": \"read\"}' WHEN 3 THEN concat('{\"tool\": \"', event_type, '\", \"args\": {}}') ELSE '{\"tool\": \"money\", \"args\": {\"k\": 1}}' END"
    return f"SELECT event_id, coalesce({d.json('s', '$.tool')} IN ('search', 'read', 'money', 'risk', 'actions') AND {d.json('s', '$.args')} IS NOT NULL, false) AS valid FROM (SELECT event_id, {step} AS s FROM events) x"


@query
def o10_question_score(d):
    """Every fact by any of its wordings, no forbidden phrase; of every assistant turn whose question has facts. A question's facts are the first three longer words of the turn before, each whole or by its first five letters."""
    facts = d.exploded(f"(SELECT conv_id, turn, lower(text) AS said, {d.cut(d.unique(d.every('lower(before)', '[a-z]{5,}')), 3)} AS ws FROM {TURNS} t WHERE role = 'assistant')", "conv_id, turn, said", "ws", "fact", "at_fact")
    ok = f"CASE WHEN {d.has('said', 'fact')} OR {d.has('said', 'substr(fact, 1, 5)')} THEN 1 ELSE 0 END"
    return f"SELECT conv_id, turn, count(*) AS facts, CAST(sum({ok}) AS BIGINT) AS told, min({ok}) = 1 AND NOT bool_or({d.has('said', chr(39) + 'sorry' + chr(39))}) AS correct FROM {facts} f GROUP BY conv_id, turn"


@query
def o12_decision_context(d):
    """O12"""
    return f"SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'confirmed' ELSE 'model' END AS origin, {d.try_cast(d.json('props', '$.k'), 'BIGINT')} AS k FROM events"


@query
def m14_failure_taxonomy(d):
    """Every attempt's answer code to its failure and whether it is tried again."""
    code = "CASE WHEN event_type = 'error' THEN 400 + 1 * (user_id % 5) + CASE event_id % 4 WHEN 0 THEN 25 WHEN 1 THEN 100 ELSE 0 END ELSE 200 END"
    return f"""SELECT event_id, code, CASE WHEN code < 400 THEN 'none' WHEN code = 429 THEN 'rate_limited' WHEN code IN (401, 403) THEN 'denied' WHEN code IN (404, 410) THEN 'gone' WHEN code >= 500 THEN 'unavailable' ELSE 'invalid' END AS failure,
      code = 429 OR code >= 500 AS retryable FROM (SELECT event_id, CAST({code} AS BIGINT) AS code FROM events) x"""


@query
def a19_delivery_result(d):
    """What a channel answered to each outbox row: sent with a number; retry when throttled or the server failed, after the wait it names; unknown without a readable answer; blocked otherwise."""
    status = "CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 403 ELSE 200 END"
    answer = "CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '{\"ok\": true}' WHEN 2 THEN '{\"ok\": false, \"wait\": 30}' ELSE concat('{\"ok\": true, \"id\": ', CAST(event_id AS STRING), '}') END"
    ok, number, wait = d.json("answer", "$.ok"), d.json("answer", "$.id"), d.json("answer", "$.wait")
    return f"""SELECT event_id, CASE WHEN answer IS NULL THEN 'unknown' WHEN status = 200 AND {ok} = 'true' THEN CASE WHEN {number} IS NULL THEN 'unknown' ELSE 'sent' END
      WHEN status = 429 OR status >= 500 THEN 'retry' ELSE 'blocked' END AS result, CASE WHEN status = 429 THEN {d.try_cast(wait, 'DOUBLE')} END AS retry_after FROM (SELECT event_id, {status} AS status, {answer} AS answer FROM events) x"""


@query
def h2_subject(d):
    """H2 of every message and document."""
    s = lambda c: f"substr(trim({d.sub(c, chr(92) + 's+', ' ')}), 1, 2000)"
    return f"SELECT id, {s('subject')} AS subject, {d.sha(s('body'))} AS body FROM {messages(d)} m"


@query
def h5_composite_format(d):
    """H5 of every message."""
    subject = f"trim({d.sub('subject', chr(92) + 's+', ' ')})"
    return f"SELECT id, {d.sha(f'rtrim(substr(concat({chr(39)}Subject: {chr(39)}, {subject}, {chr(39)} | Body: {chr(39)}, text), 1, 6000))')} AS formatted FROM {text_of(d)} m"
