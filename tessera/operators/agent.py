"""Answers and briefs by bounded steps over tables: a driver loop whose tools are DataFrames; every step is recorded.

Defined cases: a question that finds nothing is answered with none after its search; a quote that is not in its source is not
an answer; a failing stage of a brief gives its fallback line; steps beyond MOST aren't taken.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import search

MOST = 6


def ask(rows: DataFrame, question: str, word: str, most: int = MOST) -> list[dict]:
    """rows (id, body): steps search, read, quote, verify of a question about a word; the last has the answer, if there is one."""
    steps: list[dict] = []

    def note(tool: str, n: int, answer: str | None = None, source: int | None = None) -> bool:
        steps.append({"question": question, "step": len(steps) + 1, "tool": tool, "n": n, "id": source, "answer": answer})
        return len(steps) < most

    found = search(rows, word, ["body"])
    got = found.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).first()
    if not note("search", got.n) or not got.n:
        return steps
    body = found.where(F.col("id") == got.id).select("body").first().body
    if not note("read", len(body), source=got.id):
        return steps
    at = body.lower().find(word.lower())
    begin = max(body.rfind(c, 0, at) for c in ".\n") + 1
    end = min((e for c in ".\n" if (e := body.find(c, at)) >= 0), default=len(body))
    quote = " ".join(body[begin:end].split())[:200]
    if note("quote", len(quote), source=got.id) and quote in " ".join(body.split()):
        note("answer", 1, quote, got.id)
    return steps


def brief(stages: Sequence[tuple[str, Callable[[], DataFrame], str]], most: int = 5) -> list[tuple[str, int, int | None, str]]:
    """kind, place, id, line: of each stage (kind, its candidates (id, line) in order, fallback line) the first ``most``."""
    out: list[tuple[str, int, int | None, str]] = []
    for kind, candidates, fallback in stages:
        try:
            rows = [(r.id, r.line) for r in candidates().limit(most).collect()]
        except (PySparkException, LookupError, ValueError):  # a stage that can't be read leaves the others
            rows = []
        out += [(kind, k, i, line) for k, (i, line) in enumerate(rows, 1)] or [(kind, 1, None, fallback)]
    return out


QUESTIONS = (("Which accounts are blocked?", "blocked"), ("What renews?", "renews"), ("Who wrote of zebras?", "zebra crossing 77"), ("What was debited?", "debited"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.dialect import plan
    from tessera.plans.messages import messages

    return plan(lambda d: f"SELECT id, account, subject, body FROM {messages(d)} m")(spark, sf_dir)


def o3_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of four questions over all messages."""
    rows = _messages(spark, sf_dir)
    steps = [s for q, w in QUESTIONS for s in ask(rows, q, w)]
    return spark.createDataFrame([(s["question"], s["step"], s["tool"], s["id"], s["answer"]) for s in steps], "question string, step long, tool string, id long, answer string")


def o9_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look at first: money due, blocked accounts, and a stage that fails."""
    rows = _messages(spark, sf_dir)
    of = lambda word: search(rows, word, ["body"]).orderBy(F.desc("id")).select("id", F.concat("account", F.lit(": "), "subject").alias("line"))
    stages = [("money", lambda: of("amount due"), "nothing due"), ("risk", lambda: of("blocked"), "no risk"), ("calendar", lambda: rows.select("no_such_column"), "the calendar could not be read")]
    return spark.createDataFrame(brief(stages), "kind string, place long, id long, line string")


def m12_bounded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for every event, of which some time out and some fail."""
    from tessera.operators.calls import bounded_calls

    def call(row: dict) -> str:
        if row["event_id"] % 50 == 7:
            raise TimeoutError
        if row["event_id"] % 70 == 9:
            raise ValueError
        return row["event_type"].upper()

    return bounded_calls(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type"), call, "event_id")


PLANS = {f.__name__: f for f in (o3_ask, o9_brief, m12_bounded_calls)}


def _asked(d) -> str:
    from tessera.plans.messages import messages

    words = ", ".join(f"('{q}', '{w}')" for q, w in QUESTIONS)
    found = f"(SELECT question, word, count(m.id) AS n, max(m.id) AS id, arg_max(m.body, m.id) AS body FROM (VALUES {words}) AS w(question, word) LEFT JOIN {messages(d)} m ON contains(lower(m.body), w.word) GROUP BY question, word)"
    quote = r"substr(trim(regexp_replace(regexp_extract(body, '(?i)[^.\n]*' || word || '[^.\n]*'), '\s+', ' ', 'g')), 1, 200)"
    return f"SELECT question, CAST(step AS BIGINT) AS step, tool, CASE WHEN step > 1 THEN id END AS id, CASE WHEN step = 4 THEN {quote} END AS answer FROM {found} f JOIN (VALUES (1, 'search'), (2, 'read'), (3, 'quote'), (4, 'answer')) AS s(step, tool) ON step = 1 OR n > 0"


def _briefed(d) -> str:
    from tessera.plans.messages import messages

    part = lambda kind, word: f"SELECT '{kind}' AS kind, CAST(row_number() OVER (ORDER BY id DESC) AS BIGINT) AS place, id, account || ': ' || subject AS line FROM {messages(d)} m WHERE contains(lower(body), '{word}')"
    return f"SELECT * FROM ({part('money', 'amount due')} UNION ALL {part('risk', 'blocked')}) x WHERE place <= 5 UNION ALL SELECT 'calendar', 1, NULL, 'the calendar could not be read'"


ORACLES = {
    "o3_ask": _asked,
    "o9_brief": _briefed,
    "m12_bounded_calls": lambda d: "SELECT event_id, CASE WHEN event_id % 50 = 7 THEN 'timeout' WHEN event_id % 70 = 9 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_id % 50 = 7 THEN NULL WHEN event_id % 70 = 9 THEN 'ValueError' ELSE upper(event_type) END AS answer FROM events",
}
