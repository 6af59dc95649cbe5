"""One query text for two engines: Spark runs the plan, DuckDB the oracle.

A query is a function of a dialect; what the engines spell differently goes through it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


class Spark:
    name = "spark"

    def text(self, s: str) -> str:
        return "r'" + s.replace("'", "\\'") + "'" if "'" not in s else 'r"' + s + '"'

    def days(self, a, b):
        return f"CAST(datediff({b}, {a}) AS BIGINT)"

    def local(self, ts):
        return f"convert_timezone('UTC', 'Asia/Kolkata', {ts})"

    def utc(self, ts):
        return f"convert_timezone('Asia/Kolkata', 'UTC', {ts})"

    def json(self, col, path):
        return f"get_json_object({col}, '{path}')"

    def json_size(self, col):
        return f"CAST(json_array_length({col}) AS BIGINT)"

    def argmax(self, x, by):
        return f"max_by({x}, {by})"

    def argmin(self, x, by):
        return f"min_by({x}, {by})"

    def listed(self, x):
        return f"array_join(array_sort(collect_list({x})), ',')"

    def distinct_listed(self, x):
        return f"array_join(array_sort(collect_set({x})), ',')"

    def like(self, col, pattern):
        return f"regexp_like({col}, {self.text(pattern)})"

    def sub(self, col, pattern, to=""):
        return f"regexp_replace({col}, {self.text(pattern)}, {self.text(to)})"

    def first(self, col, pattern, group=0):
        return f"regexp_extract({col}, {self.text(pattern)}, {group})"

    def every(self, col, pattern):
        return f"regexp_extract_all({col}, {self.text(pattern)}, 0)"

    def count(self, col, pattern):
        return f"CAST(size({self.every(col, pattern)}) AS BIGINT)"

    def size(self, a):
        return f"CAST(size({a}) AS BIGINT)"

    def joined(self, a, sep=","):
        return f"array_join({a}, '{sep}')"

    def bround(self, x, n=0):
        return f"bround({x}, {n})"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def bytes(self, x):
        return f"octet_length({x})"

    def median(self, x):
        return f"median({x})"

    def disc(self, f, x):
        return f"percentile_disc({f}) WITHIN GROUP (ORDER BY {x})"

    def spread(self, a, b, step):
        return f"explode(sequence({a}, {b}, INTERVAL {step}))"

    def numbers(self, a, b):
        return f"explode(sequence({a}, {b}))"

    def unnest(self, a):
        return f"explode({a})"

    def cosine(self, a, b):
        dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"
        return f"(1 - {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)}))"

    def try_cast(self, x, t):
        return f"try_cast({x} AS {t})"

    def date(self, x, fmt):
        pattern = {"%d-%m-%Y": "dd-MM-yyyy", "%Y-%m-%d": "yyyy-MM-dd", "%d/%m/%Y": "dd/MM/yyyy", "%d %b %Y": "dd MMM yyyy"}[fmt]
        return f"try_to_date({x}, '{pattern}')"

    def stamp(self, ts):
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"

    def month(self, ts):
        return f"date_format({ts}, 'yyyy-MM')"

    def epoch(self, ts):
        return f"CAST(unix_micros(CAST({ts} AS TIMESTAMP)) / 1000 AS BIGINT)"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def keep(self, a, cond):
        return f"filter({a}, x -> {cond})"

    def each(self, a, f):
        return f"transform({a}, x -> {f})"

    def unique(self, a):
        return f"array_sort(array_distinct({a}))"

    def cut(self, a, n):
        return f"slice({a}, 1, {n})"

    def part(self, a, i):
        return f"try_element_at({a}, {i})"

    def split(self, s, by):
        return f"split({s}, {self.text(chr(92) + by if by in '.|+' else by)})"

    def some(self, x, pattern, refused):
        """Whether a match of the pattern in x isn't refused by what stands before and behind it (behind begins with the match)."""
        at = f"split({self.sub(x, f'({pattern})', chr(1) + '$1')}, {self.text(chr(1))})"
        return f"exists(slice(transform({at}, (p_, i_) -> struct(array_join(slice({at}, 1, i_), '') AS b_, p_ AS a_)), 2, 999), m_ -> NOT ({refused('m_.b_', 'm_.a_')}))"

    def translate(self, s, a, b):
        return f"translate({s}, '{a}', '{b}')"

    def resplit(self, s, pattern):
        return f"split({s}, {self.text(pattern)})"

    def exploded(self, source, keep, array, name, at):
        """Rows of an array's elements that aren't null and their places, from 1. Without OUTER the engine would compute the array again to see if it is empty."""
        return f"(SELECT {keep}, at_ + 1 AS {at}, {name} FROM {source} LATERAL VIEW OUTER posexplode({array}) e_ AS at_, {name} WHERE {name} IS NOT NULL)"

    def lengths(self, array, n):
        """Characters of the first n elements."""
        return f"aggregate(transform(slice({array}, 1, {n}), x -> length(x)), 0, (a, x) -> a + x)"

    def last(self, array):
        return f"try_element_at({array}, -1)"

    def find(self, s, t):
        return f"instr({s}, {t})"

    def ordered(self, x, by, sep):
        return f"array_join(transform(array_sort(collect_list(struct({by} AS b, {x} AS x))), e -> e.x), {sep})"

    def boolint(self, c):
        return f"CAST(CASE WHEN {c} THEN 1 ELSE 0 END AS BIGINT)"

    def has(self, s, t):
        return f"contains({s}, {t})"

    def bucket(self, x, n):
        return f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT) % {n}"

    def title(self, s):
        return f"concat(upper(substr({s}, 1, 1)), substr({s}, 2))"


class Duck(Spark):
    name = "duckdb"

    def text(self, s):
        return "'" + s.replace("'", "''") + "'"

    def days(self, a, b):
        return f"CAST(date_diff('day', CAST({a} AS DATE), CAST({b} AS DATE)) AS BIGINT)"

    def local(self, ts):
        return f"({ts} + INTERVAL 330 MINUTE)"

    def utc(self, ts):
        return f"({ts} - INTERVAL 330 MINUTE)"

    def json(self, col, path):
        return f"json_extract_string({col}, '{path}')"

    def json_size(self, col):
        return f"CAST(json_array_length({col}) AS BIGINT)"

    def argmax(self, x, by):
        return f"arg_max({x}, {by})"

    def argmin(self, x, by):
        return f"arg_min({x}, {by})"

    def listed(self, x):
        return f"coalesce(array_to_string(list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL)), ','), '')"

    def distinct_listed(self, x):
        return f"coalesce(array_to_string(list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL)), ','), '')"

    def like(self, col, pattern):
        return f"regexp_matches({col}, {self.text(pattern)})"

    def sub(self, col, pattern, to=""):
        return f"regexp_replace({col}, {self.text(pattern)}, {self.text(to.replace('$', chr(92)))}, 'g')"

    def first(self, col, pattern, group=0):
        return f"regexp_extract({col}, {self.text(pattern)}, {group})"

    def every(self, col, pattern):
        return f"regexp_extract_all({col}, {self.text(pattern)})"

    def count(self, col, pattern):
        return f"CAST(len({self.every(col, pattern)}) AS BIGINT)"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def joined(self, a, sep=","):
        return f"array_to_string({a}, '{sep}')"

    def bround(self, x, n=0):
        return f"round_even({x}, {n})"

    def sha(self, x):
        return f"sha256({x})"

    def bytes(self, x):
        return f"strlen({x})"

    def disc(self, f, x):
        return f"quantile_disc({x}, {f})"

    def spread(self, a, b, step):
        return f"unnest(generate_series({a}, {b}, INTERVAL {step}))"

    def numbers(self, a, b):
        return f"unnest(generate_series({a}, {b}))"

    def unnest(self, a):
        return f"unnest({a})"

    def cosine(self, a, b):
        return f"list_cosine_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def date(self, x, fmt):
        return f"CAST(try_strptime({x}, '{fmt}') AS DATE)"

    def stamp(self, ts):
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ')"

    def month(self, ts):
        return f"strftime({ts}, '%Y-%m')"

    def epoch(self, ts):
        return f"epoch_ms({ts})"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def keep(self, a, cond):
        return f"list_filter({a}, lambda x: {cond})"

    def each(self, a, f):
        return f"list_transform({a}, lambda x: {f})"

    def unique(self, a):
        return f"list_sort(list_distinct({a}))"

    def cut(self, a, n):
        return f"({a})[1:{n}]"

    def part(self, a, i):
        return f"({a})[{i}]"

    def split(self, s, by):
        return f"string_split({s}, '{by}')"

    def some(self, x, pattern, refused):
        at = f"string_split({self.sub(x, f'({pattern})', chr(1) + '$1')}, {self.text(chr(1))})"
        return f"len(list_filter(range(2, len({at}) + 1), lambda i_: NOT ({refused(f'array_to_string({at}[1:i_ - 1], {chr(39) * 2})', f'{at}[i_]')}))) > 0"

    def resplit(self, s, pattern):
        return f"regexp_split_to_array({s}, {self.text(pattern)})"

    def exploded(self, source, keep, array, name, at):
        return f"(SELECT {keep}, unnest({array}) AS {name}, generate_subscripts({array}, 1) AS {at} FROM {source})"

    def lengths(self, array, n):
        return f"CAST(coalesce(list_sum(list_transform(({array})[1:{n}], lambda x: length(x))), 0) AS BIGINT)"

    def last(self, array):
        return f"({array})[-1]"

    def ordered(self, x, by, sep):
        return f"string_agg({x}, {sep} ORDER BY {by})"

    def has(self, s, t):
        return f"contains({s}, {t})"

    def bucket(self, x, n):
        return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % {n}"


Query = Callable[[Spark], str]
SPARK, DUCK = Spark(), Duck()


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """The tables that the text names, as views."""
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def plan(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = query(SPARK)
        views(spark, sf_dir, sql)
        return spark.sql(sql)

    run.__doc__ = query.__doc__
    return run
