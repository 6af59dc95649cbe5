"""Operators 11 to 13 against brute-force versions, on small tables with the odd cases in them."""

import bisect
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import layout, spelling, url_filters

DOCS = "doc_id long, text string, source string, lang string, z string, file string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], DOCS)


def drawn(n, seed=11):
    """Hot, null and repeated values; texts of one to three bytes a letter; ids out of order, one null."""
    rng = random.Random(seed)
    sources = ["s0"] * 6 + [None, "", "s", "s\0", "sü", "source-of-a-long-name-1", "source-of-a-long-name-2", "\U0001f600", "￿"]
    rows = [(rng.randrange(10**6), rng.choice([None, "", "é" * rng.randrange(3), "x" * rng.randrange(400), "x" * 7]), rng.choice(sources), rng.choice(["en", "en", "de", None])) for _ in range(n - 1)]
    return rows + [(None, "no id", None, "en")]


def laid_out(rows, size):
    """The contract of op11_ as plainly as can be."""
    n, key = len(rows), lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    dims = [[s for _, _, s, _ in rows], [la for *_, la in rows], [-1 if t is None else len(t.encode()) for _, t, _, _ in rows], [None if d is None else zlib.crc32(str(d).encode()) % 365 for d, *_ in rows]]
    coordinates = []
    for values in dims:
        ordered = sorted(map(key, values))
        coordinates.append([8 * bisect.bisect_left(ordered, key(v)) // n for v in values])
    at = list(zip(*coordinates, strict=True))
    z = [sum(((c[k] >> b) & 1) << (4 * b + 3 - turn) for b in range(3) for turn, k in enumerate((3, 2, 1, 0))) for c in at]
    order = sorted(range(n), key=lambda i: (z[i], rows[i][0] is not None, rows[i][0] or 0))
    position = {i: p for p, i in enumerate(order)}
    files = {}
    for i in range(n):
        files.setdefault(position[i] // size, []).append(at[i])
    bounds = {f: [(min(c[k] for c in cs), max(c[k] for c in cs)) for k in range(4)] for f, cs in files.items()}
    out = Counter()
    for i in range(n):
        box = [(c - far, c + far) for c, far in zip(at[i], (0, 0, 1, 1), strict=True)]
        touched = sum(all(lo <= b and hi >= a for (lo, hi), (a, b) in zip(bs, box, strict=True)) for bs in bounds.values())
        matching = sum(any(all(a <= x <= b for x, (a, b) in zip(c, box, strict=True)) for c in cs) for cs in files.values())
        f = position[i] // size
        out[rows[i][0], z[i], f, touched, matching, ",".join(f"{a},{b}" for a, b in bounds[f])] += 1
    return out


@pytest.mark.parametrize(("n", "size"), [(1, 2000), (9, 2), (400, 30), (1500, 7)])
def test_layout_brute_force(spark, n, size):
    rows = drawn(n)
    got = layout.clustered(documents(spark, rows), rows=size).collect()
    assert sorted(r.position for r in got) == list(range(n))
    assert Counter((r.doc_id, r.z, r.file, r.files_touched, r.files_matching, r.file_bounds) for r in got) == laid_out(rows, size)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == [r.doc_id for r in sorted(got, key=lambda r: (r.z, r.doc_id is not None, r.doc_id or 0))]


def test_layout_of_nothing_and_of_equals(spark):
    assert layout.clustered(documents(spark, [])).count() == 0
    got = layout.clustered(documents(spark, [(4, "same", "s", "en")] * 50), rows=20).collect()
    assert sorted(r.position for r in got) == list(range(50)) and {(r.z, r.files_touched, r.files_matching, r.file_bounds) for r in got} == {(0, 3, 3, "0,0,0,0,0,0,0,0")}


def test_cuts_are_order_statistics(spark):
    rng = random.Random(3)
    numbers = [rng.choice([None, 0, -1, 2**62, -(2**62), 2**63 - 1, -(2**63), rng.randrange(-50, 50), rng.randrange(1 << 40)]) for _ in range(999)]
    texts = [rng.choice([None, "", "common prefix of some length " + str(rng.randrange(300)), "é", "a\0", "a", "a" * rng.randrange(60)]) for _ in range(999)]
    at = layout.cuts(spark.createDataFrame(list(zip(numbers, texts, strict=True)), "a long, b string"), {"a": "long", "b": "string"}, 16)
    plain = lambda values, key: [sorted(values, key=key)[-(-k * 999 // 16) - 1] for k in range(1, 16)]
    assert at["a"] == plain(numbers, lambda v: (v is not None, v or 0))
    assert at["b"] == plain([None if t is None else t.encode() for t in texts], lambda v: (v is not None, v or b""))


def test_layout_is_written_in_order(spark, tmp_path):
    rows = [r for r in drawn(300) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "id long, text string, source string, lang string")
    got = layout.stored(df, f"file://{tmp_path}/laid", "id", {"source": "string", "id": "long"}, ("id", "source"), cells=4, rows=50)
    assert set(map(tuple, got.select("id", "text", "source", "lang").collect())) == set(rows) and got.count() == len(rows)
    by_file = got.groupBy(F.input_file_name().alias("f")).agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count("*").alias("n")).collect()
    assert all(r.hi - r.lo + 1 == r.n for r in by_file)
    with pytest.raises(ValueError, match="more than"):
        layout.placed(df, "id", {"source": "string", "id": "long"}, ("id", "source"), cells=1024)


URLS = [
    "https://example.net/en/1", "https://a.b.example.net/en/", "http://EXAMPLE.NET/de/1", "http://example.net/EN/1", "http://myexample.net/en/", "http://example.net", "http://example.net?x=/en/", "http://example.com/de/x#y",
    "http://www.example.com/dex", "http://site.org/fr/a", "http://site.org/fr", "http://org/fr/", "http://net.org/", "ftp://x.net/#://y", "no scheme example.net/en/", "", None, "://net/", "http://u:p@x.net:80/a", "http://x.net:80/",
    "http://casino-win.example.org/en/", "http://m.casino-win.example.net/en/1", "http://xcasino-win.org/", "http://docs.casino-win.org/a.zip", "http://a.org/a.zip", "http://a.org/a.zip?x", "http://a.org/a.zipped", "http://a.org/login", "http://a.org/login/x",
    "http://a.org/logins", "http://a.org/search?a=1&q=2", "http://a.org/tag/x/y/page/3", "http://a.org/x?utm_medium=cpc", "http://a.org/x?UTM_medium=CPC&b", "http://a.org/é\nb.exe", "http://a.org/$[x](y)+.exe", "http://ads.a.org/help/",
]


def plain_verdict(url, hosts, patterns):
    if url is None or "://" not in url:
        return "", "", None, "allow", None
    lower = lambda s: s.translate({k: k + 32 for k in range(65, 91)})
    host, path, rest = re.match(r"(?s)([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1]).groups()
    host = lower(host)
    fit = [(len(r), r, a) for a, r in hosts if (host == r.split("/", 1)[0].lower() or host.endswith("." + r.split("/", 1)[0].lower())) and path.startswith("/" + r.split("/", 1)[1])]
    if fit:
        _, rule, action = sorted(fit, key=lambda x: (-x[0], x[1]))[0]
        return host, path, rule, action, None
    text = lower(url.split("://", 1)[1])
    found = sorted((not p.startswith("@@"), -len(p), p) for p in patterns if re.search(url_filters.regex_of("pattern", p).replace(r"\z", r"\Z"), text))
    return host, path, None, ("block" if found[0][0] else "allow") if found else "allow", found[0][2] if found else None


@pytest.mark.parametrize("block", [5, 50_000])
def test_url_filters_brute_force(spark, block):
    pages = spark.createDataFrame([(k, u, "x", None) for k, u in enumerate(URLS + URLS[:5])] + [(None, URLS[0], "x", None)], "page_id long, url string, rule string, verdict string")
    patterns = [*url_filters.PATTERNS, "*", "é", "*xed*", "|docs.", "^x^", "$[x](", "||", "@@||a.org/x?", "e|"]
    for given in (patterns, [p for p in patterns if p not in ("*", "||")]) if block == 5 else (url_filters.PATTERNS,):
        got = url_filters.judged(pages, url_filters.rule_table(spark, url_filters.HOSTS, given), block).collect()
        assert len(got) == len(URLS) + 6
        for r in got:
            url = URLS[0] if r.page_id is None else (URLS + URLS[:5])[r.page_id]
            assert (r.host, r.path, r.rule, r.verdict, r.pattern) == plain_verdict(url, url_filters.HOSTS, given), (url, given)


def test_url_filters_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filters.judged(pages, url_filters.rule_table(spark, [], [])).collect()] == ["allow"]
    assert url_filters.judged(pages.limit(0), url_filters.rule_table(spark)).count() == 0


def test_url_rules_lie_under_their_rarest_token(spark):
    rules = url_filters.compiled(url_filters.rule_table(spark, [("block", "a.example.net/en")], ["/common/rare/", "*open", "||seen.common|"]))
    counts = spark.createDataFrame([("common", 9), ("rare", 2), ("example", 3), ("net", 9), ("a", 4), ("en", 1), ("seen", 5)], "token string, n long")
    # the end of en is open, so that english has no such token
    assert {r.rule: r.under for r in url_filters.indexed(rules, counts).collect()} == {"a.example.net/en": "example", "/common/rare/": "rare", "*open": "", "||seen.common|": "seen"}


def test_url_filters_plan_has_no_python(spark):
    df = url_filters.op12_rarest_token(spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def apart(a, b):
    """Whether one insertion, deletion or replacement makes a to b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(counts):
    near = {w: [x for x in counts if apart(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], form[w] and counts[form[w]], root)
    return out


def vocabulary(seed, letters, sizes, n):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice([3, 4, 6, 12, 25, 99]) for _ in range(n)}


@pytest.mark.parametrize(("letters", "sizes", "n", "size"), [("ab", (5, 6, 7), 90, 10), ("abc", (5, 6, 7, 8), 500, 40), ("aéÿ", (5, 6, 9), 300, 10_000), ("a", (5, 6, 7, 8, 9, 30, 31), 30, 2)])
def test_variants_brute_force(spark, letters, sizes, n, size):
    """Small shards make hot halves that are asked in parts."""
    counts = vocabulary(5, letters, sizes, n)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    forms = spelling.formed(words, size).cache()
    roots = dict(map(tuple, spelling.rooted(forms.where("form is not null")).collect()))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, roots.get(r.word, r.word)) for r in forms.collect()}
    assert got == plain_variants(counts)
    pairs = sorted(map(tuple, spelling.near_words(words, size).select("word", "near").collect()))
    assert pairs == sorted((a, b) for a in counts for b in counts if apart(a, b))


def test_words_of_documents(spark):
    rng = random.Random(8)
    some = [*vocabulary(6, "abé", (4, 5, 6), 12), "Straße", "×÷×÷×", "x" * 5000]
    texts = [(k, rng.choice(["", " ", "-", "1"]).join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(some, k=rng.randrange(60)))) for k in range(200)]
    texts += [(None, "nullid nullid nullid"), (5, None), (6, ""), (7, "again again again"), (7, "again again again")]
    counts = Counter()
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    docs = spark.createDataFrame([(*t, "a", 1) for t in texts], "doc_id long, text string, word string, n int")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs).collect()}
    assert got == plain_variants(want)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({"tapes", "taps", "tops", "topes", "top"})
    a = spelling.Automaton(words)
    assert [a._rest(a.start, w, 0) for w in words] == list(range(5)) and a._rest(a.start, "to", 0) == -1
    # states that have the same endings are one: start, t, ta, tap, to, top, p e, end
    assert len(a.arcs) == len({(f, tuple((c, t) for c, (t, _) in x.items())) for f, x in zip(a.final, a.arcs, strict=True)})
