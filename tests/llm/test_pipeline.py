"""Each stage of the corpus pipeline against a plain version, on rows with null, repeated and clashing parts."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, mixing, pii, quality

SF = "/root/testdata/sf0.01"
DDL = "doc_id long, text string, lang string, source string, n_chars long, `__key` string, `__new` string, `__hits` string, fp string, `a.b` map<string,int>"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(6))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(31)
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 160").orderBy("doc_id").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    texts = real + bench + [None, "", " \n", "call (624) 555-3650 or write a.b@mail.example.com", " ".join(word(rng) for _ in range(30_000))]
    ids = [*range(len(texts))]
    out = list(zip(ids, texts, strict=True))
    out += [(3, texts[3]), (3, texts[3]), (3, texts[4]), (5, texts[40] + " more"), (None, texts[6]), (None, texts[7]), (None, texts[7]), (None, None), (9, None)]
    rng.shuffle(out)
    return [(d, t, "en", rng.choice(["b", "a", "c", "é", None]), None if t is None else len(t), "k", "n", "h", "f", {"x": 1}) for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="module", autouse=True)
def one_tagger(spark):
    """Trained once for all tests here."""
    fitted = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    patch = pytest.MonkeyPatch()
    patch.setattr(pii, "fit", lambda *_: fitted)
    yield
    patch.undo()


def plain(found):
    return sorted(((r[0], r[1], r[3]) for r in found), key=str)


def test_every_stage_of_an_empty_table(spark, docs):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs.limit(0), SF)
        assert got.count() == 0, name
        assert got.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1


def test_quality_stage(spark, docs, rows):
    """The fitted numbers are taken as they are; pooling and network are done again word by word."""
    table, net = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        words = (text or "").encode().split()
        if not words:
            x = np.zeros(3 * quality.DIM + 5)
        else:
            own, shape = [], []
            for w in words:
                letters = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
                letters = bytes(b for b in letters if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)
                own.append(zlib.crc32(letters) % quality.WORDS)
                kinds = [85 if 65 <= b <= 90 else 108 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in w[:64]]
                short = bytes(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)[:12]
                shape.append(quality.WORDS + zlib.crc32(short) % quality.SHAPES)
            a, b = np.float64(table[own]), np.float64(table[shape])
            mean, form = a.mean(axis=0), b.mean(axis=0)
            repeats = np.mean([p == q for p, q in zip(own, own[1:], strict=False)]) if len(own) > 1 else 0
            x = np.concatenate((mean, form, np.abs(a - mean).mean(axis=0), [np.linalg.norm(mean), np.linalg.norm(form), repeats, len(set(own)) / len(own), np.log1p(len(own))]))
        hidden = np.tanh(((x - net.centre) / net.scale) @ net.weights[0] + net.weights[1])
        return 1 / (1 + np.exp(-(hidden @ net.weights[2] + net.weights[3][0]) / net.temperature))

    got = plain(corpus_pipeline.good_quality(spark, docs, SF).collect())
    scores = {t: score(t) for _, t, *_ in rows}
    sure = [r for r in rows if abs(scores[r[1]] - quality.THRESHOLD) > 1e-3]
    near = {r[1] for r in rows} - {r[1] for r in sure}
    assert [r for r in got if r[1] not in near] == plain(r for r in sure if scores[r[1]] >= quality.THRESHOLD)
    assert 0 < len(got) < len(rows)


def test_near_dedup_stage(spark, docs, rows):
    def print_of(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    small = [r for r in rows if len(r[1] or "") < 20_000]
    prints, root = [print_of(r[1]) for r in small], list(range(len(small)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    groups = {}
    for r, k in zip(small, root, strict=True):
        groups.setdefault(k, []).append(r)
    got = corpus_pipeline.without_near_copies(spark, docs.where("text is null or n_chars < 20000"), SF).collect()
    assert len(got) == len(groups) and got[0].__fields__ == docs.columns
    kept = [(r.doc_id, r.text) for r in got]
    for members in groups.values():
        ids = [m[0] for m in members if m[0] is not None]
        mine = [(d, t) for d, t in kept if (d, t) in {(m[0], m[1]) for m in members}]
        assert len({*mine}) == 1 and mine[0][0] == (min(ids) if ids else None)


def test_decontamination_stage(spark, docs, rows):
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate({c: c + 32 for c in range(65, 91)})) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(ws[i : i + 13]) for ws in items for i in range(max(1, len(ws) - 12)) if ws}
    sizes = {len(w) for w in windows}

    def dirty(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        hit = set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if tuple(ws[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
        return bool(hit) and 20 * len(hit) >= len(ws)

    got = plain(corpus_pipeline.decontaminated(spark, docs, SF).collect())
    assert got == plain(r for r in rows if not dirty(r[1])) and len(got) < len(rows)
    assert decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)


def test_personal_data_stage(spark, docs, rows):
    texts = sorted({t for _, t, *_ in rows if t})
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {}
    for k, t in enumerate(texts):
        out, last = "", 0
        for kind, a, b in (s.split(":") for s in found[k].spans.split(",") if s):
            a, b = int(a), int(b)
            if a >= last:
                out += t[last:a] + f"<{kind.upper()}>"
            last = max(last, b)
        want[t] = out + t[last:]
        assert {(s[0], s[1], s[2]) for s in pii.base_spans(t)} <= {(k_, int(a), int(b)) for k_, a, b in (s.split(":") for s in found[k].spans.split(",") if s)}
    held = docs.where("text is not null")
    fit_alike = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.text for r in pii.redact(fit_alike).collect()} == set(want.values())
    got = corpus_pipeline.without_personal_data(spark, docs, SF)
    assert got.columns == docs.columns and got.count() == len(rows) and got.where("text is null").count() == sum(r[1] is None for r in rows)
    mail = got.where(F.col("text").contains("a.b@mail.example.com") | F.col("text").contains("<EMAIL>")).collect()
    assert mail and all("a.b@mail.example.com" not in r.text and r.n_chars == len(r.text) for r in mail)
    assert held.count() == got.where("text is not null").count()


def test_mixing_stage(spark, docs, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    want = sorted((str(d), n, s, round(t, 6), k) for d, n, s, t, k in con.sql(mixing.ORACLE).fetchall())
    got = sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    assert got == want


def test_whole_run(spark):
    """The stages by hand give what run() gives, and the ids that pass shrink from stage to stage."""
    sf = "/root/testdata/sf0.001"
    docs, ids = spark.read.parquet(f"{sf}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and (ids is None or now <= ids)
        ids = now
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))
