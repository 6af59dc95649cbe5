"""Each operator against a brute-force version, on small tables with the odd cases in them."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, fingerprints, licenses, mixing, passages, pii, quality, simhash_dedup
from tessera.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, key string, fp string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(6))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns whose names clash with the operators' own."""
    rng = random.Random(1)
    plain = [" ".join(word(rng) for _ in range(n)) for n in (1, 2, 3, 40, 200)]
    rows = [(k, t, f"s{k % 3}", "x", "y") for k, t in enumerate(plain)]
    rows += [(10, None, "s0", None, None), (11, "", None, "x", "y"), (12, " \n\t", "s1", "x", "y"), (3, plain[3], "s0", "x", "y"), (3, plain[3], "s0", "x", "y"), (None, plain[4], None, None, None), (13, plain[4], "s2", "x", "y"), (14, plain[4] * 300, "s2", "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_and_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b"), (None, "c"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = {
        "licenses": licenses.find,
        "decontaminate": lambda d: decontaminate.digest(d, items),
        "passages": passages.repeated,
        "simhash": simhash_dedup.classes,
        "quality": lambda d: quality.score(d, labels),
        "mixing": mixing.mix,
        "fingerprints": fingerprints.edited,
    }
    n = odd.count()
    for name, run in runs.items():
        assert run(odd).count() == n, name
        assert run(empty).count() == 0, name


def test_decontaminate_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [word(rng) for _ in range(6)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 7, 9])))) for k in range(12)]
    docs = [(k, " ".join(rng.choice([*vocabulary, "zzz"]) for _ in range(rng.choice([0, 5, 60])))) for k in range(60)]
    n = 5
    got = {r.doc_id: r for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n).collect()}
    for k, text in docs:
        ws, hit, found = text.split(), set(), set()
        for item, t in items:
            iw = t.split()
            size = min(n, len(iw))
            wanted = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
            for i in range(len(ws) - size + 1):
                if tuple(ws[i : i + size]) in wanted:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
        spans = {p for s in got[k].spans for p in range(s.start, s.end)}
        assert (spans, set(got[k]["items"])) == (hit, found)


def test_decontaminate_shards_and_removal(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(decontaminate.digest(docs, items).collect())
    cleaned = decontaminate.remove(docs, items).select("doc_id", F.col("left").alias("text"))
    assert decontaminate.digest(cleaned, items).agg({"n_hit": "max"}).first()[0] < 13
    kept = sorted(r.doc_id for r in decontaminate.clean(docs, items).collect())
    assert kept == sorted(r.doc_id for r in whole if not r.contaminated)
    monkeypatch.setattr(decontaminate, "SHARD", 600)
    assert sorted(decontaminate.digest(docs, items).collect()) == whole
    monkeypatch.setattr(decontaminate, "SHARD", 1200)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 2)
    again = decontaminate.clean(docs.withColumn("__spans", docs["doc_id"]), items)
    assert again.columns == [*docs.columns, "__spans"] and sorted(r.doc_id for r in again.collect()) == kept


def test_simhash_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]

    def print_of(t):
        ws = t.translate({c: c + 32 for c in range(65, 91)})
        ws = re.findall(r"[^\x20\x09-\x0D]+", ws)
        parts = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {k: print_of(t) for k, t in rows}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.op4_pivot_simhash(spark, SF).collect()}
    assert got == {k: (f"{p:016x}", find(k)) for k, p in prints.items()}


@pytest.mark.parametrize("limit", [4096, 16])
def test_links_of_dense_buckets(spark, limit):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    fps = np.unique(np.concatenate([base, *(b ^ (np.uint64(1) << rng.integers(0, 64, 60, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, np.uint64)) for b in base)]))
    edges = simhash_dedup.edges(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), 3, limit).collect()
    root = {int(f): int(f) for f in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for e in edges:
        a, b = e.a % (1 << 64), e.b % (1 << 64)
        assert (a ^ b).bit_count() <= 3
        root[max(find(a), find(b))] = min(find(a), find(b))
    for i, a in enumerate(fps.tolist()):
        for b in fps[i + 1 :].tolist():
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op5_random_indexing(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.93
    assert all(0 <= r.score <= 1 for r in scored)


def test_base_spans_brute_force():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    n = lambda m: len(pii.digits_of(m[0]))
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m: 12 <= n(m) <= 19 and pii.luhn(pii.digits_of(m[0])), "phone": lambda m: 9 <= n(m) <= 15}
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1@.-+ (b25") for _ in range(60)) for _ in range(4000)] + ["1" * 4000 + ".1.1.1", "", "a" * 5000 + "@", "4041 8949 7460 8795"]
    for t in texts:
        want = sorted(((k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if ok[k](m)), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert pii.base_spans(t) == want


def test_tagger_adds_spans_and_redacts(spark, monkeypatch):
    text = "the ande hern call (624) 555-3650 now please onte the andre"
    docs = spark.createDataFrame([(1, "mail a.b@c.example.com now, 41.143.129.254 too", 5), (2, text, 9), (3, None, 0), (4, "clean words only", 16)], "doc_id long, text string, n_chars long")
    tagger = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    monkeypatch.setattr(pii, "fit", lambda *_: tagger)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (got[1].n_email, got[1].n_ip) == (1, 1) and got[3].spans == "" and got[4].spans == ""
    assert got[2].base_sha256 == sha("")
    assert pii.added_spans(tagger, [text], [[]]) == [[("phone", 19, 33)]]
    rng, real = np.random.default_rng(15), [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 120").collect()]
    texts = [t[: len(t) // 2] + f" {pii.written_forms(rng)[0]} " + t[len(t) // 2 :] for t in real if t]
    base = [pii.base_spans(t) for t in texts]
    near = pii.added_spans(tagger, texts, base)
    assert near == pii.added_spans(tagger, texts, base, everywhere=True) and sum(map(len, near)) > 5
    # recall by kind, and false spans, on forms written into texts that training has not seen
    unseen = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 2000").select("text").limit(300).collect() if r.text]
    rng, rows = np.random.default_rng(77), []
    for t in unseen:
        at = int(rng.integers(0, min(len(t), 1500) + 1))
        form, kind = pii.written_forms(rng)
        before = t[max(0, at - 200) : at] + " "
        rows.append((before + form + " " + t[at : at + 200], kind, len(before), len(before) + len(form)))
    based = [pii.base_spans(r[0]) for r in rows]
    added = pii.added_spans(tagger, [r[0] for r in rows], based)
    found = [a + b for a, b in zip(based, added, strict=True)]
    hit = {k: [(k, a, b) in got for (_, kind, a, b), got in zip(rows, found, strict=True) if kind == k] for k in pii.KINDS}
    assert all(sum(h) >= 0.9 * len(h) for h in hit.values()), {k: (sum(h), len(h)) for k, h in hit.items()}
    assert sum(any(a <= x and y <= b for _, x, y in got) for (_, kind, a, b), got in zip(rows, added, strict=True) if kind is None) <= 2
    redacted = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert redacted[1].text == "mail <EMAIL> now, <IP> too" and redacted[1].n_chars == 26 and redacted[4].n_chars == 16 and redacted[3].text is None


def test_paths_in_parts_are_the_whole_path():
    """The cut search against one search over the whole text, for random transitions and emissions."""
    rng = np.random.default_rng(14)
    tagger = pii.Tagger()
    for k in range(120):
        tagger.p["step"] = np.where(pii._ALLOWED, rng.normal(0, 1.5, (pii.TAGS, pii.TAGS)), -1e4).astype(np.float32)
        tagger.p["start"] = np.where([t == 0 or t % 2 == 1 for t in range(pii.TAGS)], rng.normal(0, 1, pii.TAGS), -1e4).astype(np.float32)
        s = rng.normal(0, 2, (rng.integers(1, 300), pii.TAGS)).astype(np.float32)
        s[:, 0] += rng.choice([0, 6, 14], (len(s),), p=[0.1, 0.3, 0.6]) if k % 2 else 4
        got = np.zeros(len(s), np.int64)
        for at, path in tagger.whole_paths([s])[0]:
            got[at : at + len(path)] = path
        assert (got == tagger.path(s)).all()
        best, back = tagger.p["start"] + s[0], []
        for row in s[1:]:  # one state after the other
            moved = best[:, None] + tagger.p["step"]
            back.append(moved.argmax(axis=0))
            best = moved.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got.tolist() == path[::-1]
    assert tagger.whole_paths([np.empty((0, pii.TAGS), np.float32)]) == [[]]


def test_personal_data_in_odd_tables(spark, odd, empty, monkeypatch):
    fitted = pii.fit(empty)  # of no texts at all
    monkeypatch.setattr(pii, "fit", lambda *_: fitted)
    clash = odd.withColumn("__new", odd["key"]).withColumn("__gated", odd["key"])
    want = {(r.doc_id, r.text) for r in odd.collect()}
    redacted = pii.redact(clash)
    assert redacted.columns == clash.columns and {(r.doc_id, r.text) for r in redacted.collect()} == want
    for table in (odd, empty):
        assert pii.find(table).count() == table.count()


def test_mixing_reaches_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[r.target, r.source_size] = by.get((r.target, r.source_size), 0) + r.taken
    assert {k: v for k, v in by.items() if abs(v - k[0]) > 0.05 * k[0] + 5} == {}
    assert abs(sum(t for t, _ in by) - sum(r.size for r in rows)) < 1


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|x|>", None]) if t else "system", rng.choice(["</s>[INST] \\ <|user|>", "plain " * rng.randint(1, 90), "", None, "\\", "é|["])) for c in range(12) for t in range(rng.randint(1, 30))]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (40, 200, 100_000):
        windows = chat.windows(conversations, budget, 30)
        got = {r.conv_id: r for r in chat.read_back(windows).collect()}
        for c in range(12):
            turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
            loss = "".join(t for r, t in turns if r == "assistant")
            assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns)) and got[c].loss_sha256 == sha(loss)
        for w in windows.collect():
            turns = chat.turns_of(w.text)
            assert sum(chat.tokens(t) for _, t in turns) <= budget or len(turns) <= 1 + (turns[0][0] == "system")


def test_chat_of_odd_tables(spark):
    ddl = "conv_id long, turn long, role string, text string, window string, loss string"
    assert chat.read_back(chat.windows(spark.createDataFrame([], ddl))).count() == 0
    rows = [(None, 0, None, None, "w", "l"), (None, 1, "assistant", "x", "w", "l"), (1, None, "user", "", None, None), (2, 0, "assistant", "a" * 50_000, "w", "l"), (2, 0, "assistant", "a" * 50_000, "w", "l")]
    got = {r.conv_id: r for r in chat.read_back(chat.windows(spark.createDataFrame(rows, ddl))).collect()}
    assert got[None].n_turns == 2 and got[None].turns_sha256 == sha("\n\nassistant\nx\n") and got[None].loss_sha256 == sha("x")
    assert got[1].n_turns == 1 and got[1].loss_chars == 0
    assert got[2].n_turns == 2 and got[2].loss_chars == 100_000


def test_within_of_nothing(spark):
    some = spark.createDataFrame([("0" * 64,), (None,), ("f" * 64,), ("0" * 64,)], "fingerprint string")
    assert fingerprints.within(some, some.limit(0)).count() == 0 and fingerprints.within(some.limit(0), some).count() == 0
    assert {tuple(r) for r in fingerprints.within(some, some).collect()} == {("0" * 64, "0" * 64, 0), ("f" * 64, "f" * 64, 0)}


def test_edited_and_within(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited(docs).collect()}
    for k, (doc, text) in enumerate(rows):
        assert got[doc].edited_sha256 == sha(fingerprints.edited_text(text, rows[(k + 1) % len(rows)][1]))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95
    rng = random.Random(7)
    base = [rng.getrandbits(256) for _ in range(5)]
    prints = [f"{b ^ sum(1 << p for p in rng.sample(range(256), k)):064x}" for b in base for k in range(0, 20, 2)]
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    want = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in prints[:7] for b in prints if (int(a, 16) ^ int(b, 16)).bit_count() <= 12}
    assert sorted(tuple(r) for r in fingerprints.within(frame, frame.limit(7), 12).collect()) == sorted(want)


@pytest.mark.parametrize("bucket", [200_000, 8])
def test_near_counts_brute_force(spark, odd, empty, monkeypatch, bucket):
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    rng = random.Random(27)
    base = [rng.getrandbits(256) for _ in range(4)] + [0]
    prints = [f"{b ^ sum(1 << p for p in rng.sample(range(256), rng.randint(0, 6))):064x}" for b in base for _ in range(60)] + [None, f"{0:064x}"]
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint string").repartition(3)
    some = sorted({p for p in prints if p})[::3]
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {q: n for q in some if (n := sum(0 < apart(q, p) <= 7 for p in set(prints) - {None}))}
    got = fingerprints.near_counts(frame, spark.createDataFrame([(q,) for q in some], "fingerprint string"))
    assert {r.fingerprint: r.near for r in got.collect()} == want and len(want) > 40
    assert fingerprints.near_counts(frame, frame.limit(0)).count() == 0
    for t in (odd, empty):
        assert fingerprints.searched(t).count() == t.count()
    exact = {r.doc_id: fingerprints.fingerprint((r.text or "").encode()).tobytes().hex() for r in odd.where("doc_id is not null").collect()}
    for r in fingerprints.searched(odd).where("doc_id is not null").collect():
        assert r.fingerprint == exact[r.doc_id]
        every = set(exact.values()) | {r.fingerprint}
        assert r.n_near == (sum(0 < apart(r.fingerprint, e) <= 7 for e in every) if r.doc_id % 20 == 0 else None)


def test_fingerprint_by_votes():
    """The whole fingerprint against plain counting."""
    rng = random.Random(28)
    for n in (0, 1, 4, 5, 30, 400):
        ws = [rng.choice("ab cd efg Hij klm".split()) for _ in range(n)]
        terms: dict[bytes, int] = {}
        for i in range(max(1, n - 4) if n else 0):
            t = " ".join(ws[i : i + 5]).lower().encode()
            terms[t] = terms.get(t, 0) + 1
        votes = [0.0] * 256
        for t, k in terms.items():
            h = int.from_bytes(xxhash.xxh3_128_digest(t, 10) + xxhash.xxh3_128_digest(t, 11), "big")
            for b in range(256):
                votes[b] += (1 if h >> (255 - b) & 1 else -1) * (1 + np.log(k))
        got = int.from_bytes(fingerprints.fingerprint(" ".join(ws).encode()).tobytes(), "big")
        assert all((got >> (255 - b) & 1) == (votes[b] > 0) for b in range(256) if abs(votes[b]) > 1e-4)


def test_licenses_brute_force():
    rng = random.Random(8)
    names = dict(licenses.TEMPLATES)
    texts = []
    for _ in range(120):
        ws = " ".join(rng.choice(list(names.values())) if rng.random() < 0.1 else word(rng) for _ in range(30)).split()
        texts.append(" ".join(w for w in ws if rng.random() > 0.02).encode())
    scanner = licenses.Scanner()
    for text, got in zip(texts, scanner.scan(texts), strict=True):
        ws = licenses.words_of(text)
        for name, t in names.items():
            tw = licenses.words_of(t.encode())
            k = min(5, len(tw))
            of = lambda x, k=k: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
            wanted, n, s = set(of(tw)), len(tw) - k + 1, of(ws)
            assert (name in got) == any(len(wanted & set(s[i : i + n])) >= 0.8 * len(wanted) for i in range(max(1, len(s) - n + 1))), name


def test_licenses_at_the_ends_of_texts():
    """Each template whole, without its last or first words, alone and at either end of a text; recall against brute force is whole here."""
    rng, scanner, missed, n = random.Random(18), licenses.Scanner(), [], 0
    for name, t in licenses.TEMPLATES:
        ws = t.split()
        less = len(licenses.words_of(t.encode())) // 30 + 1 if len(ws) > 8 else 0
        filler = [word(rng) for _ in range(60)]
        for cut in {0, less}:
            own = [ws[: len(ws) - cut], ws[cut:]]
            texts = [" ".join(x).encode() for o in own for x in (o, filler + o, o + filler, filler + o + filler)]
            for k, got in enumerate(scanner.scan(texts)):
                n += 1
                missed += [] if name in got else [(name, cut, k)]
    assert not missed and n > 150
    assert scanner.scan([None, b"", b"mit", " ".join(word(rng) for _ in range(900)).encode()]) == [{}] * 4


def test_passages(spark):
    rng = random.Random(9)
    base = [word(rng) for _ in range(120)]
    edited = base[:]
    for i in (20, 45, 70, 95):
        edited[i] = word(rng)
    del edited[60]
    fill = lambda n: [word(rng) for _ in range(n)]
    rows = [(1, " ".join(fill(80) + base + fill(80))), (2, " ".join(fill(40) + edited + fill(60))), (3, " ".join(fill(300))), (4, " ".join(base[:30] + fill(100)))]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_passages > 0 for k in (1, 2, 3, 4)] == [False, True, False, False]
    assert 95 <= got[2].n_repeated <= 122


def test_passages_repeated_within_a_document(spark):
    rng = random.Random(21)
    fill = lambda n: [word(rng) for _ in range(n)]
    twice = fill(60)
    rows = [(1, " ".join(fill(30) + twice + fill(30))), (5, " ".join(fill(40) + twice + fill(70) + twice + fill(40)))]
    for n in (1, 2):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string")
        got = {r.doc_id: (r.n_repeated, r.n_passages) for r in passages.repeated(docs).collect()}
        assert got == {1: (0, 0), 5: (120, 2)}, n


def test_passages_of_common_phrases(spark):
    rng = random.Random(22)
    fill = lambda n: [word(rng) for _ in range(n)]
    rows, wanted = [], {}
    for k in range(12):
        passage = fill(rng.randint(55, 80))
        for at in range(0, len(passage) - 8, 3):  # every nine words are in a smaller document
            rows.append((len(rows), " ".join(fill(12) + passage[at : at + 9] + fill(12))))
        rows.append((1000 + k, " ".join(fill(30) + passage + fill(30))))
        rows.append((2000 + k, " ".join(fill(25) + passage + fill(35))))
        wanted[2000 + k] = len(passage)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    got = {r.doc_id: r.n_repeated for r in passages.repeated(docs).collect()}
    assert {k for k, n in got.items() if n} == set(wanted)
    assert all(wanted[k] <= got[k] <= wanted[k] + 2 for k in wanted), [(got[k], n) for k, n in wanted.items()]


def test_passages_catch_exact_repeats(spark):
    docs = [(r.doc_id, decontaminate.words_of(r.text.encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.n_passages for r in passages.op3_collinear_chains(spark, SF).collect()}
    seen = set()
    for doc, ws in sorted(docs):
        own = {b" ".join(ws[i : i + 50]) for i in range(len(ws) - 49)}
        assert got[doc] or not own & seen
        seen |= own


def test_chains_match_quadratic():
    rng = random.Random(4)
    for _ in range(60):
        pts = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(25)})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        best = []
        for j in range(len(pts)):
            best.append(passages.WEIGHT + max([0.0, *(best[i] - passages.GAP * (x[j] - x[i] + y[j] - y[i]) for i in range(j) if x[i] < x[j] and y[i] < y[j])]))
        chain = passages.chains(x, y)[0]
        score = passages.WEIGHT * len(chain) - passages.GAP * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(chain, chain[1:], strict=False))
        assert score == pytest.approx(max(best))


def test_pipeline_runs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        after = stage(spark, docs, SF)
        assert 0 < after.count() <= before
        assert after.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1
        docs = after


def test_near_copies_go_by_row(spark):
    import corpus_pipeline

    rng = random.Random(23)
    texts = [" ".join(word(rng) for _ in range(60)) for _ in range(12)]
    near = texts[0] + " " + word(rng)
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[3]), (4, texts[3]), (4, texts[4]), (5, near), (5, texts[5]), (None, texts[6]), (None, texts[7]), (None, texts[7]), (None, texts[1]), (6, None), (None, ""), (7, texts[8]), (7, texts[0])]
    prints = [simhash_dedup.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [min((r for r, at in zip(rows, root, strict=True) if at == c), key=key) for c in set(root)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("base", [1 << 20, 3, 0])
def test_induced_order_and_prefixes(tmp_path, base):
    """Order and common prefixes against brute force, with the queue in files and with recursion down to a few names."""
    from tessera.llm import substrings

    rng, room = random.Random(6), substrings.Room(f"file://{tmp_path}/queues")
    for _ in range(60):
        raw = "".join(rng.choice(rng.choice(["a", "ab", "abc", "abcdefgh"])) for _ in range(rng.choice([0, 1, 2, 3, 10, 60, 250]))).encode() * rng.choice([1, 1, 3])
        raw = rng.choice([raw, raw.replace(b"a", b"\xff").replace(b"b", b"\x00")])
        order, prefix = (x.tolist() for x in substrings.induced(np.frombuffer(raw, np.uint8), 256, room, rng.choice([7, 1 << 20]), base))
        assert sorted(order) == list(range(len(raw)))
        for k, (i, j) in enumerate(zip(order, order[1:], strict=False), 1):
            a, b = raw[i : i + 50], raw[j : j + 50]
            assert a <= b and prefix[k] == next((n for n in range(50) if n >= min(len(a), len(b)) or a[n] != b[n]), 50)
    assert room.files > 0
    room.close()
    assert not list((tmp_path / "queues").iterdir())


@pytest.mark.parametrize("bounds", [{}, {"held": 500, "base": 100}, {"most": 1500}])
def test_substring_dedup_brute_force(spark, odd, empty, bounds):
    """Also with shards far larger than what the queue holds in memory, and with shards whose strings are dealt on."""
    from tessera.llm import substrings

    assert substrings.dedup(empty, **bounds).count() == 0

    tables = [
        [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()],
        [(r.doc_id, r.text) for r in odd.collect()],
    ]
    rng = random.Random(12)
    base = "".join(rng.choice("ab é") for _ in range(400))
    tables.append([(k, base[rng.randint(0, 300) :][: rng.randint(0, 120)] + rng.choice(["", "a" * 70, "x"]) + base[:60]) for k in range(40)])
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(32))  # one phrase in many contexts, some of them shared
    tables.append([(k, "".join(rng.choice("klmnop") for _ in range(40)) + phrase + rng.choice(["".join(rng.choice("klmnop") for _ in range(40)), base[:40]])) for k in range(120)])
    for rows in tables:
        key = lambda d: substrings.LAST if d is None else d
        first: dict[bytes, int] = {}
        for d, t in rows:
            raw = (t or "").encode()
            for i in range(len(raw) - 49):
                w = raw[i : i + 50]
                first[w] = min(first.get(w, substrings.LAST), key(d))
        want = []
        for d, t in rows:
            raw = (t or "").encode()
            gone = np.zeros(len(raw) + 1, bool)
            for i in range(len(raw) - 49):
                if first[raw[i : i + 50]] < key(d):
                    gone[i : i + 50] = True
            kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
            want.append((str(d), len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), **bounds).collect()]
        assert sorted(got) == sorted(want)
