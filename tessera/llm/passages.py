"""Operator 3: fuzzy repeated passages by seeds, collinear chains and their alignment.

Seeds are five-word shingles, chosen as minimisers of windows of SPAN, so that any SPAN + 4 words that two texts share
hold a shared seed. Seeds meet by hash; each occurrence is linked to the one in the smallest document (within a batch
first, so that of a seed that every document has each batch sends the occurrences in one document), which is enough to tell
what repeats where seeds are rare, and grows with the occurrences, not with their pairs. Seeds that several documents have meet again
with the 5 and the 20 words before and after them (CONTEXTS), each time linked to the smallest document that has these too, so that
passages of common phrases find the document that has the passage. The links between two documents are chained: in order of
position a Fenwick tree over the other document's positions gives the best chain to go on from, less a cost for the gap.
Chains are cut at wide gaps and aligned word by word, by one-byte word hashes that seeds
carry for the REACH words before and after them; gaps of unlike length count the words that match at both ends. A passage
whose aligned words reach SIMILAR of its length stands; runs of united passages shorter than LEAST words are dropped.

Defined cases: null and empty texts have no words; of equal documents all but the smallest id repeat; rows with one
doc_id never repeat each other; null doc_ids come last; rows that repeat are reported each; an empty
table gives an empty result; other columns are ignored. Every exact repeat of LEAST words is found in any layout of the table; which of
several smaller documents is named, and so the rim of a passage with edits, can depend on the layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import WORDS, column_bytes, table
from tessera.llm.licenses import shingle_hashes, sliding_min

K, SPAN, REACH = 5, 19, 20
SIMILAR, PART, LEAST = 0.8, 25, 50
WEIGHT, GAP, WIDE, SHIFT = 8.0, 0.1, 40, 8
CHUNK = 1_000_000
LAST = (1 << 63) - 1
_POS = np.uint64((1 << 26) - 1)
_SIGN = np.uint64(1 << 63)
#: Words around a seed, as columns of its surroundings, that it must share with a partner, besides the seed itself.
CONTEXTS = [(REACH - 5, REACH), (REACH, REACH + 5), (0, REACH), (REACH, 2 * REACH)]
#: Kinds of rows; NEAR + n are seeds keyed with the n-th context, whose words their surroundings leave out.
SEED, LINK, DOC, NEAR = 0, 1, 2, 3
DDL = "key long, kind byte, body binary"
SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int8()), ("body", pa.binary())])
#: Bodies sort as bytes: document (sign bit turned), row, then for DOC and LINK which of the two.
_OWN = [("doc", ">u8"), ("row", ">u8")]
_DOC = np.dtype([*_OWN, ("link", "u1"), ("words", ">u4"), ("times", ">u4")])
_LINK = np.dtype([*_OWN, ("link", "u1"), ("pos", ">u4"), ("other", ">u8"), ("other_row", ">u8"), ("other_pos", ">u4"), ("before", ">u4"), ("after", ">u4")])


def _seen(kind: int) -> list[int]:
    """Columns of the surroundings that rows of a kind carry."""
    a, b = CONTEXTS[kind - NEAR] if kind >= NEAR else (0, 0)
    return [k for k in range(2 * REACH) if not a <= k < b]


def _seed(kind: int) -> np.dtype:
    return np.dtype([*_OWN, ("pos", ">u4"), ("around", "u1", len(_seen(kind)))])


class Numbers:
    def __init__(self, most: int = 500_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.translate(WORDS).split() if text else []
        if len(self.seen) > self.most:
            self.seen.clear()
        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        for w in set(words):
            if w not in seen:
                seen[w] = digest(w)
        return np.array([seen[w] for w in words], np.uint64)


def packed(kind: int, key: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
    n = len(body)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(body.dtype.itemsize), n, [None, pa.py_buffer(body.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(n, kind, np.int8)), raw], schema=SCHEMA)


def filled(dtype: np.dtype, n: int, **cols) -> np.ndarray:
    out = np.zeros(n, dtype)
    for name, x in cols.items():
        out[name] = x
    return out


def bodies(batch: pa.RecordBatch, dtype: np.dtype) -> np.ndarray:
    """Bodies of one kind; of a filtered batch, whose bodies lie end to end."""
    col = batch.column(2)
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype)


def unpacked(batch: pa.RecordBatch, kind: int) -> dict[str, np.ndarray]:
    """Seed rows; the words of a context, alike in all rows of a key, are ones."""
    body = bodies(batch, _seed(kind))
    around = np.ones((len(body), 2 * REACH), np.uint8)
    around[:, _seen(kind)] = body["around"]
    return {"key": batch.column(0).to_numpy(zero_copy_only=False), "doc": body["doc"].astype(np.uint64), "row": body["row"].astype(np.uint64), "pos": body["pos"].astype(np.int64), "around": around}


def address(doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The key of the rows of a document."""
    x = (doc * np.uint64(0x9E3779B97F4A7C15)) ^ row
    return x ^ (x >> np.uint64(32))


def seeds(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, position and surroundings of the seeds of several texts."""
    every = np.concatenate([*numbers, np.empty(0, np.uint64)])
    of = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
    if len(every) < SPAN + K - 1:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e, np.empty((0, 2 * REACH), np.uint8)
    h = shingle_hashes(every, K)
    inside = of[: len(h) - SPAN + 1] == of[SPAN + K - 2 :][: len(h) - SPAN + 1]
    chosen = sliding_min((h & ~_POS) | np.arange(len(h)).astype(np.uint64), SPAN)[inside]
    at = np.unique((chosen & _POS).astype(np.int64))
    starts = np.concatenate(([0], np.cumsum([len(n) for n in numbers])))
    bytes_ = np.concatenate((np.zeros(REACH, np.uint8), (every % np.uint64(255)).astype(np.uint8) + 1, np.zeros(REACH + K, np.uint8)))
    idx = np.concatenate((np.arange(-REACH, 0), np.arange(K, K + REACH)))
    where = at[:, None] + idx[None, :]
    around = bytes_[where + REACH]
    around[(where < starts[of[at]][:, None]) | (where >= starts[of[at] + 1][:, None])] = 0
    return h[at], of[at], at - starts[of[at]], around


def agreeing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the words before (nearest first) and after that agree."""
    same = (a == b) & (a != 0)
    bit = (1 << np.arange(REACH, dtype=np.int64))[None, :]
    return (same[:, :REACH][:, ::-1] * bit).sum(axis=1), (same[:, REACH:] * bit).sum(axis=1)


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to their rows: one for the document, links inside the batch, of each hash the seed rows of the smallest document. Rows that repeat in a batch are read once."""
    number = Numbers()
    for batch in batches:
        texts = column_bytes(batch, "text")
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SIGN
        rows = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts], np.uint64)
        if not len(rows):
            continue
        _, first_at, times = np.unique(np.stack((docs, rows)), axis=1, return_index=True, return_counts=True)
        docs, rows, texts = docs[first_at], rows[first_at], [texts[k] for k in first_at.tolist()]
        sizes, held, parts, first, waiting = [], [], [], 0, 0
        for k, t in enumerate(texts):
            held.append(number(t))
            sizes.append(len(held[-1]))
            waiting += sizes[-1]
            if waiting >= CHUNK or k == len(texts) - 1:
                h, of, pos, around = seeds(held)
                parts.append((h, of + first, pos, around))
                held, first, waiting = [], k + 1, 0
        yield packed(DOC, address(docs, rows), filled(_DOC, len(texts), doc=docs, row=rows, words=sizes, times=times))
        h, of, pos, around = (np.concatenate([p[i] for p in parts]) for i in range(4))
        if not len(h):
            continue
        order = np.lexsort((pos, rows[of], docs[of], h))
        of = of[order]
        c = {"key": h[order], "doc": docs[of], "row": rows[of], "pos": pos[order], "around": around[order]}
        lead = leads(c["key"])
        mine = c["doc"] == c["doc"][lead]  # links() has the others
        yield sent(c, np.flatnonzero(mine), SEED, c["key"][mine])
        yield links(c, lead)
        shared = np.zeros(len(lead), bool)
        shared[lead[~mine]] = True
        yield from contexts({k: v[shared[lead]] for k, v in c.items()})


def leads(key: np.ndarray) -> np.ndarray:
    """Of each row the first with its key; keys are sorted."""
    return np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))


def sent(c: dict[str, np.ndarray], i: np.ndarray, kind: int, key: np.ndarray) -> pa.RecordBatch:
    return packed(kind, key, filled(_seed(kind), len(i), around=c["around"][i][:, _seen(kind)], **{k: c[k][i] for k in ("doc", "row", "pos")}))


def contexts(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of seeds that several documents have, sorted by seed and document: keyed by the seed with each of CONTEXTS that lies
    within the text, the rows of each key's smallest document; links of the others to it, but those that an earlier key gave."""
    if not len(c["key"]):
        return
    known = [leads(c["key"])]
    for n, (a, b) in enumerate(CONTEXTS):
        at = np.flatnonzero((c["around"][:, a:b] != 0).all(axis=1))
        if not len(at):
            continue
        key = c["key"][at].view(np.uint64) ^ np.uint64((n + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        for k in range(a, b):
            key = (key ^ c["around"][at, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        order = np.lexsort((at, key))
        at, key = at[order], key[order]
        target = np.arange(len(c["key"]))
        target[at] = at[leads(key)]
        mine = c["doc"][at] == c["doc"][target[at]]
        yield sent(c, at[mine], NEAR + n, key[mine])
        new = np.ones(len(target), bool)
        for t in known:
            new &= target != t
        yield links(c, np.where(new, target, np.arange(len(target))))
        known.append(target)


def links(c: dict[str, np.ndarray], lead: np.ndarray) -> pa.RecordBatch:
    """Of rows in other documents than their leads."""
    i = np.flatnonzero(c["doc"] != c["doc"][lead])
    j = lead[i]
    before, after = agreeing(c["around"][i], c["around"][j])
    doc, row = c["doc"][i], c["row"][i]
    return packed(LINK, address(doc, row), filled(_LINK, len(i), doc=doc, row=row, link=1, pos=c["pos"][i], other=c["doc"][j], other_row=c["row"][j], other_pos=c["pos"][j], before=before, after=after))


def meet(kinds: tuple[int, ...]):
    """Over rows sorted by key: those of the kinds with one key are linked to the first; the others pass. Seeds that meet go on by their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_row: dict[int, dict[str, np.ndarray]] = {}
        for batch in batches:
            of = batch.column(1).to_numpy(zero_copy_only=False)
            if not (own := np.isin(of, kinds)).all():
                yield batch.filter(pa.array(~own))
            for kind in kinds:
                if not (mine := of == kind).any():
                    continue
                c = unpacked(batch.filter(pa.array(mine)), kind)
                if kind in lead_row and lead_row[kind]["key"][0] == c["key"][0]:
                    c = {k: np.concatenate((lead_row[kind][k], v)) for k, v in c.items()}
                lead = leads(c["key"])
                lead_row[kind] = {k: v[lead[-1] : lead[-1] + 1].copy() for k, v in c.items()}
                found = links(c, lead)
                if found.num_rows:
                    yield found
                if kind == SEED:
                    several = np.bincount(lead, minlength=len(lead))[lead] > 1
                    yield from contexts({k: v[several] for k, v in c.items()})

    return run


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def get(self, before: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while before > 0:
            out = max(out, self.best[before])
            before -= before & -before
        return out


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Ordered matches (x ascending, y ascending within equal x) as disjoint chains of indexes, best first."""
    ranks = {v: k for k, v in enumerate(sorted(set(y)))}
    tree, score, back = Fenwick(len(ranks)), [0.0] * len(x), [-1] * len(x)
    i = 0
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:  # matches of one word can't follow each other
            value, prev = tree.get(ranks[y[j]])
            value -= GAP * (x[j] + y[j])
            score[j], back[j] = (WEIGHT + value, prev) if value > 0 else (WEIGHT, -1)
            j += 1
        for k in range(i, j):
            tree.put(ranks[y[k]], (score[k] + GAP * (x[k] + y[k]), k))
        i = j
    used, out = [False] * len(x), []
    for end in sorted(range(len(x)), key=lambda k: (-score[k], k)):
        chain, k = [], end
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = back[k]
        if chain:
            out.append(chain[::-1])
    return out


def run_of(bits: int) -> int:
    """Leading agreeing words."""
    return ((~bits) & (bits + 1)).bit_length() - 1


def extension(bits: int) -> tuple[int, int]:
    """The longest stretch that ends in an agreement and agrees to SIMILAR: its length, its agreeing words."""
    best, hits = (0, 0), 0
    for k in range(REACH):
        if bits >> k & 1:
            hits += 1
            if hits >= SIMILAR * (k + 1):
                best = (k + 1, hits)
    return best


def passages(x: list[int], y: list[int], before: list[int], after: list[int]) -> list[tuple[int, int, int]]:
    """start, end, aligned words of the passages of one pair of documents."""
    out = []
    for chain in chains(x, y):
        cuts = [0, *(k for k in range(1, len(chain)) if (dx := x[chain[k]] - x[chain[k - 1]]) > WIDE or (dy := y[chain[k]] - y[chain[k - 1]]) > WIDE or abs(dx - dy) > SHIFT), len(chain)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = chain[a:b]
            left, hits = extension(before[part[0]])
            hits += K
            for p, q in zip(part, part[1:], strict=False):
                dx, dy = x[q] - x[p], y[q] - y[p]
                gap = min(dx, dy) - K
                if gap < 0:
                    hits += max(0, min(dx, dy))
                elif dx == dy:
                    near = min(gap, REACH)
                    rest = min(gap - near, REACH)
                    hits += K + (after[p] & ((1 << near) - 1)).bit_count() + (before[q] & ((1 << rest) - 1)).bit_count()
                else:
                    hits += K + min(gap, run_of(after[p]) + run_of(before[q]))
            right, more = extension(after[part[-1]])
            start, end = x[part[0]] - left, x[part[-1]] + K + right
            if end - start >= PART and hits + more >= SIMILAR * (end - start):
                out.append((start, end, hits + more))
    return out


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """start, end, smallest other document, of overlapping or touching spans; short runs go."""
    out: list[list[int]] = []
    for a, b, other in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][2] = max(b, out[-1][1]), min(other, out[-1][2])
        else:
            out.append([a, b, other])
    return [tuple(s) for s in out if s[1] - s[0] >= LEAST]


def chain_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and body, so by document (its own row first): as many rows as the document has."""
    now: tuple[int, int] | None = None
    sizes: list[tuple[int, int]] = []
    held: list[np.ndarray] = []

    def done() -> list[tuple]:
        spans = []
        if held:
            m = np.unique(np.concatenate(held), axis=0)  # other, other_row, pos, other_pos, before, after
            cut = np.flatnonzero((np.diff(m[:, :2], axis=0) != 0).any(axis=1)) + 1
            for part in np.split(m, cut):
                spans += [(a, b, int(part[0, 0])) for a, b, _ in passages(*(part[:, k].tolist() for k in range(2, 6)))]
        runs = united(spans)
        doc = None if now[0] == LAST else now[0]
        row = (doc, sizes[0][0], sum(b - a for a, b, _ in runs), len(runs), ",".join(f"{a}:{b}:{o}" for a, b, o in runs))
        return [row] * sum(t for _, t in sizes)

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 10_000):
            cols = list(zip(*rows[at : at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.string(),), strict=True)], ["doc_id", "n_words", "n_repeated", "n_passages", "passages"])

    def signed(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) ^ _SIGN).view(np.int64)

    for batch in batches:
        n = batch.num_rows
        own = batch.column(1).to_numpy(zero_copy_only=False) == DOC
        doc, row, at = np.empty(n, np.int64), np.empty(n, np.uint64), np.empty(n, np.int64)
        told, met = (bodies(batch.filter(pa.array(m)), t) for m, t in ((own, _DOC), (~own, _LINK)))
        for m, x in ((own, told), (~own, met)):
            doc[m], row[m], at[m] = signed(x["doc"]), x["row"].astype(np.uint64), np.arange(len(x))
        links_ = np.stack([signed(met["other"]), met["other_row"].astype(np.uint64).view(np.int64), *(met[k].astype(np.int64) for k in ("pos", "other_pos", "before", "after"))], axis=1)
        edge = np.flatnonzero((doc[1:] != doc[:-1]) | (row[1:] != row[:-1])) + 1
        rows: list[tuple] = []
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), n], strict=True):
            if now != (int(doc[a]), int(row[a])):
                rows += done() if now else []
                now, sizes, held = (int(doc[a]), int(row[a])), [], []
            mine = own[a:b]
            sizes += [(int(told["words"][k]), int(told["times"][k])) for k in at[a:b][mine].tolist()]
            if not mine.all():
                held.append(links_[at[a:b][~mine]])
        yield from out(rows)
    if now:
        yield from out(done())


def repeated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_repeated, n_passages, passages (first word:end:smallest other doc_id found)."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("string").alias("text"))
    met = source.mapInArrow(read, DDL)
    for kinds in ((SEED,), tuple(range(NEAR, NEAR + len(CONTEXTS)))):
        met = met.repartition("key").sortWithinPartitions("key", "kind", "body").mapInArrow(meet(kinds), DDL)
    dealt = met.repartition("key").sortWithinPartitions("key", "body")
    return dealt.mapInArrow(chain_up, "doc_id long, n_words long, n_repeated long, n_passages long, passages string")


def op3_collinear_chains(spark, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
