"""Operator 6: exact substring dedup by induced suffix sorting of shards, with priority queues that go to disk.

A byte is removed if a LENGTH-byte string over it also starts in a document with a smaller doc_id.

1. Census. The least of the WINDOW hashes of GRAM bytes in a LENGTH-byte string is its anchor; equal strings have equal
   anchors. Anchors meet by hash: one that a single document has belongs to strings that nothing repeats.
2. Cutting. Stretches of strings with one shared anchor are cut out, equal stretches of a batch of documents told
   from the smallest document at once, and dealt to shards by anchor, so that equal strings share a shard.
3. Sorting. A shard's distinct stretches are suffix-sorted by induction. Leftmost S substrings are sorted and named; where
   names repeat, the string of names is sorted by the same induction, down to BASE names, which are sorted by doubling.
   From the sorted leftmost S suffixes the others follow, up for L and down for S, through a monotone priority queue: its
   key is the first symbol, then the rank of the suffix that a tuple was induced from. Tuples carry position and common
   prefix with the one before, which is one more than the least common prefix between their sources. Beyond HELD tuples in
   memory the queue goes to files of the shared folder, and comes back bucket by bucket. Neighbours that share LENGTH
   bytes join equal strings, whose smallest document decides.
   A shard of more than MOST bytes (many contexts of one anchor) isn't sorted: its strings are dealt on one by one.
Groups and shards follow the size of the table (about GROUP bytes each); what is common to many documents reaches a shard
once for each group at most. Common prefixes beyond LENGTH are not told apart, so they stay in one byte. In memory are a shard's text, its
types and leftmost positions, about 20 bytes a byte of text; the rest is the queue's.

Defined cases: null text is empty; rows that share a doc_id never remove from each other; null doc_ids come last; documents
under LENGTH bytes stay whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import forget_at_exit, shared_dir, table
from tessera.llm.licenses import sliding_min

LENGTH, GRAM = 50, 25
WINDOW = LENGTH - GRAM + 1
GROUP = 8 << 20
CHUNK = 1 << 20
HELD, BASE = 4 << 20, 4 << 20
MOST = 3 * GROUP
LAST = (1 << 63) - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)
ANCHOR = np.uint64((1 << 48) - 1)
_POS = np.uint64((1 << 24) - 1)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, with their sizes."""
    raw = [np.ascontiguousarray(a) for a in arrays]
    head = np.array([len(raw), *(a.nbytes for a in raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in raw))


def opened(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds), 8)
    at = 8 * (len(kinds) + 1)
    out = []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM = 16 + 8 + 1 bytes, by doubling."""
    one = data.astype(np.uint64) + np.uint64(1)
    h, power, size = one, FACTOR, 1
    kept = {1: one}
    while size < 16:
        h = h[:-size] * power + h[size:]
        power, size = power * power, 2 * size
        kept[size] = h
    n = len(data) - GRAM + 1
    b8 = pow(int(FACTOR), 8, 1 << 64)
    out = (kept[16][:n] * np.uint64(b8) + kept[8][16 : 16 + n]) * FACTOR + one[24 : 24 + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def stretches(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts laid end to end: anchor, first and last start of each stretch of strings with one anchor; ends: of each text."""
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        h = gram_hashes(part)
        least = sliding_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), WINDOW)
        starts = np.arange(len(least), dtype=np.int64) + at
        near = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(starts)) + 1]
        whole = starts + LENGTH <= np.repeat(near, np.diff(np.concatenate(([at], near))))[: len(starts)]
        starts, where = starts[whole], (least[whole] & _POS).astype(np.int64)
        if not len(starts):
            continue
        first = np.concatenate(([True], (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)))
        i = np.flatnonzero(first)
        yield h[where[i]], starts[i], starts[np.concatenate((i[1:], [len(starts)])) - 1]


def laid(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(t or b"" for t in texts), np.uint8), np.cumsum([len(t or b"") for t in texts])


def together(parts: list[tuple], n: int) -> list[np.ndarray]:
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(n)]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pair(document: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return scrambled(document.view(np.uint64) ^ scrambled(anchor))


def census(groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to (shard, blob of anchors and documents); what several documents of a batch have goes once, without a document, and is told them at once."""
    for batch in batches:
        data, ends = laid(batch.column(1).to_pylist())
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        anchor, start, _ = together(list(stretches(data, ends)), 3)
        if not len(anchor):
            continue
        own = keys[np.searchsorted(ends, start, "right")]
        anchor = anchor & ANCHOR  # six bytes: a chance meeting only adds a candidate
        order = np.lexsort((own, anchor))
        anchor, own = anchor[order], own[order]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])))
        anchor, own = anchor[new], own[new]
        lead = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        several = np.diff(np.concatenate((np.flatnonzero(lead), [len(anchor)])))[np.cumsum(lead) - 1] > 1
        first = np.flatnonzero(lead)
        first = first[np.argsort(own[first], kind="stable")]  # by document, so that the keys shrink to nothing
        yield from addressed(0, anchor[first] % np.uint64(groups), (anchor[first].astype(np.uint32), (anchor[first] >> np.uint64(32)).astype(np.uint16), own[first], several[first]))
        yield from addressed(1, own[several] % groups, (pair(own[several], anchor[several]),))


def addressed(kind: int, to: np.ndarray, arrays: tuple) -> Iterator[pa.RecordBatch]:
    """A row for each address."""
    to = to.astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    parts = [i for i in np.split(order, cuts) if len(i)]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.int32()), pa.array([int(to[i[0]]) for i in parts], pa.int64()), pa.array([squeeze(*(a[i] for a in arrays)) for i in parts], pa.binary())], ["kind", "to", "blob"])


def as_table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("blob", pa.binary())])
    return pa.Table.from_batches(list(batches), schema)


def shared(groups: int, rows: pa.Table) -> pa.Table:
    """The anchors of a shard that several documents have, told to those that said so; rows of kind 1 pass."""
    told = pa.compute.equal(rows.column("kind"), 1)
    passed, rows = rows.filter(told).select(["kind", "to", "blob"]), rows.filter(pa.compute.invert(told))
    if not rows.num_rows:
        return passed
    low, high, own, several = together([opened(b, np.uint32, np.uint16, np.int64, np.bool_) for b in rows.column("blob").to_pylist()], 4)
    anchor = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    order = np.argsort(anchor, kind="stable")
    anchor, own, several = anchor[order], own[order], several[order]
    lead = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.concatenate((lead, [len(anchor)])))
    yes = np.repeat((size > 1) | np.logical_or.reduceat(several, lead), size)
    return pa.concat_tables([passed, as_table(addressed(1, own[yes] % groups, (pair(own[yes], anchor[yes]),)))])


def cut(groups: int, docs: pa.Table, told: pa.Table) -> pa.Table:
    """Documents and their shared anchors to stretches for the shards (kind 0) and spans that are known already (kind 1)."""
    if not told.num_rows or not docs.num_rows:
        return as_table(iter(()))
    known = np.unique(np.concatenate([opened(b, np.uint64)[0] for b in told.column("blob").to_pylist()]))
    key, doc = (docs.column(c).to_numpy() for c in ("key", "doc"))
    data, ends = laid(docs.column("text").to_pylist())
    anchor, first, last = together(list(stretches(data, ends)), 3)
    if not len(anchor):
        return as_table(iter(()))
    at = np.searchsorted(ends, first, "right")
    anchor = anchor & ANCHOR
    mine = pair(key[at], anchor)
    yes = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
    anchor, first, last, at = anchor[yes], first[yes], last[yes], at[yes]
    offset = first - np.concatenate(([0], ends))[at]
    texts = [data[a : b + LENGTH].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    lowest: dict[bytes, int] = {}
    for k in np.lexsort((offset, key[at], doc[at])).tolist():
        lowest.setdefault(texts[k], k)
    lead = np.array([lowest[t] for t in texts], np.int64) if texts else np.empty(0, np.int64)
    known_ = doc[at] > doc[at[lead]] if len(lead) else np.empty(0, bool)
    out = list(addressed(1, key[at][known_] % groups, (key[at][known_], offset[known_], (last - first + LENGTH)[known_])))
    rest = np.flatnonzero(~known_)
    to = (scrambled(anchor[rest]) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    kinds, tos, blobs = [], [], []
    for part in np.split(rest[order], np.flatnonzero(np.diff(to[order])) + 1):
        if len(part):
            kinds.append(0)
            tos.append(int(scrambled(anchor[part[:1]])[0] % np.uint64(groups)))
            blobs.append(squeeze(doc[at[part]], key[at[part]], offset[part], (last - first + LENGTH)[part], np.frombuffer(b"".join(texts[k] for k in part.tolist()), np.uint8)))
    if blobs:
        out.append(pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(tos, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "to", "blob"]))
    return as_table(iter(out))


class Room:
    """Files for chunks beyond memory, in a folder that all executors share."""

    def __init__(self, folder: str):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.name, self.files = uuid.uuid4().hex, 0

    def put(self, chunks: list[np.ndarray]) -> list[tuple[str, int, int, str]]:
        """One file; of each chunk its file, place, bytes and kind."""
        self.files += 1
        path, out, at = f"{self.folder}/{self.name}-{self.files}", [], 0
        self.fs.create_dir(self.folder, recursive=True)
        with self.fs.open_output_stream(path) as f:
            for c in chunks:
                f.write(c.tobytes())
                out.append((path, at, c.nbytes, c.dtype.str))
                at += c.nbytes
        return out

    def get(self, place: tuple[str, int, int, str]) -> np.ndarray:
        path, at, size, kind = place
        with self.fs.open_input_file(path) as f:
            return np.frombuffer(f.read_at(size, at), kind)

    def close(self) -> None:
        for k in range(1, self.files + 1):
            self.fs.delete_file(f"{self.folder}/{self.name}-{k}")
        self.files = 0


class Queue:
    """A monotone priority queue of tuples (position, common prefix), by symbol, then in the order in which they come; beyond HELD tuples in memory to a room."""

    def __init__(self, symbols: int, room: Room | None, held: int):
        self.buckets: list[list] = [[] for _ in range(symbols)]
        self.room, self.held, self.now = room, held, 0

    def put(self, symbols: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> None:
        """Sorted by symbol."""
        edges = np.concatenate(([0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, [len(symbols)])).tolist() if len(symbols) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            self.buckets[symbols[a]].append((at[a:b], prefix[a:b]))
        self.now += len(at)
        if self.now > self.held and self.room is not None:
            places = [(bucket, k) for bucket in self.buckets for k, c in enumerate(bucket) if isinstance(c[0], np.ndarray)]
            written = self.room.put([x for bucket, k in places for x in bucket[k]])
            for i, (bucket, k) in enumerate(places):
                bucket[k] = (written[2 * i], written[2 * i + 1])
            self.now = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of the least symbol left."""
        at, prefix = [np.empty(0, np.int32)], [np.empty(0, np.uint8)]
        for a, p in self.buckets[symbol]:
            if isinstance(a, np.ndarray):
                self.now -= len(a)
            else:
                a, p = self.room.get(a), self.room.get(p)
            at.append(a)
            prefix.append(p)
        self.buckets[symbol] = []
        return np.concatenate(at), np.concatenate(prefix)


def lowest(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of x[first..last] for each pair, by minima of spans of powers of two."""
    out, size, span, level = np.empty(len(first), x.dtype), last - first + 1, 1, x
    power = np.frexp(size.astype(np.float64))[1] - 1
    for k in range(int(power.max(initial=-1)) + 1):
        some = np.flatnonzero(power == k)
        if len(some):
            out[some] = np.minimum(level[first[some]], level[last[some] - span + 1])
        if len(level) > span:
            level = np.minimum(level[:-span], level[span:])
        span *= 2
    return out


class Induction:
    """One pass over sorted sources in order: the suffixes before them go to the queue, with their common prefixes."""

    def __init__(self, text: np.ndarray, symbols: int, wanted: np.ndarray, room: Room | None, held: int):
        self.text, self.wanted, self.queue = text, wanted, Queue(symbols, room, held)
        self.since = np.full(symbols, -1, np.int16)  # least common prefix of the sources since the last tuple of a symbol; none yet

    def push(self, at: np.ndarray, prefix: np.ndarray, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Sources and their common prefixes with the source before; the tuples of symbol ``own`` come back."""
        mine_at, mine_prefix = [np.empty(0, np.int32)], [np.empty(0, np.uint8)]
        for k in range(0, len(at), 1 << 18):
            a, p = self._chunk(at[k : k + (1 << 18)], prefix[k : k + (1 << 18)], own)
            mine_at.append(a)
            mine_prefix.append(p)
        return np.concatenate(mine_at), np.concatenate(mine_prefix)

    def _chunk(self, at: np.ndarray, prefix: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(at > 0)
        i = i[self.wanted[at[i] - 1]]
        before = at[i] - np.int32(1)
        symbols = self.text[before]
        order = np.argsort(symbols, kind="stable")
        i, before, symbols = i[order], before[order], symbols[order]
        first = np.concatenate(([True], symbols[1:] != symbols[:-1]))[: len(symbols)]
        least = np.empty(len(i), np.int16)
        upto = np.minimum.accumulate(prefix)
        least[first] = np.minimum(self.since[symbols[first]], upto[i[first]])
        rest = np.flatnonzero(~first)
        least[rest] = lowest(prefix, i[rest - 1] + 1, i[rest])
        behind = np.concatenate((np.minimum.accumulate(prefix[::-1])[::-1][1:].astype(np.int16), [LENGTH]))
        if len(prefix):
            self.since = np.minimum(self.since, upto[-1])
        ends = np.flatnonzero(np.concatenate((first[1:], [True]))[: len(symbols)])
        self.since[symbols[ends]] = behind[i[ends]]
        new = np.minimum(least + 1, LENGTH).astype(np.uint8)
        mine = symbols == own
        if mine.any():
            self.queue.put(symbols[~mine], before[~mine], new[~mine])
            return before[mine], new[mine]
        self.queue.put(symbols, before, new)
        return before[:0], new[:0]

    def bucket(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbol's suffixes and common prefixes; runs of the symbol induce each other."""
        at, prefix = [], []
        now = self.queue.take(symbol)
        while len(now[0]):
            at.append(now[0])
            prefix.append(now[1])
            now = self.push(*now, symbol)
        return np.concatenate([*at, np.empty(0, np.int32)]), np.concatenate([*prefix, np.empty(0, np.uint8)])


def kinds_of(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S); the empty one at the end is smallest of all."""
    n = len(text)
    if not n:
        return np.empty(0, bool)
    up = np.concatenate((text[:-1] < text[1:], [False]))
    decided = np.where(np.concatenate((text[:-1] == text[1:], [False])), n, np.arange(n))
    return up[np.minimum.accumulate(decided[::-1])[::-1]]


def run_length(text: np.ndarray, at: int) -> int:
    part = text[at : at + LENGTH]
    other = part != part[0]
    return int(other.argmax()) if other.any() else len(part)


def named(text: np.ndarray, starts: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the leftmost S substrings and, in that order, their names (equal ones share one).

    Of two of which one begins the other the shorter is larger, so missing symbols count as largest; but the last
    one of the text ends it, and is smaller.
    """
    m, wide = len(starts), 8 if text.dtype == np.uint8 else 1
    size = np.concatenate((starts[1:], [len(text) - 1])).astype(np.int64) - starts + 1
    padded = np.concatenate((text, np.zeros(wide, text.dtype)))
    last = np.arange(m) == m - 1

    def word(which: np.ndarray, k: int) -> np.ndarray:
        at = np.minimum(starts[which].astype(np.int64) + k * wide, len(text))
        beyond = size[which][:, None] <= k * wide + np.arange(wide)[None, :]
        if wide == 1:
            return np.where(beyond[:, 0], np.where(last[which], -1, symbols), padded[at].astype(np.int64))
        got = np.lib.stride_tricks.sliding_window_view(padded, 8)[at]
        got = np.where(beyond, np.where(last[which], 0, 255)[:, None], got).astype(np.uint8)
        return got.view(">u8")[:, 0].astype(np.uint64)

    first = word(np.arange(m), 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    rank = np.concatenate(([0], np.cumsum(first[1:] != first[:-1])))
    k = 1
    while True:
        tie = rank[1:] == rank[:-1]
        open_ = np.concatenate((tie, [False])) | np.concatenate(([False], tie))
        some = np.flatnonzero(open_)
        some = some[size[order[some]] > k * wide] if len(some) else some
        if not len(some):
            break
        group = np.flatnonzero(open_ & np.isin(rank, rank[some]))
        w = word(order[group], k)
        turn = np.lexsort((w, rank[group]))
        order[group], w = order[group][turn], w[turn]
        new = np.concatenate(([True], rank[1:] != rank[:-1]))
        new[group[1:]] |= w[1:] != w[:-1]
        rank = np.cumsum(new) - 1
        k += 1
    # the last one ends the text: alone, and before those it ties with
    tied = np.flatnonzero(rank == rank[np.flatnonzero(order == m - 1)[0]])
    if len(tied) > 1:
        order[tied] = np.concatenate(([m - 1], order[tied][order[tied] != m - 1]))
        new = np.concatenate(([True], rank[1:] != rank[:-1]))
        new[tied[1]] = True
        rank = np.cumsum(new) - 1
    return order, rank


def doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names by its first LENGTH names, by doubling; what is told apart isn't sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    at = names[order]
    group = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
    rank[order] = group
    k = 1
    while k < LENGTH:
        tie = group[1:] == group[:-1]
        some = np.flatnonzero(np.concatenate((tie, [False])) | np.concatenate(([False], tie)))
        if not len(some):
            break
        nxt = rank[np.minimum(order[some] + k, n)]
        turn = np.lexsort((nxt, group[some]))
        order[some], nxt = order[some][turn], nxt[turn]
        new = np.concatenate(([True], group[1:] != group[:-1]))
        new[some[1:]] |= nxt[1:] != nxt[:-1]
        group = np.cumsum(new) - 1
        rank[order] = group
        k *= 2
    return order


def leftmost(text: np.ndarray, symbols: int, s: np.ndarray, room: Room | None, held: int, base: int) -> np.ndarray:
    """The leftmost S positions in the order of their suffixes."""
    starts = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    if len(starts) < 2:
        return starts
    order, rank = named(text, starts, symbols)
    if rank[-1] + 1 == len(starts):
        return starts[order]
    names = np.empty(len(starts), np.int32)
    names[order] = rank
    if len(names) <= base:
        return starts[doubled(names)]
    return starts[induced(names, int(rank[-1]) + 1, room, held, base)[0]]


def induced(text: np.ndarray, symbols: int, room: Room | None = None, held: int = HELD, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order (by LENGTH symbols at least) and of each the common prefix with the one before, LENGTH at most."""
    n, s = len(text), kinds_of(text)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.uint8)
    lms = leftmost(text, symbols, s, room, held, base)
    shares = neighbours(text, lms)
    cut = np.searchsorted(text[lms], np.arange(symbols + 1))
    up = Induction(text, symbols, ~s, room, held)
    up.queue.put(text[n - 1 :], np.array([n - 1], np.int32), np.zeros(1, np.uint8))  # the last suffix is L
    up.since[text[n - 1]] = 0
    larger: list = []
    for c in range(symbols):
        at, prefix = up.bucket(c)
        own, p = lms[cut[c] : cut[c + 1]], shares[cut[c] : cut[c + 1]].copy()
        if len(own):
            p[0] = min(run_length(text, int(at[-1])), run_length(text, int(own[0]))) if len(at) else 0
            up.push(own, p)
        larger.append(room.put([at, prefix]) if room is not None and len(at) > held else (at, prefix))
    down = Induction(text, symbols, s, room, held)
    parts: list = []
    for c in range(symbols - 1, -1, -1):
        at, prefix = down.bucket(c)
        big, p = (x if isinstance(x, np.ndarray) else room.get(x) for x in larger[c])
        larger[c] = None
        seam = min(run_length(text, int(big[-1])), run_length(text, int(at[-1]))) if len(big) and len(at) else 0
        if len(big):
            down.push(big[::-1], np.concatenate(([seam], p[:0:-1])).astype(np.uint8))
        # from the smallest on, each shares with the one before it what it shared with the one after it
        small = np.concatenate(([seam], prefix[:0:-1])).astype(np.uint8) if len(at) else prefix
        parts.append((np.concatenate((big, at[::-1])), np.concatenate((p, small))))
    parts.reverse()
    return np.concatenate([a for a, _ in parts]), np.concatenate([p for _, p in parts])


def neighbours(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each position in order what its suffix shares with the one before, LENGTH at most."""
    out = np.zeros(len(order), np.uint8)
    if text.dtype != np.uint8:
        return out  # names carry no common prefixes
    n = len(text)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(64, np.uint8))), 8)
    some = np.arange(1, len(order))
    for k in range(0, LENGTH, 8):
        a, b = order[some].astype(np.int64) + k, order[some - 1].astype(np.int64) + k
        x = windows[np.minimum(a, n)].view(">u8")[:, 0] ^ windows[np.minimum(b, n)].view(">u8")[:, 0]
        same = np.full(len(x), 8)
        for j in range(8):  # the first byte that differs
            same[(same == 8) & (x >> np.uint64(56 - 8 * j) != 0)] = j
        same = np.minimum(same, np.maximum(n - np.maximum(a, b), 0))
        out[some] += same.astype(np.uint8)
        some = some[same == 8]
        if not len(some):
            break
    return np.minimum(out, LENGTH)


def spans_of(groups: int, parts: list[list[np.ndarray]], room: Room, held: int, base: int) -> Iterator[pa.RecordBatch]:
    """The stretches of a shard to the spans that a smaller document has too."""
    doc, key, offset, size, data = together(parts, 5)
    starts = np.cumsum(size) - size
    raw = data.tobytes()
    distinct: dict[bytes, int] = {}
    number = np.array([distinct.setdefault(raw[a : a + n], len(distinct)) for a, n in zip(starts.tolist(), size.tolist(), strict=True)], np.int64)
    texts = list(distinct)
    least = np.full(len(texts), LAST, np.int64)
    np.minimum.at(least, number, doc)
    text = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    own = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    order, prefix = induced(text, 256, room, held, base)
    whole = np.flatnonzero(order + LENGTH <= (at + sizes)[own[order]])
    best = np.empty(len(text), np.int64)
    if len(whole):
        # what lies between two whole strings counts in what they share
        shared_ = np.minimum.reduceat(prefix[: whole[-1] + 1], np.concatenate(([0], whole[:-1] + 1)))
        order = order[whole]
        lead = np.flatnonzero(np.concatenate(([True], shared_[1:] < LENGTH)))
        best[order] = np.repeat(np.minimum.reduceat(least[own[order]], lead), np.diff(np.concatenate((lead, [len(order)]))))
    n = size - LENGTH + 1
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - begin[of]
    hit = best[at[number[of]] + step] < doc[of]
    edge = np.concatenate((of[1:] != of[:-1], [True]))
    firsts = np.flatnonzero(hit & np.concatenate(([True], edge[:-1] | ~hit[:-1])))
    lasts = np.flatnonzero(hit & (edge | ~np.concatenate((hit[1:], [False]))))
    spans = (key[of[firsts]], offset[of[firsts]] + step[firsts], lasts - firsts + LENGTH)
    yield from addressed(1, spans[0] % groups, spans)


def dealt_on(groups: int, part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The strings of stretches of a shard that is too large, each to a shard by its own hash (kind 2); equal ones of a blob once, the others told at once."""
    doc, key, offset, size, data = part
    n = size - LENGTH + 1
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    start = (np.cumsum(size) - size)[of] + step
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start])
    order = np.lexsort((doc[of], strings.view(f"S{LENGTH}")[:, 0]))
    text = [r.tobytes() for r in strings[order]]
    of, step = of[order], step[order]
    lead = np.flatnonzero([k == 0 or t != text[k - 1] for k, t in enumerate(text)])
    mine = np.repeat(lead, np.diff(np.concatenate((lead, [len(text)]))))
    later = np.flatnonzero(doc[of] > doc[of[mine]])
    yield from addressed(1, key[of[later]] % groups, (key[of[later]], offset[of[later]] + step[later], np.full(len(later), LENGTH, np.int64)))
    rest = np.flatnonzero(doc[of] == doc[of[mine]])
    to = np.array([int.from_bytes(hashlib.blake2b(text[k], digest_size=7).digest(), "big") % groups for k in rest.tolist()], np.int64)
    turn = np.argsort(to, kind="stable")
    for cut_ in np.split(turn, np.flatnonzero(np.diff(to[turn])) + 1):
        if len(cut_):
            r = rest[cut_]
            blob = squeeze(doc[of[r]], key[of[r]], offset[of[r]] + step[r], np.frombuffer(b"".join(text[k] for k in r.tolist()), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([int(to[cut_[0]])], pa.int64()), pa.array([blob], pa.binary())], ["kind", "to", "blob"])


def met_again(groups: int, parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Strings dealt on, to the spans that a smaller document has too."""
    doc, key, offset, data = together(parts, 4)
    rows = data.reshape(-1, LENGTH)
    least: dict[bytes, int] = {}
    text = [r.tobytes() for r in rows]
    for t, d in zip(text, doc.tolist(), strict=True):
        if d < least.get(t, LAST + 1):
            least[t] = d
    hit = np.flatnonzero(doc > np.array([least[t] for t in text], np.int64)) if text else np.empty(0, np.int64)
    yield from addressed(1, key[hit] % groups, (key[hit], offset[hit], np.full(len(hit), LENGTH, np.int64)))


def by_shard(groups: int, kind: int, folder: str, bounds: tuple[int, int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shard: those of the kind, a shard after the other; the others pass."""
    types = (np.int64, np.int64, np.int64, np.int64, np.uint8) if kind == 0 else (np.int64, np.int64, np.int64, np.uint8)
    room, (most, most_held, base) = Room(folder), bounds
    now, held, size, over = None, [], 0, False

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            yield from spans_of(groups, held, room, most_held, base) if kind == 0 else met_again(groups, held)

    try:
        for batch in batches:
            mine = pa.compute.equal(batch.column(0), kind)
            rest = batch.filter(pa.compute.invert(mine))
            if rest.num_rows:
                yield rest
            rows = batch.filter(mine)
            for to, blob in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if to != now:
                    yield from done()
                    now, held, size, over = to, [], 0, False
                part = opened(blob, *types)
                held.append(part)
                size += len(part[-1])
                if kind == 0 and (over or size > most):
                    over = True
                    for p in held:
                        yield from dealt_on(groups, p)
                    held, size = [], 0
        yield from done()
    finally:
        room.close()


def removed(docs: pa.Table, told: pa.Table) -> pa.Table:
    """The result rows of a group of documents."""
    key, at, size = together([opened(b, np.int64, np.int64, np.int64) for b in told.column("blob").to_pylist()], 3)
    order = np.lexsort((at, key))
    key, at, size = key[order], at[order], size[order]
    rows = []
    for own, doc, text in zip(docs.column("key").to_pylist(), docs.column("doc").to_pylist(), docs.column("text").to_pylist(), strict=True):
        text = text or b""
        a, b = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
        kept, last, runs, gone = [], 0, 0, 0
        reach = -1
        for s, e in zip(at[a:b].tolist(), (at[a:b] + size[a:b]).tolist(), strict=True):
            if s > reach:
                kept.append(text[last:s])
                runs += 1
                gone += e - s
            elif e > reach:
                gone += e - reach
            reach = last = max(reach, e)
        rows.append((None if doc == LAST else doc, len(text), gone, runs, hashlib.sha256(b"".join([*kept, text[last:]])).hexdigest()))
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.string(),), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def on_group(f, *given):
    def run(rows):
        return f(*given, rows)

    return run


def on_both(f, *given):
    def run(left, right):
        return f(*given, left, right)

    return run


def dedup(docs: DataFrame, most: int = MOST, held: int = HELD, base: int = BASE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    most: bytes of a shard that is sorted, beyond which its strings are dealt on; held: tuples of a queue in memory; base: names that are sorted without recursion.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"))
    groups = max(16, (source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP)
    source = source.withColumn("key", F.xxhash64("doc", "text"))
    blobs = "kind int, to long, blob binary"
    by_group = source.withColumn("to", F.pmod("key", F.lit(groups))).groupBy("to")
    # one query: the shuffle of the documents serves both cogroups
    told = source.select("key", "text").mapInArrow(partial(census, groups), blobs).groupBy("to").applyInArrow(on_group(shared, groups), blobs)
    pieces = by_group.cogroup(told.groupBy("to")).applyInArrow(on_both(cut, groups), blobs)
    folder = f"{shared_dir(docs.sparkSession)}/tessera-queues-{uuid.uuid4().hex}"
    forget_at_exit(docs.sparkSession, folder)
    spans = pieces
    for kind in (0, 2):
        spans = spans.repartition("to").sortWithinPartitions("to").mapInArrow(partial(by_shard, groups, kind, folder, (most, held, base)), blobs)
    return by_group.cogroup(spans.groupBy("to")).applyInArrow(on_both(removed), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_induced_sorting(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
