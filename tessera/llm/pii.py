"""Operator 8: personal data by patterns, and by a character BiLSTM with CRF transitions in numpy.

Patterns find the base spans, which always stay. The network adds spans that no pattern covers (a
phone without its plus, an address spelt with (at), a card grouped with dots). It is
trained at the start from labelled spans: the base spans of a bounded sample of documents, and spans that
are written in other forms into the texts of that sample, with dates, versions, prices, plain
numbers and running text as counterexamples. Texts are decoded in overlapping windows whose
emissions are averaged with weights that fall towards the rim, after which the best path over the whole text is found.
Windows that are NEAR characters or more away from any digit, @ or spelt (at) are outside without being run: the marks that a kind
must have leave no span there, and a test holds the result against that of all windows.
That path is cut where it must be outside of any span (see ``cuts``), and its parts are solved on their own: their paths
joined are the path over the whole. The log odds of an added span against no span must reach ``sure``; it must have the
digits and marks of its kind, and be clear of the base spans.

Offsets are code points, end exclusive. Kinds: email, ip, card, phone.

Defined cases: null text is empty and has no spans; texts of any length are scanned whole; a sample
without spans leaves only the written forms to train on; an empty table gives an empty result; rows may
repeat; other columns are kept by ``redact``, whatever their names, and ignored by ``find``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from tessera.llm.base import mapped, per_batch, table

KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
#: Training texts, and characters of each that training reads, from a place that the text's hash gives.
SAMPLE, REACH = 300, 20_000


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[::-2])
    return (total + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, last := m.end()))
        else:  # the run before a failed @ is not looked at again
            last = max(last, at + 1)
        at = text.find("@", at + 1)
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end; by start, then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


TAGS = 1 + 2 * len(KINDS)  # outside, then first and inner of each kind
CHARS, EMBED, HIDDEN, WINDOW = 130, 12, 20, 64
#: Characters a window when decoding, and from one window to the next.
LONG, STEP, NEAR = 256, 192, 64
CHUNK = 400_000
#: Emissions of a character that was not run.
SURELY = np.array([100.0] + [0.0] * (TAGS - 1), np.float32)
_ALLOWED = np.array([[t == 0 or t % 2 == 1 or s in (t, t - 1) for t in range(TAGS)] for s in range(TAGS)])


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, 128).astype(np.int16)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.3, (CHARS, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in "fb":
            b = np.zeros(4 * HIDDEN)
            b[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"{d}x": rng.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN)), f"{d}h": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"{d}b": b}
        self.p = {k: q.astype(np.float32) for k, q in self.p.items()}

    def _run(self, d: str, pre: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """pre: steps x batch x gates, what the characters give to the gates."""
        steps, batch = pre.shape[:2]
        scale = np.array([0.5] * 3 * HIDDEN + [1.0] * HIDDEN, pre.dtype)
        inner = self.p[f"{d}h"] * scale
        h, c = np.zeros((batch, HIDDEN), pre.dtype), np.zeros((batch, HIDDEN), pre.dtype)
        out, tape = np.empty((steps, batch, HIDDEN), pre.dtype), []
        for t in range(steps):
            z = h @ inner
            z += pre[t] * scale
            np.tanh(z, out=z)
            g, s = z[:, 3 * HIDDEN :], z[:, : 3 * HIDDEN]
            s *= 0.5
            s += 0.5
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, c = (h, c), f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((before, i, f, o, g, tc))
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: steps x batch of codes -> steps x batch x tags."""
        e = self.p["embed"][x] if keep else None
        f, ft = self._run("f", (self.p["embed"] @ self.p["fx"] + self.p["fb"])[x], keep)
        b, bt = self._run("b", (self.p["embed"] @ self.p["bx"] + self.p["bb"])[x[::-1]], keep)
        h = np.concatenate((f, b[::-1]), axis=2)
        scores = h @ self.p["out"] + self.p["bias"]
        return (scores, (e, h, ft, bt)) if keep else scores

    def _back(self, d: str, x: np.ndarray, dout: np.ndarray, tape: list, grads: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh_next, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            (h0, c0), i, f, o, g, tc = tape[t]
            dh = dout[t] + dh_next
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            grads[f"{d}x"] += x[t].T @ dz
            grads[f"{d}h"] += h0.T @ dz
            grads[f"{d}b"] += dz.sum(axis=0)
            dx[t] = dz @ self.p[f"{d}x"].T
            dh_next, dc = dz @ self.p[f"{d}h"].T, dc * f
        return dx

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean negative log likelihood of the tag paths y (steps x batch)."""
        steps, batch = x.shape
        scores, (e, h, ft, bt) = self.emissions(x, True)
        move, start = self.p["step"], self.p["start"]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = start + scores[0]
        for t in range(1, steps):
            alpha[t] = logsumexp(alpha[t - 1][:, :, None] + move, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = logsumexp(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = logsumexp(alpha[-1], 1)
        ds = np.exp(alpha + beta - total[None, :, None])
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        cols = np.arange(batch)
        grads["start"] = ds[0].sum(axis=0)
        np.add.at(grads["start"], y[0], -1)
        for t in range(1, steps):
            grads["step"] += np.exp(alpha[t - 1][:, :, None] + move + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
            np.add.at(grads["step"], (y[t - 1], y[t]), -1)
        for t in range(steps):
            ds[t, cols, y[t]] -= 1
        grads["bias"] = ds.sum(axis=(0, 1))
        grads["out"] = np.tensordot(h, ds, ([0, 1], [0, 1]))
        dh = ds @ self.p["out"].T
        de = self._back("f", e, dh[:, :, :HIDDEN], ft, grads) + self._back("b", e[::-1], dh[::-1, :, HIDDEN:], bt, grads)[::-1]
        np.add.at(grads["embed"], x, de)
        return {k: g / batch for k, g in grads.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 16, seed: int = 8) -> Tagger:
        rng = np.random.default_rng(seed)
        m, v, n = {k: np.zeros_like(q) for k, q in self.p.items()}, {k: np.zeros_like(q) for k, q in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                i = order[at : at + 64]
                n += 1
                for k, g in self.gradient(x[i].T, y[i].T).items():
                    g = np.clip(g, -5, 5)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.002 * (g * g - v[k])
                    self.p[k] -= 1.5e-2 * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.998**n)) + 1e-8)
        self.p["step"] = np.where(_ALLOWED, self.p["step"], -1e4)
        self.p["start"] = np.where([t == 0 or t % 2 == 1 for t in range(TAGS)], self.p["start"], -1e4)
        self.p = {k: q.astype(np.float32) for k, q in self.p.items()}
        return self

    def stretches(self, parts: list[np.ndarray], marks: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Emissions of texts of any length: windows overlap and are averaged; with marks (their places in each text, ascending) only windows near one are run."""
        where = []
        for k, c in enumerate(parts):
            at = np.arange(0, max(1, len(c) - (LONG - STEP)), STEP)
            if marks is not None:
                at = at[np.searchsorted(marks[k], at + LONG + NEAR) > np.searchsorted(marks[k], at - NEAR)]
            where += [(k, a) for a in at.tolist()]
        where.sort(key=lambda w: min(LONG, len(parts[w[0]]) - w[1]))
        rim = (np.minimum(np.arange(LONG), np.arange(LONG)[::-1]) + 1).astype(np.float32)[:, None]
        sums = [np.zeros((len(c), TAGS), np.float32) for c in parts]
        weights = [np.zeros((len(c), 1), np.float32) for c in parts]
        for first in range(0, len(where), 512):
            some = where[first : first + 512]
            longest = min(LONG, len(parts[some[-1][0]]) - some[-1][1])
            x = np.full((longest, len(some)), CHARS - 1, np.int16)
            for j, (k, at) in enumerate(some):
                piece = parts[k][at : at + LONG]
                x[: len(piece), j] = piece
            got = self.emissions(x)
            for j, (k, at) in enumerate(some):
                n = min(LONG, len(parts[k]) - at)
                sums[k][at : at + n] += got[:n, j] * rim[:n]
                weights[k][at : at + n] += rim[:n]
        return [np.where(w > 0, s / np.maximum(w, 1), SURELY).astype(np.float32) for s, w in zip(sums, weights, strict=True)]

    def cuts(self, s: np.ndarray) -> np.ndarray:
        """Positions of a text where the best path is outside for certain. In a run of positions whose emissions favour outside (by
        more than transitions within spans can make up), let a path be in a span at t. If the span's part in the run ends inside it,
        leaving it out gains what t's emission does, less the best entry and exit. If it goes on beyond the run, leaving out its part on
        t's side of the run's end gains the sum there, less what entry, exit and beginning anew after the run can cost."""
        step, none = np.where(_ALLOWED, self.p["step"], np.nan), self.p["step"][0, 0]
        within = float(np.nanmax(step[1:, 1:]))
        enter, leave = float(np.nanmax(step[0, 1:])) - none, float(np.nanmax(step[1:, 0])) - none
        ends, begins = within - float(np.nanmin(step[1:, 0])), within - float(np.nanmin(step[0, 1::2]))
        begins += max(0.0, float(np.nanmax(step[2::2] - step[1::2])))  # what follows the new beginning
        gain = s[:, 0] - s[:, 1:].max(axis=1) - max(0.0, within - none)
        anew = np.concatenate((np.maximum((s[1:, 2::2] - s[1:, 1::2]).max(axis=1), 0), [0]))
        good = gain > 0
        good[:1] = good[-1:] = False  # the ends have transitions of their own
        edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        out = np.zeros(len(s), bool)
        sums = np.concatenate(([0.0], np.cumsum(np.where(good, gain, 0), dtype=np.float64)))
        size = edge[1::2] - edge[::2]
        at = np.flatnonzero(good)
        first, last = np.repeat(edge[::2], size), np.repeat(edge[1::2], size)
        beyond = begins + anew[last - 1]
        right, left = sums[last] - sums[at], sums[at + 1] - sums[first]
        out[at] = (gain[at] > enter + leave) & (right > max(enter, ends) + beyond) & (left > ends + np.maximum(leave, beyond))
        return np.flatnonzero(out)

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best tag path of one text."""
        return self.paths([s], [(True, True)])[0]

    def whole_paths(self, scores: list[np.ndarray]) -> list[list[tuple[int, np.ndarray]]]:
        """Of each text the parts of its best path between cuts, with their places; all else is outside."""
        parts, ends, where = [], [], []
        for k, s in enumerate(scores):
            if not len(s):
                continue
            at = np.concatenate(([-1], self.cuts(s), [len(s)]))
            for i in np.flatnonzero(np.diff(at) > 1).tolist():
                a, b = int(at[i]) + 1, int(at[i + 1])
                parts.append(s[a:b])
                ends.append((a == 0, b == len(s)))
                where.append((k, a))
        out: list[list] = [[] for _ in scores]
        for (k, a), path in zip(where, self.paths(parts, ends), strict=True):
            if path.any():
                out[k].append((a, path))
        return out

    def paths(self, scores: list[np.ndarray], ends: list[tuple[bool, bool]]) -> list[np.ndarray]:
        """The best tag path of each stretch; ends: whether it begins and ends its text, else outside is next to it."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
        move = np.where(_ALLOWED, self.p["step"], -1e4).astype(np.float32)
        begins, first = np.array([self.p["start"], move[0]]), 0
        while first < len(order):
            n = 1
            while first + n < len(order) and n < 4096 and len(scores[order[first + n]]) * (n + 1) <= CHUNK:
                n += 1
            some = order[first : first + n]
            first += n
            longest = len(scores[some[-1]])
            s = np.zeros((longest, n, TAGS), np.float32)
            for j, k in enumerate(some):  # right-aligned, so that all paths end together
                s[longest - len(scores[k]) :, j] = scores[k]
            begin = np.array([longest - len(scores[k]) for k in some])
            start = begins[[0 if ends[k][0] else 1 for k in some]]
            best, back = np.zeros((n, TAGS), np.float32), np.zeros((longest, n, TAGS), np.int8)
            for t in range(longest):
                moved = best[:, :, None] + move
                back[t] = moved.argmax(axis=1)
                best = np.where((begin == t)[:, None], start, moved.max(axis=1)) + s[t]
            best += np.where(np.array([ends[k][1] for k in some])[:, None], 0, move[:, 0])
            tag = best.argmax(axis=1)
            path = np.empty((longest, n), np.int64)
            for t in range(longest - 1, -1, -1):
                path[t] = tag
                tag = np.take_along_axis(back[t], tag[:, None], 1)[:, 0]
            for j, k in enumerate(some):
                out[k] = path[begin[j] :, j]
        return out


def plausible(kind: str, s: str) -> bool:
    n = len(digits_of(s))
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|[(\[]at[)\]])\s?[\w-]+(?:\.[\w-]+)+", s))
    if kind == "ip":
        return bool(re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", s))
    if kind == "card":
        return 13 <= n <= 19 and bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", s)) and luhn(digits_of(s))
    return 9 <= n <= 15 and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", s)) and bool(re.search(r"[ ().-]", s))


def written_forms(rng: np.random.Generator) -> tuple[str, str | None]:
    """One labelled form, or (kind None) one that is no personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    k = int(rng.integers(0, 16))
    if k < 3:
        return f"{w(rng.integers(2, 9))}{rng.choice(['.', '_', ''])}{d(rng.integers(0, 3))}{rng.choice(['@', '(at)', '[at]', ' (at) '])}{w(rng.integers(3, 8))}.{rng.choice(['com', 'org', 'net', 'example.com'])}", "email"
    if k < 5:
        return ".".join(str(x) for x in rng.integers(1, 256, 4)), "ip"
    if k < 7:
        body = rng.integers(0, 10, 15).tolist()
        last = next(c for c in range(10) if luhn("".join(map(str, [*body, c]))))
        s = "".join(map(str, [*body, last]))
        return rng.choice(["", " ", "-", "."]).join(s[i : i + 4] for i in range(0, 16, 4)), "card"
    if k < 10:
        return [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"+{rng.integers(1, 99)}.{d(3)}.{d(3)}.{d(4)}"][rng.integers(0, 5)], "phone"
    return [f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"v{d(1)}.{d(1)}.{d(2)}", f"${rng.integers(1, 999)},{d(3)}.{d(2)}", d(rng.integers(1, 20)), f"{d(2)}:{d(2)}:{d(2)}", f"#{d(6)}", f"@{w(6)}", f"{d(3)} {w(4)} {d(4)}", f"{d(4)}-{d(4)}", f"{d(1)}.{d(1)}"][rng.integers(0, 10)], None


def examples(texts: list[str], seed: int = 8, forms: int = 1200) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, list[tuple[str, int, int]]]] = []
    plain = [t for t in texts if len(t) > 2 * WINDOW] or ["and the other one was of that kind " * 8]
    for text in texts:
        spans = base_spans(text)
        marks = [s[1] for s in spans] or [m.start() for m in TRIGGER.finditer(text)][:2]
        for at in marks[:4]:
            a = max(0, at - int(rng.integers(0, WINDOW - 16)))
            rows.append((text[a : a + WINDOW], [(k, s - a, e - a) for k, s, e in spans]))
        for a in rng.integers(0, max(1, len(text) - WINDOW), 2).tolist():
            rows.append((text[a : a + WINDOW], [(k, s - a, e - a) for k, s, e in spans]))
    for _ in range(forms):
        form, kind = written_forms(rng)
        text = plain[rng.integers(0, len(plain))]
        at = int(rng.integers(0, len(text) - WINDOW))
        left, right = text[at : at + int(rng.integers(0, 40))], text[at + 40 : at + 40 + WINDOW]
        left, right = re.sub(TRIGGER, " ", left), re.sub(TRIGGER, " ", right)
        rows.append(((left + " " + form + rng.choice([" ", ".", ", "]) + right)[:WINDOW], [(kind, len(left) + 1, len(left) + 1 + len(form))] if kind else []))
    x, y = np.full((len(rows), WINDOW), CHARS - 1, np.int16), np.zeros((len(rows), WINDOW), np.int64)
    for j, (text, spans) in enumerate(rows):
        c = codes(text)[:WINDOW]
        x[j, : len(c)] = c
        for kind, a, b in spans:
            t = 1 + 2 * KINDS.index(kind)
            if b > 0 and a < WINDOW:
                y[j, max(a, 0) : b] = t + 1
                if a >= 0:
                    y[j, a] = t
    for j in range(len(y)):  # a span cut by the window's edge begins there
        if y[j, 0] and y[j, 0] % 2 == 0:
            y[j, 0] -= 1
    return x, y


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[str, int, int]]], sure: float = 3.0, everywhere: bool = False) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = []
    first = 0
    while first < len(texts):  # as many texts at once as CHUNK characters hold
        last, waiting = first + 1, len(texts[first])
        while last < len(texts) and waiting + len(texts[last]) <= CHUNK:
            waiting += len(texts[last])
            last += 1
        out += _added(tagger, texts[first:last], base[first:last], sure, everywhere)
        first = last
    return out


def _added(tagger: Tagger, texts: list[str], base: list[list[tuple[str, int, int]]], sure: float, everywhere: bool) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    marks = None if everywhere else [np.array([m.start() for m in TRIGGER.finditer(t)], np.int64) for t in texts]
    if marks is not None and not any(map(len, marks)):
        return out
    if marks is not None:  # texts without a mark hold no span
        some = [k for k, m in enumerate(marks) if len(m)]
        if len(some) < len(texts):
            for k, spans in zip(some, _added(tagger, [texts[k] for k in some], [base[k] for k in some], sure, everywhere), strict=True):
                out[k] = spans
            return out
    scores = tagger.stretches([codes(t) for t in texts], marks)
    move = tagger.p["step"]
    for k, parts in enumerate(tagger.whole_paths(scores)):
        for at, path in parts:
            s = scores[k][at : at + len(path)]
            for a in np.flatnonzero(path % 2 == 1).tolist():
                t = int(path[a])
                b = a + 1
                while b < len(path) and path[b] == t + 1:
                    b += 1
                span = (KINDS[t // 2], at + a, at + b)
                own = np.concatenate(([0], path[a:b], [0]))
                odds = s[np.arange(a, b), own[1:-1]].sum() + move[own[:-1], own[1:]].sum() - s[a:b, 0].sum() - (b - a + 1) * move[0, 0]
                if odds >= sure and plausible(span[0], texts[k][span[1] : span[2]]) and all(y <= span[1] or x >= span[2] for _, x, y in base[k]) and edges_clear(texts[k], *span[1:]):
                    out[k].append(span)
    return out


def edges_clear(text: str, a: int, b: int) -> bool:
    """Not in the middle of a word or number."""
    return not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


def fit(docs: DataFrame, sample: int = SAMPLE, reach: int = REACH) -> Tagger:
    """From at most ``sample`` documents with a digit or an @, by the smallest hash of their texts, and of each at most ``reach`` characters from a place that the hash gives."""
    text = F.col("text").cast("string")
    some = docs.where(text.rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), text.alias("text"))
    # hashes first: a task sends the driver no texts that are not among the sample
    chosen = [r.h for r in some.select("h").distinct().orderBy("h").limit(sample).collect()]
    place = 1 + F.pmod("h", F.greatest(F.lit(1), F.char_length("text") - reach + 1))
    read = some.where(F.col("h").isin(chosen)).select("h", F.col("text").substr(place.cast("int"), F.lit(reach)).alias("text"))
    texts = {r.h: r.text for r in read.groupBy("h").agg(F.min("text").alias("text")).collect()} if chosen else {}
    x, y = examples([texts[h] for h in chosen])
    return Tagger().train(x, y)


def all_spans(tagger: Tagger, texts: list[str | None]) -> tuple[list, list]:
    some = [t or "" for t in texts]
    base = [base_spans(t) if t else [] for t in some]
    added = added_spans(tagger, some, base)
    return base, [sorted(b + a, key=lambda s: (s[1], KINDS.index(s[0]))) for b, a in zip(base, added, strict=True)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the counts of base spans, base_sha256, spans."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, every = all_spans(held.value, batch.column(1).to_pylist())
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(s) for s in every])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        return one

    return source.mapInArrow(per_batch(make), f"doc_id {dict(source.dtypes)['doc_id']}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; n_chars, where there is one, follows."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    names = docs.columns
    at, new_name = names.index("text"), "__new" + "_" * max(map(len, names))  # longer than any other name

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            _, spans = all_spans(held.value, texts)
            new = [masked(t, s) if s else None for t, s in zip(texts, spans, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, "new"])

        return one

    out = mapped(docs, make, StructField(new_name, StringType()))
    changed = F.col(new_name).isNotNull()
    own = {"text": F.coalesce(new_name, "text"), "n_chars": F.when(changed, F.char_length(new_name).cast("long")).otherwise(F.col("n_chars") if "n_chars" in names else F.lit(None))}
    return out.select(*(own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col(f"`{c}`") for c in names))


def op8_char_bilstm_crf(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
