"""Operator 7: conversations as training windows within a token budget.

A turn is written ``<|role|>text</s>``, with a backslash before each backslash, ``<``, ``[`` and ``|``
of role and text: no control string can arise from a text, and reading back is exact. Prefix sums of the turns'
tokens choose the spans of turns that fit the budget (a turn is never split; one that is
larger than the budget has a window of its own). Each window begins with the leading system turn and, from the second
on, repeats the last turns of the window before that fit the history budget. Assistant texts are targets once:
repeated ones are masked.

Windows are made in a stream over rows sorted by conversation and turn; what is held is one
window, however long the conversation.

Defined cases: null text is empty; null role is the empty role; null conv_id is one conversation; equal
turn numbers are ordered by role and text; rows that repeat are turns of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import table

BUDGET, HISTORY = 1024, 256
_ESCAPE = re.compile(r"[\\<\[|]")
_PLAIN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|((?:\\.|[^\\|])*)\|>((?:\\.|[^\\<])*)</s>", re.S)
WINDOWS = "window long, repeated long, text string, loss array<struct<start:long,end:long>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
EXTRA = (-7, ("user", "assistant"), "</s>[INST] ok [/INST]")


def escaped(s: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", s)


def plain(s: str) -> str:
    return _PLAIN.sub(r"\1", s)


def tokens(text: str) -> int:
    """An estimate that needs no vocabulary: four bytes a token, and four tokens of markup a turn."""
    return 4 + -(-len(text.encode()) // 4)


class Conversation:
    """The windows of one conversation, as its turns come."""

    def __init__(self, conv: object, budget: int, history: int, count):
        self.conv, self.budget, self.history, self.count = conv, budget, history, count
        self.system: tuple[str, str] | None = None
        self.head = 0
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]
        self.repeated = self.number = self.seen = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        size = self.count(text)
        if not self.seen and role == "system":
            self.system, self.head = (role, text), size
        elif self.system and self.seen == 1 or not self.turns or self.sums[-1] + size + self.head <= self.budget:
            self._hold(role, text, size)
        else:
            yield self._window()
            last = len(self.turns)
            # the longest tail of turns whose tokens, with those of the new turn, fit
            room = min(self.history, self.budget - self.head - size)
            first = bisect_left(self.sums, self.sums[-1] - room) if room > 0 else last
            first = max(first, bisect_right(self.sums, self.sums[0]) - 1)
            tail = self.turns[first:]
            sizes = [b - a for a, b in zip(self.sums[first:], self.sums[first + 1 :], strict=False)]
            self.turns, self.sums, self.repeated = [], [0], len(tail) + (self.system is not None)
            for (r, t), s in zip(tail, sizes, strict=True):
                self._hold(r, t, s)
            self._hold(role, text, size)
        self.seen += 1

    def _hold(self, role: str, text: str, size: int) -> None:
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + size)

    def _window(self) -> tuple:
        out, loss, at = [], [], 0
        every = ([self.system] if self.system else []) + self.turns
        for k, (role, text) in enumerate(every):
            mark, body = f"<|{escaped(role)}|>", escaped(text)
            if role == "assistant" and k >= self.repeated:
                loss.append({"start": at + len(mark), "end": at + len(mark) + len(body)})
            out.append(f"{mark}{body}</s>")
            at += len(out[-1])
        self.number += 1
        return self.conv, self.number - 1, self.repeated, "".join(out), loss

    def end(self) -> Iterator[tuple]:
        if self.turns or (self.system and not self.number):
            yield self._window()


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, count=tokens) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, window, repeated (leading turns told before), text, loss (code point spans)."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        schema = None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("window", pa.int64()), ("repeated", pa.int64()), ("text", pa.string()), ("loss", _LOSS)])
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now is None or now.conv != conv:
                    out += now.end() if now else ()
                    now = Conversation(conv, budget, history, count)
                out += now.add(role, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if now and (out := list(now.end())):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, {WINDOWS}")


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns of a window's text."""
    return [(plain(m[1]), plain(m[2])) for m in _TURN.finditer(text)]


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows hold, read from their texts and masks, one row a conversation; the windows come as ``windows`` gives them, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def rows(done: list[list], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*((c, n, t.hexdigest(), k, h.hexdigest(), f) for c, n, t, k, h, f in done), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

        kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, number, repeated, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for s in loss:
                    part = plain(text[s["start"] : s["end"]])
                    now[3] += len(part)
                    now[4].update(part.encode())
                now[5] += len(text)
            if done:
                yield rows(done, kind)
        if now:
            yield rows([now], kind)

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_budgeted_windows(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, roles, text = EXTRA
    extra = spark.createDataFrame([(conv, k, role, text) for k, role in enumerate(roles)], "conv_id long, turn long, role string, text string")
    return read_back(windows(conversations.unionByName(extra)))
