"""Chat formatting with budgeted windows.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside
texts get a backslash after their first character (and one more where backslashes
stand there already), which reading takes away again, so they never act as marks.

A conversation is cut into windows at turns.  Running sums of the turns' tokens (those of
``model_file``'s pieces, or words without one, and four for the marks and line ends) say
where: a window holds the system turn (a first turn with that role), up to
``history_turns`` and ``history_tokens`` of the turns before, and as many new turns as
the budget has room for, at least one: a turn beyond the budget stands alone and is
flagged.  Only new assistant texts are under the loss mask; what is repeated is masked.

Rows are dealt by conversation, sorted by Spark (which spills), and read as a stream:
a task holds one window and one turn, however long a conversation is.  One very long
conversation stays in one task, since its turns are digested in their order.

Edge cases: null roles and texts are empty; null conversation ids are one conversation;
turns sort by (turn, role, text) with null turns first; repeated rows are turns.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.sentencepieces import encode_batch, loaded
from lattica.llm.text import pieces, text_column
from lattica.session import prepare, shuffle_partitions

#: Control strings of common chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_FIRST = "[" + re.escape("".join(sorted({c[0] for c in CONTROLS}))) + "]"
_RAW = re.compile(rf"({_FIRST}\\*)(?={_REST})")
_ESCAPED = re.compile(rf"({_FIRST}\\*)\\(?={_REST})")
MARKS = 4  # tokens of a turn's two marks and line ends
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass(frozen=True)
class Params:
    budget: int = 1024
    history_turns: int = 4
    history_tokens: int = 256


@dataclass
class _Turn:
    role: str
    text: str
    tokens: int

    def render(self) -> tuple[str, str]:
        return f"<|im_start|>{escape_role(self.role)}\n", f"{escape(self.text)}<|im_end|>\n"


@dataclass
class Windows:
    """Windows of one conversation, made turn by turn."""

    params: Params
    system: _Turn | None = None
    kept: deque = field(default_factory=deque)  # turns that the next window may repeat
    new: list = field(default_factory=list)
    used: int = 0  # tokens of system, repeated and new turns
    repeated: list = field(default_factory=list)
    turns: int = 0
    done: int = 0

    def add(self, role: str, text: str, tokens: int):
        """Windows that this turn closes."""
        turn = _Turn(role, text, tokens)
        self.turns += 1
        if self.turns == 1 and role == "system":
            self.system, self.used = turn, turn.tokens
            return
        if self.new and self.used + turn.tokens > self.params.budget:
            yield self._close()
        if not self.new:
            self._begin(turn)
        self.new.append(turn)
        self.used += turn.tokens

    def finish(self):
        if self.new or (self.system is not None and not self.done):
            yield self._close()

    def _begin(self, turn: _Turn) -> None:
        self.used = self.system.tokens if self.system else 0
        room = min(self.params.history_tokens, self.params.budget - self.used - turn.tokens)
        self.repeated = []
        for old in reversed(self.kept):
            if old.tokens > room:
                break
            self.repeated.insert(0, old)
            room -= old.tokens
            self.used += old.tokens

    def _close(self) -> dict:
        text, at, spans = [], 0, []
        again = ([self.system] if self.system and self.done else []) + self.repeated
        fresh = ([self.system] if self.system and not self.done else []) + self.new
        for turn, counts in [*((t, False) for t in again), *((t, True) for t in fresh)]:
            head, body = turn.render()
            if counts and turn.role == "assistant":
                spans.append((at + len(head), at + len(head) + len(body) - len("<|im_end|>\n")))
            text += [head, body]
            at += len(head) + len(body)
        out = {"window": self.done, "text": "".join(text), "n_repeated": len(again), "loss_spans": spans, "n_tokens": self.used, "over_budget": self.used > self.params.budget}
        self.kept.extend(self.new)
        while len(self.kept) > self.params.history_turns:
            self.kept.popleft()
        self.new, self.repeated, self.done = [], [], self.done + 1
        self.used = self.system.tokens if self.system else 0
        return out


def read_window(text: str, n_repeated: int, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """The new turns of a window, and the texts under its loss mask."""
    turns = [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
    return turns[n_repeated:], [unescape(text[a:b]) for a, b in spans]


WINDOWS = "conv_id long, window int, text string, n_repeated int, loss_spans array<struct<start:int,end:int>>, n_tokens long, over_budget boolean"
_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_repeated", pa.int32()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])
_FLUSH = 4 << 20


def format_windows(turns: DataFrame, params: Params | None = None, model_file: str | None = None) -> DataFrame:
    """A row for each window of each conversation; the windows of one come in order."""
    p = params or Params()
    spark = prepare(turns.sparkSession)
    model = spark.sparkContext.broadcast(Path(model_file).read_bytes()) if model_file else None

    def counts(batch, column):
        texts = text_column(batch, column)
        if model is None:
            return np.array([len(x.split()) for x in texts.to_pylist()], dtype=np.int64)
        return np.diff(encode_batch(loaded(model), texts)[0])

    def run(batches):
        conv, state, rows, size = None, None, [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        def put(windows):
            nonlocal size
            for w in windows:
                size += len(w["text"])
                rows.append(w | {"conv_id": conv, "loss_spans": [{"start": a, "end": b} for a, b in w["loss_spans"]]})

        for batch in pieces(batches):
            tokens = (MARKS + counts(batch, "role") + counts(batch, "text")).tolist()
            for own, role, text, size_of in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), tokens):
                if state is None or own != conv:
                    if state is not None:
                        put(state.finish())
                    conv, state = own, Windows(p)
                put(state.add(role, text, size_of))
                if size > _FLUSH:
                    yield batch_of(rows)
                    rows, size = [], 0
        if state is not None:
            put(state.finish())
        if rows:
            yield batch_of(rows)

    none = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    dealt = rows.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation from the output of ``format_windows`` alone."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def run(batches):
        conv, state = None, None

        def closed():
            return pa.record_batch([pa.array([v]) if n != "conv_id" else pa.array([v], pa.int64()) for n, v in zip(names, (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))], names=names)

        for batch in batches:
            for own, text, repeated, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss_spans"))):
                if state is None or own != conv:
                    if state is not None:
                        yield closed()
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns, losses = read_window(text, repeated, [(s["start"], s["end"]) for s in spans])
                state[0] += len(turns)
                for role, said in turns:
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for said in losses:
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
        if state is not None:
            yield closed()

    return windows.mapInArrow(run, DIGESTS)
