"""Chat formatting in budgeted windows.

A conversation's turns stream in order through a state of one window. Prefix sums of the turns' tokens choose the
spans: turns join the window while the budget lasts; the next window repeats the system turn and the longest tail of
earlier turns within the history budget, and only its new assistant texts are under the loss mask. Turns are never
cut; a turn that exceeds the budget by itself has a window of its own, marked over_budget.

A turn reads <|im_start|>role newline text<|im_end|> newline. Inside roles and texts a backslash is doubled and "<|"
becomes "<\\|" (in roles also newline a backslash and n), so control strings occur only as marks and reading reverses.

Defined results: null role and null text are empty; turns that are equal or null keep an order by turn (null first),
role, text; a null conversation id is a conversation; an empty table gives an empty result. Other columns are ignored.
The query adds a conversation -1; rows of that id in the table itself are turns of the same conversation.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, partitions, table
from tidemark.llm.packing import default_vocabulary
from tidemark.llm.tokens import bpe

# The template's marks.
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"((?:[^\n\\]|\\.)*)\n((?:(?!<\|).)*)" + re.escape(END) + "\n", re.DOTALL)
WINDOWS = "window long, formatted string, loss array<struct<start:int,stop:int>>, tokens int, n_repeated int, over_budget boolean"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


class _Window:
    """Turns (head, body, is a target, tokens) with prefix sums of their tokens; the first `repeated` are old."""

    def __init__(self, turns: list[tuple], repeated: int):
        self.turns, self.repeated, self.sums = list(turns), repeated, [0]
        for t in turns:
            self.sums.append(self.sums[-1] + t[3])

    def add(self, turn: tuple) -> None:
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[3])

    def next(self, turn: tuple, budget: int, history: int) -> _Window:
        """The window that begins with turn: the system turn, then the longest tail that fits, then turn."""
        system = [t for t in self.turns[:1] if t[4]]
        room = min(history, budget - turn[3] - sum(t[3] for t in system))
        first = max(len(system), bisect_left(self.sums, self.sums[-1] - max(0, room)))
        kept = system + self.turns[first:]
        out = _Window(kept, len(kept))
        out.add(turn)
        return out

    def row(self, conv, number: int, budget: int) -> tuple:
        text, loss, at = [], [], 0
        for i, (head, body, target, _, _) in enumerate(self.turns):
            if target and i >= self.repeated:
                loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
            text += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        return conv, number, "".join(text), loss, self.sums[-1], self.repeated, self.sums[-1] > budget


def chat_windows(conversations: DataFrame, budget: int = 2048, history: int = 512, target: str = "assistant", path: str | None = None) -> DataFrame:
    """conv_id, window, formatted, loss (spans of code points), tokens, n_repeated, over_budget of conversations(conv_id, turn, role, text)."""
    path = path or default_vocabulary()
    arrow_rows(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe(path).ids
        conv, now, number, out = None, None, 0, []
        names = ["conv_id", "window", "formatted", "loss", "tokens", "n_repeated", "over_budget"]
        kinds = [None, pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.int32(), pa.int32(), pa.bool_()]
        for b in batches:
            kinds[0] = b.schema.field("conv_id").type
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if now is not None and c != conv:
                    out.append(now.row(conv, number, budget))
                    now = None
                head, body = START + escape(role or "", True) + "\n", escape(text or "")
                turn = (head, body, role == target, len(count(head + body + END + "\n")) // 4, role == "system" and now is None)
                if now is None:
                    conv, number, now = c, 0, _Window([turn], 0)
                elif now.sums[-1] + turn[3] <= budget:
                    now.add(turn)
                else:
                    out.append(now.row(conv, number, budget))
                    number, now = number + 1, now.next(turn, budget, history)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(now.row(conv, number, budget), kinds, strict=True)], names=names)

    kind = dict(conversations.dtypes)["conv_id"]
    rows = conversations.select("conv_id", "turn", "role", "text").repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind}, {WINDOWS}")


def read_turns(formatted: str, loss: list[dict]) -> Iterator[tuple[str, str, bool]]:
    """role, text and whether the text is under the mask, of each turn of a formatted window."""
    masked = {x["start"]: x["stop"] for x in loss}
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not the template at {at}")
        yield unescape(m[1], True), unescape(m[2]), masked.get(m.start(2)) == m.end(2)
        at = m.end()


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say when read back, by conversation; windows stream in order, digests run on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def close():
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for b in batches:
            kinds[0] = b.schema.field("conv_id").type
            for w in b.to_pylist():
                if state is None or state[0] != w["conv_id"]:
                    if state is not None:
                        out.append(close())
                    state = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(w["formatted"])
                for i, (role, text, masked) in enumerate(read_turns(w["formatted"], w["loss"])):
                    if masked:
                        state[3] += len(text)
                        state[4].update(text.encode())
                    if i >= w["n_repeated"]:
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(close(), kinds, strict=True)], names=names)

    kind = dict(windows.dtypes)["conv_id"]
    rows = windows.select("conv_id", "window", "formatted", "loss", "n_repeated").repartition(partitions(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation and of conversation -1, read back from the windows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    turn = F.col("id").cast("int")
    extra = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digests(chat_windows(rows.unionByName(extra)))
