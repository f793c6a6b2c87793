"""The boundary to a model: a source of answers, its retries, its rate, and the rows that asking leaves.

A source is any object with `name` and generate(question) -> str; question is a dict of the request's columns. Sources
are made on the executors by a function, so clients and their connections are never sent.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.functions.scalars import MARKERS


class AnswerSource(Protocol):
    name: str

    def generate(self, question: dict) -> str: ...


class DryAnswers:
    """The deterministic source: a cell by the seed, and yes to every question of a feedback round (those with a flag)."""

    name = "dry"

    def __init__(self, cells: int = 9):
        self.cells = cells

    def generate(self, question: dict) -> str:
        if question.get("flag") is not None:
            return "1"
        return f'{{"points": [{int(question.get("seed") or 0) % self.cells + 1}]}}'


def passing(error: Exception) -> bool:
    """Whether a failure may pass on another try."""
    status = getattr(error, "status_code", None)
    if status is not None:
        return int(status) in (408, 429) or int(status) >= 500
    return isinstance(error, TimeoutError | ConnectionError) or any(m in str(error).lower() for m in MARKERS)


def failure(error: Exception, secret: str | None = None) -> dict:
    """type, status_code, request_id and message (without the secret, 4,000 characters at most) of an error."""
    status, request = getattr(error, "status_code", None), getattr(error, "request_id", None)
    message = str(error).replace(secret, "[REDACTED]") if secret else str(error)
    digits = status is not None and str(status).lstrip("-").isdigit()
    return {"type": type(error).__name__, "status_code": int(status) if digits else None, "request_id": None if request is None else str(request), "message": message[:4000]}


class StartSpacing:
    """Lets requests start at most `per_second` times a second, all threads of a process together; 0 sets no limit. Completions are free."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if not 0 <= per_second < float("inf"):
            raise ValueError("per_second must be finite and not negative")
        self.gap = 1 / per_second if per_second else 0.0
        self._clock, self._sleep, self._lock, self._free = clock, sleep, threading.Lock(), None

    def wait(self) -> float:
        """Waits for this caller's own slot and returns the time at which it starts."""
        with self._lock:
            now = self._clock()
            start = now if self._free is None or not self.gap else max(now, self._free)
            self._free = start + self.gap
        if start > now:
            self._sleep(start - now)
        return start


class SlotSpacing:
    """A limit over several processes without a word between them: time is cut into slots of 1 / per_second, dealt in turn to the lanes.

    A caller starts in slots of its own lane alone (lane, lane + lanes, ... from the epoch on) and once a slot, at its
    beginning, so no two starts of all lanes are closer than a slot, whenever the lanes begin and whichever lag behind.
    The clocks must agree to well under a slot.
    """

    def __init__(self, per_second: float, lane: int, lanes: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        if not 0 <= per_second < float("inf") or not 0 <= lane < lanes:
            raise ValueError("per_second must be finite and not negative, lane under lanes")
        self.gap, self.lane, self.lanes, self._clock, self._sleep, self._turn = 1 / per_second if per_second else 0.0, lane, lanes, clock, sleep, None

    def wait(self) -> float:
        """Waits for the lane's next slot and returns when it begins."""
        now = self._clock()
        if not self.gap:
            return now
        turn = math.ceil((now / self.gap - self.lane) / self.lanes - 1e-9)
        self._turn = turn if self._turn is None else max(turn, self._turn + 1)
        start = (self._turn * self.lanes + self.lane) * self.gap
        while (left := start - self._clock()) > 0:  # never before the slot
            self._sleep(left)
        return start


class Retrying:
    """A source that asks again after a passing failure: `attempts` in all, the delay doubles; other failures go through."""

    def __init__(self, source: AnswerSource, attempts: int = 3, delay: float = 1.0, spacing: StartSpacing | SlotSpacing | None = None, sleep: Callable[[float], None] = time.sleep):
        self.source, self.attempts, self.delay, self.spacing, self._sleep = source, attempts, delay, spacing, sleep
        self.name, self.tries = source.name, 0

    def generate(self, question: dict) -> str:
        for k in range(self.attempts):
            if self.spacing is not None:
                self.spacing.wait()
            self.tries = k + 1
            try:
                return self.source.generate(question)
            except Exception as error:
                if k + 1 == self.attempts or not passing(error):
                    raise
                self._sleep(self.delay * 2**k)
        raise ValueError("attempts must be at least 1")


ANSWERS = "raw_response string, backend_used string, attempts int, latency_s double, error struct<type:string,status_code:int,request_id:string,message:string>"


def ask(requests: DataFrame, make: Callable[[], AnswerSource], attempts: int = 3, delay: float = 1.0, per_second: float = 0.0, secret: str | None = None, lanes: int = 8) -> DataFrame:
    """requests with raw_response, backend_used, attempts, latency_s and error (null, or what stopped the last try).

    Requests are dealt to `lanes` tasks, each of which asks in order through one source. per_second limits the starts of
    all of them together, retries too; lanes that run one after another use their share of it only. A failed request is
    a row with an error, never a failed task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = Retrying(make(), attempts, delay, SlotSpacing(per_second, TaskContext.get().partitionId() % lanes, lanes))
        for batch in batches:
            rows = []
            for question in batch.to_dict("records"):
                began, text, error = time.monotonic(), None, None
                try:
                    text = source.generate({k: None if isinstance(v, float) and v != v else v for k, v in question.items()})
                except Exception as stop:
                    error = failure(stop, secret)
                rows.append((text, source.name, source.tries, time.monotonic() - began, error))
            yield batch.assign(**{name: pd.Series([r[i] for r in rows], index=batch.index, dtype=object) for i, name in enumerate(("raw_response", "backend_used", "attempts", "latency_s", "error"))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.repartition(lanes).mapInPandas(run, f"{fields}, {ANSWERS}")
