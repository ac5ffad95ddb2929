"""Request control step by step: rate windows, pauses, and the two controllers, the same for a replay of a log and for a stream.

A key is a provider or an account. Its events are taken in the order of their times, then of their ids; those of one moment are in each
other's windows. What a key has to remember is small: the moments of one window, the end of the last pause, and what the controllers know.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is left of workers and batch after a failure of a kind; base and most seconds of pause.
PRESSURE = {"rate": (0.6, 0.7, 60.0), "timeout": (0.75, 0.75, 45.0), "format": (0.85, 0.5, 20.0)}


@dataclass(frozen=True)
class Limits:
    """What a provider allows, and what a run starts with."""

    rpm: int
    tpm: int
    seconds: int = 60
    workers: int = 4
    batch: int = 6
    slow: float = 30.0
    down_at: int = 8
    up_at: int = 16
    ring: int = 24


class Event(NamedTuple):
    """A request: when in microseconds, its number, tokens, seconds it took if it has ended, kind if it failed, seconds of pause it asked for."""

    us: int
    id: int
    tokens: int
    elapsed: float | None
    kind: str | None
    pause: float | None


DECISION = (
    "id long, us long, requests long, window_tokens long, wait double, gap double, held double, action string, workers int, batch int, "
    "failure_workers int, failure_batch int, failure_pause double"
)


def failed(state: tuple[int, int, int, int], kind: str) -> tuple[tuple[int, int, int, int], float]:
    """(workers, batch, failures, format failures) after a failure, and the seconds of pause.

    Rate and timeout pause for doubling seconds, formats for 1.5 a failure; three format failures, or one at batches of 3, end batches.
    """
    w, b, events, formats = state
    events, formats = events + 1, formats + (kind == "format")
    left_w, left_b, most = PRESSURE.get(kind, PRESSURE["rate"])
    single = kind == "format" and (formats >= 3 or b <= 3)
    w, b = max(1, int(w * left_w + 0.999)), 1 if single else max(1, int(b * left_b + 0.999))
    return (w, b, events, formats), min(most, 1.5 * formats if kind == "format" else 2.0 ** min(events, 5))


def sampled(held: list[float], w: int, b: int, elapsed: float, limits: Limits) -> tuple[str, list[float], int, int]:
    """(action, window, workers, batch) after a request that took so long: batches shrink before workers while the window is slow, and grow first once it is fast; it starts anew with each change."""
    held = [*held, max(0.001, elapsed)][-limits.ring :]
    n, mean = len(held), int(sum(held) / len(held) * 1000)
    slow = sum(x >= limits.slow for x in held)
    if n >= limits.down_at and (mean >= int(limits.slow * 1000) or slow / n >= 0.5) and (b > 1 or w > 1):
        return "down", [], w - (b <= 1), b - (b > 1)
    if n >= limits.up_at and mean <= int(limits.slow * 600) and not slow and (b < limits.batch or w < limits.workers):
        return "up", [], w + (b >= limits.batch), b + (b < limits.batch)
    return "none", held, w, b


class Control:
    """A key's state, and what it decides on the events of the next moment."""

    def __init__(self, limits: Limits, saved: str | None = None):
        self.limits = limits
        own = json.loads(saved) if saved else {}
        self.window = deque(map(tuple, own.get("window", ())))  # (seconds, requests, tokens, all tokens up to here)
        self.place, self.total, self.due, self.until = own.get("place", 0), own.get("total", 0), own.get("due"), own.get("until")
        self.held, self.workers, self.batch = own.get("held", []), own.get("workers", limits.workers), own.get("batch", limits.batch)
        self.failure = tuple(own.get("failure", (limits.workers, limits.batch, 0, 0)))
        self.requests, self.tokens = sum(m[1] for m in self.window), sum(m[2] for m in self.window)
        # the window without its first moments that may stay for want of tokens: as sums only grow, a moment leaves it once
        self.over = deque(self.window)

    def saved(self) -> str:
        return json.dumps({k: list(v) if isinstance(v, (deque, tuple)) else v for k, v in vars(self).items() if k not in ("limits", "requests", "tokens", "over")})

    def moment(self, events: list[Event]) -> Iterator[tuple]:
        """Decisions on all events of one moment, in the order of their ids."""
        at, limits = events[0].us / 1e6, self.limits
        n, tokens = len(events), sum(e.tokens for e in events)
        self.total += tokens
        self.window.append((at, n, tokens, self.total))
        self.over.append(self.window[-1])
        self.requests, self.tokens = self.requests + n, self.tokens + tokens
        while self.window[0][0] < at - limits.seconds:
            _, gone, gone_tokens, _ = self.window.popleft()
            self.requests, self.tokens = self.requests - gone, self.tokens - gone_tokens
        while self.over[0][3] < self.total - limits.tpm:
            self.over.popleft()
        first, wait = self.window[0][0], 0.0
        if self.requests > limits.rpm:
            wait = max(wait, first + limits.seconds - at)
        if self.tokens > limits.tpm:
            # as many of the first moments must leave as hold the tokens that are too many
            wait = max(wait, self.over[0][0] + limits.seconds - at)
        step = limits.seconds / limits.rpm
        for e in sorted(events, key=lambda e: e.id):
            ahead = self.place * step
            self.due = at - ahead if self.due is None else max(self.due, at - ahead)
            self.place += 1
            held = max(0.0, self.until - at) if self.until is not None else 0.0
            if e.pause is not None and e.pause > 0:
                self.until = at + e.pause if self.until is None else max(self.until, at + e.pause)
            action, failure = None, (None, None, None)
            if e.elapsed is not None:
                action, self.held, self.workers, self.batch = sampled(self.held, self.workers, self.batch, e.elapsed, limits)
            if e.kind is not None:
                self.failure, pause = failed(self.failure, e.kind)
                failure = (*self.failure[:2], pause)
            yield e.id, e.us, self.requests, self.tokens, wait, self.due + ahead - at, held, action, self.workers, self.batch, *failure

    def run(self, events: Iterable[Event]) -> Iterator[tuple]:
        """Decisions on events in order, of which no more come for the moments seen."""
        for _, same in groupby(events, key=lambda e: e.us):
            yield from self.moment(list(same))


def plain(rows: pd.DataFrame) -> list[Event]:
    """Events of a frame's columns us, id, tokens, elapsed, kind, pause; missing values as None."""
    some = lambda c: [None if x is None or x != x else x for x in rows[c].tolist()]
    return list(map(Event, rows["us"].tolist(), rows["id"].tolist(), rows["tokens"].tolist(), some("elapsed"), some("kind"), some("pause")))


def events(df: DataFrame, key: Column, ts: Column, ident: Column, tokens: Column, elapsed: Column, kind: Column, pause: Column) -> DataFrame:
    """(key, ts, us, id, tokens, elapsed, kind, pause): rows without key or time are left out; tokens that are missing are none."""
    own = df.select(key.cast("string").alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("us"), ident.cast("long").alias("id"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"), elapsed.cast("double").alias("elapsed"), kind.alias("kind"), pause.cast("double").alias("pause"))
    return own.where("key is not null and ts is not null")


def replayed(found: DataFrame, limits: Limits) -> DataFrame:
    """(key, and DECISION) on all events of a table, a key's in order by one task, one Arrow batch at a time."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, control, open_ = None, None, []
        for part in parts:
            out = []
            for k, e in zip(part["key"], plain(part), strict=True):
                if open_ and (k != key or e.us != open_[0].us):
                    out += [(key, *d) for d in control.moment(open_)]
                    open_ = []
                if k != key:
                    key, control = k, Control(limits)
                open_.append(e)
            yield pd.DataFrame(out, columns=COLUMNS)
        if open_:
            yield pd.DataFrame([(key, *d) for d in control.moment(open_)], columns=COLUMNS)

    # a number of partitions is kept as it is: adaptive execution would put several keys into one task
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = found.drop("ts").repartition(parts, "key").sortWithinPartitions("key", "us", "id")
    return own.mapInPandas(run, f"key string, {DECISION}")


COLUMNS = ["key", *(c.split()[0] for c in DECISION.split(", "))]
