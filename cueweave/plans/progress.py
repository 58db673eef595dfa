"""Progress of a conversion, folded from its events, with the time that is left."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import SparkContext

# Rates before anything was observed, in seconds.
ROW_SECONDS = {"non-tall-fast": 1.20, "tall-default": 1.45, "default": 1.35}
LOAD_SECONDS, LEAST_LOAD_SECONDS = 7.0, 2.0
BYTES_PER_ROW = 22_000
ROWS_UNKNOWN, LEAST_ROWS, MOST_ROWS = 120, 24, 6000
TALL_SHARE = 0.12
TALL_FACTOR, TALL_BLEND, OBSERVED_BLEND = 1.60, 8, 6
PREPARE_SECONDS, PREPARE_ROW, PREPARE_ROW_MASKED = 1.0, 0.0058, 0.0068
WRITE_SECONDS, WRITE_ROW, LEAST_WRITE = 0.35, 0.0012, 0.2


class Cancelled(RuntimeError):
    """The conversion was asked to stop."""


@dataclass(frozen=True)
class Event:
    phase: str
    elapsed: float
    branch: str | None = None
    rows: int | None = None
    wide_rows: int | None = None
    tall_rows: int | None = None
    branch_rows: int | None = None
    branch_unique: int | None = None
    done_rows: int | None = None
    done_unique: int | None = None


@dataclass
class Branch:
    rows: int = 0
    unique: int | None = None
    done_rows: int = 0
    done_unique: int = 0
    loading_since: float | None = None
    load: float | None = None
    began: float | None = None
    latest: float | None = None

    def rate(self) -> float | None:
        if not self.done_unique or self.began is None or self.latest is None:
            return None
        return max(0.001, self.latest - self.began) / self.done_unique


@dataclass
class Progress:
    """``record`` takes events in any order of time; ``snapshot`` never goes back."""

    fast: bool = False
    masked: bool = False
    input_bytes: int = 0
    elapsed: float = 0.0
    phase: str = "start"
    rows: int | None = None
    split: tuple[int, int] | None = None
    prepared: bool = False
    writing_since: float | None = None
    finished: bool = False
    branches: dict[str, Branch] = field(default_factory=dict)

    def record(self, event: Event) -> None:
        self.elapsed, self.phase = max(self.elapsed, event.elapsed), event.phase
        self.rows = event.rows if event.rows is not None else self.rows
        if event.wide_rows is not None or event.tall_rows is not None:
            self.split = (event.wide_rows or 0, event.tall_rows or 0)
        self.prepared |= event.phase == "prepare_completed"
        self.finished |= event.phase == "finished"
        if event.phase == "write_started":
            self.writing_since = event.elapsed
        if event.branch is None:
            return
        branch = self.branches.setdefault(event.branch, Branch())
        branch.rows = event.branch_rows if event.branch_rows is not None else branch.rows
        branch.unique = event.branch_unique if event.branch_unique is not None else branch.unique
        if event.phase == "backend_loading":
            branch.loading_since = event.elapsed
        elif event.phase == "backend_ready" and branch.loading_since is not None:
            branch.load = max(0.0, event.elapsed - branch.loading_since)
        elif event.phase == "ocr_started":
            branch.began = branch.latest = event.elapsed
        elif event.phase == "ocr_progress":
            branch.done_rows = event.done_rows if event.done_rows is not None else branch.done_rows
            branch.done_unique = event.done_unique if event.done_unique is not None else branch.done_unique
            branch.latest = event.elapsed

    def expected_rows(self) -> int:
        if self.rows is not None:
            return self.rows
        if self.input_bytes <= 0:
            return ROWS_UNKNOWN
        return max(LEAST_ROWS, min(MOST_ROWS, round(self.input_bytes / BYTES_PER_ROW)))

    def expected_branches(self) -> dict[str, int]:
        rows = self.expected_rows()
        if not self.fast:
            return {"default": sum(self.split) if self.split else rows}
        tall = round(rows * TALL_SHARE)
        wide, tall = self.split or (rows - tall, tall)
        return {name: n for name, n in (("non-tall-fast", wide), ("tall-default", tall)) if n}

    def prior(self, name: str) -> float:
        wide = self.branches.get("non-tall-fast")
        if name == "tall-default" and self.fast and wide and wide.rate() is not None:
            share = min(wide.done_unique, TALL_BLEND) / TALL_BLEND
            return ROW_SECONDS[name] * (1 - share) + wide.rate() * TALL_FACTOR * share
        return ROW_SECONDS[name]

    def load_seconds(self) -> float:
        seen = [b.load for b in self.branches.values() if b.load is not None]
        return max(LEAST_LOAD_SECONDS, sum(seen) / len(seen)) if seen else LOAD_SECONDS

    def left(self) -> float:
        """Seconds that are left."""
        if self.finished:
            return 0.0
        rows = self.expected_rows()
        write = max(LEAST_WRITE, WRITE_SECONDS + rows * WRITE_ROW)
        total = write if self.writing_since is None else max(0.05, write - (self.elapsed - self.writing_since))
        if not self.prepared:
            prepare = PREPARE_SECONDS + rows * (PREPARE_ROW_MASKED if self.masked else PREPARE_ROW)
            total += max(0.4, prepare - self.elapsed)
        for name, expected in self.expected_branches().items():
            branch = self.branches.get(name, Branch(expected))
            if branch.load is None:
                total += self.load_seconds() if branch.loading_since is None else max(0.25, self.load_seconds() - (self.elapsed - branch.loading_since))
            rate, seen = self.prior(name), branch.rate()
            if seen is not None:
                share = min(branch.done_unique, OBSERVED_BLEND) / OBSERVED_BLEND
                rate = rate * (1 - share) + seen * share
            whole = branch.unique if branch.unique is not None else (branch.rows or expected)
            total += max(0, whole - branch.done_unique) * rate
        return total

    def snapshot(self, elapsed: float | None = None) -> dict:
        """Phase, share done (0.01 to 0.99 while it runs), elapsed and remaining seconds."""
        self.elapsed = max(self.elapsed, elapsed or 0.0)
        left = self.left()
        share = 1.0 if self.finished else 0.0 if self.elapsed <= 0 else min(0.99, max(0.01, self.elapsed / max(self.elapsed + left, 0.001)))
        return {"phase": self.phase, "fraction": share, "elapsed": self.elapsed, "eta": left}


def fold(events: Iterable[Event], **settings) -> Progress:
    progress = Progress(**settings)
    for event in events:
        progress.record(event)
    return progress


class Job:
    """Runs an action in a job group that can be cancelled from another thread."""

    def __init__(self, context: SparkContext, name: str):
        self.context, self.name, self._stop = context, name, threading.Event()

    def cancel(self) -> None:
        self._stop.set()
        self.context.cancelJobGroup(self.name)

    def check(self) -> None:
        if self._stop.is_set():
            raise Cancelled(self.name)

    def run(self, action: Callable[[], object], report: Callable[[Event], None] | None = None) -> object:
        began = time.monotonic()
        self.check()
        self.context.setJobGroup(self.name, self.name, interruptOnCancel=True)
        try:
            out = action()
        except Exception:
            self.check()
            raise
        if report:
            report(Event("finished", time.monotonic() - began))
        return out
