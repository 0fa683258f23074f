"""What an agent's session is told, event by event: problems once in full, then as reminders; a stop blocked once for them.

A session's events, and those of each agent it started, are folded in order over a small state. An
agent's change of files also marks its session, by an event of its own keyed to the session. The fold
runs over a table, sorted and streamed so that a long session needs memory for its state alone, or
over a stream with the state in Spark's store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

#: Lists are of keys: found, the problems that the check of this event gives; invalid and invalid_before, those of
#: the declaration itself after and before an edit; advice, what it could say better. config_changed: since the last event.
EVENTS = "session string, agent string, seq long, phase string, found array<string>, invalid array<string>, invalid_before array<string>, advice array<string>, applied boolean, changes boolean, config_changed boolean, stop_active boolean"
DECISIONS = "session string, agent string, seq long, kind string, fresh long, old long, resolved long, repeated boolean, advised long"
_FIELDS, _COLUMNS = ([x.split()[0] for x in schema.split(", ")] for schema in (EVENTS, DECISIONS))
_SETS = ("shown", "pending", "stop_keys", "advice_seen", "advice_shown")
_FLAGS = ("dirty", "blocked", "baseline")


@dataclass
class State:
    """shown in full, pending, those of the last block, advice of the baseline and shown since; whether a check is due, the last stop was blocked, a baseline is there."""

    shown: set[str] = field(default_factory=set)
    pending: set[str] = field(default_factory=set)
    stop_keys: set[str] = field(default_factory=set)
    advice_seen: set[str] = field(default_factory=set)
    advice_shown: set[str] = field(default_factory=set)
    dirty: bool = False
    blocked: bool = False
    baseline: bool = False

    def show(self, found: set[str], advised: set[str]) -> tuple:
        """The list as it is now: what is new in full, what is known as a reminder, what has gone once."""
        new, known, gone = found - self.shown, found & self.shown, self.pending - found
        self.pending, self.shown = found, set(found)
        return "context" if new or known or gone or advised else "silent", len(new), len(known), len(gone), False, len(advised)

    def fresh_advice(self, advice: set[str], touched: bool) -> set[str]:
        """Advice not in the baseline nor shown; the first look at a declaration makes the baseline."""
        if not self.baseline:
            self.baseline, self.advice_seen = True, advice
        found = advice - self.advice_seen - self.advice_shown if touched else set()
        self.advice_shown = self.advice_shown | found
        return found

    def mark(self) -> None:
        self.dirty, self.blocked = True, False


SILENT = ("silent", 0, 0, 0, False, 0)


def _stop(s: State, found: set[str], advice: set[str], active: bool) -> tuple:
    """A stop checks everything. It blocks for what is found, but not for the same again, nor while it is held already."""
    if not s.dirty and not s.pending:
        return SILENT
    caused = advice - s.advice_seen if s.baseline else set()
    again = active or (s.blocked and s.pending == found)
    new, known, gone = len(found - s.shown), len(found & s.shown), len(s.pending - found)
    s.pending, s.shown, s.dirty, s.advice_shown = found, set(found), False, set()
    if s.baseline:
        s.advice_seen = advice
    if not found or again:
        s.blocked = bool(found) and (s.blocked or active)
        if not found:
            s.stop_keys = set()
        return ("note", 0, 0, 0, False, len(caused)) if not found and caused else SILENT
    repeated = found <= s.stop_keys
    s.blocked, s.stop_keys = True, set(found)
    return "block", new, known, gone, repeated, len(caused)


def step(s: State, phase: str, found: set[str], invalid: set[str], before: set[str], advice: set[str], applied: bool, changes: bool, config_changed: bool, active: bool) -> tuple | None:
    """One event: kind, counts of what is fresh, old and resolved, whether a block repeats, counts of advice; None where nobody asks."""
    if phase == "dirty":
        s.mark()
        return None
    if phase == "post-compact":
        s.shown = set()
        return SILENT
    if phase in ("stop", "subagent-stop"):
        return _stop(s, found, advice, active)
    if phase == "pre-edit":
        # an edit that makes the declaration worse does not land, and the session stays as it was
        if invalid and not applied and (invalid - before or len(invalid) > len(before)):
            return "deny", len(invalid), 0, 0, False, 0
        advised = s.fresh_advice(advice, config_changed)
        s.mark()
        return s.show(invalid if invalid and applied else found, advised)
    if changes:
        s.mark()
    advised = s.fresh_advice(advice, config_changed)
    if not s.pending and not config_changed and not advised:
        return SILENT
    return s.show(found if config_changed else found & s.pending, advised)


def _apply(s: State, r) -> tuple | None:
    lists = (set(x if x is not None else ()) for x in (r.found, r.invalid, r.invalid_before, r.advice))
    return step(s, r.phase, *lists, bool(r.applied), bool(r.changes), bool(r.config_changed), bool(r.stop_active))


def with_parents(events: DataFrame) -> DataFrame:
    """events and, for each change that an agent makes, a mark on its session; agent '' is the session itself."""
    own = events.withColumn("agent", F.coalesce("agent", F.lit("")))
    changing = (F.col("phase") == "pre-edit") & ~((F.size("invalid") > 0) & ~F.coalesce("applied", F.lit(False)) & ((F.size(F.array_except("invalid", F.coalesce("invalid_before", F.array().cast("array<string>")))) > 0) | (F.size("invalid") > F.coalesce(F.size("invalid_before"), F.lit(0)))))
    marks = own.where((F.col("agent") != "") & (F.coalesce(changing, F.col("phase") == "pre-edit") | ((F.col("phase") == "pre-tool") & F.coalesce("changes", F.lit(False)))))
    return own.unionByName(marks.select("session", F.lit("").alias("agent"), "seq", F.lit("dirty").alias("phase")), allowMissingColumns=True).select(*_FIELDS)


def decisions(events: DataFrame) -> DataFrame:
    """events (EVENTS) -> DECISIONS, from a table. An order within equal seq: marks by agents come first, then by phase.

    Null lists are empty and null flags false; events without a session are one of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if key != (now := (r.session, r.agent)):
                    key, state = now, State()
                if (d := _apply(state, r)) is not None:
                    out.append((r.session, r.agent, r.seq, *d))
            yield pd.DataFrame(out, columns=_COLUMNS)

    sort = ("session", "agent", "seq", F.col("phase") != "dirty", "phase")
    return with_parents(events).repartition("session", "agent").sortWithinPartitions(*sort).mapInPandas(run, DECISIONS)


class _Session(StatefulProcessor):
    """The same fold with its state in Spark's store: the sets in a map each, the flags in a value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sets = {n: handle.getMapState(n, "key string", "n int") for n in _SETS}
        self.flags = handle.getValueState("flags", ", ".join(f"{x} boolean" for x in _FLAGS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        flags = self.flags.get()
        s = State(**{n: {k[0] for k in m.keys()} for n, m in self.sets.items()}, **(dict(zip(_FLAGS, flags, strict=True)) if flags else {}))
        before = {n: set(getattr(s, n)) for n in _SETS}
        for r in sorted(rows, key=lambda r: (r.seq, r.phase != "dirty", r.phase)):
            if (d := _apply(s, r)) is not None:
                yield Row(**dict(zip(_COLUMNS, (r.session, r.agent, r.seq, *d), strict=True)))
        for n, m in self.sets.items():
            for k in before[n] - getattr(s, n):
                m.removeKey((k,))
            for k in getattr(s, n) - before[n]:
                m.updateValue((k,), (1,))
        self.flags.update(tuple(getattr(s, x) for x in _FLAGS))

    def close(self) -> None:
        pass


def stream_decisions(events: DataFrame) -> DataFrame:
    """decisions() of a stream; a batch's events are folded in order of seq. Needs the RocksDB state store."""
    return with_parents(events).groupBy("session", "agent").transformWithState(_Session(), DECISIONS, "Append", "None")
