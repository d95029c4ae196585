"""Utterance sessions over audio chunks, as a state machine, in streams and in batches.

Chunks come in order within a session: (session, start_sample, samples, speech). Disorder isn't repaired; a gap or an
overlap raises. The same machine serves ``stream_events`` (arbitrary state, one key a session) and ``batch_events``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

EVENTS = "session string, sequence int, kind string, utterance int, start_sample long, end_sample long, reason string"


@dataclass(frozen=True)
class Limits:
    """Fixed values, in samples at 16,000 a second: silence that ends an utterance, its longest length, what is kept
    before it, how often partial results come, how long until a final is refined, finals remembered."""

    silence: int = 5_600
    longest: int = 192_000
    preroll: int = 12_800
    partial: int = 8_000
    refine: int = 32_000
    history: int = 16


@dataclass
class Machine:
    limits: Limits = field(default_factory=Limits)
    cursor: int = 0
    sequence: int = 0
    utterance: int = 0
    active: bool = False
    start: int = 0
    quiet: int = 0
    shown: int = 0
    before: int = 0
    waiting: list = field(default_factory=list)  # finals not yet refined: [utterance, start, end]
    counts: dict = field(default_factory=lambda: {"partial": 0, "final": 0, "refine": 0})

    def dump(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "limits"})

    @classmethod
    def load(cls, text: str | None, limits: Limits) -> Machine:
        return cls(limits=limits, **(json.loads(text) if text else {}))

    def _event(self, kind: str, utterance: int, start: int, end: int, reason: str) -> tuple:
        self.sequence += 1
        if kind in self.counts:
            self.counts[kind] += 1
        return self.sequence, kind, utterance, start, end, reason

    def _final(self, reason: str) -> tuple:
        event = self._event("final", self.utterance, self.start, self.cursor, reason)
        self.waiting.append([self.utterance, self.start, self.cursor])
        del self.waiting[: -self.limits.history]
        self.active, self.quiet, self.before = False, 0, 0
        return event

    def _refined(self) -> Iterator[tuple]:
        for u in [u for u in self.waiting if self.cursor - u[2] >= self.limits.refine]:
            self.waiting.remove(u)
            yield self._event("refine", u[0], u[1], u[2], "child-of-first-pass-final")

    def feed(self, start: int, samples: int, speech: bool) -> Iterator[tuple]:
        """Events of a chunk. The longest length beats silence, and silence a partial result."""
        if start != self.cursor or samples <= 0:
            raise ValueError(f"a chunk at {start} of {samples} samples doesn't continue the session at {self.cursor}")
        self.cursor += samples
        if not self.active:
            if speech:
                self.active, self.utterance, self.quiet = True, self.utterance + 1, 0
                self.start = self.shown = start - self.before
                yield self._event("speech_start", self.utterance, self.start, self.cursor, "speech")
            else:
                self.before = min(self.limits.preroll, self.before + samples)
        else:
            self.quiet = 0 if speech else self.quiet + samples
        if self.active:
            if self.cursor - self.start >= self.limits.longest:
                yield self._final("max-speech")
            elif not speech and self.quiet >= self.limits.silence:
                yield self._final("silence")
                self.before = min(self.limits.preroll, samples)  # the chunk that ended it may precede the next
            elif speech and self.cursor - self.shown >= self.limits.partial:
                self.shown = self.cursor
                yield self._event("partial", self.utterance, self.start, self.cursor, "display-only")
        yield from self._refined()

    def flush(self) -> Iterator[tuple]:
        if self.active:
            yield self._final("flush")
        yield from self._refined()

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        yield self._event("session_summary", 0, 0, self.cursor, ";".join(f"{k}s={v}" for k, v in self.counts.items()))


def _frame(session: str, events: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session, *e) for e in events], columns=["session", "sequence", "kind", "utterance", "start_sample", "end_sample", "reason"])


def batch_events(chunks: DataFrame, limits: Limits | None = None) -> DataFrame:
    """All events of whole sessions, closed at their ends."""
    limits = limits or Limits()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m, out = Machine(limits), []
        for c in g.sort_values("start_sample").itertuples():
            out += m.feed(int(c.start_sample), int(c.samples), bool(c.speech))
        return _frame(g["session"].iloc[0], [*out, *m.close()])

    return chunks.groupBy("session").applyInPandas(run, EVENTS)


def stream_events(chunks: DataFrame, limits: Limits | None = None, *, idle_ms: int | None = None) -> DataFrame:
    """Events of a stream of chunks, with a session's machine as its state.

    Rows of a micro-batch are put in order; across batches order is a precondition. With ``idle_ms`` a session without
    chunks for so long (processing time) is closed and its state removed.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    limits = limits or Limits()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Machine.load(state.get[0] if state.exists else None, limits)
        if state.hasTimedOut:
            state.remove()
            yield _frame(key[0], list(m.close()))
            return
        rows, out = pd.concat(list(batches)), []
        for c in rows.sort_values("start_sample").itertuples():
            out += m.feed(int(c.start_sample), int(c.samples), bool(c.speech))
        state.update((m.dump(),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield _frame(key[0], out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("session").applyInPandasWithState(run, EVENTS, "machine string", "append", timeout)


GROUPS = "session string, `group` int, first string, last string, start long, end long, parents int, trigger string"


@dataclass
class Grouper:
    """Finals to groups for a second pass: closed by an idle gap, by length, by number, or at the end."""

    idle: int
    longest: int
    most: int
    number: int = 0
    open: list = field(default_factory=list)  # first, last, start, end, parents

    def _close(self, trigger: str) -> tuple:
        self.number += 1
        first, last, start, end, parents = self.open
        self.open = []
        return self.number, first, last, start, end, parents, trigger

    def feed(self, name: str, start: int, end: int) -> Iterator[tuple]:
        if self.open:
            if start < self.open[2] or end <= self.open[3]:
                raise ValueError(f"final {name} doesn't advance")
            if start - self.open[3] >= self.idle:
                yield self._close("idle-gap")
            elif end - self.open[2] > self.longest:
                yield self._close("max-duration")
            elif self.open[4] >= self.most:
                yield self._close("parent-limit")
        self.open = [self.open[0], name, self.open[2], end, self.open[4] + 1] if self.open else [name, name, start, end, 1]
        if end - self.open[2] >= self.longest:
            yield self._close("max-duration")


def stream_groups(finals: DataFrame, *, idle: int, longest: int, most: int, idle_ms: int | None = None) -> DataFrame:
    """Groups of a stream of finals (session, id, start, end), in order; what is open closes when a session falls idle."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["session", "group", "first", "last", "start", "end", "parents", "trigger"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, open_ = json.loads(state.get[0]) if state.exists else (0, [])
        g = Grouper(idle, longest, most, number, open_)
        if state.hasTimedOut:
            state.remove()
            out = [g._close("eof")] if g.open else []
        else:
            rows = pd.concat(list(batches)).sort_values(["start", "end", "id"])
            out = [e for r in rows.itertuples() for e in g.feed(str(r.id), int(r.start), int(r.end))]
            state.update((json.dumps([g.number, g.open]),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *e) for e in out], columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return finals.groupBy("session").applyInPandasWithState(run, GROUPS, "open string", "append", timeout)


def windowed(events: DataFrame, time: str, *, size: str = "28 seconds", step: str = "26.8 seconds", late: str = "1 minute", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in sliding windows of event time behind a watermark; windows start at multiples of the step."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, size, step), *by).agg(F.count("*").alias("n"))


def checkpointed(stream: DataFrame, path: str, checkpoint: str, *, form: str = "json"):
    """A resumable sink: each row is committed once, a restart goes on where the checkpoint says."""
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
