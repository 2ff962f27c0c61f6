"""The life of every job as keyed state of a stream: its fields, its steps, and deadlines that timers keep.

Events may come in any order and repeatedly. Each field keeps the value of the largest ``seq`` that set it, as in
``jobs.latest_state``; the steps of the status are judged in the order of ``seq``, and one that the life cannot take from where it is
(``STEPS``) is refused, until an event that came late makes it possible. A job that has run without any sign for ``stale``
has failed; one that was asked to stop and has not for ``grace`` is to be killed and counts as cancelled. Both are timers: on the
watermark of the events' ``at``, or on the clock (``clock="processing"``).

Events that come more than ``lateness`` after later ones are left out where the watermark is the clock, so it is to be chosen
for the longest way of an event; on the processing clock all count.

State per job: a number and value per field, and its events with a status, so a few hundred bytes; it goes ``keep`` after the
job's last event. One row comes out whenever a job changes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators import jobs
from codeloom.schemas import JOBS

#: What may follow a status; before a job is queued there is none.
STEPS = {None: {"queued"}, "queued": {"running", "cancelled", "failed"}, "running": {"cancelling", *jobs.FINISHED}, "cancelling": set(jobs.FINISHED)}
FIELDS = [f for f in JOBS.fields if f.name not in ("id", "status")]
CHANGES = T.StructType([JOBS["id"], JOBS["status"], T.StructField("action", T.StringType()), T.StructField("refused", T.ArrayType(T.LongType())), *FIELDS])
STATE = T.StructType([T.StructField("life", T.StringType())])


class Life:
    """One job. ``events``: status by seq; ``values``: field -> [seq, value]; ``ended``: what a timer has put in its place."""

    def __init__(self, text: str | None = None):
        held = json.loads(text) if text else {}
        self.events: dict[int, str] = {int(k): v for k, v in held.get("events", {}).items()}
        self.values, self.ended, self.seen = held.get("values", {}), held.get("ended"), held.get("seen", 0)
        self.asked = held.get("asked")

    def dump(self) -> str:
        return json.dumps({"events": self.events, "values": self.values, "ended": self.ended, "seen": self.seen, "asked": self.asked})

    def status(self) -> tuple[str | None, list[int]]:
        """Where the steps lead, and the seqs of those refused."""
        now, refused = None, []
        for seq, status in sorted(self.events.items()):
            if status in STEPS.get(now, ()):
                now = status
            elif status != now:
                refused.append(seq)
        return (self.ended["status"] if self.ended and now not in jobs.FINISHED else now), refused

    def take(self, seq: int, status: str | None, fields: dict, at: int) -> None:
        self.seen = max(self.seen, at)
        if status is not None:
            self.events.setdefault(seq, status)
        for name, value in fields.items():
            if seq > self.values.get(name, [-1])[0]:
                self.values[name] = [seq, value]

    def deadline(self, stale: int, grace: int, keep: int) -> int:
        status = self.status()[0]
        if status == "cancelling":
            return (self.asked or self.seen) + grace
        return self.seen + (stale if status == "running" else keep)

    def expire(self) -> str | None:
        """What a deadline that has come means; None where the state may go."""
        status = self.status()[0]
        if status == "running":
            self.ended = {"status": "failed", "error": jobs.STALE}
            return "stale"
        if status == "cancelling":
            self.ended = {"status": "cancelled"}
            return "kill"
        return None

    def row(self, job: str, action: str | None) -> pd.DataFrame:
        status, refused = self.status()
        held = {f.name: self.values.get(f.name, [0, None])[1] for f in FIELDS} | {k: v for k, v in (self.ended or {}).items() if k != "status"}
        return pd.DataFrame([{"id": job, "status": status, "action": action, "refused": refused} | held], columns=CHANGES.names).astype(object)


def _plain(value):
    if value is None or (not isinstance(value, (str, list)) and pd.isna(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def _stepper(stale: int, grace: int, keep: int, clock: str) -> Callable:
    by_clock = clock == "processing"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        life, changed, action = Life(state.get[0] if state.exists else None), False, None
        now = state.getCurrentProcessingTimeMs()
        mark = now if by_clock else state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            action = life.expire()
            if action is None:
                state.remove()
                return
            changed = True
        before, known = life.dump(), life.status()[0]
        for batch in batches:
            for r in batch.to_dict("records"):
                at = now if by_clock else int(r["at_ms"])
                life.take(int(r["seq"]), _plain(r["status"]), {f.name: v for f in FIELDS if (v := _plain(r[f.name])) is not None}, at)
        if life.seen == 0:
            return
        status = life.status()[0]
        if status == "cancelling" and known != "cancelling":
            action, life.asked = "stop", life.seen
        changed |= {k: v for k, v in json.loads(before).items() if k not in ("seen", "asked")} != {k: v for k, v in json.loads(life.dump()).items() if k not in ("seen", "asked")}
        state.update((life.dump(),))
        due = life.deadline(stale, grace, keep)
        if by_clock:
            state.setTimeoutDuration(max(1, due - now))
        else:
            state.setTimeoutTimestamp(max(due, mark + 1))
        if changed:
            yield life.row(key[0], action)

    return step


def follow(events: DataFrame, stale: float = 3600, grace: float = 10, keep: float = 24 * 3600, lateness: str = "1 hour", clock: str = "event") -> DataFrame:
    """The changes of jobs (``CHANGES``) from a stream of ledger events with their time ``at``; times in seconds. ``action`` says
    what is to be done: stop, kill, or stale."""
    marked = events.withWatermark("at", lateness).withColumn("at_ms", F.unix_millis("at"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if clock == "processing" else GroupStateTimeout.EventTimeTimeout
    step = _stepper(*(int(1000 * x) for x in (stale, grace, keep)), clock)
    return marked.groupBy("id").applyInPandasWithState(step, CHANGES, STATE, "update", timeout)
