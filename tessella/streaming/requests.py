"""Requests of workers as keyed state with timers: pending, answered, failed, timed out, closed.

Requests are dealt to buckets by a hash of (worker, id), so a busy worker's requests spread over tasks and a
trigger calls Python once a bucket, not once a request. A request's timer is its deadline in event time;
afterwards it is remembered for a while, so that a late answer can be told from one that nobody asked for,
and then forgotten: state is bounded by what is in flight. A bucket's timer is the first of its requests'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.session import ship_package

MESSAGES = "worker string, id string, at timestamp, seq long, kind string, method string, ok boolean"
OUTCOMES = "worker string, id string, seq long, outcome string, method string, asked_at timestamp, deadline timestamp, at timestamp"
#: A bucket's requests as JSON: [worker, id, phase, method, asked, deadline, seq, due] each.
_STATE = "requests string"
#: Groups of the keyed state, each with its part of the requests in flight.
BUCKETS = 4096
#: Outcomes that end a request.
FINAL = ("answered", "failed", "timed_out", "closed")


#: No time, as numpy has it.
NEVER = np.iinfo(np.int64).min


class _Request:
    """One request's state and what happens to it, times in microseconds."""

    def __init__(self, held: tuple | None, timeout: int):
        self.phase, self.method, self.asked, self.deadline, self.seq, self.due = held or (None,) * 6
        self.timeout, self.out = timeout, []

    def _tell(self, outcome: str, seq: int | None, at: int) -> None:
        self.out.append((seq, outcome, self.method, self.asked, self.deadline, at))

    def expire(self) -> None:
        self._tell("timed_out", self.seq, self.deadline)
        self.phase = "expired"

    def take(self, kind: str, method: str | None, ok: bool, at: int, seq: int) -> None:
        if self.phase == "pending" and at > self.deadline:
            self.expire()
        if kind == "request":
            if self.phase is not None:
                self._tell("repeated", seq, at)
                return
            self.phase, self.method, self.asked, self.deadline, self.seq = "pending", method, at, at + self.timeout, seq
            self._tell("pending", seq, at)
        elif self.phase == "pending":
            self._tell("answered" if ok else "failed", seq, at)
            self.phase = "done"
        elif self.phase == "expired":
            self._tell("late", seq, at)
            self.phase = "done"
        else:
            self._tell("stray", seq, at)


def track(messages: DataFrame, timeout_s: float, delay: str = "10 minutes", keep_s: float = 3600.0, buckets: int = BUCKETS) -> DataFrame:
    """Outcomes of a stream of ``MESSAGES`` as they become known; ``kind`` is request or response, others and
    messages without worker, id or time are left out. Within a trigger messages apply as they were sent, by
    ``seq``, then time, since a clock may step back; an answer that arrives in an earlier trigger than its
    request is stray. A task holds one bucket: its requests in flight and its messages of a trigger."""
    ship_package(messages.sparkSession)
    timeout, keep = int(timeout_s * 1e6), int(keep_s * 1e3)
    names = [x.split()[0] for x in OUTCOMES.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(worker, id_): _Request(tuple(rest), timeout) for worker, id_, *rest in json.loads(state.get[0])} if state.exists else {}
        now, touched, rows, told = state.getCurrentWatermarkMs(), set(), [], []
        if not state.hasTimedOut:
            for pdf in batches:
                at = pdf["at"].to_numpy("datetime64[us]").astype("int64").tolist()
                rows += zip(pdf["seq"].tolist(), at, pdf["worker"], pdf["id"], pdf["kind"], pdf["method"], pdf["ok"])
        for seq, at, worker, id_, kind, method, ok in sorted(rows, key=lambda r: r[:2]):
            name = (worker, id_)
            touched.add(name)
            if name not in held:
                held[name] = _Request(None, timeout)
            held[name].take(kind, method, ok is True or ok == 1, at, int(seq))
        kept = []
        for name, request in held.items():
            forget = request.phase is None  # nobody asked: nothing to remember
            if not forget and name in touched:
                due = request.deadline // 1000 if request.phase == "pending" else request.deadline // 1000 + keep
                request.due = max(due, now) + 1
            elif not forget and request.due < now:
                if request.phase == "pending":
                    request.expire()
                    request.due = max(request.deadline // 1000 + keep, now) + 1
                else:
                    forget = True
            told += ((*name, *x) for x in request.out)
            if not forget:
                kept.append((*name, request.phase, request.method, request.asked, request.deadline, request.seq, request.due))
        if kept:
            state.update((json.dumps(kept, separators=(",", ":")),))
            state.setTimeoutTimestamp(min(x[-1] for x in kept))
        elif state.exists:
            state.remove()
        if told:
            worker, id_, seq, outcome, method, *times = zip(*told)
            when = [np.array([NEVER if us is None else us for us in column], "datetime64[us]") for column in times]
            yield pd.DataFrame(dict(zip(names, (worker, id_, seq, outcome, method, *when))))

    known = messages.where("worker is not null and id is not null and at is not null and kind in ('request', 'response')").withWatermark("at", delay)
    dealt = known.withColumn("_bucket", F.pmod(F.xxhash64("worker", "id"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(step, OUTCOMES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settle(outcomes: DataFrame, ends: DataFrame) -> DataFrame:
    """The last word on every request once the input has ended: what has no answer has timed out where its
    deadline had come before its worker's end, else that end closed it, whether or not the stream's clock,
    which all workers share, had gone on. ``ends`` has worker, end; answers that ended no request (late,
    stray) and repeated requests stay as they are."""
    asks = outcomes.where(F.col("outcome").isin("pending", *FINAL))
    last = asks.groupBy("worker", "id").agg(F.max_by(F.struct("seq", "outcome", "method", "asked_at", "deadline", "at"), (F.col("outcome") != "pending").cast("int")).alias("x")).select("worker", "id", "x.*")
    held = last.join(ends, "worker", "left")
    waits, over = F.col("outcome").isin("pending", "timed_out"), F.col("deadline") <= F.col("end")
    ended = held.withColumn("at", F.when(waits & over, F.col("deadline")).when(waits, F.col("end")).otherwise(F.col("at"))).withColumn("outcome", F.when(waits & over, "timed_out").when(waits, "closed").otherwise(F.col("outcome")))
    names = [x.split()[0] for x in OUTCOMES.split(", ")]
    return ended.select(*names).unionByName(outcomes.where(~F.col("outcome").isin("pending", *FINAL)).select(*names))
