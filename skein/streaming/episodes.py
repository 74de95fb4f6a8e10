"""How episodes end, over a table or a stream of their steps.

A step is a call, a submit, an error (of the policy itself) or malformed (no call could be read).  An episode takes steps in
order until one submits, one is an error, more than max_malformed did not parse, or max_steps are used up; a malformed step
uses one up but is none of its `steps`, as an error is not.  What comes after the end changes nothing.

An episode without an end is budget_exhausted: in a table, which has all its steps, and in a stream once nothing has come for
`stall` of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SUBMIT, ERROR, MALFORMED = "submit", "error", "malformed"
SUBMITTED, FAILED, EXHAUSTED = "submitted", "error", "budget_exhausted"

#: places in the state of an episode
_NEXT, _USED, _STEPS, _MALFORMED, _STATUS, _LAST, _WAITING = range(7)


def outcomes(steps: DataFrame, key: str, order: str, kind: str, max_steps: int, max_malformed: int = 2) -> DataFrame:
    """(key, steps, malformed, status) of each episode of a table.

    Only the first max_steps steps of an episode are kept, before the shuffle as after it, however many there are.
    """
    of = Window.partitionBy(key).orderBy(order)
    first = steps.select(key, F.col(kind).alias("_kind"), F.row_number().over(of).alias("_k")).where(F.col("_k") <= max_steps)
    bad = F.count_if(F.col("_kind") == MALFORMED).over(Window.partitionBy(key).orderBy("_k"))
    end = (
        F.when(F.col("_kind") == SUBMIT, SUBMITTED)
        .when((F.col("_kind") == ERROR) | ((F.col("_kind") == MALFORMED) & (bad > max_malformed)), FAILED)
        .when(F.col("_k") == max_steps, EXHAUSTED)
    )
    ended = first.withColumn("_end", end).withColumn("_last", F.min(F.when(F.col("_end").isNotNull(), F.col("_k"))).over(Window.partitionBy(key)))
    used = ended.where("_last is null or _k <= _last")
    calls = F.count_if(~F.col("_kind").isin(MALFORMED, ERROR)).cast("int")
    status = F.coalesce(F.max("_end"), F.lit(EXHAUSTED))
    return used.groupBy(key).agg(calls.alias("steps"), F.count_if(F.col("_kind") == MALFORMED).cast("int").alias("malformed"), status.alias("status"))


class _Episode(StatefulProcessor):
    """State of an episode: its fold (the next step's number, steps, malformed, status) and steps that came before their turn."""

    def __init__(self, key: str, order: str, kind: str, ts: str, max_steps: int, max_malformed: int, stall_ms: int):
        self.key, self.order, self.kind, self.ts = key, order, kind, ts
        self.max_steps, self.max_malformed, self.stall_ms = max_steps, max_malformed, stall_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "next int, used int, steps int, malformed int, status string, last long, waiting int")
        self.early = handle.getMapState("early", "at int", "kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.fold.exists()
        state = list(self.fold.get()) if known else [0, 0, 0, 0, None, 0, 0]
        before, ended = state[_LAST], state[_STATUS]
        steps: dict[int, str] = {}
        for frame in rows:
            state[_LAST] = max(state[_LAST], int(frame[self.ts].max().timestamp() * 1000))
            for at, kind in zip(frame[self.order].tolist(), frame[self.kind].tolist()):
                if at >= state[_NEXT]:  # else it has had its turn
                    steps.setdefault(at, kind)
        if ended is None:
            waiting = self._waiting(state)
            steps |= waiting
            while state[_STATUS] is None and state[_NEXT] in steps:
                self._take(state, steps.pop(state[_NEXT]))
            self._wait(state, {} if state[_STATUS] else steps, waiting)
        self.fold.update(tuple(state))
        if state[_LAST] != before:
            if known:
                self.handle.deleteTimer(before + self.stall_ms)
            self.handle.registerTimer(state[_LAST] + self.stall_ms)
        if state[_STATUS] is not None and ended is None:
            yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.fold.get())
        if expiredTimerInfo.getExpiryTimeInMs() < state[_LAST] + self.stall_ms:
            return  # steps have come since; their timer is still to come
        if state[_STATUS] is None:  # gaps will not be filled any more
            for _, kind in sorted(self._waiting(state).items()):
                if state[_STATUS] is None:
                    self._take(state, kind)
            state[_STATUS] = state[_STATUS] or EXHAUSTED
            yield self._row(key, state)
        self.fold.clear()
        self.early.clear()

    def _waiting(self, state: list) -> dict[int, str]:
        return {k[0]: v[0] for k, v in self.early.iterator()} if state[_WAITING] else {}

    def _wait(self, state: list, steps: dict[int, str], waiting: dict[int, str]) -> None:
        """Keep the steps that wait; waiting did before."""
        for at in waiting.keys() - steps.keys():
            self.early.removeKey((at,))
        for at in steps.keys() - waiting.keys():
            self.early.updateValue((at,), (steps[at],))
        state[_WAITING] = len(steps)

    def _take(self, state: list, kind: str) -> None:
        state[_NEXT] += 1
        state[_USED] += 1
        state[_STEPS] += kind not in (MALFORMED, ERROR)
        state[_MALFORMED] += kind == MALFORMED
        if kind == SUBMIT:
            state[_STATUS] = SUBMITTED
        elif kind == ERROR or state[_MALFORMED] > self.max_malformed:
            state[_STATUS] = FAILED
        elif state[_USED] >= self.max_steps:
            state[_STATUS] = EXHAUSTED

    def _row(self, key, state: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], state[_STEPS], state[_MALFORMED], state[_STATUS])], columns=[self.key, "steps", "malformed", "status"])

    def close(self) -> None:
        pass


def outcome_stream(steps: DataFrame, key: str, order: str, kind: str, ts: str, max_steps: int, max_malformed: int = 2, stall: str = "1 hour") -> DataFrame:
    """outcomes() of a stream: a row for each episode when it ends, once.

    Steps are numbered 0, 1, ... in `order`; they may come late, repeated or out of order, and wait for those before them.
    An episode ends by its steps, or by a timer when `stall` of event time has passed since its last step; then the steps
    that wait are taken without those that never came, and the state goes.  Steps later than the watermark (also `stall`)
    are not seen.  State is kept by RocksDB, so a restart goes on where the last run stopped.
    """
    spark = steps.sparkSession
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != provider:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    stall_ms = int(spark.range(1).select((F.expr(f"timestamp '1970-01-02 00:00:00' + interval {stall}").cast("double") - F.expr("timestamp '1970-01-02 00:00:00'").cast("double")) * 1000).first()[0])
    schema = f"{key} {dict(steps.dtypes)[key]}, steps int, malformed int, status string"
    rows = steps.select(key, F.col(order).cast("int").alias(order), kind, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, stall)
    return rows.groupBy(key).transformWithStateInPandas(_Episode(key, order, kind, ts, max_steps, max_malformed, stall_ms), schema, "Append", "EventTime")
