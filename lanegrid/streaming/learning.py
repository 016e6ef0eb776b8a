"""The learning fold and rate ingestion as structured streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lanegrid.operators.labels import CONFIRM_GAIN, DECAY, PASSIVE_GAIN, PROMOTE_AT, PROMOTE_CONFIDENCE, PROMOTE_PASSIVE_AT, TAUGHT_GAIN, fold_step
from lanegrid.operators.rates import money
from lanegrid.streaming.target import Target

STATE = "confirmations double, corrections int, confidence double, promoted boolean"
WAITING = "ts timestamp, seq long, kind string"
OUTPUT = f"type string, raw string, canonical string, {STATE}, waiting array<struct<ts:timestamp,seq:bigint,kind:string>>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple, kind: str) -> tuple:
    """One event applied to (confirmations, corrections, confidence, promoted)."""
    n, wrong, c, promoted = state
    if kind == "wrong":
        return (n, wrong, None, promoted) if c is None else (n, wrong + 1, c * DECAY, promoted)
    if c is None:
        c = 0.4 if kind == "passive" else 0.5
    if kind == "confirm":
        n, c = n + 1, min(0.99, c + (1 - c) * CONFIRM_GAIN)
        promoted = promoted or (n >= PROMOTE_AT and c >= PROMOTE_CONFIDENCE)
    elif kind == "passive":
        n, c = n + 0.5, min(0.95, c + (1 - c) * PASSIVE_GAIN)
        promoted = promoted or (n >= PROMOTE_PASSIVE_AT and c >= PROMOTE_CONFIDENCE)
    else:
        n, c, promoted = n + 1, min(0.99, c + TAUGHT_GAIN), True
    return n, wrong, c, promoted


class LearningFold(StatefulProcessor):
    """Folds each key's events in the order of their time, whatever order they come in.

    Events wait in the state until the watermark has passed them: then no earlier one can come any more. A timer
    at the time of a key's earliest waiting event wakes it; the fold takes all that the watermark has passed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def _events(self) -> list[tuple]:
        return sorted(map(tuple, self.waiting.get()), key=lambda e: e[:2]) if self.waiting.exists() else []

    def _state(self) -> tuple:
        return tuple(self.folded.get()) if self.folded.exists() else (0.0, 0, None, False)

    def _row(self, key: tuple, state: tuple, events: list[tuple]) -> pd.DataFrame:
        waiting = [{"ts": ts, "seq": seq, "kind": kind} for ts, seq, kind in events]
        return pd.DataFrame([(*key, *state, waiting)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._events()
        new = [(ts.to_pydatetime(), int(seq), kind) for part in rows for ts, seq, kind in zip(part["ts"], part["seq"], part["kind"], strict=True)]
        self.waiting.appendList(new)
        events = sorted(before + new, key=lambda e: e[:2])
        if not before or events[0][0] < before[0][0]:
            self._wake(events[0][0], before[0][0] if before else None)
        yield self._row(key, self._state(), events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        events, state = self._events(), self._state()
        due = [e for e in events if pd.Timestamp(e[0]) <= now]
        left = events[len(due) :]
        for e in due:
            state = step(state, e[2])
        self.folded.update(state)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(_ms(left[0][0]))
        else:
            self.waiting.clear()
        yield self._row(key, state, left)

    def _wake(self, first, before) -> None:
        if before is not None:
            self.handle.deleteTimer(_ms(before))
        self.handle.registerTimer(_ms(first))

    def close(self) -> None:
        pass


def _ms(ts) -> int:
    """A time in whole milliseconds, not before it."""
    return -(-pd.Timestamp(ts).value // 1_000_000)


def learning_state(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The state of every key whenever the watermark has passed some of its events; events over ``late`` behind the latest are dropped and counted."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # the processor's runner does not get the session's module path, so the class travels itself
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = events.select("type", "raw", "canonical", F.col("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    return rows.withWatermark("ts", late).groupBy("type", "raw", "canonical").transformWithStateInPandas(LearningFold(), OUTPUT, "Update", "EventTime")


def late_events(query: StreamingQuery) -> int:
    """Events that a stream has dropped as too late, as far as its progress is kept."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def _latest(rows: DataFrame) -> DataFrame:
    state = F.struct("confirmations", "corrections", "confidence", "promoted", "waiting")
    return rows.groupBy("type", "raw", "canonical").agg(F.max_by(state, "batch").alias("s")).select("type", "raw", "canonical", "s.*")


def states(spark: SparkSession, path: str) -> Target:
    """The target of the states: the last one of each key counts."""
    return Target(spark, path, _latest)


def write_states(events: DataFrame, target: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Starts a stream that writes the state of the keys that each batch touched."""
    to = states(events.sparkSession, target)
    return learning_state(events, late).writeStream.foreachBatch(to.put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_states(spark: SparkSession, target: str, settled: bool = False) -> DataFrame:
    """The state of every key after all events so far; ``settled``: only after those that the watermark has passed."""
    rows = states(spark, target).read()
    if not settled:
        start = F.struct(F.col("confirmations").alias("n"), "corrections", F.col("confidence").alias("c"), "promoted")
        rows = rows.withColumn("s", F.aggregate(F.array_sort("waiting"), start, fold_step))
        rows = rows.select("type", "raw", "canonical", F.col("s.n").alias("confirmations"), "s.corrections", F.col("s.c").alias("confidence"), "s.promoted")
    return rows.drop("waiting").where("confidence is not null")


def _summed(rows: DataFrame) -> DataFrame:
    parts = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")]
    return rows.groupBy("vendor_id", "origin", "dest").agg(*parts)


def cells(spark: SparkSession, path: str) -> Target:
    """The target of the rates: number, sum, least and greatest of each cell add up."""
    return Target(spark, path, _summed)


def ingest_rates(rates: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that writes, for every batch, what its samples add to each cell (vendor_id, origin, dest): number, sum, least and greatest."""
    to = cells(rates.sparkSession, target)
    parts = [F.count("rate").alias("n"), F.sum("rate").alias("total"), F.min("rate").alias("least"), F.max("rate").alias("most")]

    def write(batch: DataFrame, number: int) -> None:
        to.put(batch.groupBy("vendor_id", "origin", "dest").agg(*parts), number)

    return rates.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_matrix(spark: SparkSession, target: str, threshold: float = 5.0) -> DataFrame:
    """One rate per cell over all batches: the highest sample if they are within ``threshold`` of each other, else their mean."""
    close = F.col("most") - F.col("least") <= threshold
    return cells(spark, target).read().select("vendor_id", "origin", "dest", money(F.when(close, F.col("most")).otherwise(F.col("total") / F.col("n"))).alias("rate"))
