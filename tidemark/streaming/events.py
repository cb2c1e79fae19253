"""Streaming versions of the event jobs. Run over the same events, they equal the batch jobs.

Streams carry ``event_id, ts (timestamp), name, user_id, anon_id, props``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from tidemark.operators import events as e
from tidemark.streaming.runner import last_update, nothing_yet, run_available

#: Microseconds of the shortest slot by which rows of a busy identity are parked.
SLOT = 3_600_000_000


def intake(stream: DataFrame, opted_out: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without opted-out users and without repeats of an event id within the delay.

    A stream is read once, so rows without a user take part in the lookup, each under a key of its
    own that no user has; they do not meet in one task.
    """
    user = F.col("user_id").cast("string")
    own = F.coalesce(F.concat(F.lit("u"), user), F.concat(F.lit("e"), F.col("event_id").cast("string")))
    gone = opted_out.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("__user")).distinct()
    kept = stream.withColumn("__user", own).join(gone, "__user", "left_anti").select(*stream.columns)
    return kept.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_intake(
    stream: DataFrame, registered: Sequence[str], opted_out: DataFrame, folder: str, delay: str = "1 hour"
) -> None:
    """Write accepted events and, apart from them, events with unregistered names."""

    rows = intake(stream, opted_out, delay)

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/arrived/batch={batch_id}")
        arrived = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/arrived/batch={batch_id}")
        accepted, quarantined = e.split_registered(arrived, registered)
        accepted.write.mode("overwrite").parquet(f"{folder}/accepted/batch={batch_id}")
        quarantined.write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch_id}")

    for name in ("accepted", "quarantine"):
        nothing_yet(stream.sparkSession, rows.schema, f"{folder}/{name}")
    run_available(rows, write, f"{folder}/checkpoint")


def quota_counters(uses: DataFrame, span: str, delay: str = "1 hour") -> DataFrame:
    """Used amount per (quota, tier, identity) and tumbling window of one minute or one day."""
    return (
        uses.withWatermark("ts", delay)
        .groupBy("quota", "tier", "identity", F.window("ts", span).alias("w"))
        .agg(F.sum("amount").alias("used"))
        .select("quota", "tier", "identity", F.col("w.start").alias("period_start"), "used")
    )


def monthly(days: DataFrame) -> DataFrame:
    """Used amount per calendar month, from the newest daily counters.

    No window of fixed length is a month, and state by month would never be let go; days are.
    """
    keys = ["quota", "tier", "identity"]
    return days.groupBy(*keys, F.date_trunc("month", "period_start").alias("period_start")).agg(F.sum("used").alias("used"))


def daily_rollup(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per name and day, appended once the watermark has passed the day."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "name")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(F.col("w.start").cast("date").alias("day"), "name", "event_count")
    )


def _keeper(width: int) -> type[StatefulProcessor]:
    """Base of the processors below. Made by a factory so that workers get it by value."""

    class Keeper(StatefulProcessor):
        """Typed state of an identity, until a moment that the watermark passes, and its rows in time order.

        Rows come in chunks of no particular order. If there are several, they are parked in the state
        store by slots of ``width`` microseconds and read slot by slot, so what is held is one chunk, or
        an identity's rows in one slot, however many of them a micro-batch has.
        """

        value_schema = ""
        columns: tuple[str, ...] = ()

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("kept", f"{self.value_schema}, until long")
            self.parked = handle.getMapState("parked", "slot long, part int", "block binary")

        def in_time_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            """Blocks of numbers, a row for each of ``columns``: first the time, then the event."""
            blocks = (np.stack([pdf[c].to_numpy(np.int64) for c in self.columns]) for pdf in rows if len(pdf))
            sort = lambda block: block[:, np.lexsort((block[1], block[0]))]
            first, second = next(blocks, None), next(blocks, None)
            if second is None:
                if first is not None:
                    yield sort(first)
                return
            parts: dict[int, int] = {}
            for block in itertools.chain([first, second], blocks):
                slots = block[0] // width
                for slot in np.unique(slots).tolist():
                    part = parts.get(slot, 0)
                    self.parked.updateValue((slot, part), (block[:, slots == slot].tobytes(),))
                    parts[slot] = part + 1
            for slot in sorted(parts):
                held = [np.frombuffer(self.parked.getValue((slot, part))[0], np.int64) for part in range(parts[slot])]
                yield sort(np.concatenate([x.reshape(len(self.columns), -1) for x in held], axis=1))
                for part in range(parts[slot]):
                    self.parked.removeKey((slot, part))

        def hold(self, value: tuple, until: int, timers: TimerValues) -> None:
            """Keep a value until the watermark passes a moment (milliseconds); not at all if it has passed already."""
            if until > timers.getCurrentWatermarkInMs():
                self.kept.update((*value, until))
                self.handle.registerTimer(until)
            elif self.kept.exists():
                self.kept.clear()

        def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            if self.kept.exists() and self.kept.get()[-1] <= expiredTimerInfo.getExpiryTimeInMs():
                self.kept.clear()  # an earlier timer of a value that was renewed does nothing
            return iter(())

        def close(self) -> None:
            pass

    return Keeper


def _limiter(width: int, limit: int, slot: int) -> StatefulProcessor:
    place_hits = e.anchored_window(width)

    class Limiter(_keeper(slot)):
        value_schema, columns = "start long, count long", ("at", "event_id")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            start, count = self.kept.get()[:2] if self.kept.exists() else (None, 0)
            for at, event_id in self.in_time_order(rows):
                ranks, start, count = place_hits(at, start, count)
                yield pd.DataFrame({"identity": key[0], "event_id": event_id, "place": ranks, "rejected": ranks > limit})
            self.hold((start, count), (start + width) // 1000, timerValues)

    return Limiter()


def rate_limiter(hits: DataFrame, limit: int, window_seconds: int = 60, delay: str = "1 hour") -> DataFrame:
    """Place of each hit in its identity's anchored window and whether it is rejected.

    State per identity: start of the window and hits in it, until the watermark has passed the
    window's end. Hits of one micro-batch are placed in time order. Run it on a state store that keeps
    state on disk, as ``runner`` does.
    """
    width = int(window_seconds) * 1_000_000
    rows = hits.withWatermark("ts", delay).select("identity", F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("identity").transformWithStateInPandas(
        _limiter(width, limit, max(width, SLOT)), "identity string, event_id long, place long, rejected boolean", "append", "eventTime"
    )


def _advancer(wanted: list[list[int]], kept_ms: int, slot: int) -> StatefulProcessor:
    class Advancer(_keeper(slot)):
        value_schema, columns = "stage int", ("at", "event_id", "code")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            stage, newest, reached = (self.kept.get()[0] if self.kept.exists() else 0), 0, []
            for at, event_id, code in self.in_time_order(rows):
                low, newest = 0, int(at[-1])
                while stage < len(wanted):
                    hits = np.flatnonzero(np.isin(code[low:], wanted[stage]))
                    if not len(hits):
                        break
                    low += int(hits[0]) + 1
                    reached.append((key[0], stage, int(event_id[low - 1])))
                    stage += 1
            self.hold((stage,), newest // 1000 + kept_ms, timerValues)
            if reached:
                yield pd.DataFrame(reached, columns=["identity", "stage", "event_id"])

    return Advancer()


def funnel_progress(
    stream: DataFrame, steps: Sequence[tuple[str, Sequence[str]]], look_back_days: int = 90, delay: str = "1 hour"
) -> DataFrame:
    """(identity, stage, event_id) whenever an identity reaches a further stage.

    State per identity: the stage reached, until nothing has come for ``look_back_days``; an identity
    that comes back later starts anew. Events are in time order within a micro-batch; an event
    that comes a batch too late counts from where the identity stands (batch results may differ).
    """
    every = sorted({name for _, names in steps for name in names})
    wanted = [[every.index(name) for name in names] for _, names in steps]
    code = F.coalesce(*[F.when(F.col("name") == name, F.lit(k)) for k, name in enumerate(every)])
    rows = stream.withWatermark("ts", delay).where(F.col("name").isin(every)).select(
        e.identity().alias("identity"), F.col("event_id").cast("long").alias("event_id"), code.alias("code"), "ts", F.unix_micros("ts").alias("at")
    )
    processor = _advancer(wanted, look_back_days * 86_400_000, 24 * SLOT)
    return rows.groupBy("identity").transformWithStateInPandas(processor, "identity string, stage int, event_id long", "append", "eventTime")


def run_lead_scores(
    stream: DataFrame,
    history: DataFrame | None,
    rules: Sequence[e.SignalRule],
    as_of: str,
    days: int,
    folder: str,
) -> DataFrame:
    """Lead scores kept up to date: each micro-batch rescores the users it touches.

    Arrived events are kept by day in a table below ``folder``; a batch reads the days of the window
    there, and of those its own users, so no state grows in the stream. A batch writes the scores of
    its users; the newest row of a user is the valid one. Running a batch again replaces its own
    folders. ``history`` holds events from before the stream.
    """
    spark = stream.sparkSession
    columns = ["event_id", "ts", "name", "user_id", "props"]
    schema = stream.select(*columns).schema
    stored = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("day", DateType())])
    day = F.to_date("ts")

    def write(df: DataFrame, batch_id: int) -> None:
        kept = df.select(*columns, day.alias("day"))
        kept.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/events/batch={batch_id}")
        seen = spark.read.schema(stored).option("basePath", f"{folder}/events").parquet(f"{folder}/events")
        touched = seen.where(F.col("batch") == batch_id).select("user_id").distinct()
        first = F.date_sub(F.to_date(F.lit(as_of)), days + 1)
        window = seen.where((F.col("day") >= first) & (F.col("batch") <= batch_id)).select(*columns)
        if history is not None:
            window = window.unionByName(e.look_back(history, as_of, days).select(*columns))
        window = window.join(touched, "user_id", "left_semi")
        fresh = e.lead_scores(window, rules, as_of, days).select("user_id", "score", "instant")
        fresh.write.mode("overwrite").parquet(f"{folder}/leads/batch={batch_id}")

    empty = spark.createDataFrame([], schema)
    scores = e.lead_scores(empty, rules, as_of, days).select("user_id", "score", "instant").schema
    nothing_yet(spark, scores, f"{folder}/leads")
    run_available(stream, write, f"{folder}/checkpoint")
    leads = spark.read.schema(scores.add("batch", IntegerType())).option("basePath", f"{folder}/leads").parquet(f"{folder}/leads")
    return last_update(leads, "user_id")
