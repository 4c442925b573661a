"""The event log of scans: batch folds and their streaming twins."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (StatefulProcessor,
                                                      StatefulProcessorHandle)

from ..functions import fixed, labels
from ..operators.ordered import numbered, running_totals, top_n

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCAN = ("scan_id",)


# ---- the log itself (R1, R8, P21) -------------------------------------------------
def sequenced(events: DataFrame, keys=SCAN, order=("ts", "event_id"), block="hour"):
    """Event sequence numbers per scan; long logs are numbered hour by hour."""
    return numbered(events, keys, list(order), F.date_trunc(block, F.col(order[0])), "seq")


def persisted(events: DataFrame) -> DataFrame:
    """Token and heartbeat events stay live-only."""
    return events.where(~F.col("type").isin(*fixed.TRANSIENT_EVENTS))


def retained(events: DataFrame, keys=SCAN, n: int = fixed.EVENT_RETENTION) -> DataFrame:
    """The newest *n* events per scan: everything above (max seq - n)."""
    last = events.groupBy(*keys).agg((F.max("seq") - n).alias("_floor"))
    return events.join(last, list(keys)).where(F.col("seq") > F.col("_floor")).drop("_floor")


# ---- batch folds (R3, R5-R7, R14) ---------------------------------------------------
def until_terminal(events: DataFrame, keys=SCAN) -> DataFrame:
    """Events up to and including the first done, failed or canceled one."""
    stops = events.where(F.col("type").isin(*fixed.TERMINAL_EVENTS)).groupBy(*keys).agg(
        F.min("seq").alias("_stop"))
    return events.join(stops, list(keys), "left").where(
        F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop"))).drop("_stop")


def _last(column: str):
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq")))


def stage_board(events: DataFrame, keys=SCAN, finished: bool = True) -> DataFrame:
    """Last known state, done and total per stage. After a clean finish a stage that
    is still pending or running was never reached: skipped."""
    rows = events.where(F.col("stage").isNotNull() & (F.col("stage") != "")).groupBy(
        *keys, "stage").agg(_last("state").alias("state"), _last("done").alias("done"),
                            _last("total").alias("total"))
    state = F.coalesce("state", F.lit("pending"))
    if finished:
        state = F.when(state.isin("pending", "running"), "skipped").otherwise(state)
    return rows.withColumn("state", state).withColumn(
        "stage_order", labels.stage_order(F.col("stage")))


def stage_progress(events: DataFrame, keys=SCAN) -> DataFrame:
    """Monotone progress per stage."""
    return events.where("stage is not null").groupBy(*keys, "stage").agg(
        F.max("done").alias("done"), F.max("total").alias("total"))


def narration(tokens: DataFrame, keys=SCAN, chunk: int = 1000) -> DataFrame:
    """Token texts joined in order, in runs of *chunk* tokens so that one scan's
    narration is never assembled in one place."""
    runs = tokens.select(*keys, F.floor(F.col("seq") / chunk).alias("chunk"), "seq", "text")
    return runs.groupBy(*keys, "chunk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
        .alias("text"))


def narration_pages(tokens: DataFrame, keys=SCAN, page: int = 65_536, block: int = 4096) -> DataFrame:
    """(keys, page_no, text): the narration of a scan cut into pages of *page* characters, the last one shorter.

    Every token gets its place in the text by running sums over blocks of *block* sequence numbers, and
    is cut where pages end; a page is put together from its own pieces only. Null texts are empty.
    """
    keys = list(keys)
    rows = tokens.select(*keys, "seq", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    placed = running_totals(rows, keys, ["seq"], F.floor(F.col("seq") / block), end=F.length("text"))
    start = F.col("end") - F.length("text")
    cut = placed.select(*keys, "text", start.alias("start"), F.explode(F.sequence(
        F.floor(start / page), F.floor((F.col("end") - 1) / page))).alias("page_no"))
    lo = F.greatest(F.col("page_no") * page, F.col("start"))
    piece = F.substr("text", (lo - F.col("start") + 1).cast("int"), (F.col("page_no") * page + page - lo).cast("int"))
    return cut.select(*keys, "page_no", lo.alias("lo"), piece.alias("piece")).groupBy(*keys, "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "piece"))), lambda x: x["piece"]), "").alias("text"))


def narration_slice(pages: DataFrame, wanted: DataFrame, keys=SCAN, page: int = 65_536) -> DataFrame:
    """(the columns of *wanted*, text): characters first .. last (from 0) of narrations, one page join. *wanted* has keys,
    first and last; a slice is put together from the pages it touches."""
    keys = list(keys)
    each = wanted.withColumn("page_no", F.explode(F.sequence(
        F.floor(F.col("first") / page), F.floor(F.col("last") / page)))).join(pages, [*keys, "page_no"])
    lo = F.greatest(F.col("first") - F.col("page_no") * page, F.lit(0))
    piece = F.substr("text", (lo + 1).cast("int"), (F.col("last") - F.col("page_no") * page - lo + 1).cast("int"))
    return each.groupBy(*wanted.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("page_no", piece.alias("piece")))), lambda x: x["piece"]), "").alias("text"))


def live_status(events: DataFrame, keys=SCAN) -> DataFrame:
    """Last status, paused flag and token total per scan."""
    c = F.col
    ended = c("type").isin(*fixed.TERMINAL_EVENTS)
    status = F.when(c("type") == "status", c("status")).when(
        c("type") == "done", F.coalesce("status", F.lit("completed"))).when(ended, c("type"))
    paused = F.when(ended, F.lit(False)).when(c("type") == "control", F.when(
        c("control") == "paused", True).when(c("control").isin("resumed", "resume"), False))
    tokens = F.when(c("type").isin("tokens", "done"), c("tokens"))
    pick = lambda v: F.max_by(v, F.when(v.isNotNull(), c("seq")))
    return events.groupBy(*keys).agg(
        pick(status).alias("status"), F.coalesce(pick(paused), F.lit(False)).alias("paused"),
        pick(tokens).alias("tokens"))


def recent_events(events: DataFrame, keys=SCAN, n: int = 100) -> DataFrame:
    return top_n(events, keys, [F.desc("seq")], n, "_back").drop("_back")


# ---- streams ---------------------------------------------------------------------------
def deduplicated(events: DataFrame, delay: str = "10 minutes", keys=SCAN) -> DataFrame:
    """Replayed events dropped within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*keys, "seq"])


def stage_board_stream(events: DataFrame, keys=SCAN) -> DataFrame:
    """The stage board as a running aggregation (update mode)."""
    return stage_board(events, keys, finished=False)


class _Feed(StatefulProcessor):
    """Passes events on until a terminal one; emits a heartbeat when a scan that has
    not ended stays silent."""

    def __init__(self, columns: list[str], idle_seconds: int | None) -> None:
        self._columns, self._idle = columns, idle_seconds
        self._terminal = fixed.TERMINAL_EVENTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers):
        """Frame by frame: a scan's events come in the order of their numbers, so nothing is gathered."""
        ended, seen = self._ended.exists(), False
        for frame in rows:
            if ended:
                continue  # the rest is read and dropped
            frame, seen = frame.sort_values("seq", kind="stable"), True
            stops = frame["type"].isin(self._terminal).to_numpy().nonzero()[0]
            if len(stops):
                frame, ended = frame.iloc[: stops[0] + 1], True
                self._ended.update((True,))
            yield frame[self._columns]
        if self._idle is not None and seen:
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            if not ended:
                self._handle.registerTimer(
                    timers.getCurrentProcessingTimeInMs() + self._idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._ended.exists():
            return
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle * 1000)
        beat = dict.fromkeys(self._columns)
        beat.update(scan_id=key[0], type="heartbeat")
        yield pd.DataFrame([beat], columns=self._columns)

    def close(self) -> None:
        pass


def feed_stream(events: DataFrame, idle_seconds: int | None = None) -> DataFrame:
    """Live feed per scan: ends after a terminal event (R3), heartbeat when idle.

    Needs the RocksDB state store:
    ``spark.sql.streaming.stateStore.providerClass``.
    """
    mode = "none" if idle_seconds is None else "processingTime"
    cols = events.columns
    return events.groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_Feed(cols, idle_seconds), outputStructType=events.schema,
        outputMode="Append", timeMode=mode)


class _Ring(StatefulProcessor):
    """The newest events of a scan in a ring of the state store: a place for each number modulo
    its size, so an event leaves when the one that many numbers later arrives."""

    def __init__(self, size: int, idle_seconds: int | None) -> None:
        self._size, self._idle = size, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._ring = handle.getMapState("ring", "place long", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers):
        for frame in rows:
            gone = []
            for seq in sorted(int(x) for x in frame["seq"]):
                place = (seq % self._size,)
                held = self._ring.getValue(place) if self._ring.containsKey(place) else None
                if held is None or held[0] < seq:
                    self._ring.updateValue(place, (seq,))
                if held is not None and held[0] != seq:
                    gone.append(min(held[0], seq))
            if gone:
                yield pd.DataFrame({"scan_id": key[0], "seq": gone, "reason": "newer"})
        if self._idle is not None:
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            self._handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self._idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        left = sorted(int(v[0]) for v in self._ring.values())
        self._ring.clear()
        if left:
            yield pd.DataFrame({"scan_id": key[0], "seq": left, "reason": "idle"})

    def close(self) -> None:
        pass


def evicted_stream(events: DataFrame, n: int = fixed.EVENT_RETENTION, idle_seconds: int | None = None) -> DataFrame:
    """(scan_id, seq, reason): events that leave the newest *n* of their scan (R1), and what a scan still
    holds once it was silent for *idle_seconds*. The state keeps numbers only, *n* a scan at most. Needs the RocksDB state store."""
    return events.groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_Ring(n, idle_seconds), outputStructType="scan_id string, seq long, reason string",
        outputMode="Append", timeMode="none" if idle_seconds is None else "processingTime")


def append_in_batches(findings: DataFrame, table: str, checkpoint: str):
    """Findings appended while a run goes on (R13); the final set replaces them with
    ``replace_sources``. Batches are written under their id, so a retried batch
    overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return findings.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
