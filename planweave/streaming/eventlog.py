"""Numbering, latest status and replay of a stream of project events."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from planweave.sources.ledger import Ledger

# A project's states in their order.
STATES = ("draft", "floorplan_ingested", "plan_parsed", "graph_built", "style_inferred", "geometry_rules_built", "model_reconstructed", "model_critiqued", "renders_generated", "exports_ready", "ready")
NUMBERED = "user_id long, event_id long, sequence_no long"


class Numbering(StatefulProcessor):
    """Gives each event of a key the next number; the last one is kept as state, so numbers have no gaps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = self.last.get()[0] if self.last.exists() else 0
        self.last.update((last + len(batch),))
        yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"].to_numpy(), "sequence_no": range(last + 1, last + 1 + len(batch))})

    def close(self) -> None:
        pass


def number_events(events: DataFrame) -> DataFrame:
    """user_id, event_id, sequence_no: one writer a key, so two events never share a number."""
    rows = events.select("user_id", "event_id", "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(Numbering(), outputStructType=NUMBERED, outputMode="append", timeMode="none")


def latest_status(events: DataFrame) -> DataFrame:
    """Latest event of each (user_id, event_type), as a running aggregate."""
    newest = F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id", "event_type").agg(newest.alias("e")).select("user_id", "event_type", "e.*")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def chained(events: DataFrame, stages, checkpoint: str) -> StreamingQuery:
    """Runs every micro-batch through ``stages`` (functions of a DataFrame and the batch's number) in order."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for stage in stages:
                stage(batch, number)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged(events: DataFrame, ledger: Ledger, keys: list[str], group: list[str], order: list[str], checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Writes a stream of events (with ts) to the ledger, numbered by group: repeats within the watermark are dropped, and the ledger adds no key twice, so
    neither repeated events nor a batch that runs again after a failure change it."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.foreachBatch(lambda batch, _: ledger.append_numbered(batch, keys, group, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FRAMES = "project string, id long, data string"
#: Milliseconds between heartbeats, and after which a project without events is forgotten.
HEARTBEAT_MS, IDLE_MS = 15_000, 3_600_000


def timestamp(milliseconds: int) -> str:
    return datetime.fromtimestamp(milliseconds / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class LiveTail(StatefulProcessor):
    """A project's frames: its events after the cursor, each number once, then a heartbeat whenever nothing came for a while. After an idle time
    its state goes, and with it the heartbeats, until the next event."""

    def __init__(self, cursor: int, heartbeat_ms: int, idle_ms: int) -> None:
        self.cursor, self.heartbeat_ms, self.idle_ms = cursor, heartbeat_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "sent long, heard long")

    def wake(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.heartbeat_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sent = self.state.get()[0] if self.state.exists() else self.cursor
        for part in rows:
            new = part[part["sequence_no"] > sent].sort_values("sequence_no").drop_duplicates("sequence_no")
            if len(new):
                sent = int(new["sequence_no"].iloc[-1])
                data = [f'{{"event": {json.dumps(e)}, "data": {p if isinstance(p, str) else "{}"}}}' for e, p in zip(new["event_type"], new["payload"], strict=True)]
                yield pd.DataFrame({"project": key[0], "id": new["sequence_no"].to_numpy(), "data": data})
        now = timerValues.getCurrentProcessingTimeInMs()
        self.state.update((sent, now))
        self.wake(now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.state.exists() or now - self.state.get()[1] >= self.idle_ms:
            self.state.clear()
            return
        yield pd.DataFrame({"project": [key[0]], "id": pd.array([None], dtype="Int64"), "data": [json.dumps({"event": "heartbeat", "data": {"timestamp": timestamp(now)}})]})
        self.wake(now)

    def close(self) -> None:
        pass


def live_tail(events: DataFrame, cursor: int = 0, heartbeat_ms: int = HEARTBEAT_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """(project, id, data): what a client that has seen ``cursor`` is sent of a stream of numbered events (project, sequence_no, event_type, payload as JSON text)."""
    rows = events.select("project", "sequence_no", "event_type", "payload")
    return rows.groupBy("project").transformWithStateInPandas(LiveTail(cursor, heartbeat_ms, idle_ms), outputStructType=FRAMES, outputMode="append", timeMode="ProcessingTime")


# The job types and the flag that each one's running sets.
JOB_FLAGS = {"floorplan_parse": "parsing", "style_inference": "inferring_style", "model_reconstruct": "building", "geometry_rules": "generating_rules", "floorplan_upload": "uploading"}
# Stages that a running job without one shows.
JOB_STAGES = {"floorplan_parse": "analyzing", "model_reconstruct": "building"}


def client_state(events: DataFrame, keys: list[str], number: str, payload: str) -> DataFrame:
    """What a client shows after all events of a key: progress, stage, a flag for each running job and the last error. Of a stream it is a running
    aggregate, so batch and stream give the same.

    Payloads are JSON of any shape, read as variants; what is no job update, or no JSON, changes nothing. Each field keeps the last value that an event gives it:
    running sets its job's flag, complete and failed reset it (a failed parse needs an error), and a failure with an
    error sets the error and resets uploading and parsing.
    """
    v = F.try_parse_json(payload)
    of = lambda path, kind: F.try_variant_get(v, path, kind)
    fields = {"event": of("$.event", "string"), "job": of("$.data.job_type", "string"), "status": of("$.data.status", "string"), "stage": F.nullif(of("$.data.stage", "string"), F.lit("")), "progress": of("$.data.progress", "double"), "error": of("$.data.error", "variant"), "message": of("$.data.error.message", "string")}
    rows = events.select(*keys, F.col(number).alias("__n"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("__e")).filter("__e.event = 'job_update'")
    e = F.col("__e")
    failed = (e["status"] == "failed") & e["error"].isNotNull() & ~F.coalesce(F.is_variant_null(e["error"]), F.lit(True))

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("__n")))

    stage = e["stage"]
    for job, shown in JOB_STAGES.items():
        stage = F.when((e["job"] == job) & (e["status"] == "running"), F.coalesce(e["stage"], F.lit(shown))).otherwise(stage)
    flags = []
    for job, flag in JOB_FLAGS.items():
        mine, down = e["job"] == job, e["status"].isin("complete", "failed")
        if flag in ("parsing", "uploading"):
            down = (e["status"] == "complete") | (failed & F.lit(flag == "parsing"))
        changed = F.when(mine & down, F.lit(False))
        if flag != "uploading":
            changed = F.when(mine & (e["status"] == "running"), F.lit(True)).otherwise(changed)
        if flag in ("parsing", "uploading"):
            changed = F.when(failed, F.lit(False)).otherwise(changed)
        flags.append(F.coalesce(last(changed), F.lit(False)).alias(flag))
    return rows.groupBy(*keys).agg(last(e["progress"]).alias("progress"), last(stage).alias("stage"), *flags, last(F.when(failed, F.coalesce(e["message"], F.lit("")))).alias("error"))
