"""The event log: sequence numbers, replay, latest status, rule folding, line grouping and gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.operators.latest import assign_sequence, latest_by, next_sequence, replay_since
from planweave.operators.runs import line_numbers, runs_below
from planweave.operators.scale import last_value
from planweave.sources.ledger import Ledger
from planweave.sources.scratch import scratch_folder
from planweave.sources.tables import table
from planweave.streaming.eventlog import JOB_FLAGS, client_state

SECONDS = 20_000


def q_next_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return next_sequence(table(spark, folder, "events").select("user_id", "event_id"), ["user_id"], "event_id")


def q_assign_sequence(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return assign_sequence(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "sequence_no")


def replay_since_cursor(spark: SparkSession, folder: str) -> DataFrame:
    return replay_since(q_assign_sequence(spark, folder), "sequence_no", "5")


def latest_status_per_job(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return latest_by(events, ["user_id", "event_type"], ["ts", "event_id"])


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """The field k of the JSON properties, by a fixed schema."""
    events = table(spark, folder, "events")
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def fold_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Last rule of each kind over its default: clicks keep the previous value when theirs is small (missing),
    views reset to the default."""
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    value = F.when(F.col("value") >= 10, F.col("value"))
    kind, order = F.col("event_type"), F.col("event_id")
    return e.groupBy("user_id").agg(
        last_value(kind, value, order, "click", F.lit(3.0), keep_previous=True).alias("floor_height"),
        last_value(kind, value, order, "view", F.lit(0.3), keep_previous=False).alias("glazing_ratio"),
    )


def line_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events in lines: a pause of more than SECONDS begins one."""
    e = table(spark, folder, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "ts")
    lines = line_numbers(e, ["user_id"], ["ts", "event_id"], F.col("at"), SECONDS)
    return lines.groupBy("user_id", "line_no").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


def gap_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of low values of a user, closed by the next event that is not low."""
    e = table(spark, folder, "events").select("user_id", "event_id", "value")
    return runs_below(e, ["user_id"], ["event_id"], "value", 20.0, "event_id")


def client_states(spark: SparkSession, folder: str) -> DataFrame:
    """Events as job updates of their users, with payloads of several shapes, folded to what a client shows."""
    e = table(spark, folder, "events").select("user_id", "event_id")
    n = F.col("event_id")
    job = F.element_at(F.array(*map(F.lit, JOB_FLAGS)), (n % 5 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("running", "complete", "failed"))), (F.floor(n / 5) % 3 + 1).cast("int"))
    error = F.when(n % 7 == 0, F.concat(F.lit(', "error": {"message": "no '), n, F.lit('", "code": 5}'))).when(n % 7 == 1, F.lit(', "error": null')).otherwise("")
    stage = F.when(n % 4 == 0, F.concat(F.lit(', "stage": "s'), n % 10, F.lit('"'))).when(n % 4 == 1, F.lit(', "stage": ""')).otherwise("")
    data = F.concat(F.lit('{"event": "job_update", "data": {"job_type": "'), job, F.lit('", "status": "'), status, F.lit('"'), F.when(n % 3 == 0, F.concat(F.lit(', "progress": '), n % 100)).otherwise(""), stage, error, F.lit("}}"))
    payload = F.when(n % 11 == 0, F.lit('{"event": "heartbeat", "data": {}}')).when(n % 13 == 0, F.lit("no json {")).when(n % 17 == 0, F.lit("[1, 2]")).otherwise(data)
    return client_state(e.withColumn("payload", payload), ["user_id"], "event_id", "payload")


def numbered_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events logged in two appends that overlap, the second one twice: each event once, numbered on by user."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts")
    ledger = Ledger(spark, f"{scratch_folder(spark)}/log-{uuid.uuid4().hex}")
    for rows in (e.filter("event_id % 3 = 0"), e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 0"), e):
        ledger.append_numbered(rows, ["event_id"], ["user_id"], ["ts", "event_id"])
    return ledger.read().select("user_id", "event_id", "sequence_no")


QUERIES = {
    "client_states": client_states,
    "numbered_log": numbered_log,
    "next_sequence": q_next_sequence,
    "assign_sequence": q_assign_sequence,
    "replay_since_cursor": replay_since_cursor,
    "latest_status_per_job": latest_status_per_job,
    "json_props": json_props,
    "fold_rules": fold_rules,
    "line_grouping": line_grouping,
    "gap_runs": gap_runs,
}

_JOBS = "[" + ", ".join(f"'{j}'" for j in JOB_FLAGS) + "]"

ORACLE_SQL = {
    "client_states": f"""
        WITH j AS (SELECT user_id, event_id AS n, {_JOBS}[event_id % 5 + 1] AS job, ['running', 'complete', 'failed'][event_id // 5 % 3 + 1] AS status, CASE WHEN event_id % 4 = 0 THEN 's' || event_id % 10 END AS stage, CASE WHEN event_id % 3 = 0 THEN (event_id % 100)::DOUBLE END AS progress
            FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0),
        k AS (SELECT *, status = 'failed' AND n % 7 = 0 AS bad FROM j),
        c AS (SELECT *, CASE WHEN job = 'floorplan_parse' AND status = 'running' THEN coalesce(stage, 'analyzing') WHEN job = 'model_reconstruct' AND status = 'running' THEN coalesce(stage, 'building') ELSE stage END AS shown,
            CASE WHEN bad THEN false WHEN job = 'floorplan_parse' AND status = 'running' THEN true WHEN job = 'floorplan_parse' AND status = 'complete' THEN false END AS parsing,
            CASE WHEN bad OR job = 'floorplan_upload' AND status = 'complete' THEN false END AS uploading,
            CASE WHEN job = 'style_inference' THEN status = 'running' END AS inferring, CASE WHEN job = 'model_reconstruct' THEN status = 'running' END AS building, CASE WHEN job = 'geometry_rules' THEN status = 'running' END AS generating FROM k)
        SELECT user_id, arg_max(progress, n) FILTER (progress IS NOT NULL) AS progress, arg_max(shown, n) FILTER (shown IS NOT NULL) AS stage, coalesce(arg_max(parsing, n) FILTER (parsing IS NOT NULL), false) AS parsing,
          coalesce(arg_max(inferring, n) FILTER (inferring IS NOT NULL), false) AS inferring_style, coalesce(arg_max(building, n) FILTER (building IS NOT NULL), false) AS building, coalesce(arg_max(generating, n) FILTER (generating IS NOT NULL), false) AS generating_rules,
          coalesce(arg_max(uploading, n) FILTER (uploading IS NOT NULL), false) AS uploading, arg_max('no ' || n, n) FILTER (bad) AS error FROM c GROUP BY user_id""",
    "numbered_log": """
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 2 ELSE 3 END, ts, event_id) AS sequence_no FROM events""",
    "next_sequence": "SELECT user_id, coalesce(max(event_id), 0) + 1 AS next_sequence FROM events GROUP BY user_id",
    "assign_sequence": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS sequence_no FROM events",
    "replay_since_cursor": "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS sequence_no FROM events) WHERE sequence_no > 5",
    "latest_status_per_job": """
        SELECT user_id, event_type, ts, event_id, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "json_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "fold_rules": """
        WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN value >= 10 THEN value END AS v FROM events),
        c AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e WHERE event_type = 'click' AND v IS NOT NULL),
        w AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM e WHERE event_type = 'view')
        SELECT u.user_id, coalesce(c.v, 3.0::DOUBLE) AS floor_height, coalesce(w.v, 0.3::DOUBLE) AS glazing_ratio FROM (SELECT DISTINCT user_id FROM e) u
        LEFT JOIN c ON u.user_id = c.user_id AND c.rn = 1 LEFT JOIN w ON u.user_id = w.user_id AND w.rn = 1""",
    "line_grouping": f"""
        WITH e AS (SELECT user_id, event_id, ts, floor(epoch(ts)) AS s FROM events),
        j AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > {SECONDS} AS jump FROM e),
        l AS (SELECT *, sum(coalesce(jump::INT, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS line_no FROM j)
        SELECT user_id, line_no::BIGINT AS line_no, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM l GROUP BY ALL""",
    "gap_runs": """
        WITH e AS (SELECT user_id, event_id, value < 20 AS low, sum((value >= 20)::INT) OVER w AS run, coalesce(lead(event_id) OVER w, event_id) AS nxt
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, min(event_id) AS opens_at, max(nxt) AS closes_at, count(*) AS n FROM e WHERE low GROUP BY user_id, run""",
}
