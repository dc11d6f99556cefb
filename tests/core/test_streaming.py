"""Streams give what the batch queries give."""

import json
import time

from pyspark.sql import functions as F

from planweave.operators.latest import assign_sequence, latest_by
from planweave.sources.ledger import Ledger
from planweave.streaming.eventlog import chained, client_state, latest_status, live_tail, logged, number_events, timestamp, windowed_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark, folder, files=3):
    events = spark.read.parquet(EVENTS)
    step = -(-events.count() // files)
    for i in range(files):  # one file after the other, in the order of time
        events.filter(F.floor(F.col("event_id") / step) == i).coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(query, checkpoint, mode, name):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return query.sparkSession.table(name)


def test_numbering_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = drain(number_events(stream(spark, f"{tmp_path}/in")), f"{tmp_path}/c", "append", "numbered")
    want = assign_sequence(spark.read.parquet(EVENTS), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "sequence_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_latest_status(spark, tmp_path):
    got = drain(latest_status(stream(spark, f"{tmp_path}/in")), f"{tmp_path}/c", "complete", "latest")
    want = latest_by(spark.read.parquet(EVENTS).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])
    assert {(r.user_id, r.event_type, r.event_id) for r in got.collect()} == {(r.user_id, r.event_type, r.event_id) for r in want.collect()}


def test_windows(spark, tmp_path):
    got = drain(windowed_counts(stream(spark, f"{tmp_path}/in")), f"{tmp_path}/c", "complete", "windows")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(EVENTS).count()


def test_chain_runs_stages_in_order(spark, tmp_path):
    seen = []
    query = chained(stream(spark, f"{tmp_path}/in", 2), [lambda b, n: seen.append((n, "parse", b.count())), lambda b, n: seen.append((n, "rules", b.count()))], f"{tmp_path}/c")
    query.awaitTermination(240)
    assert [s[1] for s in seen] == ["parse", "rules"] * (len(seen) // 2) and sum(s[2] for s in seen[::2]) == 1000


def test_logged_stream_restarts_without_repeats(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/log")
    for checkpoint in ("c1", "c1", "c2"):  # the same run again, then one that has lost its checkpoint
        events = stream(spark, f"{tmp_path}/in-{checkpoint}-{time.time_ns()}", 2) if checkpoint == "c2" else (stream(spark, f"{tmp_path}/in", 2) if not ledger.version() else spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp")))
        logged(events, ledger, ["event_id"], ["user_id"], ["ts", "event_id"], f"{tmp_path}/{checkpoint}").awaitTermination(240)
    want = assign_sequence(spark.read.parquet(EVENTS), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "sequence_no")
    assert sorted(map(tuple, ledger.read().select("user_id", "event_id", "sequence_no").collect())) == sorted(map(tuple, want.collect()))


def test_live_tail_replays_follows_and_beats(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "project string, sequence_no long, event_type string, payload string"
    add = lambda *seq: spark.createDataFrame([("p", n, "job_update", json.dumps({"n": n})) for n in seq], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(1, 2, 3, 4)
    events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = live_tail(events, cursor=2, heartbeat_ms=1000, idle_ms=6000).writeStream.format("memory").queryName("frames").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()

    def wait(done):
        end = time.time() + 180
        while time.time() < end and not done():
            time.sleep(0.5)
        assert done()

    frames = lambda: [(r.id, json.loads(r.data)) for r in spark.table("frames").collect()]
    try:
        wait(lambda: any(d["event"] == "heartbeat" for _, d in frames()))
        assert [i for i, d in frames() if i is not None] == [3, 4]  # the replay, before any heartbeat
        add(4, 5)
        wait(lambda: [i for i, _ in frames() if i is not None] == [3, 4, 5])
        beats = lambda: sum(i is None for i, _ in frames())
        seen = beats()
        wait(lambda: beats() > seen)
        last = -1
        for _ in range(60):  # until the project is forgotten
            if beats() == last:
                break
            last = beats()
            time.sleep(4)
        assert beats() == last and {d["event"] for _, d in frames()} == {"job_update", "heartbeat"}
        assert [d["data"] for i, d in frames() if i == 5] == [{"n": 5}]
    finally:
        query.stop()


def test_timestamp():
    assert timestamp(1_700_000_000_123) == "2023-11-14T22:13:20.123Z"


def test_client_state_of_batch_and_stream(spark, tmp_path):
    update = lambda **data: json.dumps({"event": "job_update", "data": data})
    events = [
        (1, 1, update(job_type="floorplan_parse", status="running", progress=5)),
        (1, 2, "no json"),
        (1, 3, json.dumps({"event": "heartbeat", "data": {"timestamp": "x"}})),
        (1, 4, update(job_type="model_reconstruct", status="running", stage="walls", progress=0)),
        (1, 5, update(job_type="floorplan_parse", status="failed", error={"message": "bad scan", "code": "E1"})),
        (2, 1, update(job_type="floorplan_parse", status="running")),
        (2, 2, update(job_type="floorplan_parse", status="failed", error=None)),
        (2, 3, update(job_type="geometry_rules", status="running", stage="")),
        (2, 4, update(job_type="style_inference", status="complete", progress="many")),
        (3, 1, json.dumps([1])),
    ]
    df = spark.createDataFrame(events, "project int, n long, payload string")
    want = {(1, 0.0, "walls", False, False, True, False, False, "bad scan"), (2, None, "analyzing", True, False, False, True, False, None)}
    assert set(map(tuple, client_state(df, ["project"], "n", "payload").collect())) == want
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert set(map(tuple, drain(client_state(rows, ["project"], "n", "payload"), f"{tmp_path}/c", "complete", "clients").collect())) == want
