"""Commits of ledger tables: races, repeats, numbering and updates."""

import threading

import pytest
from pyspark.sql import functions as F

from planweave.sources.ledger import Conflict, Ledger

SCHEMA = "id int, kind string, v double"


def rows(spark, *ids, v=0.0):
    return spark.createDataFrame([(i, "ab"[i % 2] + "/=", v) for i in ids], SCHEMA)


def held(ledger, version=None):
    return sorted((r.id, r.kind, r.v) for r in ledger.read(version).collect())


def test_appending_again_adds_nothing(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/t", ("kind",))
    assert ledger.read() is None and ledger.version() == 0
    assert ledger.append(rows(spark, 1, 1, 2), ["id"]) == 1
    assert ledger.append(rows(spark, 2, 3), ["id"]) == 2
    assert ledger.append(rows(spark, 1, 3), ["id"]) == 2  # nothing new, no version
    assert [r[0] for r in held(ledger)] == [1, 2, 3] and [r[0] for r in held(ledger, 1)] == [1, 2]
    assert ledger.read(parts={"kind=b/="}).count() == 2
    assert ledger.append(rows(spark, *[]), ["id"]) == 2
    assert ledger.compact() == 1 and [r[0] for r in held(ledger)] == [1, 2, 3]
    assert ledger.vacuum() >= 1 and [r[0] for r in held(ledger)] == [1, 2, 3]


def test_racing_writers_lose_and_repeat_nothing(spark, tmp_path):
    path, errors = f"{tmp_path}/t", []
    start = threading.Barrier(3)

    def write(k):
        try:
            start.wait()
            events = spark.range(60).filter(F.col("id") % 3 != k).select(F.col("id").alias("event"), (F.col("id") % 4).alias("project"))
            Ledger(spark, path).append_numbered(events, ["event"], ["project"], ["event"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join(240) for t in threads]
    got = Ledger(spark, path).read().collect()
    assert not errors and sorted(r.event for r in got) == list(range(60))
    for p in range(4):
        assert sorted(r.sequence_no for r in got if r.project == p) == list(range(1, 16))


def test_a_lost_race_is_tried_again_and_given_up_in_the_end(spark, tmp_path, monkeypatch):
    ledger, other = (Ledger(spark, str(tmp_path / "t"), attempts=2) for _ in range(2))
    aside, lost = ledger._aside, []

    def late(df):
        if not lost:  # another writer comes first, with a row of its own and one of ours
            lost.append(other.append(rows(spark, 1, 9), ["id"]))
        return aside(df)

    monkeypatch.setattr(ledger, "_aside", late)
    assert ledger.append(rows(spark, 1, 2), ["id"]) == 2 and [r[0] for r in held(ledger)] == [1, 2, 9]
    monkeypatch.setattr(ledger, "_commit", lambda *_: False)
    with pytest.raises(Conflict):
        ledger.append(rows(spark, 5), ["id"])
    assert [r[0] for r in held(other)] == [1, 2, 9]


def test_updates_rewrite_the_partitions_they_touch(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"), ("kind",))
    ledger.append(rows(spark, *range(10)), ["id"])
    before = ledger._state(1)["folders"]
    assert ledger.update(rows(spark, 2, 4, 100, v=5.0), ["id", "kind"]) == 1
    after = ledger._state(2)["folders"]
    assert {f for f, p in before.items() if p == "kind=b/="} <= set(after) and len(set(after) & set(before)) == 1
    assert {r[0]: r[2] for r in held(ledger)} == {i: 5.0 if i in (2, 4, 100) else 0.0 for i in [*range(10), 100]}
    assert ledger.update(rows(spark, 3, 101, v=7.0), ["id", "kind"], insert=False) == 1
    assert {r[0] for r in held(ledger)} == {*range(10), 100} and dict((r[0], r[2]) for r in held(ledger))[3] == 7.0
    assert held(ledger, 1) == sorted((i, "ab"[i % 2] + "/=", 0.0) for i in range(10))
    some = spark.createDataFrame([(1, "b/=", None)], SCHEMA).drop("kind")
    with pytest.raises(ValueError, match="kind"):
        ledger.update(some, ["id"])
    assert ledger.update(spark.createDataFrame([(None, None, 1.0)], SCHEMA), ["id", "kind"]) == 1 and ledger.read().filter("kind IS NULL AND v = 1").count() == 1
