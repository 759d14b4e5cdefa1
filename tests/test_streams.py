"""Streams against their batch forms: the limiter, the store of newest records, the views of the feed."""

import random
from datetime import datetime, timedelta

import pytest

from claimworks.operators import detect, records
from claimworks.sources.tables import claims
from claimworks.streaming import feed, rate_limit, sink, versions
from conftest import SF

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batches(path, rows, schema, spark, n):
    """n files, one for each micro-batch."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_limiter_of_shuffled_batches(spark, tmp_path):
    r, t0 = random.Random(4), datetime(2024, 1, 1)
    actions = ["predict", "verify", "ground", "extract", "opinion"]
    rows = [(i, i % 3, r.choice(actions), t0 + timedelta(seconds=r.randint(0, 300), milliseconds=r.randint(0, 999))) for i in range(400)]
    rows += [(1000, None, "verify", t0), (1001, 1, "verify", None), (1002, 1, "other", t0)]
    schema = "event_id long, user_id long, action string, ts timestamp"
    expected = {x["event_id"]: (x["ok"], x["retry_after"], x["action"]) for x in rate_limit.by_action(spark.createDataFrame(rows, schema)).collect()}
    assert len(expected) == 400 and len({v[0] for v in expected.values()}) == 2
    r.shuffle(rows)
    end = [(2000 + i, 9, "verify", t0 + timedelta(hours=1 + i)) for i in range(2)]  # moves the watermark past all others
    path = tmp_path / "in"
    batches(path, rows, schema, spark, 3)
    for row in end:
        stream = batches(path, [row], schema, spark, 1)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        limited = rate_limit.limited_stream(stream, "10 minutes")
        q = limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = [x for x in spark.read.parquet(str(tmp_path / "out")).collect() if x["event_id"] < 1000]
    assert len(got) == 400 and {x["event_id"]: (x["ok"], x["retry_after"], x["action"]) for x in got} == expected


def record(i, at, text="t", image=None):
    return (str(i), text, datetime(2024, 1, 1) + timedelta(minutes=at), "v", image)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_keeps_the_newest_and_replays_change_nothing(spark, tmp_path):
    r = random.Random(1)
    rows = [record(i, r.randint(0, 500)) for i in range(300)]
    rows += [record(5, 900, "again"), record(6, 901, "once more")]
    stream = batches(tmp_path / "in", rows, sink.RECORD, spark, 4)
    path = str(tmp_path / "store")
    sink.start(stream, path, str(tmp_path / "state"), cap=50).awaitTermination()
    last = {}
    for x in sorted(rows, key=lambda x: x[2]):
        last[x[0]] = x
    expected = sorted(sorted(last.values(), key=lambda x: (x[2], x[0]), reverse=True)[:50])
    assert rows_of(versions.current(spark, path, sink.RECORD)) == expected
    before = versions.versions(spark, path)
    assert len(before) == versions.KEPT
    write = sink.writer(path, cap=50)
    for n in before[-2:]:  # a replay, of the last batch and of the one before
        write(spark.createDataFrame(rows[:10], sink.RECORD), n)
    assert rows_of(versions.current(spark, path, sink.RECORD)) == expected and versions.versions(spark, path) == before


def test_store_without_room(spark, tmp_path):
    path, told = str(tmp_path / "store"), []
    write = sink.writer(path, cap=5, most_bytes=200, told=lambda *x: told.append(x))
    image = "i" * 90
    for n, batch in enumerate([[record(1, 1, image=image)], [record(2, 2, image=image), record(3, 3, image=image)], [record(4, 4, "x" * 300)], []]):
        write(spark.createDataFrame(batch, sink.RECORD), n)
    assert told == [(0, "whole"), (1, "without-images"), (2, "refused"), (3, "whole")]
    assert [(x[0], x[4]) for x in rows_of(versions.current(spark, path, sink.RECORD))] == [("1", None), ("2", None), ("3", None)]


@pytest.mark.parametrize("view", ["totals", "topics", "aspects"])
def test_views_follow_the_feed(spark, tmp_path, view):
    rows = [tuple(r) for r in claims(spark, SF).limit(60).collect()]
    schema, path, state = "claim_id long, text string", str(tmp_path / "view"), str(tmp_path / "state")
    batch = {
        "totals": (feed.dashboard, lambda s: records.totals(s)), "topics": (feed.topic_counts, lambda s: records.topic_counts(s)), "aspects": (feed.aspect_averages, lambda s: records.aspect_averages(detect.aspects(s))),
    }[view]
    for n in (20, 40, 60):
        stream = batches(tmp_path / "in", rows[n - 20 : n], schema, spark, 1)
        feed.follow(stream, view, path, state).awaitTermination()
        expected = batch[1](detect.detect(spark.createDataFrame(rows[:n], schema)))
        assert rows_of(batch[0](spark, path)) == rows_of(expected)
