"""Keyed state and timers of streams: restarts, order of arrival, late events."""

import time
from datetime import datetime, timedelta

import pytest
from panelflow.streaming import events as S
from panelflow.streaming import state as K

ACTIONS = "job_id string, action string, at timestamp, action_id long, status string"
EVENTS = "job_id string, type string, status string, progress double, current_page int, total_pages int, timestamp timestamp, event_id long"
START = datetime(2024, 1, 1)


def minutes(n):
    return START + timedelta(minutes=n)


@pytest.fixture
def feed(spark, tmp_path):
    """Adds rows as one file, then runs a stream over all that is there, with one checkpoint for all calls."""
    def run(rows, kind, build, **options):
        if rows:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        reader = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1)
        S.run_available(build(reader.parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return spark.read.parquet(f"{tmp_path}/out").collect()
    run.checkpoint = f"{tmp_path}/checkpoint"
    return run


def test_statuses_go_on_from_the_state(spark, feed, tmp_path):
    jobs = spark.createDataFrame([("j", "processing"), ("k", "pending")], "id string, status string")
    for k, action in enumerate(["stop", "resume", "cancel", "cancel"]):
        log = feed([("j", action, minutes(k), k, None), ("nobody", action, minutes(k), k, None)], ACTIONS, lambda s: K.transitions(s, jobs))
    assert [(r["status_before"], r["status_after"], r["accepted"]) for r in sorted(log, key=lambda r: r["action_id"])] == [
        ("processing", "paused", True), ("paused", "queued", True), ("queued", "cancelled", True), ("cancelled", "cancelled", False)]
    assert log[0]["at"] in [minutes(k) for k in range(4)]
    held = {r["job_id"]: r["status"] for r in K.read_state(spark, feed.checkpoint, "status").collect()}
    assert held == {"j": "cancelled", "k": "pending"}
    # A report sets the status of a new job, and of one that stands.
    log = feed([("new", None, minutes(9), 9, "failed"), ("new", "retry", minutes(10), 10, None), ("j", None, minutes(9), 11, "failed"),
                ("j", "retry", minutes(10), 12, None)], ACTIONS, lambda s: K.transitions(s, jobs))
    assert {r["action_id"]: r["status_after"] for r in log if r["action_id"] > 8} == {10: "pending", 12: "pending"}
    # A new stream takes over the statuses of the old one.
    before = K.read_state(spark, feed.checkpoint, "status").withColumnRenamed("job_id", "id")
    spark.createDataFrame([("k", "cancel", minutes(20), 20, None)], ACTIONS).write.parquet(f"{tmp_path}/next")
    stream = spark.readStream.schema(ACTIONS).parquet(f"{tmp_path}/next")
    S.run_available(K.transitions(stream, before), f"{tmp_path}/out2", f"{tmp_path}/checkpoint2")
    assert [r["status_before"] for r in spark.read.parquet(f"{tmp_path}/out2").collect()] == ["pending"]


def event(job, kind, minute, number, status=None, page=None):
    return (job, kind, status, None, page, None, minutes(minute), number)


def test_latest_event_in_any_order_of_arrival(spark, feed):
    feed([event("a", "job_progress", 5, 1, "processing", 3), event("a", "job_error", 4, 2, "error")], EVENTS, K.latest_events)
    feed([event("a", "job_completed", 2, 3, "completed"), event("b", "job_error", 1, 4, "error")], EVENTS, K.latest_events)
    sent = feed([event("b", "page_processed", 1, 5), (None, "x", None, None, None, None, None, 6)], EVENTS, K.latest_events)
    got = {r["job_id"]: (r["type"], r["status"], r["current_page"], r["timestamp"]) for r in K.job_state(spark, feed.checkpoint).collect()}
    assert got == {"a": ("job_progress", "processing", 3, minutes(5)), "b": ("page_processed", None, None, minutes(1))}
    assert sorted(r["event_id"] for r in sent) == [1, 4, 5]  # the older event changed nothing


def test_newest_events_are_bounded_and_not_doubled(spark, feed):
    build = lambda s: K.newest_events(s, n=5, slices=3)
    feed([event("a", "x", k, k) for k in range(40)], EVENTS, build)
    feed([event("a", "x", k, k) for k in range(30, 38)] + [event("b", "y", 60, 99)], EVENTS, build)
    assert [r["event_id"] for r in K.last_events(spark, feed.checkpoint, 5).collect()] == [99, 39, 38, 37, 36]
    assert K.read_state(spark, feed.checkpoint, "newest").count() <= 15


def test_timeouts_fire_without_events_and_late_ends_cancel_them(feed):
    build = lambda s: K.job_timeouts(s, "10 minutes", "5 minutes")
    feed([event("slow", "job_progress", 0, 1), event("slow", "page_processed", 4, 2), event("late", "job_progress", 0, 3)], EVENTS, build)
    feed([event("other", "job_progress", 12, 4)], EVENTS, build)  # watermark 7: nothing is certain
    got = feed([event("late", "job_completed", 9, 5)], EVENTS, build)
    assert got == []
    got = feed([event("other", "job_completed", 21, 6), event("slow", "job_progress", 13, 7)], EVENTS, build)  # watermark 16
    assert [(r["job_id"], r["started_at"], r["timed_out_at"]) for r in got] == [("slow", minutes(0), minutes(10))]
    got = feed([event("other", "page_processed", 40, 8)], EVENTS, build)  # watermark 35: the second run of slow began at 13
    assert sorted((r["job_id"], r["started_at"]) for r in got) == [("slow", minutes(0)), ("slow", minutes(13))]


def test_the_order_of_arrival_changes_no_timeout(spark, tmp_path):
    rows = [event(f"j{k % 7}", ["job_progress", "page_processed", "job_completed", "job_progress", "job_error"][k * k % 5], k * 3 % 97, k)
            for k in range(120)] + [event("end", "page_processed", 500, 999)]
    found = []
    for n, order in enumerate((rows, sorted(rows, key=lambda r: r[7] * 37 % 101))):
        for k in range(0, len(order), 50):
            spark.createDataFrame(order[k:k + 50], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in{n}")
        S.run_available(K.job_timeouts(stream, "10 minutes", "600 minutes"), f"{tmp_path}/a{n}", f"{tmp_path}/c{n}")
        S.run_available(K.idle_notices(stream, "6 minutes", "100 minutes"), f"{tmp_path}/b{n}", f"{tmp_path}/d{n}")
        found.append([sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{x}{n}").collect())) for x in "ab"])
    assert found[0] == found[1] and found[0][1] and not found[0][0]


def test_silence_is_noticed_once(feed):
    build = lambda s: K.idle_notices(s, "2 minutes", "1 minute")
    feed([event("a", "x", 0, 1), event("a", "x", 2, 2), event("b", "x", 1, 3)], EVENTS, build)
    got = feed([event("a", "x", 9, 4)], EVENTS, build)
    assert sorted((r["job_id"], r["last_event_at"], r["idle_at"]) for r in got) == [("a", minutes(2), minutes(4)), ("b", minutes(1), minutes(3))]
    assert sorted(r["job_id"] for r in feed([event("c", "x", 30, 5)], EVENTS, build)) == ["a", "a", "b"]


def test_forgotten_after_their_time(spark, tmp_path):
    def run(wanted):
        stream = K.latest_events(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), ttl_ms=1)
        query = stream.writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        try:
            for _ in range(120):
                time.sleep(0.5)
                done = query.lastProgress and spark.read.schema("event_id long").parquet(f"{tmp_path}/out").collect()
                if done and sorted(r["event_id"] for r in done) == wanted:
                    return True
        finally:
            query.stop()
        return False
    spark.createDataFrame([event("a", "x", 1, 1)], EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
    assert run([1])
    spark.createDataFrame([event("a", "x", 0, 2)], EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
    assert run([1, 2])  # the state is gone, so an older event is the latest again
