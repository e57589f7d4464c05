import random

from pyspark.sql import functions as F

from panelflow.operators import jobs as J
from panelflow.operators.skew import first_rows, numbered, running, salted_lookup


def frame(spark, n=300):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.7 else rng.randint(2, 5), rng.randint(0, 40), i, rng.randint(1, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, o int, id int, v long").repartition(4)


def test_running_sums_of_a_hot_key_match_the_plain_window(spark):
    rows, df = frame(spark)
    order = [F.col("o").desc(), F.col("id")]
    plain = running(df, ["k"], order, {"s": F.col("v"), "n": F.lit(1).cast("long")}, hot_rows=None)
    split = running(df, ["k"], order, {"s": F.col("v"), "n": F.lit(1).cast("long")}, hot_rows=50, pieces=6)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    assert split.filter("k = 1").agg(F.max("n")).first()[0] == sum(r[0] == 1 for r in rows)


def test_equal_rows_of_a_hot_key_are_numbered_once_each(spark):
    df = spark.range(100).select(F.lit(None).cast("string").alias("k"), F.lit(1).alias("o"))
    got = numbered(df, ["k"], [F.col("o")], hot_rows=10, pieces=4)
    assert sorted(r["rn"] for r in got.collect()) == list(range(1, 101))


def test_first_rows_limits_before_the_shuffle(spark):
    _, df = frame(spark)
    out = first_rows(df, ["k"], [F.col("o"), F.col("id")], 3)
    assert out.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    for limited in (out, first_rows(df, ["k"], [F.col("o")], 90_000)):
        plan = limited._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2


def test_salted_lookup_is_a_left_join(spark):
    _, df = frame(spark)
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    got = salted_lookup(df, right, ["k"], salts=4)
    want = df.join(right, "k", "left").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_replay_gives_the_same_for_every_chunk_size(spark):
    rng = random.Random(4)
    acts = [("a" if rng.random() < 0.8 else "b", rng.choice(["stop", "resume", "cancel", "retry", "bogus"]), i // 3, i) for i in range(120)]
    jobs = spark.createDataFrame([("a", "processing"), ("b", "completed")], "id string, status string")
    actions = spark.createDataFrame(acts, "job_id string, action string, at int, action_id int")
    rules = {"stop": {"processing": "paused"}, "cancel": {s: "cancelled" for s in ("pending", "queued", "processing", "paused", "failed")},
             "retry": {"failed": "pending", "cancelled": "pending"}}
    state, want = {"a": "processing", "b": "completed"}, []
    for job, action, _, i in acts:
        new = "queued" if action == "resume" else rules.get(action, {}).get(state[job])
        want.append((i, state[job], new is not None, new or state[job]))
        state[job] = new or state[job]
    for chunk in (7, 1000):
        out = J.replay_actions(jobs, actions, chunk_rows=chunk, hot_rows=30)
        assert sorted((r["action_id"], r["status_before"], r["accepted"], r["status_after"]) for r in out.collect()) == want


def test_every_transition_pair(spark):
    jobs = ["pending", "queued", "processing", "paused", "completed", "failed", "cancelled"]
    pairs = spark.createDataFrame([(s, a) for s in jobs for a in ("stop", "resume", "cancel", "retry")], "s string, a string")
    got = {(r["s"], r["a"]): r["n"] for r in pairs.withColumn("n", J.next_status(F.col("a"), F.col("s"))).collect()}
    assert got["processing", "stop"] == "paused" and got["queued", "stop"] is None
    assert all(got[s, "resume"] == "queued" for s in jobs)
    assert [s for s in jobs if got[s, "cancel"] is None] == ["completed", "cancelled"]
    assert [s for s in jobs if got[s, "retry"] == "pending"] == ["failed", "cancelled"]
