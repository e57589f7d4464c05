"""Queries of job rules and job analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow import schema
from panelflow.checks.base import query, quoted, sql, ts
from panelflow.operators import jobs as J

ACTIONS = list(schema.JOB_TRANSITIONS)


def _next_sql(action: str, status: str) -> str:
    whens = " ".join(f"WHEN {action} = '{a}' AND {status} = '{b}' THEN '{c}'"
                     for a, moves in schema.JOB_TRANSITIONS.items() for b, c in moves.items())
    return f"CASE {whens} END"


ACTION_LOG = f"""acts AS (SELECT user_id AS job_id, event_id AS action_id, ts AS t_at, {quoted(ACTIONS)}[CAST(event_id % 4 + 1 AS INTEGER)] AS action FROM events),
start AS (SELECT DISTINCT user_id AS id, {quoted(schema.JOB_STATUSES)}[CAST(user_id % 7 + 1 AS INTEGER)] AS status FROM events),
folded AS (SELECT job_id, list_reduce(list({{'action_id': action_id, 't_at': t_at, 'action': action}} ORDER BY t_at, action_id),
    lambda acc, r: list_append(acc, {{'action_id': r.action_id, 'action': r.action, 'before': acc[-1].after, 'ok': {_next_sql('r.action', 'acc[-1].after')} IS NOT NULL,
      'after': coalesce({_next_sql('r.action', 'acc[-1].after')}, acc[-1].after)}}),
    CAST([{{'action_id': -1, 'action': '', 'before': '', 'ok': true, 'after': first(status)}}]
      AS STRUCT(action_id BIGINT, action VARCHAR, before VARCHAR, ok BOOLEAN, "after" VARCHAR)[])) AS acc
    FROM acts JOIN start ON job_id = start.id GROUP BY job_id),
verdicts AS (SELECT job_id, r.action_id, r.action, r.before AS status_before, r.ok AS accepted, r.after AS status_after
    FROM (SELECT job_id, unnest(acc[2:]) AS r FROM folded))"""


def _actions(d):
    pick = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("event_id") % 4 + 1).cast("int"))
    return d.table("events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("action_id"), F.col("ts").alias("at"), pick.alias("action"))


def _start(d):
    status = F.element_at(F.array(*[F.lit(s) for s in schema.JOB_STATUSES]), (F.col("user_id") % 7 + 1).cast("int"))
    return d.table("events").select(F.col("user_id").alias("id")).distinct().withColumn(
        "user_id", F.col("id")).select("id", status.alias("status"), F.lit("boom").alias("error_message"), F.lit(50.0).alias("progress"),
                                       ts("2023-01-01 00:00:00").alias("completed_at"))


@query(sql("SELECT * FROM verdicts", extra=ACTION_LOG))
def replay_actions(d):
    return J.replay_actions(_start(d), _actions(d), chunk_rows=10).drop("at")


@query(sql("""SELECT s.id, coalesce(last_status, s.status) AS status, CASE WHEN retried IS NULL THEN 'boom' END AS error_message,
    CASE WHEN retried IS NULL THEN 50.0 ELSE 0.0 END AS progress,
    CASE WHEN cancelled IS NOT NULL AND (retried IS NULL OR cancelled > retried) THEN cancelled[1] WHEN retried IS NOT NULL THEN NULL
      ELSE TIMESTAMP '2023-01-01' END AS completed_at
    FROM start s LEFT JOIN (SELECT v.job_id, arg_max(status_after, (t_at, action_id)) AS last_status,
      max(CASE WHEN v.action = 'retry' THEN (t_at, action_id) END) AS retried, max(CASE WHEN v.action = 'cancel' THEN (t_at, action_id) END) AS cancelled
      FROM verdicts v JOIN acts USING (job_id, action_id) WHERE accepted GROUP BY v.job_id) ON job_id = s.id""", extra=ACTION_LOG))
def apply_job_actions(d):
    done, _ = J.apply_job_actions(_start(d), _actions(d))
    return done


@query(sql("SELECT job_id, action_id, status_before FROM verdicts WHERE NOT accepted", extra=ACTION_LOG))
def refused_actions(d):
    _, refused = J.apply_job_actions(_start(d), _actions(d))
    return refused.select("job_id", "action_id", "status_before")


RESULTS = "results AS (SELECT chapter_id AS job_id, page_number, is_translated AS ok, processing_time_ms AS ms FROM page_rows)"


def _results(d):
    return d.pages.select(F.col("chapter_id").alias("job_id"), "page_number", F.col("is_translated").alias("ok"), F.col("processing_time_ms").alias("ms"))


@query(sql("""SELECT job_id, count(*) AS total_pages, count(*) FILTER (ok) AS completed_pages, count(*) FILTER (NOT ok) AS failed_pages,
    CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) * 100 AS page_progress, 'completed' AS status, 100.0::DOUBLE AS progress FROM results GROUP BY 1""",
           "page_rows", extra=RESULTS))
def job_rollup(d):
    return J.job_rollup(_results(d))


@query(sql("""SELECT *, CAST(completed_pages AS DOUBLE) / total * 100 AS progress, page_index % 3 = 0 AS is_checkpoint FROM
    (SELECT job_id, page_number, ms, row_number() OVER w AS page_index, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS BIGINT) AS failed_pages,
      row_number() OVER w - CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS BIGINT) AS completed_pages, count(*) OVER (PARTITION BY job_id) AS total
     FROM results WINDOW w AS (PARTITION BY job_id ORDER BY page_number, ms ROWS UNBOUNDED PRECEDING))""", "page_rows", extra=RESULTS))
def progress_curve(d):
    order = [F.col("page_number"), F.col("ms")]
    totals = _results(d).groupBy("job_id").agg(F.count("*").alias("total"))
    return J.progress_curve(_results(d), order, every=3).drop("ok").join(totals, "job_id")


ATTEMPTS = """attempts AS (SELECT l_orderkey AS job_id, l_partkey AS page_id, l_linenumber - 1 AS attempt, l_returnflag = 'A' AS ok,
    CASE WHEN l_returnflag <> 'A' THEN repeat('e', l_linenumber * 60) END AS error FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber ORDER BY l_suppkey) = 1)"""


@query(sql("""SELECT job_id, page_id, count(*) AS attempts, bool_or(ok) AS ok, round(sum(CASE WHEN attempt > 0 THEN 1.5 ** (attempt - 1) ELSE 0 END), 4) AS delay_seconds,
    CASE WHEN NOT bool_or(ok) THEN substring(arg_max(error, attempt), 1, 200) END AS last_error
    FROM (SELECT *, min(attempt) FILTER (ok) OVER (PARTITION BY job_id, page_id) AS ok_at FROM attempts WHERE attempt <= 3)
    WHERE ok_at IS NULL OR attempt <= ok_at GROUP BY ALL""", extra=ATTEMPTS))
def attempt_summary(d):
    from panelflow.operators.skew import first_rows
    rows = first_rows(d.table("lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"], [F.col("l_suppkey"), F.col("l_returnflag")], 1)
    bad = F.col("l_returnflag") != "A"
    attempts = rows.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("page_id"), (F.col("l_linenumber") - 1).alias("attempt"),
        (~bad).alias("ok"), F.when(bad, F.repeat(F.lit("e"), F.col("l_linenumber") * 60)).alias("error"))
    s = J.attempt_summary(attempts)
    return s.withColumn("delay_seconds", F.round("delay_seconds", 4))


PENDING = "more AS (SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN 'pending' ELSE status END AS status) FROM jobs)"


@query(sql("""(SELECT id, 'pending' AS reason FROM more WHERE status = 'pending' ORDER BY created_at, id LIMIT 2)
    UNION ALL (SELECT id, 'retry' FROM more WHERE status = 'failed' AND error_message IS NOT NULL ORDER BY created_at, id LIMIT 3)""", "jobs", extra=PENDING))
def admission_candidates(d):
    jobs = d.jobs.withColumn("status", F.when(F.col("id") % 9 == 0, "pending").otherwise(F.col("status")))
    return J.admission_candidates(jobs, 2).select("id", "reason")


@query(sql("""SELECT job_id, page_index FROM (SELECT chapter_id AS job_id, page_number - 1 AS page_index FROM page_rows)
    LEFT JOIN (SELECT id AS job_id, max(id % 4) AS done FROM jobs WHERE status = 'processing' GROUP BY 1) USING (job_id) WHERE page_index >= coalesce(done, 0)""",
           "jobs", "page_rows"))
def remaining_pages(d):
    pages = d.pages.select(F.col("chapter_id").alias("job_id"), (F.col("page_number") - 1).alias("page_index"))
    marks = d.jobs.filter("status = 'processing'").select(F.col("id").alias("job_id"), (F.col("id") % 4).alias("page_index"))
    return J.remaining_pages(pages, marks)


@query(sql("SELECT id FROM jobs WHERE status = 'processing' AND started_at < TIMESTAMP '1998-07-01 00:00:00' - INTERVAL 10 MINUTE", "jobs"))
def timed_out_jobs(d):
    return J.timed_out_jobs(d.jobs, ts("1998-07-01 00:00:00")).select("id")


LATEST = """latest AS (SELECT * REPLACE (CASE WHEN status = 'error' THEN 'failed' ELSE status END AS status) FROM progress_events
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, event_id DESC) = 1)"""


@query(sql("SELECT job_id, type, status, progress, timestamp FROM latest", "progress_events", extra=LATEST))
def live_job_state(d):
    return J.live_job_state(d.progress_events).select("job_id", "type", "status", "progress", "timestamp")


OVERLAY_SQL = """SELECT id, CASE WHEN job_id IS NOT NULL THEN l.status ELSE j.status END AS status, l.progress, coalesce(l.total_pages, j.total_pages, -1) AS total_pages,
    coalesce(l.current_page, j.completed_pages, -1) AS completed_pages FROM jobs j LEFT JOIN latest l ON job_id = id"""


@query(sql(OVERLAY_SQL, "jobs", "progress_events", extra=LATEST))
def overlay_latest(d):
    jobs = d.jobs.withColumn("progress", F.lit(None).cast("double"))
    out = J.overlay_latest(jobs, J.live_job_state(d.progress_events)).select("id", "status", "progress", "total_pages", "completed_pages")
    return out.fillna(-1, ["total_pages", "completed_pages"])


@query(sql("SELECT event_id, job_id, type FROM progress_events ORDER BY timestamp DESC, event_id DESC LIMIT 100", "progress_events"))
def last_events(d):
    return J.last_events(d.progress_events).select("event_id", "job_id", "type")


@query(sql("""SELECT job_id, before AS idle_from, timestamp AS idle_to, (epoch_us(timestamp) - epoch_us(before)) / 1000000 AS idle_seconds FROM
    (SELECT job_id, timestamp, lag(timestamp) OVER (PARTITION BY job_id ORDER BY timestamp) AS before FROM progress_events)
    WHERE epoch_us(timestamp) - epoch_us(before) >= 30000000""", "progress_events"))
def idle_gaps(d):
    return J.idle_gaps(d.progress_events)
