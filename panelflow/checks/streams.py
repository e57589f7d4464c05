"""Streaming queries, run over what is there and compared with their batch meaning.

Each run gets new folders in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.checks.base import mean_sql, now, query, sql
from panelflow.checks.jobs import ACTION_LOG, LATEST, OVERLAY_SQL, _actions, _start
from panelflow.checks.translation import REQUESTS, _segments_sql, batch_provider
from panelflow.domain import events_to_progress
from panelflow.session import scratch_path
from panelflow.sources.memory import MemoryStore
from panelflow.sources.tables import CatalogStore
from panelflow.streaming import events as S
from panelflow.streaming import state as K
from panelflow.streaming.translate import translate_batches


def _events(d):
    return events_to_progress(S.stream_table(d.spark, d.folder, "events"))


def _appended(d, df, label):
    """Run an append-mode stream into a new folder and read the result."""
    root = scratch_path(d.spark, label)
    S.run_available(df, f"{root}/out", f"{root}/checkpoint")
    return d.spark.read.schema(df.schema).parquet(f"{root}/out")


@query(sql("SELECT event_id, job_id, type FROM progress_events WHERE job_id = 3", "progress_events"))
def stream_job_room(d):
    return _appended(d, S.job_room(_events(d), 3), "room").select("event_id", "job_id", "type")


@query(sql("SELECT event_id, job_id, type FROM progress_events", "progress_events"))
def stream_bounded_events(d):
    """Every event arrives twice and leaves once."""
    twice = _events(d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _appended(d, S.bounded(twice), "bounded").select("event_id", "job_id", "type")


@query(sql("SELECT job_id, type, CASE WHEN status = 'failed' THEN 'error' ELSE status END AS status, progress, timestamp FROM latest",
           "progress_events", extra=LATEST))
def stream_job_state(d):
    """The latest event of every job, read from the state store."""
    root = scratch_path(d.spark, "state")
    S.run_available(K.latest_events(_events(d)), f"{root}/out", f"{root}/checkpoint")
    return K.job_state(d.spark, f"{root}/checkpoint").select("job_id", "type", "status", "progress", "timestamp")


@query(sql(OVERLAY_SQL, "jobs", "progress_events", extra=LATEST))
def stream_overlay(d):
    """Job rows overlaid with the state of a stream of their events."""
    root = scratch_path(d.spark, "overlay")
    S.run_available(K.latest_events(_events(d)), f"{root}/out", f"{root}/checkpoint")
    jobs = d.jobs.withColumn("progress", F.lit(None).cast("double"))
    out = K.live_jobs(jobs, f"{root}/checkpoint").select("id", "status", "progress", "total_pages", "completed_pages")
    return out.fillna(-1, ["total_pages", "completed_pages"])


@query(sql("SELECT event_id, job_id, type FROM progress_events ORDER BY timestamp DESC, event_id DESC LIMIT 100", "progress_events"))
def stream_last_events(d):
    """The newest events overall, read from the state store."""
    root = scratch_path(d.spark, "last")
    S.run_available(K.newest_events(_events(d)), f"{root}/out", f"{root}/checkpoint")
    return K.last_events(d.spark, f"{root}/checkpoint").select("event_id", "job_id", "type")


CLOSED = "(SELECT max(timestamp) - INTERVAL 10 MINUTE FROM progress_events WHERE type = 'page_processed')"
MINUTES = f"""minutes AS (SELECT date_trunc('minute', timestamp) AS window_start, job_id, count(*) AS pages, {mean_sql('processing_time_ms', 2)} AS mean_ms,
    CAST(sum(bubbles_detected) AS BIGINT) AS bubbles FROM progress_events WHERE type = 'page_processed' GROUP BY ALL)"""


@query(sql("SELECT * FROM minutes", "progress_events", extra=MINUTES))
def page_throughput(d):
    return S.page_throughput(d.progress_events)


@query(sql(f"SELECT * FROM minutes WHERE window_start + INTERVAL 1 MINUTE <= {CLOSED}", "progress_events", extra=MINUTES))
def stream_page_throughput(d):
    """Windows the watermark has closed."""
    return _appended(d, S.page_throughput(_events(d)), "throughput")


WINDOWS = f"""windows AS (SELECT window_end, host, {mean_sql('cpu_percent', 1)} AS avg_cpu, {mean_sql('ram_used_mb', 1)} AS avg_ram_mb, max(ram_used_mb) AS max_ram_mb, count(*) AS samples FROM
    (SELECT *, unnest(range(1, 7)) AS k, time_bucket(INTERVAL 5 MINUTE, ts) + to_minutes(CAST(5 * unnest(range(1, 7)) AS INTEGER)) AS window_end FROM snapshots) GROUP BY ALL)"""


@query(sql("SELECT * FROM windows", "snapshots", extra=WINDOWS))
def resource_windows(d):
    return S.resource_windows(d.snapshots.withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes", "5 minutes")


@query(sql("SELECT * FROM windows WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM snapshots)", "snapshots", extra=WINDOWS))
def stream_resource_windows(d):
    """Windows the watermark has closed."""
    from panelflow.domain import events_to_snapshots
    samples = events_to_snapshots(S.stream_table(d.spark, d.folder, "events"))
    return _appended(d, S.resource_windows(samples.withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes", "5 minutes"), "resources")


SPANS = """gaps AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY job_id ORDER BY timestamp) AS gap FROM progress_events),
spans AS (SELECT job_id, min(timestamp) AS start, max(timestamp) + INTERVAL 10 MINUTE AS idle_since, count(*) AS events FROM
    (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS n
     FROM gaps) GROUP BY job_id, n)"""


@query(sql("SELECT * FROM spans WHERE idle_since <= (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM progress_events)", "progress_events", extra=SPANS))
def stream_activity_spans(d):
    return _appended(d, S.activity_spans(_events(d), "10 minutes"), "spans")


@query(sql("SELECT job_id, action_id, action, status_before, accepted, status_after FROM verdicts", extra=ACTION_LOG))
def stream_transitions(d):
    """Half of the actions are there at the first start, the later half at the second: statuses go on from the state."""
    root = scratch_path(d.spark, "transitions")
    actions = _actions(d).withColumn("at", F.col("at").cast("timestamp"))
    middle = actions.agg(F.percentile_approx("at", 0.5)).first()[0]
    for part in (F.col("at") <= F.lit(middle), F.col("at") > F.lit(middle)):
        actions.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = d.spark.readStream.schema(actions.schema).parquet(f"{root}/in")
        S.run_available(K.transitions(stream, _start(d).select("id", "status")), f"{root}/out", f"{root}/checkpoint")
    return d.spark.read.parquet(f"{root}/out").select(
        "job_id", "action_id", "action", "status_before", "accepted", "status_after")


MARK = "mark AS (SELECT date_trunc('millisecond', max(timestamp)) - INTERVAL 10 MINUTE AS t FROM progress_events)"


@query(sql("""SELECT job_id, s AS started_at, s + INTERVAL 10 MINUTE AS timed_out_at FROM (SELECT job_id,
      unnest(list_concat(run.outs, CASE WHEN run.since + INTERVAL 10 MINUTE <= (SELECT t FROM mark) THEN [run.since] ELSE [] END)) AS s FROM folded)""",
           "progress_events", extra=MARK + """,
    folded AS (SELECT job_id, list_reduce(list({'at': timestamp, 'kind': type} ORDER BY timestamp, type), lambda acc, r: {
        'since': CASE WHEN r.kind IN ('job_completed', 'job_error') THEN NULL
          WHEN (acc.since IS NULL OR r.at > acc.since + INTERVAL 10 MINUTE) THEN CASE WHEN r.kind = 'job_progress' THEN r.at END ELSE acc.since END,
        'outs': CASE WHEN r.at > acc.since + INTERVAL 10 MINUTE THEN list_append(acc.outs, acc.since) ELSE acc.outs END},
      CAST({'since': NULL, 'outs': []} AS STRUCT(since TIMESTAMP, outs TIMESTAMP[]))) AS run
    FROM progress_events WHERE timestamp <= (SELECT t FROM mark) GROUP BY job_id)"""))
def stream_timeouts(d):
    """Timeouts sent by timers on the watermark."""
    return _appended(d, K.job_timeouts(_events(d)), "timeouts")


@query(sql("""SELECT job_id, timestamp AS last_event_at, timestamp + INTERVAL 12 HOUR AS idle_at FROM
    (SELECT job_id, timestamp, lead(timestamp) OVER (PARTITION BY job_id ORDER BY timestamp) AS next FROM progress_events)
    WHERE (next IS NULL OR next > timestamp + INTERVAL 12 HOUR) AND timestamp + INTERVAL 12 HOUR <= (SELECT t FROM mark)""",
           "progress_events", extra=MARK))
def stream_idle(d):
    """Silences sent by timers on the watermark, also those that no event ends."""
    return _appended(d, K.idle_notices(_events(d), "12 hours"), "idle")


@query(sql(_segments_sql(), "segments", "memory", extra=REQUESTS))
def stream_translation(d):
    root = scratch_path(d.spark, "translate")
    store, memory = CatalogStore(d.spark, root), MemoryStore(d.spark, root)
    memory.learn(d.memory, "given")
    new = S.stream_table(d.spark, d.folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("original_text"), F.col("lang").alias("source_language"), F.lit("en").alias("target_language"))
    S.run_batches(new, translate_batches(store, memory, batch_provider(), now()), f"{root}/checkpoint")
    return d.spark.read.parquet(f"{root}/translated").select("id", "translated_text", "confidence", "engine", "from_memory")


@query(sql("SELECT event_id, job_id FROM progress_events", "progress_events"))
def stream_resumed(d):
    """A stream stopped midway and started again with its checkpoint: half of the events are there at the first
    start, the rest at the second, and a third start adds nothing."""
    root = scratch_path(d.spark, "resume")
    events = d.table("events")
    for half in (0, 1, None):
        if half is not None:
            events.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{root}/in")
        source = d.spark.readStream.schema(events.schema).parquet(f"{root}/in")
        S.run_resumable(events_to_progress(source).select("event_id", "job_id"), f"{root}/out", f"{root}/checkpoint")
    return d.spark.read.parquet(f"{root}/out")


@query(sql("SELECT type, job_id::VARCHAR AS job_id, status, progress, coalesce(current_page, -1) AS current_page, coalesce(total_pages, -1) AS total_pages, processing_time_ms, coalesce(bubbles_detected, -1) AS bubbles_detected FROM progress_events", "progress_events"))
def read_progress_events(d):
    """Events of all types written as JSON lines, with keep-alive and broken lines between, read back as a stream."""
    from panelflow.sources.events import read_progress_events as read
    root = scratch_path(d.spark, "json")
    wanted = d.progress_events
    fields = ["status", "progress", "current_page", "total_pages", "processing_time_ms", "bubbles_detected"]
    line = F.to_json(F.struct("type", F.col("job_id").cast("string").alias("job_id"), *fields, "timestamp"))
    noise = wanted.select(F.when(F.col("event_id") % 2 == 0, '{"type": "heartbeat"}').otherwise("{broken").alias("value"))
    wanted.select(line.alias("value")).unionByName(noise).write.text(f"{root}/in")
    S.run_available(read(d.spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint")
    return d.spark.read.parquet(f"{root}/out").select("type", "job_id", *fields).fillna(
        -1, ["current_page", "total_pages", "bubbles_detected"])


@query(sql("SELECT id, title FROM projects WHERE id % 2 = 0", "projects"))
def catalog_store(d):
    """Save, overwrite from itself, load."""
    store = CatalogStore(d.spark, scratch_path(d.spark, "catalog"))
    store.save(d.projects, "kept")
    store.save(d.spark.read.parquet(store.current("kept")).filter("id % 2 = 0"), "kept")
    return d.spark.read.parquet(store.current("kept")).select("id", "title")


@query(sql(r"""SELECT n::INTEGER AS page_number, 'page_' || n || '.png' AS filename, page_id AS archive, strlen(html)::BIGINT + n AS size, n <> 3 AS success
    FROM (SELECT page_id, html, unnest([1, 2, 3]) AS n FROM pages)"""))
def explode_archives(d):
    """Archives built from the pages table by Spark tasks, then exploded; only the third entry is over the limit,
    which the longest page sets."""
    from panelflow.sources.files import explode_archives as explode

    longest = d.table("pages").agg(F.max(F.octet_length("html"))).first()[0] or 0
    limit = max(80_000, longest + 2)

    def pack(batches):
        import io
        import zipfile

        import pandas as pd
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for n in (3, 1, 2):
                        z.writestr(f"d/page_{n}.png", html.encode() + b"x" * (n if n < 3 else limit + 3))
                    z.writestr("notes.txt", "no image")
                rows.append((f"{page_id}.cbz", out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    archives = d.table("pages").select("page_id", "html").mapInPandas(pack, "path string, content binary")
    out = explode(archives, max_entry=limit)
    size = F.when(F.col("success"), F.octet_length("content").cast("long")).otherwise(F.col("size") - limit)
    return out.select("page_number", "filename", F.regexp_extract("archive_path", r"^(\d+)", 1).cast("long").alias("archive"),
                      size.alias("size"), "success")
