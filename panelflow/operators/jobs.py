"""Job rules and job analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions.text import clip
from panelflow.functions.values import half_even, percent
from panelflow.operators.skew import numbered, running

CHUNK_ROWS = 1000
STATUS_ARRAY = schema.JOB_STATUSES


def next_status(action: Column, status: Column) -> Column:
    """Status after an action, null when the action is refused."""
    out = F.lit(None).cast("string")
    for name, moves in schema.JOB_TRANSITIONS.items():
        for before, after in moves.items():
            out = F.when((action == name) & (status == before), after).otherwise(out)
    return out


def _transition_table() -> Column:
    """Map of action -> array with the index of the next status for each status (itself when refused)."""
    entries = []
    for name, moves in schema.JOB_TRANSITIONS.items():
        after = [STATUS_ARRAY.index(moves.get(s, s)) for s in STATUS_ARRAY]
        entries += [F.lit(name), F.array(*[F.lit(i) for i in after])]
    return F.create_map(*entries)


def replay_actions(jobs: DataFrame, actions: DataFrame, chunk_rows: int = CHUNK_ROWS, **kw) -> DataFrame:
    """Every action with the status before and after it and whether it was accepted.

    actions: job_id, action, at, action_id. A job's actions depend on each
    other, but each action is a mapping over seven statuses, and mappings
    compose. So actions are cut into chunks, each chunk is reduced to one
    mapping in parallel, and so are spans of ``chunk_rows`` chunks. The short
    list of a job's spans gives each span's first status, a span gives those of
    its chunks, and the chunks are replayed in parallel.
    """
    table = _transition_table()
    names = F.array(*[F.lit(s) for s in STATUS_ARRAY])
    identity = F.array(*[F.lit(i) for i in range(len(STATUS_ARRAY))])
    rows = numbered(actions, ["job_id"], [F.col("at"), F.col("action_id")], "__n", **kw).withColumn(
        "__chunk", F.floor((F.col("__n") - 1) / chunk_rows))
    chunks = rows.groupBy("job_id", "__chunk").agg(
        F.sort_array(F.collect_list(F.struct("__n", "action_id", "action", "at"))).alias("__rows")
    ).withColumn("__map", F.aggregate("__rows", identity, lambda m, r: F.transform(
        m, lambda i: F.coalesce(F.element_at(F.try_element_at(table, r["action"]), i + 1), i))))
    first = jobs.select(F.col("id").alias("job_id"),
                        (F.array_position(names, F.col("status")).cast("int") - 1).alias("__first"))
    def gathered(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), F.col("__map").alias("map")))).alias("__maps"))

    def walked(rows: DataFrame, keys: list[str], place: str, start: str) -> DataFrame:
        """The status index before each mapping of a list, from the one before the first."""
        states = F.aggregate(F.slice("__maps", 1, F.size("__maps") - 1), F.array(start), lambda acc, m: F.concat(
            acc, F.array(F.element_at(m["map"], F.element_at(acc, -1) + 1))))
        return rows.select(*keys, F.explode(F.arrays_zip(F.col("__maps.at").alias("at"), states.alias("start"))).alias("x")).select(
            *keys, F.col("x.at").alias(place), F.col("x.start").alias("__start"))

    spans = gathered(chunks.select("job_id", F.floor(F.col("__chunk") / chunk_rows).alias("__span"), "__chunk", "__map"),
                     ["job_id", "__span"], "__chunk")
    composed = spans.select("job_id", "__span", F.aggregate("__maps", identity, lambda m, s: F.transform(
        m, lambda i: F.element_at(s["map"], i + 1))).alias("__map"))
    tops = walked(gathered(composed, ["job_id"], "__span").join(first, "job_id"), ["job_id"], "__span", "__first")
    starts = walked(spans.join(tops, ["job_id", "__span"]), ["job_id"], "__chunk", "__start")
    states = F.aggregate("__rows", F.array("__start"), lambda acc, r: F.concat(acc, F.array(F.coalesce(
        F.element_at(F.try_element_at(table, r["action"]), F.element_at(acc, -1) + 1), F.element_at(acc, -1)))))
    replayed = chunks.join(starts, ["job_id", "__chunk"]).withColumn("__states", states).select(
        "job_id", "__states", F.posexplode("__rows").alias("__i", "r"))
    before = F.element_at(names, F.element_at("__states", F.col("__i") + 1) + 1)
    return replayed.select(
        "job_id", F.col("r.action_id").alias("action_id"), F.col("r.action").alias("action"), F.col("r.at").alias("at"),
        before.alias("status_before"), next_status(F.col("r.action"), before).isNotNull().alias("accepted"),
        F.coalesce(next_status(F.col("r.action"), before), before).alias("status_after"))


def apply_job_actions(jobs: DataFrame, actions: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Jobs after all accepted actions, and the refused actions.

    A retry clears error, progress, counters and times; a cancel sets the
    completion time; later actions win.
    """
    done = replay_actions(jobs, actions, **kw)
    ok = done.filter("accepted")
    when = F.struct("at", "action_id")
    last = ok.groupBy("job_id").agg(
        F.max_by("status_after", when).alias("__status"), F.max("at").alias("__at"),
        F.max(F.when(F.col("action") == "retry", when)).alias("__retry"),
        F.max(F.when(F.col("action") == "cancel", when)).alias("__cancel"))
    joined = jobs.join(last, jobs["id"] == last["job_id"], "left")
    retried = F.col("__retry").isNotNull()
    cancelled = F.col("__cancel").isNotNull() & (~retried | (F.col("__cancel") > F.col("__retry")))

    def reset(name: str, value) -> Column:
        return F.when(retried, F.lit(value)).otherwise(F.col(name)).alias(name)

    changes = {
        "status": F.coalesce("__status", "status"),
        "error_message": reset("error_message", None), "progress": reset("progress", 0.0),
        "completed_pages": reset("completed_pages", 0), "failed_pages": reset("failed_pages", 0),
        "started_at": reset("started_at", None),
        "completed_at": F.when(cancelled, F.col("__cancel.at")).when(retried, F.lit(None)).otherwise(F.col("completed_at")),
        "updated_at": F.coalesce("__at", "updated_at") if "updated_at" in jobs.columns else None,
    }
    changes = {n: c for n, c in changes.items() if n in jobs.columns}
    return joined.withColumns(changes).select(*jobs.columns), done.filter("NOT accepted")


def job_rollup(page_results: DataFrame) -> DataFrame:
    """Counters of a finished job over its page results (job_id, ok). Failed pages do not stop completion."""
    done = page_results.groupBy("job_id").agg(
        F.count("*").alias("total_pages"), F.count_if("ok").alias("completed_pages"),
        F.count_if(~F.col("ok")).alias("failed_pages"))
    return done.select("*", percent(F.col("completed_pages"), F.col("total_pages"), None).alias("page_progress"),
                       F.lit("completed").alias("status"), F.lit(100.0).alias("progress"))


def progress_curve(page_results: DataFrame, order: list[Column], every: int = 10, **kw) -> DataFrame:
    """Progress after each page of a job, with the pages where a checkpoint is due."""
    totals = page_results.groupBy("job_id").agg(F.count("*").alias("total_pages"))
    rows = running(page_results, ["job_id"], order, {
        "page_index": F.lit(1).cast("long"), "failed_pages": F.when(F.col("ok"), 0).otherwise(1).cast("long")}, **kw)
    done = F.col("page_index") - F.col("failed_pages")
    return rows.join(totals, "job_id").select(
        *page_results.columns, "page_index", "failed_pages", done.alias("completed_pages"),
        percent(done, F.col("total_pages"), None).alias("progress"),
        (F.col("page_index") % every == 0).alias("is_checkpoint"))


def attempt_summary(attempts: DataFrame, retries: int = 3, delay: float = 1.0, factor: float = 1.5) -> DataFrame:
    """Outcome per page over its attempts 0..retries: status, attempts used, seconds waited, last error.

    attempts: job_id, page_id, attempt, ok, error. Attempts after a success or past the limit do not count.
    """
    keys = ["job_id", "page_id"]
    allowed = attempts.filter(F.col("attempt") <= retries)
    success = allowed.groupBy(*keys).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("__ok_at"))
    used = allowed.join(success, keys).filter(F.col("__ok_at").isNull() | (F.col("attempt") <= F.col("__ok_at")))
    waited = F.sum(F.when(F.col("attempt") > 0, F.lit(delay) * F.pow(F.lit(factor), F.col("attempt") - 1)).otherwise(0.0))
    out = used.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.max("ok").alias("ok"), half_even(waited, 6).alias("delay_seconds"),
        F.max_by("error", F.when(~F.col("ok"), F.col("attempt"))).alias("last_error"))
    return out.withColumn("last_error", F.when(~F.col("ok"), F.coalesce(clip(F.col("last_error"), 200), F.lit("Unknown error"))))


def admission_candidates(jobs: DataFrame, slots: int, retry: int = 3) -> DataFrame:
    """Oldest pending jobs for the free slots, and the oldest failed jobs with a message to retry."""
    order = [F.col("created_at"), F.col("id")]
    waiting = jobs.filter(F.col("status") == "pending").orderBy(*order).limit(max(slots, 0))
    failed = jobs.filter((F.col("status") == "failed") & F.col("error_message").isNotNull()).orderBy(*order).limit(retry)
    return waiting.withColumn("reason", F.lit("pending")).unionByName(failed.withColumn("reason", F.lit("retry")))


def remaining_pages(pages: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pages at or after the job's last checkpoint (0-based page_index)."""
    last = checkpoints.groupBy("job_id").agg(F.max("page_index").alias("__done"))
    return pages.join(last, "job_id", "left").filter(
        F.col("page_index") >= F.coalesce("__done", F.lit(0))).drop("__done")


def timed_out_jobs(jobs: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Processing jobs that started more than the given minutes ago."""
    return jobs.filter((F.col("status") == "processing") & (
        F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes))))


def overlay_latest(jobs: DataFrame, latest: DataFrame) -> DataFrame:
    """Job rows overlaid with their latest event (job_id, status, progress, total_pages, current_page).
    Status and progress come from the event; counters stay when the event has none."""
    ev = latest.select(F.col("job_id").alias("__job"), F.col("status").alias("__s"), F.col("progress").alias("__p"),
                       F.col("total_pages").alias("__t"), F.col("current_page").alias("__c"))
    hit = F.col("__job").isNotNull()
    return jobs.join(ev, jobs["id"] == ev["__job"], "left").withColumns({
        "status": F.when(hit, F.col("__s")).otherwise(F.col("status")),
        "progress": F.when(hit, F.col("__p")).otherwise(F.col("progress")),
        "total_pages": F.coalesce("__t", "total_pages"),
        "completed_pages": F.coalesce("__c", "completed_pages"),
    }).select(*jobs.columns)


def last_events(events: DataFrame, n: int = 100) -> DataFrame:
    return events.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(n)


def live_job_state(events: DataFrame) -> DataFrame:
    """Latest event per job by time, then id; 'error' reads as failed."""
    status = F.when(F.col("status") == "error", "failed").otherwise(F.col("status"))
    latest = F.max_by(F.struct(
        "type", status.alias("status"), "progress", "current_page", "total_pages", "timestamp"),
        F.struct("timestamp", "event_id"))
    return events.groupBy("job_id").agg(latest.alias("e")).select("job_id", "e.*")


def idle_gaps(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Silences of at least the given seconds between two events of a job.

    Such a gap always crosses a boundary of time slots of that length, so slots
    are reduced to their first and last event and only slots are put in order.
    """
    slot = F.floor(F.unix_timestamp("timestamp") / seconds)
    slots = events.groupBy("job_id", slot.alias("slot")).agg(
        F.min("timestamp").alias("idle_to"), F.max("timestamp").alias("last_at"))
    before = F.lag("last_at").over(W.partitionBy("job_id").orderBy("slot"))
    gaps = slots.select("job_id", before.alias("idle_from"), "idle_to")
    silence = F.timestamp_diff("MICROSECOND", F.col("idle_from"), F.col("idle_to")) / 1e6
    return gaps.withColumn("idle_seconds", silence).filter(F.col("idle_seconds") >= seconds)
