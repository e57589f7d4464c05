"""Streams that keep a state per job in the state store: statuses, latest events, timeouts, silences.

The state lives in RocksDB under the stream's checkpoint. A micro-batch reads and writes only the keys it has rows for,
whatever came before, and ``read_state`` gives the state of all keys at the cost of one row each. Times are held as
microseconds, so that no time zone of a worker matters. A key's rows of one micro-batch are held by one task; bound them
by the source's trigger options (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).

With ``ttl_ms`` a stream always asks for another batch, so it runs until it is stopped; an available-now run would not end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from panelflow import schema
from panelflow.operators.jobs import overlay_latest

LATEST_FIELDS = ["type", "status", "progress", "current_page", "total_pages", "timestamp", "event_id"]
SLICES = 16


def _micros(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.unix_micros(c) for c in times}) if times else df


def _times(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in names})


def _plain(row, kind: str) -> tuple:
    """Values of a pandas row as Python values of a schema; pandas holds whole numbers beside nulls as floats."""
    whole = [k.split()[-1] in ("long", "bigint", "int") for k in kind.split(", ")]
    return tuple(None if pd.isna(v) else int(v) if w else v.item() if hasattr(v, "item") else v for v, w in zip(row, whole, strict=True))


def _schema(df: DataFrame, columns: Iterable[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def read_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The value or list of every key in the store of a stream: the key's and the state's columns."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    held = "value" if "value" in rows.columns else "list_element"
    return rows.select("key.*", f"{held}.*")


class _Statuses(StatefulProcessor):
    """Status of a job; every action gets a verdict at the status it finds."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.status = handle.getValueState("status", "status string", self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.status.update((initialState["status"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = sorted(((r["at"], r["action_id"], r["action"], r["status"]) for r in rows),
                       key=lambda r: (r[0] is None, r[0], r[1] is None, r[1]))
        held = self.status.get()
        before = status = held[0] if held else None
        for at, action_id, action, given in batch:
            if given is not None:
                status = given
            elif status is not None:
                after = schema.JOB_TRANSITIONS.get(action, {}).get(status)
                yield Row(job_id=key[0], action_id=action_id, action=action, at=at, status_before=status,
                          accepted=after is not None, status_after=after or status)
                status = after or status
        # Each call to the store is a round trip; a time to live counts from the last write.
        if status is not None and (status != before or self.ttl_ms):
            self.status.update((status,))


def transitions(actions: DataFrame, jobs: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Verdict of every action of a stream (job_id, action, at, action_id) at the status its job has at that moment.

    jobs (id, status) gives the statuses at the very first start; ``read_state(..., "status")`` of an earlier stream
    will do. A row with a non-null ``status``, if the stream has that column, sets the job's status and gives no verdict: a
    created job or a worker's report. Actions of a micro-batch are taken by (at, action_id), micro-batches as they
    come; actions of jobs without a status give nothing. With ``ttl_ms`` a status untouched for so long is forgotten.
    """
    rows = actions if "status" in actions.columns else actions.withColumn("status", F.lit(None).cast("string"))
    rows = _micros(rows.select("job_id", "action", "at", "action_id", "status"))
    # Rows, not pandas: a job has few actions in a micro-batch, and frames for each job cost more than the rows.
    kind = f"{_schema(rows, ['job_id', 'action_id', 'action', 'at'])}, status_before string, accepted boolean, status_after string"
    first = jobs.select(F.col("id").cast(rows.schema["job_id"].dataType).alias("job_id"), "status").groupBy("job_id") if jobs is not None else None
    done = rows.groupBy("job_id").transformWithState(
        _Statuses(ttl_ms), kind, "append", "ProcessingTime" if ttl_ms else "None", first)
    return _times(done, ["at"]) if actions.schema["at"].dataType.typeName() == "timestamp" else done


class _Latest(StatefulProcessor):
    """The latest event of a job; sent on when it changes."""

    def __init__(self, kind: str, fields: list[str], ttl_ms: int | None):
        self.kind, self.fields, self.ttl_ms = kind, fields, ttl_ms

    def init(self, handle) -> None:
        self.latest = handle.getValueState("latest", self.kind, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, number = self.fields.index("timestamp"), self.fields.index("event_id")
        held = best = self.latest.get()
        for batch in rows:
            last = _plain(batch.sort_values(["timestamp", "event_id"])[self.fields].iloc[-1], self.kind)
            if best is None or (last[at], last[number]) > (best[at], best[number]):
                best = last
        if best is not held:
            self.latest.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["job_id", *self.fields])


def latest_events(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A row for every job and micro-batch that changed its latest event.

    The latest event is that with the greatest (timestamp, event_id), in whatever order events come. The state of all
    jobs is ``job_state``. With ``ttl_ms`` jobs without a newer event for so long are forgotten.
    """
    rows = _micros(events.filter("timestamp IS NOT NULL AND event_id IS NOT NULL").select("job_id", *LATEST_FIELDS))
    done = rows.groupBy("job_id").transformWithStateInPandas(
        _Latest(_schema(rows, LATEST_FIELDS), LATEST_FIELDS, ttl_ms), _schema(rows, ["job_id", *LATEST_FIELDS]), "append",
        "ProcessingTime" if ttl_ms else "None")
    return _times(done, ["timestamp"])


def job_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Latest event of every job, from the state of a ``latest_events`` stream."""
    return _times(read_state(spark, checkpoint, "latest"), ["timestamp"])


def live_jobs(jobs: DataFrame, checkpoint: str) -> DataFrame:
    """Job rows overlaid with the latest events that a ``latest_events`` stream holds now; 'error' reads as failed."""
    status = F.when(F.col("status") == "error", "failed").otherwise(F.col("status"))
    return overlay_latest(jobs, job_state(jobs.sparkSession, checkpoint).withColumn("status", status))


class _Newest(StatefulProcessor):
    """The newest n events of a slice."""

    def __init__(self, kind: str, columns: list[str], n: int):
        self.kind, self.columns, self.n = kind, columns, n

    def init(self, handle) -> None:
        self.newest = handle.getListState("newest", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(r) for r in self.newest.get()], columns=self.columns, dtype=object)
        kept, came = held, 0
        for batch in rows:
            came += len(batch)
            both = pd.concat([kept, batch[self.columns].astype(object)]).drop_duplicates("event_id")
            kept = both.sort_values(["timestamp", "event_id"], ascending=False).head(self.n)
        self.newest.put([_plain(r, self.kind) for r in kept.itertuples(index=False)])
        yield pd.DataFrame([(key[0], came)], columns=["slice", "events"])


def newest_events(events: DataFrame, n: int = 100, slices: int = SLICES) -> DataFrame:
    """Keeps the newest n events; gives (slice, events) of each micro-batch. ``last_events`` reads them.

    Events are dealt to slices by a hash of their id, each with at most n events in its state, so no task holds all of
    a busy moment. An event that comes twice is kept once.
    """
    rows = _micros(events.filter("timestamp IS NOT NULL AND event_id IS NOT NULL"))
    columns = rows.columns
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("event_id"), F.lit(slices)).cast("int"))
    return sliced.groupBy("slice").transformWithStateInPandas(
        _Newest(_schema(rows, columns), columns, n), "slice int, events long", "append", "None")


def last_events(spark: SparkSession, checkpoint: str, n: int = 100) -> DataFrame:
    """The newest n events overall, newest first, from the state of a ``newest_events`` stream."""
    rows = read_state(spark, checkpoint, "newest").drop("slice")
    return _times(rows.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n), ["timestamp"])


class _InOrder(StatefulProcessor):
    """Walks a job's events in event-time order once the watermark has passed them.

    Events wait in a list. A timer stands at the next waiting event or at the end of what is open, so the walk goes on
    when the watermark gets there, also without any new event of the job.
    """

    def __init__(self, width: int, starts: list[str] | None, ends: list[str]):
        self.width, self.starts, self.ends = width, starts, ends

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, type string")
        self.open = handle.getValueState("open", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.appendList([_plain(r, "at long, type string") for r in batch[["at", "type"]].itertuples(index=False)])
            least = int(batch["at"].min())
            first = least if first is None else min(first, least)
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        passed = [r for r in waiting if r[0] <= now]
        left = waiting[len(passed):]
        held = self.open.get()
        since, out = held[0] if held else None, []
        for at, kind in passed:
            if since is not None and at > since + self.width:
                out.append((key[0], since, since + self.width))
                since = None
            if kind in self.ends:
                since = None
            elif self.starts is None or (since is None and kind in self.starts):
                since = at
        if since is not None and since + self.width <= now:
            out.append((key[0], since, since + self.width))
            since = None
        if since is None:
            self.open.clear()
        else:
            self.open.update((since,))
        if passed:
            self.waiting.put(left) if left else self.waiting.clear()
        nexts = [r[0] for r in left[:1]] + ([since + self.width] if since is not None else [])
        if nexts:
            self._wake(min(nexts))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "since", "until"])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))


def _in_order(events: DataFrame, width: str, delay: str, starts: list[str] | None, ends: list[str]) -> DataFrame:
    micros = int(events.sparkSession.sql(f"SELECT timestampdiff(MICROSECOND, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + INTERVAL {width})").first()[0])
    rows = events.filter("job_id IS NOT NULL").withWatermark("timestamp", delay).select(
        "job_id", "timestamp", F.unix_micros("timestamp").alias("at"), "type")
    done = rows.groupBy("job_id").transformWithStateInPandas(
        _InOrder(micros, starts, ends), f"{_schema(rows, ['job_id'])}, since long, until long", "append", "EventTime")
    return _times(done, ["since", "until"])


def job_timeouts(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """A row for every run that lasted longer than ``width``: (job_id, started_at, timed_out_at).

    A run starts at a job's first progress event and ends with its completion or error. When the watermark passes the
    start plus ``width`` and no end came up to then, the run times out, with or without further events of the job. An
    end that comes late but within ``delay`` still counts. After a timeout the next progress event starts a new run.
    """
    done = _in_order(events, width, delay, ["job_progress"], ["job_completed", "job_error"])
    return done.select("job_id", F.col("since").alias("started_at"), F.col("until").alias("timed_out_at"))


def idle_notices(events: DataFrame, width: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """A row for every silence of a job longer than ``width``: (job_id, last_event_at, idle_at), sent once the watermark
    is past it, also when no further event ever comes."""
    done = _in_order(events, width, delay, None, [])
    return done.select("job_id", F.col("since").alias("last_event_at"), F.col("until").alias("idle_at"))
