"""Translation requests, memory lookup, provider calls and fallback order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow import schema
from panelflow.functions import text as t
from panelflow.functions.values import half_even, is_live, percent, tally
from panelflow.operators.journal import journaled
from panelflow.operators.regions import rank_of
from panelflow.operators.skew import running
from panelflow.session import cut

CANDIDATE = "key string, engine string, text string, confidence double"
CANDIDATE_ARROW = pa.schema([("key", pa.string()), ("engine", pa.string()), ("text", pa.string()), ("confidence", pa.float64())])
PIECE_BYTES = 1 << 20
MEMORY_TTL = 3600.0
Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


# --- requests ---------------------------------------------------------------

def translation_keys(segments: DataFrame) -> DataFrame:
    """Add the request key of text, languages and context (when there is one)."""
    context = F.col("context") if "context" in segments.columns else None
    return segments.withColumn("key", t.request_key(
        F.col("original_text"), F.col("source_language"), F.col("target_language"), context))


def distinct_requests(segments: DataFrame) -> DataFrame:
    """One row per key over segments with text; n is how many segments want it."""
    keyed = translation_keys(segments).filter(t.has_text(F.col("original_text")))
    kept = [c for c in ("original_text", "source_language", "target_language", "context") if c in keyed.columns]
    return keyed.groupBy("key").agg(*[F.min(c).alias(c) for c in kept], F.count("*").alias("n"))


def batch_source_language(segments: DataFrame, batch: str = "batch", order: str = "id") -> DataFrame:
    """'auto' becomes the language of the batch's first non-blank text, when that is known."""
    text = F.col("original_text")
    first = segments.filter(t.has_text(text)).groupBy(batch).agg(
        F.min_by(text, F.struct(order, text)).alias("__first"))
    found = t.script_presence(F.col("__first"))
    decided = F.when((F.col("source_language") == "auto") & (found != "unknown"), found)
    return segments.join(first, batch, "left").withColumn(
        "source_language", F.coalesce(decided, "source_language")).drop("__first")


def page_context(bubbles: DataFrame, given: str | None = None) -> DataFrame:
    """Context line per page: how many texts there are and how the first non-blank one starts."""
    text = F.coalesce("original_text", F.lit(""))
    place = F.struct(F.coalesce("reading_order", F.lit(0)), F.col("id"))
    base = F.coalesce(F.max(given), F.lit("")) if given else F.lit("")
    pages = bubbles.groupBy("page_id").agg(
        base.alias("base"), F.count("*").alias("n"),
        F.min_by(F.when(t.has_text(text), F.substring(text, 1, 100)),
                 F.when(t.has_text(text), place)).alias("first"))
    line = F.concat(F.col("base"), F.lit("\nPage contains "), F.col("n").cast("string"),
                    F.lit(" text bubbles. First: '"), F.col("first"), F.lit("'"))
    return pages.select("page_id", F.nullif(t.strip(F.coalesce(line, "base")), F.lit("")).alias("context"))


def detected_language(rows: DataFrame) -> Column:
    """Language found in a text whose source is 'auto'; null for other rows."""
    return F.when(rows["source_language"] == "auto", t.script_presence(rows["original_text"]))


# --- memory -----------------------------------------------------------------

def live_memory(memory: DataFrame, now: Column) -> DataFrame:
    """Newest live entry per key."""
    live = memory.filter(is_live(F.col("created_at"), F.col("ttl"), now))
    return live.groupBy("key").agg(F.max_by(
        F.struct("translated_text", "engine", "created_at"),
        F.struct("created_at", "translated_text")).alias("m")).select("key", "m.*")


def memory_hits(requests: DataFrame, memory: DataFrame, now: Column) -> DataFrame:
    return requests.join(live_memory(memory, now), "key", "left").withColumn(
        "hit", F.col("created_at").isNotNull())


def memory_misses(requests: DataFrame, memory: DataFrame, now: Column) -> DataFrame:
    live = memory.filter(is_live(F.col("created_at"), F.col("ttl"), now)).select("key")
    return requests.join(live, "key", "left_anti")


def purge_expired(memory: DataFrame, now: Column) -> DataFrame:
    return memory.filter(is_live(F.col("created_at"), F.col("ttl"), now))


def preload(memory: DataFrame, now: Column, n: int = 100) -> DataFrame:
    """The newest n live entries."""
    return purge_expired(memory, now).orderBy(F.col("created_at").desc(), "key", "translated_text").limit(n)


def recent_entries(memory: DataFrame, now: Column, n: int = 20) -> DataFrame:
    """The n most recently used entries, oldest first by age."""
    age = F.timestamp_diff("MICROSECOND", F.col("created_at"), now) / 1e6
    return (
        memory.orderBy(F.col("accessed_at").desc(), F.col("key").desc()).limit(n)
        .select(F.substring("key", 1, 80).alias("key"), half_even(F.col("size") / 1024, 1).alias("size_kb"),
                half_even(age, 1).alias("age_seconds"), "ttl",
                (~is_live(F.col("created_at"), F.col("ttl"), now)).alias("expired"))
        .orderBy(F.col("age_seconds").desc(), "key"))


def retain_by_budget(entries: DataFrame, max_bytes: int, cache: str = "cache", **kw) -> DataFrame:
    """Longest most-recently-used run of each cache whose total size fits the budget."""
    used = running(entries, [cache], [F.col("accessed_at").desc(), F.col("key")],
                   {"used_bytes": F.col("size")}, **kw)
    return used.filter(F.col("used_bytes") <= max_bytes)


def cache_report(access_log: DataFrame, entries: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Entries, size, usage and traffic per cache; a restore also counts as a hit."""
    event = F.col("event")
    traffic = access_log.groupBy("cache").agg(
        F.count_if(event.isin("hit", "restore")).alias("hits"), F.count_if(event == "miss").alias("misses"),
        F.count_if(event == "eviction").alias("evictions"), F.count_if(event == "restore").alias("restores"))
    held = entries.groupBy("cache").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("cache"))

    def n(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    return traffic.join(held, "cache", "full").select(
        "cache", n("entries").alias("entries"),
        half_even(n("bytes") / (1024 * 1024), 2).alias("memory_mb"),
        percent(n("bytes"), limit).alias("usage_percent"),
        n("hits").alias("hits"), n("misses").alias("misses"),
        percent(n("hits"), n("hits") + n("misses")).alias("hit_rate_percent"),
        n("evictions").alias("evictions"), n("restores").alias("restores"))


def delete_keys(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


# --- providers and fallback -------------------------------------------------

def per_row(engine: str, translate: Callable[[str, str, str, str | None], str]) -> Provider:
    """Provider from a function of one text; a failing row gives its own text at confidence 0."""

    def one(row) -> tuple:
        try:
            out = translate(row.original_text, row.source_language, row.target_language, getattr(row, "context", None))
            return row.key, engine, out, 0.95
        except Exception:  # a bad row must not fail the task
            return row.key, "fallback", row.original_text, 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(r) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["key", "engine", "text", "confidence"])

    return run


def _in_pieces(provider: Provider, kind: pa.Schema = CANDIDATE_ARROW, piece: int = PIECE_BYTES):
    """The provider over Arrow batches, given about ``piece`` bytes of requests at a time: long texts are held in pandas a
    few at a time, however many rows Spark puts in a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = max(1, int(batch.num_rows * piece / max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows).to_pandas()

        for answers in provider(frames()):
            yield pa.RecordBatch.from_pandas(answers, schema=kind, preserve_index=False)

    return run


def run_provider(requests: DataFrame, provider: Provider, parallelism: int | None = None, journal: str | None = None) -> DataFrame:
    """Candidate rows from a provider. Spark decides how many tasks call it; ``parallelism`` sets that number for
    services that allow only so many callers. With ``journal``, a folder on shared storage, a key that was answered is
    never asked again by a retried task or a repeated job (see ``operators.journal``).

    A source language of 'auto' is detected per text first; where that fails the provider is told 'auto'.
    """
    found = detected_language(requests)
    requests = requests.withColumn("source_language", F.when(found != "unknown", found).otherwise(F.col("source_language")))
    if journal:
        return journaled(requests, provider, CANDIDATE, journal, parallelism=parallelism)
    spread = requests.repartition(parallelism) if parallelism else requests
    return spread.mapInArrow(_in_pieces(provider), CANDIDATE)


def resolve_translations(requests: DataFrame, candidates: DataFrame, priority: list[str] | None = None,
                         reject_echo: bool = False) -> DataFrame:
    """First engine in priority order with a non-blank text; else the source text at confidence 0."""
    priority = priority or schema.TRANSLATOR_PRIORITY
    source = F.col("original_text")
    valid = candidates.filter(F.col("engine").isin(priority) & t.has_text(F.col("text")))
    if reject_echo:
        valid = valid.join(requests.select("key", source.alias("__src")), "key").filter(
            t.strip(F.col("text")) != F.col("__src")).drop("__src")
    best = valid.groupBy("key").agg(F.min(F.struct(
        rank_of("engine", priority).alias("rank"), t.strip(F.col("text")).alias("text"),
        F.col("engine").alias("engine"))).alias("best"))
    found = F.col("best").isNotNull()
    blank = ~t.has_text(source)
    return requests.join(best, "key", "left").select(
        *requests.columns,
        F.when(blank, "").when(found, F.col("best.text")).otherwise(source).alias("translated_text"),
        F.when(blank, 1.0).when(found, 0.95).otherwise(0.0).alias("confidence"),
        F.when(blank, "").when(found, F.col("best.engine")).otherwise("fallback").alias("engine"))


def compute_missing(keys: DataFrame, memory: DataFrame, now: Column,
                    compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Values of all keys and the newly computed rows: live memory first, ``compute`` for the rest.

    The looked-up keys and the computed rows are each written out once: the
    lookup has two readers, and a provider must not be called again by a second one.
    """
    planned = cut(memory_hits(keys, memory, now))
    fresh = cut(compute(planned.filter("NOT hit").select(*keys.columns)))
    known = planned.filter("hit").select(
        *keys.columns, "translated_text", F.lit(0.95).alias("confidence"), "engine", F.lit(True).alias("from_memory"))
    return known.unionByName(fresh.withColumn("from_memory", F.lit(False))), fresh


def translate_segments(segments: DataFrame, memory: DataFrame, provider: Provider, now: Column,
                       ttl: float = MEMORY_TTL, parallelism: int | None = None,
                       priority: list[str] | None = None, reject_echo: bool = False,
                       journal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Translated segments and the memory rows to append.

    Equal requests are asked once; only requests without a live memory entry
    reach the provider; fallbacks are returned but not remembered. The key keeps 'auto'; the provider is
    told the language found in the text, and detected_source_language has it.
    """
    def ask(misses: DataFrame) -> DataFrame:
        return resolve_translations(misses, run_provider(misses, provider, parallelism, journal), priority, reject_echo)

    answers, fresh = compute_missing(distinct_requests(segments).drop("n"), memory, now, ask)
    out = translation_keys(segments).join(
        answers.select("key", "translated_text", "confidence", "engine", "from_memory"), "key", "left")
    out = out.withColumns({
        "detected_source_language": F.coalesce(detected_language(out), F.lit("")),
        "translated_text": F.coalesce("translated_text", F.lit("")),
        "confidence": F.coalesce("confidence", F.lit(1.0)),
        "engine": F.coalesce("engine", F.lit("")),
        "from_memory": F.coalesce("from_memory", F.lit(False)),
    })
    learned = fresh.filter(F.col("engine") != "fallback").select(
        "key", "translated_text", "engine", F.octet_length("translated_text").cast("long").alias("size"),
        now.cast("timestamp_ntz").alias("created_at"), now.cast("timestamp_ntz").alias("accessed_at"),
        F.lit(float(ttl)).alias("ttl"))
    return out, learned


def append_memory(memory: DataFrame, learned: DataFrame) -> DataFrame:
    """Memory with new rows; running it again with the same rows adds nothing."""
    return memory.unionByName(learned.join(memory.select("key", "created_at"), ["key", "created_at"], "left_anti"))


def translate_pages(bubbles: DataFrame, memory: DataFrame, provider: Provider, now: Column,
                    source: str = "auto", target: str = "en", **kw) -> tuple[DataFrame, DataFrame]:
    """Bubbles with translated text, in reading order, all texts of a page sharing its context."""
    asked = bubbles.withColumns({
        "original_text": F.coalesce("original_text", F.lit("")),
        "reading_order": F.coalesce("reading_order", F.lit(0)),
        "source_language": F.lit(source), "target_language": F.lit(target)})
    asked = batch_source_language(asked.withColumn("__place", F.struct("reading_order", "id")), "page_id", "__place")
    asked = asked.drop("__place").join(page_context(bubbles), "page_id", "left")
    done, learned = translate_segments(asked, memory, provider, now, **kw)
    return done.withColumnsRenamed(
        {"confidence": "translation_confidence", "engine": "translation_engine"}), learned


def drop_blank_text(df: DataFrame, column: str = "original_text") -> DataFrame:
    return df.filter(t.has_text(F.col(column)))


def translation_stats(translations: DataFrame) -> DataFrame:
    pair = F.concat("source_language", F.lit("→"), "target_language")
    groups = translations.groupBy("engine", pair.alias("pair")).agg(
        F.count("*").alias("n"), F.sum(F.char_length("translated_text")).alias("chars"), F.sum("time_ms").alias("t"),
        F.count("time_ms").alias("timed"))
    one = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_translations"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"),
        F.coalesce(F.try_divide(F.sum("t"), F.sum("timed")), F.lit(0.0)).alias("avg_time_ms"),
        F.collect_list(F.struct("engine", "pair", "n")).alias("g"))
    return one.withColumns({"by_engine": tally(F.col("g"), "engine"), "by_language_pair": tally(F.col("g"), "pair")}).drop("g")


def duplicate_pages(files: DataFrame, region: str = "None", languages: list[str] | None = None) -> DataFrame:
    """Content key per file and how many files share it."""
    tail = f":{region}:{':'.join(languages or ['ja'])}"
    keyed = files.withColumn("key", F.concat(F.lit("ocr:"), F.sha2("content", 256), F.lit(tail))).drop("content")
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("copies")), "key")
