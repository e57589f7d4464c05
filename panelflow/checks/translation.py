"""Queries of translation planning and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow import schema
from panelflow.checks.base import EPOCH, STRIP, flat, now, query, quoted, rounded, sql
from panelflow.operators import translate as X

LIVE = f"(ttl IS NULL OR ttl <= 0 OR epoch_us(TIMESTAMP '{EPOCH}') - epoch_us(created_at) <= ttl * 1000000)"
REQUESTS = f"""requests AS (SELECT 'trans:' || md5(original_text) || ':' || source_language || ':' || target_language AS key,
    min(original_text) AS original_text, min(source_language) AS source_language, min(target_language) AS target_language, count(*) AS n
    FROM segments WHERE regexp_replace(original_text, '{STRIP}', '', 'g') <> '' GROUP BY 1),
live AS (SELECT key, translated_text, engine, created_at FROM memory WHERE {LIVE}
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, translated_text DESC) = 1)"""


@query(sql("SELECT id, 'trans:' || md5(original_text) || ':' || source_language || ':en:ctx=' || substring(md5(batch), 1, 16) AS key FROM segments", "segments"))
def translation_keys(d):
    return X.translation_keys(d.segments.withColumn("context", F.col("batch"))).select("id", "key")


@query(sql("SELECT * FROM requests", "segments", "memory", extra=REQUESTS))
def distinct_requests(d):
    return X.distinct_requests(d.segments)


@query(sql("SELECT key, n, translated_text, created_at, created_at IS NOT NULL AS hit FROM requests LEFT JOIN live USING (key)",
           "segments", "memory", extra=REQUESTS))
def memory_hits(d):
    return X.memory_hits(X.distinct_requests(d.segments), d.memory, now()).select("key", "n", "translated_text", "created_at", "hit")


@query(sql("SELECT key, original_text, n FROM requests ANTI JOIN live USING (key)", "segments", "memory", extra=REQUESTS))
def memory_misses(d):
    return X.memory_misses(X.distinct_requests(d.segments), d.memory, now()).select("key", "original_text", "n")


CANDIDATES = f"""candidates AS (SELECT key, e AS engine, CASE (strlen(original_text) + i) % 4 WHEN 0 THEN '  ' WHEN 1 THEN original_text
    ELSE ' ' || e || ':' || original_text || chr(10) END AS text FROM requests,
    (SELECT unnest(['google', 'argos', 'mystery']) AS e, unnest([1, 2, 3]) AS i) WHERE strlen(original_text) % 5 <> i),
ranked AS (SELECT key, engine, regexp_replace(text, '^{STRIP}+|{STRIP}+$', '', 'g') AS text, list_position({quoted(schema.TRANSLATOR_PRIORITY)}, engine) AS rk
    FROM candidates WHERE list_position({quoted(schema.TRANSLATOR_PRIORITY)}, engine) IS NOT NULL),
best AS (SELECT * FROM ranked WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY rk) = 1),
no_echo AS (SELECT ranked.* FROM ranked JOIN requests USING (key) WHERE text <> '' AND text <> original_text
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY rk) = 1)"""


def _candidates(d):
    """Candidate texts of three engines: blank, an echo of the source, or a translation."""
    requests = X.distinct_requests(d.segments)
    size = F.octet_length("original_text")
    engines = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(i).alias("i"))
                                  for i, e in enumerate(["google", "argos", "mystery"], 1)]))
    rows = requests.select("key", "original_text", engines.alias("x")).filter(size % 5 != F.col("x.i"))
    kind = (size + F.col("x.i")) % 4
    text = (F.when(kind == 0, "  ").when(kind == 1, F.col("original_text"))
            .otherwise(F.concat(F.lit(" "), F.col("x.e"), F.lit(":"), "original_text", F.lit("\n"))))
    return requests, rows.select("key", F.col("x.e").alias("engine"), text.alias("text"))


def _resolved(best: str) -> str:
    return sql(f"""SELECT key, coalesce(text, original_text) AS translated_text, CASE WHEN text IS NULL THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence,
      coalesce(engine, 'fallback') AS engine FROM requests LEFT JOIN {best} USING (key)""",
               "segments", "memory", extra=REQUESTS + ",\n" + CANDIDATES)


@query(_resolved("best"))
def resolve_translations(d):
    return X.resolve_translations(*_candidates(d)).select("key", "translated_text", "confidence", "engine")


@query(_resolved("no_echo"))
def resolve_without_echo(d):
    return X.resolve_translations(*_candidates(d), reject_echo=True).select("key", "translated_text", "confidence", "engine")


def batch_provider():
    """Stand-in engine that answers whole batches: fails on German, else marks the text. The function is
    local, so it travels to the workers with the plan."""
    def answer(batches):
        for batch in batches:
            failed = batch["source_language"] == "de"
            text = batch["original_text"].where(failed, batch["target_language"] + ": " + batch["original_text"])
            yield batch[["key"]].assign(engine=failed.map({True: "fallback", False: "google"}), text=text,
                                        confidence=failed.map({True: 0.0, False: 0.95}).astype(float))

    return answer


def _segments_sql() -> str:
    return f"""SELECT s.id, CASE WHEN r.key IS NULL THEN '' WHEN l.key IS NOT NULL THEN l.translated_text
      WHEN s.source_language = 'de' THEN s.original_text
      ELSE regexp_replace('en: ' || s.original_text, '^{STRIP}+|{STRIP}+$', '', 'g') END AS translated_text,
    CASE WHEN r.key IS NULL THEN 1.0 WHEN l.key IS NULL AND s.source_language = 'de' THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence,
    CASE WHEN r.key IS NULL THEN '' WHEN l.key IS NOT NULL THEN l.engine WHEN s.source_language = 'de' THEN 'fallback' ELSE 'google' END AS engine,
    l.key IS NOT NULL AS from_memory
    FROM (SELECT *, 'trans:' || md5(original_text) || ':' || source_language || ':' || target_language AS key FROM segments) s
    LEFT JOIN requests r USING (key) LEFT JOIN live l USING (key)"""


@query(sql(_segments_sql(), "segments", "memory", extra=REQUESTS))
def translate_segments(d):
    """Flagship of the text side: dedupe, memory, provider for the misses, fallback, back to every segment."""
    done, _ = X.translate_segments(d.segments, d.memory, batch_provider(), now())
    return done.select("id", "translated_text", "confidence", "engine", "from_memory")


@query(sql(f"""SELECT key, CASE WHEN source_language = 'de' THEN 'fallback' ELSE 'google' END AS engine,
    CASE WHEN source_language = 'de' THEN original_text ELSE 'en: ' || original_text END AS text,
    CASE WHEN source_language = 'de' THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence FROM requests""", "segments", "memory", extra=REQUESTS))
def run_provider(d):
    return X.run_provider(X.distinct_requests(d.segments), batch_provider())


@query(sql(f"""SELECT key, 'en: ' || original_text AS translated_text, 'google' AS engine, CAST(strlen(original_text) + 4 AS BIGINT) AS size
    FROM (SELECT key, source_language, regexp_replace(original_text, '{STRIP}+$', '', 'g') AS original_text FROM requests)
    ANTI JOIN live USING (key) WHERE source_language <> 'de'""",
           "segments", "memory", extra=REQUESTS))
def learned_memory(d):
    """Memory rows to append after one run."""
    _, learned = X.translate_segments(d.segments, d.memory, batch_provider(), now())
    return learned.select("key", "translated_text", "engine", "size")


@query(sql("SELECT key, source_language FROM requests ANTI JOIN live USING (key) WHERE source_language = 'de'",
           "segments", "memory", extra=REQUESTS))
def second_run_misses(d):
    """What a second run over the same segments asks again, with the appended memory: the first run's fallbacks."""
    _, learned = X.translate_segments(d.segments, d.memory, batch_provider(), now())
    grown = X.append_memory(d.memory, learned)
    return X.memory_misses(X.distinct_requests(d.segments), grown, now()).select("key", "source_language")


@query(sql(f"""SELECT page_id, 'Page contains ' || count(*) || ' text bubbles. First: ''' || substring(first(original_text ORDER BY reading_order, id), 1, 100)
    || '''' AS context FROM bubbles GROUP BY page_id""", "bubbles"))
def page_context(d):
    return X.page_context(d.bubbles)


FIRST = f"""firsts AS (SELECT batch, first(original_text ORDER BY id) AS t FROM segments
    WHERE regexp_replace(original_text, '{STRIP}', '', 'g') <> '' GROUP BY batch)"""


@query(sql("""SELECT id, CASE WHEN id % 3 <> 0 THEN source_language WHEN len(regexp_extract_all(t, '[A-Za-z]')) > length(t) * 0.5 THEN 'en'
    ELSE 'auto' END AS source_language FROM segments LEFT JOIN firsts USING (batch)""", "segments", extra=FIRST))
def batch_source_language(d):
    asked = F.when(F.col("id") % 3 == 0, "auto").otherwise(F.col("source_language"))
    return X.batch_source_language(d.segments.withColumn("source_language", asked)).select("id", "source_language")


PAGE_TR = f"""pages_ctx AS (SELECT page_id, first(original_text ORDER BY reading_order, id) AS t FROM bubbles GROUP BY page_id),
langs AS (SELECT page_id, CASE WHEN len(regexp_extract_all(t, '[A-Za-z]')) > length(t) * 0.5 THEN 'en' ELSE 'auto' END AS lang FROM pages_ctx)"""


@query(sql(f"""SELECT id, reading_order, lang AS source_language, regexp_replace('en: ' || original_text, '^{STRIP}+|{STRIP}+$', '', 'g') AS translated_text,
    'google' AS translation_engine FROM bubbles JOIN langs USING (page_id)""", "bubbles", extra=PAGE_TR))
def translate_pages(d):
    done, _ = X.translate_pages(d.bubbles, d.memory, batch_provider(), now())
    return done.select("id", "reading_order", "source_language", "translated_text", "translation_engine")


@query(sql(f"SELECT id FROM segments WHERE id % 5 <> 0 AND regexp_replace(original_text, '{STRIP}', '', 'g') <> ''", "segments"))
def drop_blank_text(d):
    blanked = F.when(F.col("id") % 5 == 0, "　\n ").otherwise(F.col("original_text"))
    return X.drop_blank_text(d.segments.withColumn("original_text", blanked)).select("id")


@query(sql(f"SELECT key, created_at, ttl FROM memory WHERE {LIVE}", "memory"))
def purge_expired(d):
    return X.purge_expired(d.memory, now()).select("key", "created_at", "ttl")


@query(sql(f"SELECT key, created_at FROM memory WHERE {LIVE} ORDER BY created_at DESC, key, translated_text LIMIT 100", "memory"))
def preload_memory(d):
    return X.preload(d.memory, now()).select("key", "created_at")


@query(sql(f"""SELECT substring(key, 1, 80) AS key, {rounded('size / 1024.0::DOUBLE', 1)} AS size_kb,
    {rounded(f"(epoch_us(TIMESTAMP '{EPOCH}') - epoch_us(created_at)) / 1000000.0::DOUBLE", 1)} AS age_seconds, NOT {LIVE} AS expired
    FROM (SELECT * FROM memory ORDER BY accessed_at DESC, key DESC LIMIT 20)""", "memory"))
def recent_entries(d):
    return X.recent_entries(d.memory, now()).select("key", "size_kb", "age_seconds", "expired")


@query(sql("""SELECT cache, key, CAST(used_bytes AS BIGINT) AS used_bytes FROM (SELECT *, sum(size) OVER (PARTITION BY cache ORDER BY accessed_at DESC, key
    ROWS UNBOUNDED PRECEDING) AS used_bytes FROM (SELECT *, substring(key, 7, 1) AS cache FROM memory)) WHERE used_bytes <= 20000""", "memory"))
def retain_by_budget(d):
    entries = d.memory.withColumn("cache", F.substring("key", 7, 1))
    return X.retain_by_budget(entries, 20000).select("cache", "key", "used_bytes")


CACHES = ["ocr", "translation", "image", "detection"]
LOG = f"""log AS (SELECT {quoted(CACHES)}[CAST(user_id % 4 + 1 AS INTEGER)] AS cache, CASE event_type WHEN 'view' THEN 'hit' WHEN 'click' THEN 'miss'
    WHEN 'error' THEN 'eviction' WHEN 'signup' THEN 'restore' ELSE 'hit' END AS event FROM events),
held AS (SELECT {quoted(CACHES[:3])}[CAST(strlen(key) % 3 + 1 AS INTEGER)] AS cache, count(*) AS entries, sum(size) AS bytes FROM memory GROUP BY 1),
traffic AS (SELECT cache, count(*) FILTER (event IN ('hit', 'restore')) AS hits, count(*) FILTER (event = 'miss') AS misses,
    count(*) FILTER (event = 'eviction') AS evictions, count(*) FILTER (event = 'restore') AS restores FROM log GROUP BY 1)"""


@query(sql(f"""SELECT cache, coalesce(entries, 0) AS entries, {rounded('coalesce(bytes, 0) / 1048576.0::DOUBLE', 2)} AS memory_mb,
    {rounded('coalesce(bytes, 0) / 52428800.0::DOUBLE * 100', 1)} AS usage_percent, hits, misses,
    {rounded('hits::DOUBLE / (hits + misses) * 100', 1)} AS hit_rate_percent, evictions, restores
    FROM traffic LEFT JOIN held USING (cache)""", "memory", extra=LOG))
def cache_report(d):
    def pick(values, n):
        return F.element_at(F.array(*[F.lit(x) for x in values]), (n % len(values) + 1).cast("int"))

    kind = (F.when(F.col("event_type") == "click", "miss").when(F.col("event_type") == "error", "eviction")
            .when(F.col("event_type") == "signup", "restore").otherwise("hit"))
    log = d.table("events").select(pick(CACHES, F.col("user_id")).alias("cache"), kind.alias("event"))
    entries = d.memory.select(pick(CACHES[:3], F.octet_length("key")).alias("cache"), "size")
    return X.cache_report(log, entries, {c: 50 * 2**20 for c in CACHES})


@query(sql("SELECT key, created_at FROM memory WHERE key NOT IN (SELECT key FROM requests WHERE n > 1)", "segments", "memory", extra=REQUESTS))
def delete_keys(d):
    return X.delete_keys(d.memory, X.distinct_requests(d.segments).filter("n > 1")).select("key", "created_at")


@query(sql("""SELECT count(*) AS total_translations, CAST(sum(length(original_text)) AS BIGINT) AS total_chars, round(avg(length(batch)), 4) AS avg_time_ms,
    (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT batch AS k, count(*) AS n FROM segments GROUP BY 1)) AS by_engine,
    (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT source_language || '→' || target_language AS k, count(*) AS n FROM segments GROUP BY 1)) AS by_language_pair
    FROM segments""", "segments"))
def translation_stats(d):
    rows = d.segments.select(F.col("original_text").alias("translated_text"), F.col("batch").alias("engine"),
                             "source_language", "target_language", F.char_length("batch").alias("time_ms"))
    s = X.translation_stats(rows)
    return s.select("total_translations", "total_chars", F.round("avg_time_ms", 4).alias("avg_time_ms"),
                    flat(F.col("by_engine")).alias("by_engine"), flat(F.col("by_language_pair")).alias("by_language_pair"))


@query(sql("""SELECT page_id, 'ocr:' || sha256(html) || ':None:ja' AS key, count(*) OVER (PARTITION BY sha256(html)) AS copies FROM pages"""))
def duplicate_pages(d):
    return X.duplicate_pages(d.table("pages").select("page_id", F.encode("html", "utf-8").alias("content")))


@query(sql("SELECT doc_id, 'trans:' || md5(text) AS key, count(*) OVER (PARTITION BY text) AS copies FROM documents"))
def duplicate_texts(d):
    """The same duplicate count over document texts."""
    docs = d.table("documents").select("doc_id", F.encode("text", "utf-8").alias("content"), F.concat(F.lit("trans:"), F.md5("text")).alias("k"))
    return X.duplicate_pages(docs).select("doc_id", F.col("k").alias("key"), "copies")


@query(sql("SELECT key, from_memory FROM (SELECT key, l.key IS NOT NULL AS from_memory FROM requests LEFT JOIN (SELECT key FROM live) l USING (key))",
           "segments", "memory", extra=REQUESTS))
def compute_missing(d):
    """Known values come from memory, the rest from the given function."""
    def by_length(misses):
        return misses.withColumns({"translated_text": F.char_length("original_text").cast("string"),
                                   "confidence": F.lit(0.95), "engine": F.lit("length")})

    requests = X.distinct_requests(d.segments).select("key", "original_text")
    values, _ = X.compute_missing(requests, d.memory, now(), by_length)
    return values.select("key", "from_memory")
