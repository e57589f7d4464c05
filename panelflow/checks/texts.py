"""Queries of the text layer and of the text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow import schema
from panelflow.checks.base import STRIP, mean_sql, query, quoted, sql
from panelflow.functions import text as t
from panelflow.functions import values as v
from panelflow.operators import ocr as O
from panelflow.session import cut

SAMPLES = ["かな", "漢字", "한국어", "中한", "한中", "مرحبا", "สวัสดี", "Привет", "", "ệ", "λόγος", "  x  "]
SAMPLE_SQL = "['" + "', '".join(SAMPLES) + "']"
TEXTS = f"""texts AS (SELECT 2 * doc_id AS id, {SAMPLE_SQL}[CAST(doc_id % {len(SAMPLES)} + 1 AS INTEGER)]
    || text AS t FROM documents
  UNION ALL SELECT 2 * doc_id + 1, {SAMPLE_SQL}[CAST(doc_id % {len(SAMPLES)} + 1 AS INTEGER)] FROM documents)"""


def texts(d):
    """Documents in several scripts: every text after a sample, and the samples alone."""
    sample = F.element_at(F.array(*[F.lit(x) for x in SAMPLES]), (F.col("doc_id") % len(SAMPLES) + 1).cast("int"))
    docs = d.table("documents")
    return docs.select((2 * F.col("doc_id")).alias("id"), F.concat(sample, "text").alias("t")).unionByName(
        docs.select((2 * F.col("doc_id") + 1).alias("id"), sample.alias("t")))


def _n(rx: str) -> str:
    return f"len(regexp_extract_all(t, '{rx}'))"


def _script_sql() -> str:
    """Most characters, then first seen: compared as (count, -position)."""
    cols = ", ".join(f"{{'n': {_n(rx)}, 'first': -length(regexp_extract(t, '(?s)^(.*?){rx}', 1)), 'lang': '{lang}'}}"
                     for lang, rx in t.SCRIPTS.items())
    return f"""CASE WHEN regexp_replace(t, '{STRIP}', '', 'g') = '' THEN 'unknown' WHEN regexp_matches(t, '{t.KANA}') THEN 'ja'
      WHEN list_sort([{cols}])[-1].n > 0 THEN list_sort([{cols}])[-1].lang
      WHEN regexp_matches(regexp_replace(t, '[\\x{{00}}-\\x{{2AF}}]', '', 'g'), '\\p{{L}}') THEN 'unknown' ELSE 'en' END"""


@query(sql(f"SELECT id, {_script_sql()} AS lang FROM texts", extra=TEXTS))
def script_language(d):
    return texts(d).select("id", t.script_language(F.col("t")).alias("lang"))


@query(sql(f"""SELECT id, CASE WHEN regexp_matches(t, '{t.KANA}') THEN 'ja' {' '.join(
    f"WHEN regexp_matches(t, '{t.SCRIPTS[x]}') THEN '{x}'" for x in t.PRESENCE_ORDER)}
    WHEN {_n('[A-Za-z]')} > length(t) * 0.5 THEN 'en' ELSE 'unknown' END AS lang FROM texts""", extra=TEXTS))
def script_presence(d):
    return texts(d).select("id", t.script_presence(F.col("t")).alias("lang"))


@query(sql(f"""SELECT id, CASE WHEN tag IN ('unknown', 'japan') AND found <> 'unknown' THEN found ELSE tag END AS lang FROM
    (SELECT id, ['unknown', 'japan', 'fr'][CAST(id % 3 + 1 AS INTEGER)] AS tag, {_script_sql()} AS found FROM texts)""", extra=TEXTS))
def retag_language(d):
    tag = F.element_at(F.array(F.lit("unknown"), F.lit("japan"), F.lit("fr")), (F.col("id") % 3 + 1).cast("int"))
    return texts(d).select("id", t.retag_language(tag, F.col("t")).alias("lang"))


@query(sql(f"SELECT id, regexp_replace(x, '^{STRIP}+|{STRIP}+$', '', 'g') AS stripped, regexp_replace(x, '{STRIP}', '', 'g') <> '' AS has_text FROM "
           "(SELECT id, chr(12288) || ' ' || t || chr(160) || chr(10) AS x FROM texts)", extra=TEXTS))
def strip_text(d):
    padded = F.concat(F.lit("　 "), "t", F.lit(" \n"))
    return texts(d).select("id", t.strip(padded).alias("stripped"), t.has_text(padded).alias("has_text"))


NAMES = """names AS (SELECT page_id AS id, ['[Group] My Title ', 'My_Title_', '(x)', 'Chapter 3 of ', ''][CAST(page_id % 5 + 1 AS INTEGER)]
    || regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) || [' ch 12.5 (raw)', '_v03', ' Vol. 7', ''][CAST(page_id % 4 + 1 AS INTEGER)]
    || ['.cbz', '.ZIP', '.tar.gz', ''][CAST(page_id % 4 + 1 AS INTEGER)] AS name FROM pages)"""


def names(d):
    def pick(values, n):
        return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("page_id") % n + 1).cast("int"))

    last = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)$", 1)
    return d.table("pages").select(F.col("page_id").alias("id"), F.concat(
        pick(["[Group] My Title ", "My_Title_", "(x)", "Chapter 3 of ", ""], 5), last,
        pick([" ch 12.5 (raw)", "_v03", " Vol. 7", ""], 4), pick([".cbz", ".ZIP", ".tar.gz", ""], 4)).alias("name"))


STEM = r"regexp_replace(name, '^(.+)\.[^.]+$', '\1')"


@query(sql(rf"""SELECT id, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS ext, {STEM} AS stem,
    CAST(nullif(regexp_extract(name, '(?i)(?:ch|chapter|ch\.|vol|v)[.\s]*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS chapter,
    nullif(regexp_replace(trim(regexp_replace(regexp_replace({STEM}, '\s*[\[\(].*?[\]\)]\s*', ' ', 'g'),
      '(?i)(?:ch|chapter|vol|v)\s*\d+.*$', '', 'g')), '^[-_.]+|[-_.]+$', '', 'g'), '') AS title FROM names""", extra=NAMES))
def file_names(d):
    c = F.col("name")
    return names(d).select("id", t.extension(c).alias("ext"), t.stem(c).alias("stem"),
                           t.detected_chapter(c).alias("chapter"), t.detected_title(c).alias("title"))


LEADS = ["Translation: ", "Output:Result: ", "Translated:", "note ", "Here is the translation:\n"]


def _leads_sql() -> str:
    out = "x"
    for lead in t.LEAD_INS:
        out = f"regexp_replace({out}, '^{lead}{STRIP}*', '')"
    return f"regexp_replace({out}, '^{STRIP}+|{STRIP}+$', '', 'g')"


@query(sql(f"SELECT id, {_leads_sql()} AS clean FROM (SELECT id, ['Translation: ', 'Output:Result: ', 'Translated:', 'note ', "
           "'Here is the translation:' || chr(10)][CAST(id % 5 + 1 AS INTEGER)] || t AS x FROM texts)", extra=TEXTS))
def strip_prefixes(d):
    lead = F.element_at(F.array(*[F.lit(x) for x in LEADS]), (F.col("id") % 5 + 1).cast("int"))
    return texts(d).select("id", t.strip_prefixes(F.concat(lead, "t")).alias("clean"))


@query(sql("""SELECT id, CASE WHEN length(t) > 50 THEN substring(t, 1, 50) || '...' ELSE t END AS preview, substring(t, 1, 100) AS clip,
    replace(replace(substring(t, 1, 30), ' ', '_'), '/', '_') || '_' || substring(md5(t), 1, 8) || ['.pdf', '', '.cbz'][CAST(id % 3 + 1 AS INTEGER)] AS safe
    FROM texts""", extra=TEXTS))
def text_cuts(d):
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("png"), F.lit("cbz")), (F.col("id") % 3 + 1).cast("int"))
    return texts(d).select("id", t.preview(F.col("t")).alias("preview"), t.clip(F.col("t"), 100).alias("clip"),
                           t.safe_name(F.substring("t", 1, 30), F.md5("t"), kind).alias("safe"))


def _case(values: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in values.items()) + f" ELSE {default} END"


@query(sql(f"SELECT id, {_case(schema.MIME_TYPES, 'e', chr(39) + 'application/octet-stream' + chr(39))} AS mime, "
           f"{_case({k: x[1] for k, x in schema.EXPORT_FORMATS.items()}, 'substring(e, 2)', 'NULL')} AS export_mime "
           r"FROM (SELECT id, lower(regexp_extract(filename, '^.+(\.[^.]+)$', 1)) AS e FROM file_listing)", "file_listing"))
def mime_types(d):
    ext = t.extension(F.col("filename"))
    return d.file_listing.select("id", t.mime_type(ext).alias("mime"),
                                 t.export_mime(F.substring(ext, 2, 10)).alias("export_mime"))


@query(sql(f"SELECT id, {_case(schema.STATUS_ACTIONS, 's', chr(39) + 'updated' + chr(39))} AS action FROM "
           f"(SELECT id, {quoted(schema.JOB_STATUSES)}"
           "[CAST(id % 7 + 1 AS INTEGER)] AS s FROM chapters)", "chapters"))
def status_actions(d):
    s = F.element_at(F.array(*[F.lit(x) for x in schema.JOB_STATUSES]), (F.col("id") % 7 + 1).cast("int"))
    return d.chapters.select("id", t.status_action(s).alias("action"))


ENGINES = ["paddleocr", "easyocr", "tesseract", "nllb", "m2m100", "argos", "deepl"]
ENGINES_SQL = "['" + "', '".join(ENGINES) + "']"


def _language_sql() -> str:
    codes = {**schema.OCR_LANGUAGES, **schema.TRANSLATOR_LANGUAGES}
    whens = " ".join(
        f"WHEN '{e}' THEN " + (_case(m, "iso", f"'{schema.LANGUAGE_DEFAULTS[e]}'" if e in schema.LANGUAGE_DEFAULTS else "iso") if m else "iso")
        for e, m in codes.items())
    return f"CASE engine {whens} END"


MARIAN_SQL = f"""CASE WHEN (iso IN {tuple(schema.MARIAN_SOURCES_TO_ENGLISH)} AND target = 'en') OR (iso = 'en' AND target IN {tuple(schema.MARIAN_TARGETS_FROM_ENGLISH)})
  OR (iso = 'ja' AND target = 'zh') THEN 'Helsinki-NLP/opus-mt-' || iso || '-' || target END"""


@query(sql(f"SELECT id, {_language_sql()} AS code, {MARIAN_SQL} AS model FROM (SELECT id, {ENGINES_SQL}[CAST(id % 7 + 1 AS INTEGER)] AS engine, "
           "source_language AS iso, target_language AS target FROM jobs)", "jobs"))
def engine_languages(d):
    e = F.element_at(F.array(*[F.lit(x) for x in ENGINES]), (F.col("id") % 7 + 1).cast("int"))
    return d.jobs.select("id", t.map_language(e, F.col("source_language")).alias("code"),
                         t.marian_model(F.col("source_language"), F.col("target_language")).alias("model"))


@query(sql("""SELECT id, 'trans:' || md5(t) || ':de:en' || CASE WHEN c <> '' THEN ':ctx=' || substring(md5(c), 1, 16) ELSE '' END AS key,
    'k:' || CASE WHEN length(replace(t, chr(10), '')) > 500 THEN md5(t) ELSE replace(replace(t, chr(10), ''), chr(13), '') END AS stored,
    CAST(strlen(t) AS BIGINT) AS size, CAST(strlen(t) + strlen(c) + 128 AS BIGINT) AS map_size, CAST(strlen(t) + 8 AS BIGINT) AS list_size
    FROM (SELECT id, t, CASE WHEN id % 2 = 0 THEN '' ELSE 'ctx' END AS c FROM texts)""", extra=TEXTS))
def request_keys(d):
    c = F.when(F.col("id") % 2 == 0, "").otherwise("ctx")
    rows = texts(d).withColumn("c", c)
    return rows.select(
        "id", t.request_key(F.col("t"), F.lit("de"), F.lit("en"), F.col("c")).alias("key"),
        t.stored_key(F.col("t"), "k:").alias("stored"), t.size_estimate(F.col("t")).alias("size"),
        t.size_estimate(F.create_map(F.lit("a"), "t", F.lit("b"), "c"), "map").alias("map_size"),
        t.size_estimate(F.array("t"), "array").alias("list_size"))


@query(sql("SELECT id, CASE WHEN completed_at IS NOT NULL THEN CAST(epoch_us(completed_at) - epoch_us(started_at) AS DOUBLE) / 1000 END AS ms FROM jobs", "jobs"))
def elapsed_ms(d):
    return d.jobs.select("id", v.elapsed_ms(F.col("started_at"), F.col("completed_at")).alias("ms"))


@query(sql("""SELECT id, trim(text) AS text, greatest(0.0, least(1.0, coalesce(TRY_CAST(conf AS DOUBLE) / 100, 0))) AS confidence FROM
    (SELECT l_orderkey AS id, p_name AS text, CASE WHEN l_linenumber = 1 THEN '-1' WHEN l_linenumber = 2 THEN 'n/a'
      ELSE CAST(CAST(l_quantity AS INTEGER) * 3 AS VARCHAR) END AS conf FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE conf <> '-1'"""))
def normalize_confidence(d):
    conf = (F.when(F.col("l_linenumber") == 1, "-1").when(F.col("l_linenumber") == 2, "n/a")
            .otherwise((F.col("l_quantity").cast("int") * 3).cast("string")))
    rows = d.table("lineitem").join(d.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("id"), F.col("p_name").alias("text"), conf.alias("conf"))
    return O.normalize_confidence(rows)


# Greedy choice in SQL, as in the region queries; drop only.
SHARE = """(CASE WHEN least(k.x + k.w, r.x + r.w) > greatest(k.x, r.x) AND least(k.y + k.h, r.y + r.h) > greatest(k.y, r.y)
 THEN (least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * (least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y))
 / least(k.w * k.h, r.w * r.h) ELSE 0 END)"""
ROW = ("STRUCT(o DOUBLE, rk INTEGER, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, text VARCHAR, rotation DOUBLE, engine VARCHAR, "
       "confidence DOUBLE)")
BEST = f"""lists AS (SELECT page_id, list_sort(list(CAST({{'o': -confidence, 'rk': CASE engine WHEN 'paddleocr' THEN 1 WHEN 'easyocr' THEN 2 ELSE 3 END,
  'x': x, 'y': y, 'w': w, 'h': h, 'text': text, 'rotation': rotation, 'engine': engine, 'confidence': confidence}} AS {ROW}))) AS rows
  FROM ocr_regions GROUP BY page_id),
best AS (SELECT page_id, unnest(list_reduce(rows, lambda acc, r: CASE WHEN len(list_filter(acc, lambda k: {SHARE} > 0.5)) = 0
  THEN list_append(acc, r) ELSE acc END, CAST([] AS {ROW}[])), recursive := true) FROM lists)"""


@query(sql("SELECT page_id, -1 AS region_index, engine, confidence, x, y, w, h, text, 'en' AS language, rotation FROM best", "ocr_regions", extra=BEST))
def best_ocr(d):
    return O.best_ocr(d.ocr_regions)


@query(sql(f"""SELECT page_id, -1 AS region_index, string_agg(text, chr(10) ORDER BY y, x, confidence DESC, CASE engine WHEN 'paddleocr' THEN 1 WHEN 'easyocr' THEN 2 ELSE 3 END, text, rotation) AS text,
    {mean_sql("confidence", 4)} AS confidence, first(rotation ORDER BY y, x, confidence DESC, CASE engine WHEN 'paddleocr' THEN 1 WHEN 'easyocr' THEN 2 ELSE 3 END, text, rotation) AS rotation,
    least(count(*), 100) AS region_count FROM best GROUP BY page_id""", "ocr_regions", extra=BEST))
def call_text(d):
    return O.call_text(cut(O.best_ocr(d.ocr_regions)))


@query(sql("""SELECT page_id, -1 AS region_index, text, x, y FROM best
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY y, x, confidence DESC, CASE engine WHEN 'paddleocr' THEN 1 WHEN 'easyocr' THEN 2 ELSE 3 END, text) <= 2""", "ocr_regions", extra=BEST))
def cap_ocr_results(d):
    return O.cap_results(O.best_ocr(d.ocr_regions), 2).select("page_id", "region_index", "text", "x", "y")


@query(sql("""SELECT page_id, -1 AS region_index, engine, score FROM (SELECT page_id, engine, round_even(sum(confidence), 6) AS score
    FROM ocr_regions GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC,
    CASE engine WHEN 'paddleocr' THEN 1 WHEN 'easyocr' THEN 2 ELSE 3 END) = 1""", "ocr_regions"))
def best_engine(d):
    return O.best_engine(d.ocr_regions.withColumn("region_index", F.lit(-1)))


@query(sql("""SELECT count(DISTINCT page_id) AS total_pages, CAST(sum(n) AS BIGINT) AS total_regions, CAST(sum(n) AS DOUBLE) * 2 AS total_time_ms,
    (SELECT string_agg(engine, ',' ORDER BY engine) FROM (SELECT DISTINCT engine FROM ocr_regions)) AS engines_used
    FROM (SELECT page_id, engine, count(*) AS n FROM ocr_regions GROUP BY ALL)""", "ocr_regions"))
def ocr_batch_summary(d):
    calls = d.ocr_regions.groupBy("page_id", "engine").agg(F.count("*").alias("region_count"))
    s = O.ocr_batch_summary(calls.withColumn("time_ms", F.col("region_count") * 2.0))
    return s.withColumn("engines_used", F.array_join("engines_used", ","))
