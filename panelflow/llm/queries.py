"""The numbered queries: given tables to the operators' segments and back, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(statement: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if statement:
            SQL[fn.__name__] = statement
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def segments_of(documents: DataFrame) -> DataFrame:
    """Documents as segments: the source is the project they belong to."""
    return documents.select(F.col("doc_id").alias("id"), F.col("text").alias("original_text"),
                            F.col("lang").alias("source_language"), F.col("source").alias("project_id"))


def remainder(id: str, n: int) -> Column:
    return F.crc32(F.col(id).cast("string")) % n


@_query()
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.quality import rank_quality
    labels = _table(spark, folder, "labels").filter(remainder("doc_id", 4) != 2).withColumnRenamed("doc_id", "id")
    scored = rank_quality(segments_of(_table(spark, folder, "documents")), labels)
    return scored.select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "score", "predicted",
                         "strength")


@_query()
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.near import near_duplicates
    found = near_duplicates(segments_of(_table(spark, folder, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        "component_id")


@_query()
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from panelflow.llm.packing import pack_segments
    packed = pack_segments(segments_of(_table(spark, folder, "documents")), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("token_ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


_MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM docs GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((source_rank - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 3 AS cap FROM sources),
levels AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source_rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source_rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
targets AS (
  SELECT source, source_size, source_rank,
    least(CAST(cap AS DOUBLE), max(CASE WHEN level <= ratio THEN level END) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT d.*, t.source_size, t.source_rank, t.target,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT doc_id, size, CAST(turn * source_size + run AS DOUBLE) / target AS time, source_rank, key
  FROM placed, range(3) r(turn) WHERE size > 0 AND target > 0),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY time, source_rank, key ROWS UNBOUNDED PRECEDING) AS queued FROM turns),
took AS (
  SELECT doc_id, sum(size) AS taken FROM queue
  WHERE queued <= (SELECT sum(size) FROM docs) GROUP BY doc_id)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, p.source_size, p.target,
  CAST(coalesce(t.taken, 0) AS BIGINT) AS taken FROM placed p LEFT JOIN took t ON p.doc_id IS NOT DISTINCT FROM t.doc_id
"""


@_query(_MIX_SQL)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.mixing import mix_sources
    mixed = mix_sources(segments_of(_table(spark, folder, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@_query()
def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.repeats import remove_repeats
    found = remove_repeats(segments_of(_table(spark, folder, "documents")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query()
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.fingerprint import edited_fingerprints
    found = edited_fingerprints(segments_of(_table(spark, folder, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                        F.lower(F.hex("fingerprint")).alias("fingerprint"),
                        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@_query()
def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.neighbours import nearest
    found = nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, id="vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@_query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.toxicity import rate_toxicity
    labels = _table(spark, folder, "labels").filter(remainder("doc_id", 3) != 1).withColumnRenamed("doc_id", "id")
    rated = rate_toxicity(segments_of(_table(spark, folder, "documents")), labels, text="original_text")
    return rated.select(F.col("id").alias("doc_id"), (remainder("id", 3) == 1).alias("held_out"), "score", "predicted", "margin")


@_query()
def op1_languages(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.language import label_languages
    labelled = label_languages(segments_of(_table(spark, folder, "documents")), remainder("id", 4) != 2)
    return labelled.select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"),
                           F.col("language").alias("lang_pred"), "score", "words", F.size("runs").alias("n_runs"))


def _licence_sql() -> str:
    from panelflow.llm.licences import LEAST, TEMPLATES
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    grams = ("list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))")
    words = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"
    return rf"""
WITH templates AS (SELECT name, {grams} AS own FROM (
    SELECT name, {words.format('body')} AS w FROM (VALUES {rows}) t(name, body))),
passages AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[\r\n]+')) AS passage FROM documents
  UNION ALL SELECT doc_id, passage FROM (
    SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\r?\n([ \t\x0B\x0C\r]*\n)+')), E'\r\n') AS passage FROM documents)
  WHERE regexp_matches(passage, '[^\s][ \t\x0B\x0C\r]*\n[^\n]*[^\s]')),
sized AS (SELECT doc_id, passage, {grams} AS grams FROM (SELECT doc_id, passage, {words.format('passage')} AS w FROM passages) WHERE len(w) >= 2),
compared AS (
  SELECT doc_id, passage, name, 2.0::DOUBLE * len(list_intersect(grams, own)) / (len(grams) + len(own)) AS dice
  FROM sized JOIN templates ON list_has_any(grams, own))
SELECT doc_id, CAST(strlen(passage) AS BIGINT) AS length, passage, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice
FROM (SELECT *, row_number() OVER () AS n FROM compared WHERE dice >= {LEAST}) GROUP BY doc_id, passage
"""


@_query(_licence_sql())
def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.licences import scan_licences
    found = scan_licences(segments_of(_table(spark, folder, "documents")))
    return found.select(F.col("id").alias("doc_id"), "length", "passage", "licence", "dice").distinct()


@_query()
def op13_similar(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.setsketch import similar_segments
    found = similar_segments(segments_of(_table(spark, folder, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@_query()
def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.turns import damage, repair_conversations
    turns = _table(spark, folder, "conversations")
    return repair_conversations(damage(turns), originals=turns)


_SHIFTED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


@_query()
def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from panelflow.llm.negatives import mine_negatives
    vectors = _table(spark, folder, "embeddings").withColumn("label", F.expr(_SHIFTED))
    return mine_negatives(vectors, F.col("vec_id") % 100 == 0, id="vec_id")
