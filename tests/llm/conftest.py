import pytest
from pyspark.sql import types as T
from sample_texts import prose

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("original_text", T.StringType()),
    T.StructField("source_language", T.StringType()), T.StructField("project_id", T.StringType()),
    # Columns of the library's other tables and of operators' results, which must not matter.
    T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()),
    T.StructField("fingerprint", T.LongType()), T.StructField("size", T.DoubleType()),
])


@pytest.fixture(scope="session")
def make(spark):
    """Segments from (id, text, language, project) tuples, with clashing extra columns."""
    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), "other", 7, "k", 9, 1.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long_line = prose(5, 4000)
    return [(1, prose(1), "en", "a"), (2, prose(2), "fr", "a"), (3, prose(1), "en", "b"), (4, None, "fr", None), (5, "", None, "b"),
            (6, long_line, "en", "a"), (6, long_line, "en", "a"), (None, prose(3), "fr", "b"), (None, None, None, None),
            (8, "   \n\t ", "en", "a"), (9, "12 !? 34", "fr", "c"), (10, "a" * 5000, "en", "c"), (11, prose(2) + " " + prose(4), "fr", "a")]
