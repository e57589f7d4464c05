"""Pages from an order-statistics index equal those of a plain sort."""

import pytest
from pyspark.sql import functions as F

from panelflow.operators.paging import listing_info, listing_page, write_listing


def test_deep_pages_equal_the_plain_sort(spark, tmp_path):
    # Two thirds of the rows share one time, and some times are null.
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(999))).when(F.col("id") % 50 != 1, 7).alias("t"))
    order = [F.col("t").desc(), F.col("id").desc()]
    write_listing(rows, order, str(tmp_path), ranges=40)
    plain = [r["id"] for r in rows.orderBy(*order).collect()]
    for limit, offset in ((20, 0), (20, 20), (50, 9_990), (3_000, 14_321), (20, 29_990), (20, 30_000), (20, 10**9)):
        page = listing_page(spark, str(tmp_path), limit, offset)
        assert page.columns == ["id", "t"] and [r["id"] for r in page.collect()] == plain[offset:offset + limit]
    info = listing_info(spark, str(tmp_path), 20, 29_980).first()
    assert (info["total"], info["has_more"]) == (30_000, False) and listing_info(spark, str(tmp_path), 20, 29_979).first()["has_more"]
    read = listing_page(spark, str(tmp_path), 20, 20_000)
    sizes = spark.read.parquet(f"{tmp_path}/ranges")
    assert sizes.count() == 40 and sizes.agg(F.max("n")).first()[0] < 2_000
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "range#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_small_and_empty_listings(spark, tmp_path):
    write_listing(spark.range(3), [F.col("id")], f"{tmp_path}/a", ranges=16)
    assert [r[0] for r in listing_page(spark, f"{tmp_path}/a", 2, 1).collect()] == [1, 2]
    with pytest.raises(ValueError):
        listing_page(spark, f"{tmp_path}/a", 0)
