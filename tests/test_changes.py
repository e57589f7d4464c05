"""Change tables: deletion bitmaps, versions, writers that meet."""

import os

import pytest
from pyspark.sql import functions as F

from panelflow.checks.base import now
from panelflow.sources.changes import ChangeTable, Conflict


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200_000).select("id", F.md5(F.col("id").cast("string")).alias("title"), (F.col("id") % 7).alias("author"))
    t = ChangeTable(spark, str(tmp_path), "projects")
    assert t.version() is None and t.append(rows.repartition(5)) == 0
    return t


def test_deleting_writes_little_and_old_versions_stay(spark, table):
    before = size(table.path)
    assert table.delete(spark.range(0, 200_000, 100)) == 1
    assert size(table.path) - before < 0.03 * before
    assert table.load().count() == 198_000 and table.load().filter("id % 100 = 0").isEmpty()
    assert table.delete(spark.range(0, 200_000, 100)) is None
    # Rows 0, 1, 32767, 32768 and the last of files and buckets are no special cases.
    held = table.load().select("id").orderBy("id").limit(1).first()[0]
    assert table.delete(spark.createDataFrame([(held,), (199_999,), (32_769,)], "id long")) == 2
    assert table.load().count() == 197_997
    assert [table.load(v).count() for v in (0, 1, 2)] == [200_000, 198_000, 197_997]
    assert table.compact() == 3 and table.state()["deletes"] == []
    assert sorted(r[0] for r in table.load().select("id").collect()) == sorted(r[0] for r in table.load(2).select("id").collect())


def test_every_row_can_be_deleted_one_by_one(spark, tmp_path):
    t = ChangeTable(spark, str(tmp_path), "pages")
    t.append(spark.range(70_000).coalesce(1))
    gone = [0, 1, 2, 7, 8, 9, 32766, 32767, 32768, 32769, 65535, 65536, 65537, 69999]
    for some in (gone[:7], gone[7:]):
        t.delete(spark.createDataFrame([(g,) for g in some], "id long"))
    left = {r[0] for r in t.load().collect()}
    assert left == set(range(70_000)) - set(gone)


def test_updates_touch_their_rows_only(spark, table):
    before = size(table.path)
    updates = spark.createDataFrame([(5, "five", None), (6, None, ["author"]), (-1, "nobody", None)], "id long, title string, cleared array<string>")
    updates = updates.withColumn("author", F.lit(None).cast("long"))
    assert table.update(updates, "id", now()) == 1
    assert size(table.path) - before < 0.05 * before
    got = {r["id"]: (r["title"], r["author"]) for r in table.load().filter("id IN (5, 6, 7)").collect()}
    assert got[5] == ("five", 5) and got[6][1] is None and got[7][1] == 0 and table.load().count() == 200_000
    assert table.load(0).filter("id = 5").first()["author"] == 5
    assert table.update(updates.filter("id < 0"), "id", now()) is None


def test_of_two_writers_one_succeeds(spark, table):
    mine, theirs = table.state(), ChangeTable(spark, os.path.dirname(table.path), "projects").state()
    assert table.delete(spark.range(10), base=mine) == 1
    with pytest.raises(Conflict):
        table.delete(spark.range(10, 20), base=theirs)
    assert table.load().filter("id < 20").count() == 10 and table.version() == 1
    assert table.delete(spark.range(10, 20)) == 2
    # An append that lost the race is published after the winner.
    real, once = table.state, [mine]
    table.state = lambda version=None: once.pop() if once else real(version)
    assert table.append(spark.createDataFrame([(1, "back", 1)], "id long, title string, author long")) == 3
    assert table.load().filter("id < 20").count() == 1


def test_tables_without_rows(spark, tmp_path):
    t = ChangeTable(spark, str(tmp_path), "chapters")
    t.append(spark.createDataFrame([], "id long, title string"))
    assert t.load().collect() == [] and t.delete(spark.range(3)) is None
    t.append(spark.createDataFrame([(1, "a")], "id long, title string"))
    assert t.delete(spark.range(3)) == 2 and t.load().collect() == [] and t.load(1).count() == 1


def test_writers_that_meet_keep_their_own_versions(spark, tmp_path):
    from panelflow.sources.tables import CatalogStore
    stores = [CatalogStore(spark, str(tmp_path)) for _ in range(2)]
    seen = stores[0]._versions
    for s in stores:
        s._versions = lambda table: []  # both have read the folder before either wrote
    paths = [s.save(spark.range(k + 1), "kept") for k, s in enumerate(stores)]
    assert len(set(paths)) == 2 and [spark.read.parquet(p).count() for p in paths] == [1, 2]
    assert seen("kept") == [0, 1] and CatalogStore(spark, str(tmp_path)).save(spark.range(9), "kept").endswith("v00000002")
