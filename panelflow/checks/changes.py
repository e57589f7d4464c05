"""Queries of change tables, compared with the plain meaning of the change."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.checks.base import now, query, sql
from panelflow.checks.catalog import CASCADE_SQL, GONE, UPDATES_SQL, _catalog, listed, project_updates
from panelflow.session import scratch_path
from panelflow.sources.changes import ChangeTable, delete_projects


def _stored(d, *names):
    root = scratch_path(d.spark, "changes")
    tables = {n: ChangeTable(d.spark, root, n) for n in names}
    for name, df in _catalog(d).items():
        if name in tables:
            tables[name].append(df)
    return tables


@query(sql(CASCADE_SQL, "projects", "chapters", "page_rows", "bubbles", "jobs", extra=GONE))
def changed_cascade(d):
    """A cascade that writes bitmaps of deleted rows, read back."""
    tables = _stored(d, "projects", "chapters", "pages", "bubbles", "segments", "jobs")
    delete_projects(tables, d.projects.filter("id % 10 = 3"), d.chapters.filter("id % 50 = 1"), now())
    return listed({n: t.load() for n, t in tables.items()})


@query(sql(UPDATES_SQL, "projects"))
def changed_updates(d):
    """Two changes after another: every third project, in two halves."""
    table = _stored(d, "projects")["projects"]
    for half in (0, 1):
        table.update(project_updates(d).filter(F.col("id") % 2 == half), "id", now())
    return table.load().select("id", "title", "author", "updated_at")


@query(sql("""SELECT 0 AS version, id FROM projects UNION ALL SELECT 1, id FROM projects WHERE id % 10 <> 3
    UNION ALL SELECT 2, id FROM projects WHERE id % 10 <> 3 UNION ALL SELECT 2, -id FROM projects WHERE id % 100 = 1
    UNION ALL SELECT 3, id FROM projects WHERE id % 10 <> 3 UNION ALL SELECT 3, -id FROM projects WHERE id % 100 = 1""", "projects"))
def changed_versions(d):
    """Every version of a table that lost and gained rows and was compacted."""
    table = _stored(d, "projects")["projects"]
    table.delete(d.projects.filter("id % 10 = 3"))
    table.append(table.load(0).filter("id % 100 = 1").withColumn("id", -F.col("id")))
    table.compact()
    out = None
    for version in range(table.version() + 1):
        rows = table.load(version).select(F.lit(version).alias("version"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out
