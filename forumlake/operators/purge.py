"""Cascading purge along the foreign-key graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.schema import FOREIGN_KEYS, primary_key
from forumlake.session import freeze
from forumlake.sources.tables import Tables

CASCADE = "cascade"


def reach(root: str) -> list[str]:
    """Tables a delete in `root` can touch by cascade, parents before children."""
    children: dict[str, set[str]] = {}
    for fk in FOREIGN_KEYS:
        if fk.on_delete == CASCADE and fk.parent != fk.table:
            children.setdefault(fk.parent, set()).add(fk.table)
    ordered: list[str] = []

    def visit(table: str) -> None:
        for child in sorted(children.get(table, ())):
            visit(child)
        if table not in ordered:
            ordered.insert(0, table)

    visit(root)
    return ordered


def _marked(rows: DataFrame, column: str, dead: DataFrame, flag: str) -> DataFrame:
    """Adds `flag`, NULL unless `column` refers to a doomed row."""
    return rows.join(dead.selectExpr(f"id AS {flag}"), F.expr(f"{column} = {flag}"), "left")


def _with_replies(tables: Tables, table: str, gone: DataFrame) -> DataFrame:
    """Adds rows that refer to doomed rows of the same table; threads have two levels."""
    for fk in FOREIGN_KEYS:
        if fk.table == table == fk.parent:
            replies = tables[table].select("id", F.col(fk.column).alias("_up"))
            parents = gone.select(F.col("id").alias("_up"))
            gone = gone.unionByName(replies.join(parents, "_up", "left_semi").select("id")).distinct()
    return gone


def doomed_rows(tables: Tables, root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Ids (distinct, column `id`) that go when `ids` of `root` are deleted, per table.

    Id sets that several children read are frozen, so they are found once.
    """
    inner = {fk.parent for fk in FOREIGN_KEYS}
    doomed = {root: _with_replies(tables, root, ids.select("id").distinct())}
    for table in reach(root):
        if table != root:
            links = [
                fk for fk in FOREIGN_KEYS
                if fk.table == table and fk.on_delete == CASCADE and fk.parent in doomed and fk.parent != table
            ]
            rows = tables[table].select("id", *dict.fromkeys(fk.column for fk in links))
            for i, fk in enumerate(links):
                rows = _marked(rows, fk.column, doomed[fk.parent], f"_dead{i}")
            dead = " OR ".join(f"_dead{i} IS NOT NULL" for i in range(len(links)))
            gone = rows.where(dead).select("id")
            doomed[table] = _with_replies(tables, table, gone)
        if table in inner:
            doomed[table] = freeze(doomed[table])
    return doomed


def purge(tables: Tables, root: str, ids: DataFrame) -> Tables:
    """Tables after deleting `ids` from `root`: children go along, `set null` links are cleared."""
    doomed = doomed_rows(tables, root, ids)
    after = dict(tables)
    for table, gone in doomed.items():
        after[table] = tables[table].join(gone, primary_key(table), "left_anti").select(*tables[table].columns)
    for fk in FOREIGN_KEYS:
        if fk.on_delete == CASCADE or fk.parent not in doomed:
            continue
        kept = after[fk.table] if fk.table in after else tables[fk.table]
        rows = _marked(kept, fk.column, doomed[fk.parent], "_cut")
        after[fk.table] = rows.selectExpr(
            *[f"IF(_cut IS NULL, {c}, NULL) AS {c}" if c == fk.column else c for c in kept.columns]
        )
    return after


def purge_report(tables: Tables, root: str, ids: DataFrame) -> DataFrame:
    """(table_name, removed_rows) for a delete that is only planned."""
    doomed = doomed_rows(tables, root, ids)
    names = ", ".join(f"('{table}', 0L)" for table in doomed)
    rows = ids.sparkSession.sql(f"SELECT * FROM VALUES {names} AS t(table_name, removed_rows)")
    for table, gone in doomed.items():
        rows = rows.unionByName(gone.selectExpr(f"'{table}' AS table_name", "1L AS removed_rows"))
    return rows.groupBy("table_name").agg(F.sum("removed_rows").alias("removed_rows"))
