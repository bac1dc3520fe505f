"""Integrity rules as data-quality jobs over whole tables.

Every check reports a count, also when it is 0, so a run is a full protocol.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.schema import ENUMS, FOREIGN_KEYS, SYSTEM_ACTOR, TABLES, UNIQUE_KEYS, primary_key
from forumlake.sources.tables import Tables


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def column_rules(table: str, present: Iterable[str]) -> dict[str, Column]:
    """Condition of a violation per rule name, for the columns a frame has."""
    present = set(present)
    rules = {}
    for column in TABLES[table]:
        if column.name not in present:
            continue
        value = F.col(column.name)
        if column.required:
            rules[f"{column.name} not null"] = value.isNull()
        if column.length:
            rules[f"{column.name} length <= {column.length}"] = F.length(value.cast("string")) > column.length
        if column.enum:
            rules[f"{column.name} in {column.enum}"] = ~value.isin(*ENUMS[column.enum])
    return rules


def _protocol(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over the table: all rules counted together, then one row per rule."""
    names = list(rules)
    counts = df.agg(*[F.count_if(rules[name]).alias(f"r{i}") for i, name in enumerate(names)])
    rows = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(names)]
    )
    return counts.select(F.lit(table).alias("table_name"), F.inline(rows))


def audit_domains(tables: Tables, names: Iterable[str] = TABLES) -> DataFrame:
    """Not-null, length and enum rules: (table_name, rule, violations)."""
    return _union(_protocol(tables[n], n, column_rules(n, tables[n].columns)) for n in names)


def tally(found: DataFrame, labels: dict[str, list[str]], counts: list[str]) -> DataFrame:
    """Sum the counts of the findings per label; labels without any show 0."""
    zeros = ", ".join(f"({', '.join(map(repr, label))}, {', '.join('0L' for _ in counts)})" for label in zip(*labels.values()))
    rows = found.sparkSession.sql(f"SELECT * FROM VALUES {zeros} AS t({', '.join([*labels, *counts])})")
    return rows.unionByName(found).groupBy(*labels).agg(*[F.sum(c).alias(c) for c in counts])


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def key_names(table: str) -> dict[str, tuple[str, ...]]:
    """Columns of the primary and unique keys by their names."""
    keys = [(primary_key(table),)] + ([UNIQUE_KEYS[table]] if table in UNIQUE_KEYS else [])
    return {", ".join(key): key for key in keys}


def key_texts(table: str) -> dict[str, list[Column]]:
    """Values of the primary and unique keys, as text, by their names."""
    return {name: [_text(column) for column in key] for name, key in key_names(table).items()}


def key_columns(table: str) -> dict[str, Column]:
    """The same, an array each."""
    return {name: F.array(*texts) for name, texts in key_texts(table).items()}


def key_labels(names: Iterable[str]) -> dict[str, list[str]]:
    pairs = [(name, key) for name in names for key in key_columns(name)]
    return {"table_name": [name for name, _ in pairs], "key": [key for _, key in pairs]}


def audit_unique(tables: Tables, names: Iterable[str] = TABLES) -> DataFrame:
    """Primary and unique keys: (table_name, key, repeated_keys, surplus_rows).

    Each table is scanned once for all its keys. Rows with a NULL in the key do not compete.
    A value is counted under the number of its key, as nearly every value is a group of its own.
    """
    names = list(names)
    labels = key_labels(names)
    numbers = {label: n for n, label in enumerate(zip(*labels.values()))}
    parts = []
    for name in names:
        values = [
            F.struct(F.lit(numbers[name, key]).alias("_key"), value.alias("_value")) for key, value in key_columns(name).items()
        ]
        parts.append(tables[name].select(F.inline(F.array(*values))))
    present = _union(parts).where(F.forall("_value", F.isnotnull))
    repeated = present.groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    label = [F.get(F.array(*map(F.lit, texts)), "_key").alias(column) for column, texts in labels.items()]
    found = repeated.select(*label, F.lit(1).cast("bigint").alias("repeated_keys"), (F.col("_n") - 1).alias("surplus_rows"))
    return tally(found, labels, ["repeated_keys", "surplus_rows"])


def reference_columns(table: str) -> dict[tuple[str, str], Column]:
    """Values of the foreign keys, as text, by label and parent."""
    values = {}
    for fk in (fk for fk in FOREIGN_KEYS if fk.table == table):
        value = _text(fk.column)
        if (fk.table, fk.column) == ("moderation_logs", "moderator_id"):
            value = F.when(F.col(fk.column) != SYSTEM_ACTOR, value)  # reserved actor, never a row
        values[(f"{fk.column} -> {fk.parent}", fk.parent)] = value
    return values


def reference_labels(names: Iterable[str]) -> dict[str, list[str]]:
    pairs = [(name, label) for name in names for label, _ in reference_columns(name)]
    return {"table_name": [name for name, _ in pairs], "reference": [label for _, label in pairs]}


def audit_references(tables: Tables, names: Iterable[str] = TABLES) -> DataFrame:
    """Foreign keys: (table_name, reference, orphan_rows). NULL keys refer to nothing.

    Each table is scanned once for all its references, and once more if others refer to
    it. Children are reduced to their distinct keys with row counts before they meet the
    parents, so a hot parent is one row in the join.
    """
    names = list(names)
    parts, parents = [], {}
    for name in names:
        if columns := reference_columns(name):
            values = [
                F.struct(F.lit(label).alias("reference"), F.lit(parent).alias("_parent"), value.alias("_ref"))
                for (label, parent), value in columns.items()
            ]
            parts.append(tables[name].select(F.lit(name).alias("table_name"), F.inline(F.array(*values))))
            parents.update({parent: None for _, parent in columns})
    used = _union(parts).where(F.col("_ref").isNotNull())
    used = used.groupBy("table_name", "reference", "_parent", "_ref").agg(F.count(F.lit(1)).alias("orphan_rows"))
    there = _union(tables[name].select(F.lit(name).alias("_parent"), _text("id").alias("_ref")) for name in parents)
    found = used.join(there, ["_parent", "_ref"], "left_anti").select("table_name", "reference", "orphan_rows")
    return tally(found, reference_labels(names), ["orphan_rows"])


def row_rules() -> dict[str, Column]:
    """Rules over several columns of posts."""
    return {"confession has school_id": (F.col("post_type") == "confession") & F.col("school_id").isNull()}


def audit_checks(tables: Tables) -> DataFrame:
    """Row checks: a confession needs a school."""
    return _protocol(tables["posts"], "posts", row_rules())
