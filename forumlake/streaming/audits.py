"""Audits kept up to date by batches of changed rows.

Violations of single rows add up. Keys and references do not, but what one value is worth
does: a key's surplus follows from how many rows carry the value, an orphan from how many
rows refer to a value and whether a parent has it. Per value the signed row counts are kept,
and per rule the sum of what the values are worth. A value of a primary key that others refer
to is one row: how many rows have it and, by reference, how many refer to it, so a batch is
grouped once for keys and references together. A batch reads its own rows once and the
buckets of the values they carry, and adds the difference that these make; the tables are
not read again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from forumlake.operators.audit import (
    column_rules, key_labels, key_names, key_texts, reference_columns, reference_labels, row_rules, tally,
)
from forumlake.schema import FOREIGN_KEYS, TABLES, primary_key
from forumlake.streaming.segments import BUCKETS, FOLD, Notes, Segments

DOMAIN, ROW, KEY, REFERENCE = "domain", "row", "key", "reference"
RULES = ""  # the key of rows that count broken rules; their value is the set of rules, as bits
WORD = 60  # rules per number of such a set
_VALUE = ["table_name", "key", "_value"]
# references to each parent, in the order of the columns that count them
REFERENCES = {parent: [(fk.table, f"{fk.column} -> {fk.parent}") for fk in FOREIGN_KEYS if fk.parent == parent] for parent in {fk.parent: None for fk in FOREIGN_KEYS}}
SLOTS = range(max(map(len, REFERENCES.values())))
# rows per value of a key and, if others refer to it, uses of the value by reference
KEYS = StructType([
    *[StructField(c, StringType()) for c in ("table_name", "key")], StructField("_value", ArrayType(StringType())),
    StructField("n", LongType()), StructField("uses", ArrayType(LongType())),
])
TOTALS = StructType([
    *[StructField(c, StringType()) for c in ("audit", "table_name", "rule")], StructField("found", LongType()), StructField("surplus", LongType()),
])
KINDS = [(table, key) for table in TABLES for key in [*key_names(table), RULES]]
# texts of a value: of a key's columns, or numbers of a set of rules, at most three for each column and one for the row
PARTS = [f"part_{i}" for i in range(max(
    *(len(key) for table in TABLES for key in key_names(table).values()), *(-(-(3 * len(columns) + 1) // WORD) for columns in TABLES.values()),
))]
FACTS = StructType([StructField("kind", IntegerType()), StructField("slot", IntegerType()), *[StructField(c, StringType()) for c in PARTS], StructField("sign", IntegerType())])


def _summed(names: Iterable[str], *counts: str):
    return lambda rows: rows.groupBy(*names).agg(*[F.sum(c).alias(c) for c in counts])


def _used(counts: Iterable[Column]) -> Column:
    """Uses by reference; NULL if there are none, as most keys are not referred to."""
    counts = list(counts)
    return F.when(reduce(Column.__or__, [count != 0 for count in counts]), F.array(*counts)).alias("uses")


def _use(i: int) -> Column:
    return F.coalesce(F.get("uses", F.lit(i)), F.lit(0))


def _keys_added(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*_VALUE).agg(F.sum("n").alias("n"), *[F.sum(_use(i)).alias(f"uses_{i}") for i in SLOTS])
    return sums.select(*_VALUE, "n", _used(F.col(f"uses_{i}") for i in SLOTS))


_totals_added = _summed(["audit", "table_name", "rule"], "found", "surplus")


def _rules(table: str, present: Iterable[str]) -> dict[str, dict[str, Column]]:
    rules = {DOMAIN: column_rules(table, present)}
    return {**rules, ROW: row_rules()} if table == "posts" else rules


def _numbered(table: str) -> list[tuple[str, str]]:
    """All rules of a table, (audit, rule); a rule's place does not depend on the columns of a batch."""
    return [(audit, rule) for audit, rules in _rules(table, [c.name for c in TABLES[table]]).items() for rule in rules]


def _broken(table: str, present: Iterable[str]) -> tuple[Column, list[Column]]:
    """Whether a row breaks rules, and which, as bits."""
    places = {label: i for i, label in enumerate(_numbered(table))}
    words = [F.lit(0).cast("bigint") for _ in range(0, len(places), WORD)]
    for audit, rules in _rules(table, present).items():
        for rule, broken in rules.items():
            word, bit = divmod(places[audit, rule], WORD)
            words[word] = words[word].bitwiseOR(F.when(broken, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return reduce(Column.__or__, [word != 0 for word in words]), [word.cast("string") for word in words]


def _facts(table: str, present: Iterable[str]) -> Iterator[tuple[tuple[str, str], int, Column, list[Column]]]:
    """What a row may tell: the kind of a value, its slot (-1: has it, else: refers to it by that reference), whether it tells, and the value."""
    yield (table, RULES), -1, *_broken(table, present)
    for key, texts in key_texts(table).items():
        yield (table, key), -1, reduce(Column.__and__, [text.isNotNull() for text in texts]), texts
    for (label, parent), text in reference_columns(table).items():
        yield (parent, primary_key(parent)), REFERENCES[parent].index((table, label)), text.isNotNull(), [text]


def _worth(n: Column, uses: list[Column]) -> dict[str, Column]:
    """What a value is worth: it repeats, rows beyond the first, uses without a parent."""
    orphans = {f"orphans_{i}": F.when(n > 0, F.lit(0)).otherwise(count) for i, count in enumerate(uses)}
    return {"found": (n > 1).cast("int"), "surplus": F.greatest(n - 1, F.lit(0)), **orphans}


class KeptAudit:
    """The state below `path`. Batches are numbered from 0; one that is sent again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD, buckets: int = BUCKETS):
        self.spark = spark
        self.keys = Segments(spark, f"{path}/keys", "_value", _keys_added, fold, buckets, order=("table_name", "key"))
        self.totals = Segments(spark, f"{path}/totals", "rule", _totals_added, fold, 1)
        self.done = Notes(spark, f"{path}/done")

    def _told(self, tables: Mapping[str, DataFrame], sign: int) -> list[DataFrame]:
        """What rows say, each table read once: sets of rules they break, key values, values they refer to."""
        parts, none = [], F.lit(None).cast("string")
        for name in (n for n in TABLES if n in tables):
            facts = []
            for kind, slot, told, value in _facts(name, tables[name].columns):
                facts += [F.lit(KINDS.index(kind)), F.lit(slot), F.when(told, value[0]), *value[1:], *[none] * (len(PARTS) - len(value))]
            rows = tables[name].select(F.stack(F.lit(len(facts) // (2 + len(PARTS))), *facts).alias("kind", "slot", *PARTS))
            parts.append(rows.where(F.col(PARTS[0]).isNotNull()).withColumn("sign", F.lit(sign)))
        return parts

    def _delta(self, came: Mapping[str, DataFrame], went: Mapping[str, DataFrame]) -> DataFrame:
        """Counts that a batch adds, a row per value."""
        told = reduce(DataFrame.unionByName, self._told(came, 1) + self._told(went, -1), self.spark.createDataFrame([], FACTS))
        counts = [F.sum(F.when(F.col("slot") == i, F.col("sign")).otherwise(F.lit(0)).cast("bigint")).alias(f"uses_{i}") for i in (-1, *SLOTS)]
        # the names of kinds are put back after the rows are grouped, as nearly every value is a group of its own
        names = [F.get(F.array(*map(F.lit, texts)), "kind").alias(c) for c, texts in zip(_VALUE, zip(*KINDS))]
        delta = told.groupBy("kind", *PARTS).agg(*counts)
        widths = [len(key_names(table)[key]) if key != RULES else len(PARTS) for table, key in KINDS]
        value = F.slice(F.array(*PARTS), F.lit(1), F.get(F.array(*map(F.lit, widths)), "kind"))
        delta = delta.select(*names, value.alias("_value"), F.col("uses_-1").alias("n"), _used(F.col(f"uses_{i}") for i in SLOTS))
        return delta.where("n <> 0 OR uses IS NOT NULL")

    def _gains(self, batch: int, tables: set[str], delta: DataFrame) -> DataFrame:
        """What the values of a delta are worth now less what they were worth, by table and key.

        Only the kinds of values that rows of these tables can tell of are looked up.
        """
        delta = delta.where(F.col("key") != RULES)
        if batch:
            kinds = {(t, key) for t in tables for key in key_names(t)} | {(p, primary_key(p)) for t in tables for _, p in reference_columns(t)}
            wanted = reduce(Column.__or__, [(F.col("table_name") == t) & (F.col("key") == key) for t, key in sorted(kinds)], F.lit(False))
            before = self.keys.parts(batch, KEYS, delta.select("_value"), wanted)
            rows = before.withColumn("_new", F.lit(False)).unionByName(delta.withColumn("_new", F.lit(True)))
            counts = {"n": F.col("n"), **{f"uses_{i}": _use(i) for i in SLOTS}}
            was = [F.sum(F.when(F.col("_new"), F.lit(0)).otherwise(count)).alias(f"was_{c}") for c, count in counts.items()]
            both = rows.groupBy(*_VALUE).agg(*was, *[F.sum(count).alias(c) for c, count in counts.items()], F.max("_new").alias("_new")).where("_new")
            old = _worth(F.col("was_n"), [F.col(f"was_uses_{i}") for i in SLOTS])
            now = _worth(F.col("n"), [F.col(f"uses_{i}") for i in SLOTS])
        else:
            both, old, now = delta, {}, _worth(F.col("n"), [_use(i) for i in SLOTS])
        gains = {name: value - old[name] if old else value for name, value in now.items()}
        return both.groupBy("table_name", "key").agg(*[F.sum(gain.cast("bigint")).alias(name) for name, gain in gains.items()])

    def _labelled(self, rows: DataFrame, labels: list[tuple]) -> DataFrame:
        """Totals of (table_name, key, slot, found, surplus) under the audits' own names; labels: (table_name, key, slot, audit, table, rule)."""
        values = ", ".join(f"({', '.join(map(repr, label))})" for label in labels)
        named = self.spark.sql(f"SELECT * FROM VALUES {values} AS t(_table, _key, _slot, audit, _of, rule)")
        hit = (F.col("table_name") == F.col("_table")) & (F.col("key") == F.col("_key")) & (F.col("slot") == F.col("_slot"))
        return rows.join(named, hit).select("audit", F.col("_of").alias("table_name"), "rule", "found", "surplus")

    def _added(self, batch: int, tables: set[str]) -> list[DataFrame]:
        """What a batch adds to the totals, from the counts that it has written."""
        delta, none = self.keys.of(batch, KEYS), F.lit(0).cast("bigint")
        places = [(t, RULES, i, audit, t, rule) for t in TABLES for i, (audit, rule) in enumerate(_numbered(t))]
        most = max(place[2] for place in places) + 1
        sets = delta.where(F.col("key") == RULES)
        bits = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.struct(
            i.alias("slot"), F.getbit(F.coalesce(F.get("_value", (i / WORD).cast("int")), F.lit("0")).cast("bigint"), i % WORD).alias("set"),
        ))
        broken = sets.select("table_name", "key", "n", F.inline(bits)).where("set = 1")
        broken = broken.select("table_name", "key", "slot", F.col("n").alias("found"), none.alias("surplus"))
        slots = [F.struct(F.lit(-1).alias("slot"), "found", "surplus")]
        slots += [F.struct(F.lit(i).alias("slot"), F.col(f"orphans_{i}").alias("found"), none.alias("surplus")) for i in SLOTS]
        values = self._gains(batch, tables, delta).select("table_name", "key", F.inline(F.array(*slots)))
        labels = [(t, key, -1, KEY, t, key) for t, key in KINDS if key != RULES]
        labels += [(p, primary_key(p), i, REFERENCE, t, label) for p, uses in REFERENCES.items() for i, (t, label) in enumerate(uses)]
        return [self._labelled(broken, places), self._labelled(values, labels)]

    def apply(self, batch: int, came: Mapping[str, DataFrame], went: Mapping[str, DataFrame] = {}) -> None:
        """Adds rows that came and takes off rows that went, by table; a changed row goes as it was and comes as it is."""
        for state in (self.keys, self.totals):
            state.start(batch)
        self.keys.write(self._delta(came, went), batch)
        # rules that no row breaks are reported too
        ruled = [(audit, n, rule, 0, 0) for t in (came, went) for n in TABLES if n in t for audit, rules in _rules(n, t[n].columns).items() for rule in rules]
        totals = [self.spark.createDataFrame(ruled, TOTALS), *self._added(batch, {n for t in (came, went) for n in t if n in TABLES})]
        self.totals.write(_totals_added(reduce(DataFrame.unionByName, totals)), batch)
        self.done.write(batch, {})

    def _found(self, audit: str) -> DataFrame:
        last = self.done.latest()
        return self.totals.before(0 if last is None else last + 1, TOTALS).where(F.col("audit") == audit)

    def domains(self) -> DataFrame:
        """(table_name, rule, violations) of the tables that had any batch."""
        return self._found(DOMAIN).select("table_name", "rule", F.col("found").alias("violations"))

    def checks(self) -> DataFrame:
        """(table_name, rule, violations), as the full audit of rows."""
        return self._found(ROW).select("table_name", "rule", F.col("found").alias("violations"))

    def unique(self, names: Iterable[str] = TABLES) -> DataFrame:
        """(table_name, key, repeated_keys, surplus_rows), as the full audit of these tables."""
        names = list(names)
        found = self._found(KEY).where(F.col("table_name").isin(names))
        found = found.select("table_name", F.col("rule").alias("key"), F.col("found").alias("repeated_keys"), F.col("surplus").alias("surplus_rows"))
        return tally(found, key_labels(names), ["repeated_keys", "surplus_rows"])

    def references_found(self, names: Iterable[str] = TABLES) -> DataFrame:
        """(table_name, reference, orphan_rows), as the full audit of these tables."""
        names = list(names)
        found = self._found(REFERENCE).where(F.col("table_name").isin(names))
        found = found.select("table_name", F.col("rule").alias("reference"), F.col("found").alias("orphan_rows"))
        return tally(found, reference_labels(names), ["orphan_rows"])
