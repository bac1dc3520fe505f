"""Toxicity by a factorization machine over hashed terms.

A document's features are the hashed terms that occur in it: lower-cased words without
their outer punctuation, and the first letters of longer words (4, 5 and 6), which tie
inflected and compounded forms together. The machine adds up a bias, one weight per term
and, for every pair of terms, the product of two learned vectors, so that an insult next to
a group mention can weigh more than both alone.

It is trained on at most `PER_CLASS` labelled documents a class (a fixed bound, chosen by a
hash of doc_id), on the terms that are frequent and telling in them (`MIN_DOCS`, `MIN_Z`,
`TERMS`). Terms outside the model weigh nothing, so the length of a text does not move its
score. The model has a fixed size and is sent to every task; every whole text is scored
where it is read, without a shuffle.

Null texts count as empty and get a score like any other text. Without any labelled
document of one of the classes every score is 0. Rows with a null doc_id are never trained
on and count as held out only if the checksum of their id says so (null: not held out).
Repeated rows are scored each by itself. Other columns are not looked at.
"""

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import fresh, labelled_sample, ship, stored, table

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
PER_CLASS = {1: 6_000, 0: 10_000}
MIN_DOCS = 2  # and one of MIN_SHARE documents
MIN_SHARE = 4_000
MIN_Z = 3.0
TERMS = 8_192
FACTORS = 8
EPOCHS = 30
THRESHOLD = 0.7
CACHED = 300_000
EDGES = string.punctuation + "«»“”‘’¡¿…"


def terms(word: str) -> set[int]:
    """Hashed terms of a word as split at blanks."""
    low = word.lower().strip(EDGES)
    if not low:
        return set()
    out = {zlib.crc32(b"w " + low.encode()) % BUCKETS}
    out.update(zlib.crc32(b"p " + low[:k].encode()) % BUCKETS for k in PREFIXES if len(low) >= k)
    return out


def features(text: str | None, known: dict[str, object], pick) -> set[int]:
    """Distinct terms of a text; `pick` gives a word's terms, remembered in `known`."""
    found: set[int] = set()
    for word in set((text or "").split()):
        ids = known.get(word)
        if ids is None:
            if len(known) > CACHED:
                known.clear()
            ids = known[word] = pick(word)
        if ids:
            found.update(ids)
    return found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        ids = [sorted(features(t.as_py(), known, terms)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.list_(pa.int32()))], names=["label", "terms"])


class Machine:
    """Trained weights: `ids` (sorted terms), bias, `linear` and `pairs` (one vector a term)."""

    def __init__(self, ids: np.ndarray, bias: float, linear: np.ndarray, pairs: np.ndarray):
        self.ids, self.bias, self.linear, self.pairs = ids, bias, linear, pairs

    def score(self, found: list[int]) -> float:
        """Probability of label 1 given positions in `ids`."""
        z = self.bias
        if found:
            v = self.pairs[found]
            total = v.sum(axis=0)
            z += float(self.linear[found].sum() + 0.5 * (total @ total - (v * v).sum()))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def telling(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Of a sample (label, terms): documents, those of label 1, and the terms to learn, sorted.

    Counted where the rows are; only the at most TERMS terms come to the driver.
    """
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < n:
        return n, ones, np.zeros(0, dtype=np.int64)
    rate = ones / n
    seen = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("seen"), F.sum("label").alias("bad"))
    z = F.abs(F.col("bad") - F.col("seen") * rate) / F.sqrt(F.col("seen") * rate * (1 - rate))
    good = seen.where((F.col("seen") >= max(MIN_DOCS, n // MIN_SHARE)) & (z >= MIN_Z)).orderBy(z.desc(), "term").limit(TERMS)
    return n, ones, np.array(sorted(r["term"] for r in good.select("term").collect()), dtype=np.int64)


def train(labels: np.ndarray, sets: list[list[int]], ids: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> "Machine | None":
    """Logistic loss, Adam over shuffled blocks of documents; `sets` are positions in `ids`.

    None unless there are documents of both classes.
    """
    ones, n = int(labels.sum()), len(labels)
    if not 0 < ones < n:
        return None
    rate = ones / n
    where = np.array([t for s in sets for t in s], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rng, m = np.random.default_rng(seed), len(ids)
    params = [np.array([np.log(rate / (1 - rate))]), np.zeros(m), rng.normal(0, 0.02, (m, factors))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for block in np.array_split(order, max(1, n // 512)):
            counts = starts[block + 1] - starts[block]
            doc = np.repeat(np.arange(len(block)), counts)
            at = np.concatenate([where[starts[i] : starts[i + 1]] for i in block]) if counts.sum() else np.zeros(0, np.int64)
            v = params[2][at]
            total = np.zeros((len(block), factors))
            np.add.at(total, doc, v)
            squares = np.bincount(doc, weights=(v * v).sum(axis=1), minlength=len(block))
            raw = params[0][0] + np.bincount(doc, weights=params[1][at], minlength=len(block)) + 0.5 * ((total**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[block]) / len(block)
            g = [np.array([error.sum()]), np.bincount(at, weights=error[doc], minlength=m).astype(float), np.zeros_like(params[2])]
            np.add.at(g[2], at, error[doc, None] * (total[doc] - v))
            g[1] += 1e-5 * params[1]
            g[2] += 1e-4 * params[2]
            step += 1
            for p, d, a, b in zip(params, g, first, second):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Machine(ids, float(params[0][0]), params[1], params[2])


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int] | None = None) -> "Machine | None":
    """Trains on a bounded sample of the labelled rows for which `keep` (of doc_id) holds."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, keep, per_class or PER_CLASS)
    rows = stored(sample.mapInArrow(_rows, "label int, terms array<int>"), "toxic-sample")
    _, _, ids = telling(rows)
    at = {int(t): k for k, t in enumerate(ids)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[at[t] for t in terms if t in at] for terms in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(kept, pa.list_(pa.int32()))], names=["label", "terms"])

    found = rows.mapInArrow(known, "label int, terms array<int>").toArrow()
    pairs = sorted(zip(found["label"].to_pylist(), found["terms"].to_pylist()))
    return train(np.array([p[0] for p in pairs], dtype=np.int64), [p[1] for p in pairs], ids)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """`docs` with a column `score` (0 to 1), named freshly if taken."""
    spark, name = docs.sparkSession, fresh(docs, "score")
    if machine is None:
        return docs.withColumn(name, F.lit(0.0))
    ship(spark)
    model = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, known = model.value, {}
        at = {int(t): k for k, t in enumerate(machine.ids)}
        pick = lambda word: tuple(at[t] for t in terms(word) if t in at)
        for part in texts:
            yield pd.Series([machine.score(sorted(features(t, known, pick))) for t in part], dtype=float)

    return docs.withColumn(name, probability("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below `threshold`, with their columns."""
    machine = fit(docs, labels, "toxic", ~held_out(F.col("doc_id")))
    scored = score(docs, machine)
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out(F.col("doc_id")))
    return score(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
