"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document is a weighted count of hashed terms: words, word shapes (capitals, small letters
and digits written as A, a, 0, runs shortened, other characters kept) and immediate repeats.
Counts are taken relative to the length, damped by a square root, weighted by rarity and
projected on the `LATENT` leading singular vectors of the labelled sample. The projection
and the labelled vectors have a fixed bounded size (`PER_CLASS`, `TERMS`, `LATENT`) and are
sent to every task. Every whole text is read where it lies, without a shuffle; blocks of
documents are multiplied with all labelled vectors, so the cosines are exact. The
`NEIGHBOURS` nearest vote, each with its similarity: the score is the weighted share of
label 1.

Null and empty texts have no terms; their score is the share of label 1 in the sample's
classes as weighted by all neighbours equally (the plain mean label of the sample). Without
labelled documents every score is 0.5. Rows with a null doc_id are never learned from and
count as not held out. Repeated rows are scored each by itself. Other columns are not
looked at.
"""

import operator
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import fresh, labelled_sample, ship, table

WORDS, SHAPES = 1_536, 511
TERMS = WORDS + SHAPES + 1  # the last one counts immediate repeats
LATENT = 48
PER_CLASS = {1: 2_000, 0: 1_500}
NEIGHBOURS = 15
THRESHOLD = 0.3
CACHED = 300_000
BLOCK = 512
_RUNS = re.compile(r"(.)\1+", re.S)


def terms(word: str) -> tuple[int, int]:
    """Buckets of a word as split at blanks: the word's and its shape's."""
    shape = _RUNS.sub(r"\1\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
    shape = shape.replace("aa", "a").replace("AA", "A").replace("00", "0")
    low = word.lower().strip(string.punctuation)
    return zlib.crc32(low.encode()) % WORDS, WORDS + zlib.crc32(shape.encode()) % SHAPES


def counts(text: str | None, known: dict[str, tuple[int, int]]) -> tuple[list[int], list[float]]:
    """Term buckets and damped relative counts of a text."""
    words = (text or "").split()
    if not words:
        return [], []
    total: dict[int, int] = {}
    for word, n in Counter(words).items():
        ids = known.get(word)
        if ids is None:
            if len(known) > CACHED:
                known.clear()
            ids = known[word] = terms(word)
        for t in ids:
            total[t] = total.get(t, 0) + n
    repeats = sum(map(operator.eq, words, words[1:]))
    if repeats:
        total[TERMS - 1] = repeats
    scale = 1.0 / len(words)
    return list(total), [(n * scale) ** 0.5 for n in total.values()]


def matrix(texts, known: dict) -> np.ndarray:
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for row, text in enumerate(texts):
        at, weight = counts(text, known)
        if at:
            out[row, at] = weight
    return out


class Voters:
    """Rarity weights, projection and the labelled unit vectors with their labels."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray):
        self.rarity = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + 1
        raw = raw * self.rarity
        _, vectors = np.linalg.eigh((raw.T @ raw).astype(np.float64))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT]).astype(np.float32)
        self.vectors, self.labels = unit(raw @ self.basis), labels.astype(np.float32)
        self.rest = float(labels.mean())

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        latent = unit((raw * self.rarity) @ self.basis)
        cosine = latent @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, np.clip(vote / np.maximum(total, 1e-12), 0, 1), self.rest)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        rows = [sorted(zip(*counts(t.as_py(), known))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                pa.array([[t for t, _ in row] for row in rows], pa.list_(pa.int32())),
                pa.array([[w for _, w in row] for row in rows], pa.list_(pa.float32())),
            ],
            names=["label", "at", "weight"],
        )


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int] | None = None) -> "Voters | None":
    """Learns from a bounded sample of the labelled rows for which `keep` (of doc_id) holds.

    Texts are counted where they lie: at most `TERMS` numbers a document come to the driver.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, keep, per_class or PER_CLASS)
    found = sample.mapInArrow(_sparse, "label int, at array<int>, weight array<float>").toArrow()
    if not found.num_rows:
        return None
    rows = sorted(zip(*(found[c].to_pylist() for c in ("label", "at", "weight"))))
    raw = np.zeros((len(rows), TERMS), dtype=np.float32)
    for place, (_, at, weight) in enumerate(rows):
        raw[place, at] = weight
    return Voters(raw, np.array([r[0] for r in rows]))


def score(docs: DataFrame, voters: "Voters | None") -> DataFrame:
    """`docs` with a column `score` (0 to 1), named freshly if taken."""
    spark, name = docs.sparkSession, fresh(docs, "score")
    if voters is None:
        return docs.withColumn(name, F.lit(0.5))
    ship(spark)
    model = spark.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def vote(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters, known = model.value, {}
        for part in texts:
            blocks = [voters.score(matrix(part.iloc[at : at + BLOCK].tolist(), known)) for at in range(0, len(part), BLOCK)]
            yield pd.Series(np.concatenate(blocks) if blocks else [], dtype=float)

    return docs.withColumn(name, vote("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voters = fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(F.col("doc_id")))
    return score(docs, voters).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
