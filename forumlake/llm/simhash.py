"""SimHash near-duplicates, candidates pruned by pigeonring chains.

Texts are lower-cased (A-Z), cut into words at [\\x20\\x09-\\x0D]+ and into shingles of four
words, repeats included; fewer words form one shingle, no word gives fingerprint zero. A
fingerprint bit is set if it is set in over half of the shingles' XXH64 (seed 42).

Fingerprints with at most `LIMIT` differing bits are linked. The 64 bits lie on a ring of
five segments. If two fingerprints differ in at most 4 bits, some segment starts a chain in
which the first l segments together differ in at most 4 l / 5 bits, for every l. The first
two steps (no difference, then at most one) are the join key: segment and the next one with
any single bit turned, 26 bits that agree. The longer chains and then the full Hamming
distance are part of the join condition. A pair meets at each of its starts and is kept at
the first of them, so no link is lost or repeated.

Equal fingerprints are one node, however many rows have them, so groups of copies cost one
row; links between nodes of one dense group are joined as rows of a skew-split join, and
components are found without gathering a group (`components`). Null texts count as empty;
rows with a null doc_id get a component like any other, whose id is the smallest doc_id
that is not null (null if there is none). An empty table gives an empty result. Columns
besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import keep_rows, locatable, locator, ship, stored, table
from forumlake.llm.components import components

SHINGLE = 4
SEED = 42
LIMIT = 4
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK = 65_536


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII spaces split
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(SHINGLE, len(words)) - 1 :]
    ones, n = np.zeros(64, dtype=np.int64), len(last)
    for at in range(0, n, BLOCK):  # long texts in blocks
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], last[at : at + BLOCK])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("file"), batch.column("row"), pa.array(prints.view(np.int64))],
            names=["doc_id", "file", "row", "print"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, file, row, print (signed) per row of a `locatable` frame."""
    ship(docs.sparkSession)
    path, number = locator(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("file"), number.alias("row"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, file string, row long, print long")


def _segment(print_: Column, k: int) -> Column:
    start, width = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(print_, start).bitwiseAND(F.lit((1 << width) - 1))


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _chain(a: Column, b: Column, start: int) -> Column:
    """Whether the chain from `start` keeps within the proportional budget at every length."""
    m, total, fits = len(SEGMENTS), None, None
    for l in range(1, m + 1):
        k = start + l - 1
        d = _differ(_segment(a, k), _segment(b, k))
        total = d if total is None else total + d
        ok = total <= LIMIT * l // m
        fits = ok if fits is None else fits & ok
    return fits


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): each pair of distinct values of `print` with 1 to LIMIT differing bits, once."""
    # each node is about to become 70 rows: spread them, and let no plan take them for a small side
    nodes = prints.select("print").distinct().repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    exact, turned = [], []
    for k in range(len(SEGMENTS)):
        width = SEGMENTS[(k + 1) % len(SEGMENTS)][1]
        this, after = _segment(F.col("print"), k), _segment(F.col("print"), k + 1)
        key = lambda nxt: F.lit(k).cast("long") * (1 << 27) + this * (1 << 13) + nxt  # noqa: B023, E731
        exact.append(key(after))
        turned += [key(after.bitwiseXOR(F.lit(mask))) for mask in (0, *(1 << bit for bit in range(width)))]
    left = nodes.select(F.col("print").alias("a"), F.explode(F.array(*exact)).alias("key"))
    right = nodes.select(F.col("print").alias("b"), F.explode(F.array(*turned)).alias("key"))
    a, b = F.col("a"), F.col("b")
    start = F.floor(F.col("key") / (1 << 27))
    first = F.coalesce(*[F.when(_chain(a, b, k), F.lit(k)) for k in range(len(SEGMENTS))])
    pairs = left.hint("merge").join(right, "key").where((a < b) & (_differ(a, b) <= LIMIT) & (first == start))
    return pairs.select("a", "b")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, file, row, print, component_id per row of a `locatable` frame."""
    rows = stored(fingerprints(docs), "prints")
    named = components(near_links(rows)).withColumnRenamed("node", "print")
    nodes = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    whole = nodes.join(named, "print", "left").select("print", F.coalesce("component", "print").alias("component"), "least")
    ids = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(whole.select("print", "component").join(ids, "component"), "print")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group: the one with the smallest doc_id (null last), then by file and row."""
    docs = locatable(docs, "near-docs")
    groups = near_groups(docs)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("keep"))
    return keep_rows(docs, first.select("keep.file", "keep.row"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = locatable(table(spark, sf_dir, "documents"), "near-docs")
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
