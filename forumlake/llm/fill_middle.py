r"""Fill-in-middle transformation with a Fenwick tree over the blocks of a text.

A text is cut into units, the lines `[^\n]*\n|[^\n]+`. Two numbers of units drawn from the
row's id say where the prefix and the middle end. The UTF-8 bytes of a text lie in blocks of
`BLOCK` bytes; a Fenwick tree holds line ends and code points per block. Binary lifting
finds the block of a cut, and only that block is searched for the boundary, so a long text
is read once however many cuts it gets, and no list of its lines is built.

The output is `<P>`prefix`<S>`suffix`<M>`middle (psm), `<S>`suffix`<P>`prefix`<M>`middle
(spm) or the text itself (plain) where it is empty, contains a sentinel or is drawn to stay
so. `restored` gives the text back from output and form alone.

Draws are the first four 8-digit groups of the hex sha256 of `seed:id`, so they depend on
nothing else and reruns agree; a null id is drawn for as an empty one. A null text counts as
empty. Repeated rows get the same output. An empty table gives an empty result. Every column
of the table stays; the new one is named freshly if taken.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import fresh, ship, table

P, S, M = "<P>", "<S>", "<M>"
BLOCK = 4_096
RATE = 100
SPM = 50
SEED = 7
NEWLINE = 10


class Blocks:
    """Line ends and code points of UTF-8 bytes, by blocks, under a Fenwick tree."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        starts = np.arange(0, len(data), block)
        self.size = len(starts)
        ends = np.add.reduceat(data == NEWLINE, starts, dtype=np.int64) if self.size else []
        points = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64) if self.size else []
        index = np.arange(1, self.size + 1)
        below = index - (index & -index)
        self.trees = []
        for counts in (ends, points):
            sums = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            self.trees.append([0, *(sums[index] - sums[below]).tolist()])
        self.ends, self.points = int(np.sum(ends)), int(np.sum(points))
        self.units = self.ends + int(len(data) > 0 and data[-1] != NEWLINE)

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first `units` units."""
        if units == 0:
            return 0, 0
        if units > self.ends:
            return len(self.data), self.points
        ends, points = self.trees
        at, left, passed = 0, units, 0
        step = 1 << self.size.bit_length()
        while step := step >> 1:
            if at + step <= self.size and ends[at + step] < left:
                at += step
                left -= ends[at]
                passed += points[at]
        local = self.data[at * self.block : (at + 1) * self.block]
        inside = int(np.flatnonzero(local == NEWLINE)[left - 1]) + 1
        return at * self.block + inside, passed + int(np.count_nonzero((local[:inside] & 0xC0) != 0x80))


def transform(text: bytes, key: str, rate: int = RATE, spm: int = SPM, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    tree = Blocks(np.frombuffer(text, dtype=np.uint8), block)
    digits = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(mark.encode() in text for mark in (P, S, M)):
        return tree.units, "plain", None, None, text
    a, b = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    (first, before), (second, upto) = tree.cut(a), tree.cut(b)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm:
        form, parts = "spm", (S, suffix, P, prefix, M, middle)
    else:
        form, parts = "psm", (P, prefix, S, suffix, M, middle)
    return tree.units, form, before, upto - before, b"".join(p.encode() if isinstance(p, str) else p for p in parts)


def fill_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED, name: str = "fim") -> DataFrame:
    """`docs` with a struct: n, form, prefix_chars, middle_chars, output."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")
    def made(texts: pa.Array, keys: pa.Array) -> pa.Array:
        out = [transform(t.as_buffer().to_pybytes(), k.as_py(), rate, spm) for t, k in zip(texts, keys)]
        n, form, prefix, middle, output = zip(*out) if out else ([],) * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip((n, form, prefix, middle), kinds)]
        written = pa.array(output, pa.binary()).cast(pa.string())  # cut at line ends, so still UTF-8
        return pa.StructArray.from_arrays([*columns, written], names=["n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.withColumn(fresh(docs, name), made(F.coalesce("text", F.lit("")), key))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.

    Texts with sentinels stay plain, and no sentinel can begin in a part and end in the next,
    so each stands only where it was put.
    """
    marks = F.split(F.substring(output, F.lit(len(P) + 1), F.length(output)), f"{P}|{S}|{M}", -1)
    one, two, middle = (F.get(marks, F.lit(i)) for i in range(3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    docs = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = docs.select("doc_id", "fim.*")
    return fim.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
    FROM documents
), d AS (
    SELECT *, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS a,
           CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM t
), p AS (
    SELECT *, array_to_string(lines[1 : least(a, b)], '') AS prefix,
           array_to_string(lines[least(a, b) + 1 : greatest(a, b)], '') AS middle,
           array_to_string(lines[greatest(a, b) + 1 : n], '') AS suffix
    FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
