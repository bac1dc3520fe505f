r"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Words are the runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z became a-z. The windows of
the benchmark are all runs of `width` words of an item; an item of fewer words, but not none,
is one window. Their distinct (hash, words, item) rows are the set. Every document is split
into words once, a hash is taken at each word for each window length that occurs, and hash
hits are verified word by word in the same task, so a collision hits nothing.

The set is broadcast in blocks of at most `BLOCK_BYTES`, by hash: one block for usual
benchmarks, and one more scan of the documents per further block, which gives the same rows.
Documents are never shuffled with their texts: one narrow row per document and its hits meet
by file and row number, so a passage in a third of all documents is in no one's way.

A null text has no words. Repeated document rows are documents of their own. Items with one
item_id count once; an item with a null id hits words but is not listed. An empty benchmark
hits nothing; an empty table gives an empty result. Other columns are not looked at by
`scan` and pass through `without_documents` and `without_spans`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import fresh, locatable, locator, stored, table

WIDTH = 10
BLOCK_BYTES = 64 << 20
ROW_BYTES = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # the general lower case agrees on plain ASCII and is much cheaper there
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The distinct (hash, gram, item) rows of a benchmark (item_id, text)."""
    cut = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(width))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))
    return cut.select("item", F.explode(grams).alias("gram")).distinct().select(F.xxhash64("gram").alias("hash"), "gram", "item")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per row of a `locatable` frame: doc_id, file, row, n_words, spans, items.

    `spans` are the sorted occurrences of windows (start from 0, length, in words), `items`
    the sorted ids of the items whose windows occur, as strings.
    """
    grams = stored(windows(benchmark, width), "grams")
    seen = grams.agg(
        F.collect_set(F.size("gram")).alias("lengths"),  # at most `width` values
        F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "gram")) + F.coalesce(F.octet_length("item"), F.lit(0)) + F.lit(ROW_BYTES)), F.lit(0)).alias("bytes"),
    ).first()
    blocks = max(1, -(-seen["bytes"] // block_bytes))

    file, row = locator(docs)
    cut = docs.select("doc_id", file.alias("file"), row.alias("row"), words(F.col("text")).alias("words"))
    count = F.size("words")
    # one hash per word and length; runs over the end of the text fail the verification

    def hashes(length: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice("words", i, length)))
        return F.when(count > 0, each).otherwise(F.array().cast("array<long>"))

    none = F.array(F.lit(None).cast("long"))  # keeps every document in the result
    cut = cut.select("*", count.alias("n_words"), F.concat(none, *map(hashes, sorted(seen["lengths"]))).alias("hashes"))
    # never empty; the outer form only keeps the optimizer from filtering by size, which would split texts again
    at = cut.select("doc_id", "file", "row", "words", "n_words", F.posexplode_outer("hashes").alias("k", "h"))
    start = (F.col("k") - 1) % F.col("n_words")
    found = []
    for block in range(blocks):
        part = grams.where(F.pmod(F.col("hash"), F.lit(blocks)) == block) if blocks > 1 else grams
        same = (F.col("h") == F.col("hash")) & (F.slice("words", start + 1, F.size("gram")) == F.col("gram"))
        hits = at.join(F.broadcast(part), same, "left").where(F.col("gram").isNotNull() | (F.col("k") == 0 if block == 0 else F.lit(False)))
        span = F.when(F.col("gram").isNotNull(), F.struct(start.alias("start"), F.size("gram").alias("length")))
        found.append(hits.select("doc_id", "file", "row", "n_words", span.alias("span"), "item"))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("file", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    """How many words lie inside sorted spans."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        new = F.greatest(end - F.greatest(s["start"], acc["upto"]), F.lit(0))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(end, acc["upto"]).alias("upto"))

    return F.aggregate(spans, begin, add, lambda acc: acc["n"]).cast("long")


def _merged(spans: Column) -> Column:
    """Sorted spans as disjoint (start, end) runs; touching ones become one."""
    kind = "array<struct<start:int,end:int>>"

    def add(acc: Column, s: Column) -> Column:
        last, end = F.element_at(acc, -1), s["start"] + s["length"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        alone = F.struct(s["start"].alias("start"), end.alias("end"))
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"])
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(alone))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), add)


def without_documents(docs: DataFrame, benchmark: DataFrame, most_hit: float = 0.0, width: int = WIDTH) -> DataFrame:
    """`docs` without the documents of whose words more than `most_hit` are hit."""
    docs = locatable(docs, "leak-docs")
    names = [fresh(docs, c) for c in ("at_file", "at_row")]
    bad = scan(docs, benchmark, width).where(hit_words(F.col("spans")) > most_hit * F.col("n_words")).select("file", "row")
    tagged = docs.withColumns(dict(zip(names, locator(docs))))
    return tagged.join(bad.toDF(*names), names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` with every hit run of words cut from the text, what stands inside the run included."""
    docs = locatable(docs, "leak-docs")
    names = [fresh(docs, c) for c in ("at_file", "at_row")]
    spans, all_words, gaps, text = (fresh(docs, c) for c in ("spans", "all_words", "gaps", "text_left"))
    hit = scan(docs, benchmark, width).where(F.size("spans") > 0).select("file", "row", _merged(F.col("spans")).alias(spans)).toDF(*names, spans)
    tagged = docs.withColumns(dict(zip(names, locator(docs)))).join(hit, names, "left")
    # gap i stands before word i, the last one after all words
    tagged = tagged.withColumns({all_words: F.regexp_extract_all("text", F.lit(WORD), 0), gaps: F.split("text", WORD, -1)})
    starts = F.transform(spans, lambda s: s["start"])
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    upto = F.concat(starts, F.array(F.size(all_words)))

    def piece(end: Column, i: Column) -> Column:
        """Text from the gap after a run to the gap before the next one."""
        size = F.get(upto, i) - end
        inner = F.zip_with(F.slice(gaps, end + 1, size), F.slice(all_words, end + 1, size), lambda g, w: F.concat(g, w))
        return F.concat(F.array_join(inner, ""), F.get(gaps, F.get(upto, i)))

    left = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(F.transform(ends, piece), ""))
    tagged = tagged.withColumn(text, left)
    return tagged.select(*[F.col(text).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])


def op13_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = locatable(table(spark, sf_dir, "documents"), "leak-docs")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), s AS (
    SELECT item, words, least(len(words), 10) AS l, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
    FROM b WHERE len(words) > 0
), g AS (
    SELECT DISTINCT item, l, words[i : i + l - 1] AS gram FROM s
), p AS (
    SELECT r, words, l, unnest(range(1, len(words) - l + 2)) AS i
    FROM w, (SELECT DISTINCT l FROM g) WHERE len(words) >= l
), h AS (
    SELECT p.r, p.i, p.l, g.item FROM p JOIN g ON g.l = p.l AND g.gram = p.words[p.i : p.i + p.l - 1]
), c AS (
    SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS k FROM h) GROUP BY r
), t AS (
    SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
