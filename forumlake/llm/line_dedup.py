r"""Line deduplication by content-defined chunks of lines and by shared passages.

Lines are hashed, and a rolling hash runs over the last `LOOK` line hashes. Where it is 0
modulo `EVERY` (or after `MOST` lines) a chunk ends, so the same passage is cut at the same
lines wherever it stands, and lines inserted before it shift nothing. Compared are the
chunks of several lines and, whatever surrounds them, all passages of whole lines with over
`least` words: from every line with words the shortest run of over `least` words, and up to
every such line the shortest one. Any longer passage is a union of such runs that lie in it
(only lines without words at its ends can stay), so it is found whole, one line or many.

Of equal runs the first stays and the lines of the others are removed from their documents:
the order is doc_id (null last), then file and row number, then place in the document. A
removed line always equals one at an earlier place, so each line stays at least once. With
passages, lines without words between two removed lines go with them. Without `least`, only
chunks count.

Runs are matched by digests of their lines' digests, and only these travel; counts combine
before the shuffle, and the facts of runs that stand in a large share of all places are
broadcast to them. Texts are shuffled once, to meet their repeated runs. There every line of
a repeated run, removed or staying, and every run's sequence of line digests is sent on
under its digest, each line once per document however many runs cover it, and all bytes
under one digest are compared. If two ever differ, the whole is done again with digests of
another seed, so texts that share a digest without being equal stay.

A null text stays null and counts as empty; a document can become empty. Repeated rows are
documents of their own, so the second one loses what the first has. An empty table gives an
empty result. Other columns pass through.
"""

from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import fresh, join_facts, locatable, locator, ship, stored, table

LOOK = 2
EVERY = 3
MOST = 64
LEAST = 50
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
HOT = 1_000


def chunks(text: str | None) -> list[list[str]]:
    """The lines of a text, cut into chunks."""
    lines = (text or "").split("\n")
    hashes = [xxhash.xxh3_64_intdigest(line.encode(errors="surrogatepass")) for line in lines]
    leaving = pow(BASE, LOOK, 1 << 64)
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * BASE + h - (hashes[i - LOOK] * leaving if i >= LOOK else 0)) & MASK
        if (i + 1 >= LOOK and (rolling >> 24) % EVERY == 0) or i + 1 - start >= MOST:
            out.append(lines[start : i + 1])
            start = i + 1
    if start < len(lines):
        out.append(lines[start:])
    return out


def _words(line: str) -> int:
    return len(line.encode(errors="surrogatepass").split())


def runs(text: str | None, least: int | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    """The lines of a text, and (first line, lines) of all that is compared."""
    cut = chunks(text)
    lines = [line for c in cut for line in c]
    found, at = set(), 0
    for c in cut:
        if len(c) > 1:
            found.add((at, len(c)))
        at += len(c)
    if least is not None:
        sizes = [(i, n) for i, line in enumerate(lines) if (n := _words(line))]
        after = held = 0
        for i, n in sizes:  # the shortest run from each line
            while after < len(sizes) and held <= least:
                held += sizes[after][1]
                after += 1
            if held <= least:
                break
            found.add((i, sizes[after - 1][0] - i + 1))
            held -= n
        begin = held = 0
        for i, n in sizes:  # the shortest run up to each line
            held += n
            while held - sizes[begin][1] > least:
                held -= sizes[begin][1]
                begin += 1
            if held > least:
                found.add((sizes[begin][0], i - sizes[begin][0] + 1))
    return lines, sorted(found)


class Digests:
    """128-bit digests of lines and of runs of lines; `weak` maps them to fewer values to try out collisions."""

    def __init__(self, seed: int, weak: Callable[[int], int]):
        self.seed, self.weak = seed, weak if seed == 0 else int

    def line(self, line: bytes) -> bytes:
        return self.weak(xxhash.xxh3_128_intdigest(line, self.seed)).to_bytes(16)

    def run(self, lines: list[bytes]) -> bytes:
        return self.weak(xxhash.xxh3_128_intdigest(b"".join(lines), self.seed + 1)).to_bytes(16)


def _encoded(lines: list[str]) -> list[bytes]:
    return [line.encode(errors="surrogatepass") for line in lines]


def _run_digests(made: Digests, least: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, counts, digests = [], [], []
            for text in batch.column("text"):
                lines, found = runs(text.as_py(), least)
                hashed = [made.line(b) for b in _encoded(lines)]
                starts.append([a for a, _ in found])
                counts.append([n for _, n in found])
                digests.append([made.run(hashed[a : a + n]) for a, n in found])
            arrays = [pa.array(starts, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "file", "row")), *arrays], names=["doc_id", "file", "row", "start", "lines", "digest"])

    return rows


def repeated_runs(docs: DataFrame, made: Digests, least: int | None = None) -> DataFrame:
    """(file, row, start, lines, lost): the runs of a `locatable` frame's rows that stand elsewhere too.

    Three arrays per row that has any; `lost` says that an earlier place has the run.
    """
    path, number = locator(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("file"), number.alias("row"), "text")
    narrow = rows.mapInArrow(_run_digests(made, least), "doc_id long, file string, row long, start array<int>, lines array<int>, digest array<binary>")
    narrow = stored(narrow, "run-digests")
    places = narrow.select("doc_id", "file", "row", F.explode(F.arrays_zip("start", "lines", "digest")).alias("c")).select("doc_id", "file", "row", "c.*")
    total = narrow.agg(F.coalesce(F.sum(F.size("digest")), F.lit(0))).first()[0]
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row", "start")
    facts = stored(places.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated-runs")
    again = join_facts(places, facts, "digest", F.col("n") * HOT > total)
    marks = again.groupBy("file", "row").agg(F.collect_list(F.struct("start", "lines", (place != F.col("first")).alias("lost"))).alias("m"))
    return marks.select("file", "row", *[F.col("m")[c].alias(c) for c in ("start", "lines", "lost")])


def _without(lines: list[str], gone: list[tuple[int, int]], least: int | None) -> tuple[str, int, int]:
    """What stays, how many chunks lost lines, how many lines went."""
    lost = {i for a, n in gone for i in range(a, a + n)}
    if least is not None:
        ordered = sorted(lost)
        for a, b in zip(ordered, ordered[1:]):
            if b - a > 1 and not any(map(_words, lines[a + 1 : b])):
                lost.update(range(a + 1, b))
    touched, at = 0, 0
    for c in chunks("\n".join(lines)):
        touched += any(i in lost for i in range(at, at + len(c)))
        at += len(c)
    return "\n".join(line for i, line in enumerate(lines) if i not in lost), touched, len(lost)


MADE = "struct<text:string,chunks:int,lines:int,checked:array<struct<digest:binary,bytes:binary>>>"
CHECKED = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))


def _cutter(made: Digests, least: int | None):
    def cut(text: str | None, starts, counts, lost) -> dict:
        if text is None or not starts:
            return {"text": text, "chunks": 0, "lines": 0, "checked": []}
        lines, marked = text.split("\n"), list(zip(starts, counts, lost))
        covered = {i: b for i, b in ((i, lines[i].encode(errors="surrogatepass")) for a, n, _ in marked for i in range(a, a + n))}
        hashed = {i: made.line(b) for i, b in covered.items()}
        checked = {(hashed[i], b) for i, b in covered.items()}
        for a, n, _ in marked:
            sequence = [hashed[i] for i in range(a, a + n)]
            checked.add((made.run(sequence), b"".join(sequence)))
        gone = [(a, n) for a, n, away in marked if away]
        left, touched, removed = _without(lines, gone, least) if gone else (text, 0, 0)
        return {"text": left, "chunks": touched, "lines": removed, "checked": [{"digest": d, "bytes": b} for d, b in checked]}

    @F.arrow_udf(MADE)
    def cuts(texts: pa.Array, starts: pa.Array, counts: pa.Array, lost: pa.Array) -> pa.Array:
        out = [cut(t.as_py(), *(x.as_py() for x in marks)) for t, *marks in zip(texts, starts, counts, lost)]
        kinds = {"text": pa.string(), "chunks": pa.int32(), "lines": pa.int32(), "checked": CHECKED}
        return pa.StructArray.from_arrays([pa.array([r[c] for r in out], k) for c, k in kinds.items()], names=list(kinds))

    return cuts


def drop_repeated_lines(docs: DataFrame, weak: Callable[[int], int] = int, least: int | None = None) -> DataFrame:
    """`docs` without repeated chunks and, with `least`, passages of over so many words.

    Also what was removed: `removed_chunks` (chunks that lost lines) and `removed_lines`, named freshly if taken.
    """
    ship(docs.sparkSession)
    docs = locatable(docs, "line-docs")
    file, row, start, lines, lost, made, checked = (fresh(docs, c) for c in ("at_file", "at_row", "start", "lines", "lost", "made", "checked"))
    path, number = locator(docs)
    kept = [F.col(made)["text"].alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    counts = [F.col(made)[c].alias(fresh(docs, f"removed_{c}")) for c in ("chunks", "lines")]
    for seed in count():
        digests = Digests(seed, weak)
        marks = repeated_runs(docs, digests, least).toDF(file, row, start, lines, lost)
        tagged = docs.withColumns({file: path, row: number}).join(marks, [file, row], "left")
        tagged = tagged.withColumn(made, _cutter(digests, least)("text", start, lines, lost))
        out = stored(tagged.select(*kept, *counts, F.col(made)["checked"].alias(checked)), "without-lines")
        same = out.select(F.explode(checked).alias("c")).groupBy("c.digest").agg(F.min("c.bytes").alias("a"), F.max("c.bytes").alias("b"))
        if not same.where("a <> b").take(1):
            return out.drop(checked)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = drop_repeated_lines(docs, least=LEAST)
    # the counts are the last two columns, whatever the table's own are called
    out = out.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(out.columns[-2:], ("removed_chunks", "removed_lines"))])
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "removed_chunks", "removed_lines", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
