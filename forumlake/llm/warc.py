r"""WARC archives and their Merkle fixity audit.

Pages are written as WARC/1.1 response records, one archive per write task; a record's
offset is the sum of the lengths before it in its archive. Replicas are tables of (archive,
offset, record).

The audit hashes each record of each replica, then the ordered offset ranges of an archive:
the range of `RANGE` bytes in which a record begins hashes the (offset, digest) pairs that
begin in it, `FANOUT` neighbouring ranges hash into the next one, up to the archive, and
`FANOUT` neighbouring archives hash on up to one root. Roots are compared first; only below
nodes that differ are children compared, level by level, down to the records that differ.
A range holds a bounded number of records and a node a bounded number of children, so every
group is small whatever the data, and records are hashed where they are read: only digests
are shuffled.

A record of the first replica that the second lacks is `missing`, one that only the second
has is `surplus`, one whose bytes differ is `altered`. A null url or html is written as an
empty one; the null page_id as an empty id. Repeated pages are records of their own at
offsets of their own; a replica row repeated with equal bytes counts once, one repeated with
other bytes makes its offset `altered`. Empty tables give no records and equal roots. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlake.llm.common import stored, table

RANGE = 1 << 16
FANOUT = 32


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record (as text in UTF-8)."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, seq, page_id, bytes, record) as stored: an archive per write task, records in order."""
    rows = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    rows = rows.select(
        F.spark_partition_id().cast("long").alias("archive"), F.monotonically_increasing_id().alias("seq"),
        "page_id", F.octet_length("record").cast("long").alias("bytes"), F.col("record").cast("binary").alias("record"),
    )
    return stored(rows, "warc")


def index(archives: DataFrame) -> DataFrame:
    """(archive, seq, page_id, bytes, offset): the index of written archives; reads no record."""
    before = Window.partitionBy("archive").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return archives.select("archive", "seq", "page_id", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))


def leaves(replica: DataFrame) -> DataFrame:
    """(archive, offset, digest) of a replica (archive, offset, digest); one row per offset."""
    one = replica.groupBy("archive", "offset").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    both = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.sha2(F.concat("low", "high"), 256))
    return one.select("archive", "offset", both.alias("digest"))


def _hashed(children: DataFrame, keys: list[str], child: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(child, "digest")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p[child].cast("string"), p["digest"])), ",")
    return children.groupBy(*keys).agg(F.sha2(text, 256).alias("digest"))


def tree(digests: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT, levels: tuple[int, int] = (1, 1)) -> list[DataFrame]:
    """Levels from the records to the root, each (archive, node, digest).

    `levels` is how many levels of ranges and of archives lead to one node (see `depth`).
    """
    ranges, archives = levels
    out = [digests.select("archive", F.col("offset").alias("node"), "digest")]
    for level in range(ranges):
        divide = range_bytes if level == 0 else fanout
        out.append(_hashed(out[-1].withColumn("above", F.floor(F.col("node") / divide)), ["archive", "above"], "node").withColumnRenamed("above", "node"))
    # from here on one node per archive, later per group of archives
    for _ in range(archives):
        below = out[-1].withColumn("above", F.floor(F.col("archive") / fanout))
        made = _hashed(below, ["above"], "archive")
        out.append(made.select(F.col("above").alias("archive"), F.lit(0).cast("long").alias("node"), "digest"))
    return out


def depth(digests: DataFrame, other: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> tuple[int, int]:
    """Levels of ranges and archives that both replicas need to meet in one root."""
    top = digests.unionByName(other).agg(F.max("offset").alias("o"), F.max("archive").alias("a")).first()
    ranges, width = 1, range_bytes
    while width <= (top["o"] or 0):
        ranges, width = ranges + 1, width * fanout
    archives, width = 1, fanout
    while width <= (top["a"] or 0):
        archives, width = archives + 1, width * fanout
    return ranges, archives


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """(archive, offset, fixity) of every record on which two replicas (archive, offset, digest) disagree."""
    first, second = stored(leaves(first), "warc-leaves"), stored(leaves(second), "warc-leaves")
    levels = depth(first, second, range_bytes, fanout)
    ours, theirs = (tree(side, range_bytes, fanout, levels) for side in (first, second))
    wrong = None
    for level in range(len(ours) - 1, -1, -1):
        a, b = ours[level], theirs[level]
        if wrong is not None:  # children of differing nodes only
            if level >= levels[0]:  # archives, below groups of archives
                up = lambda side: side.withColumns({"up_archive": F.floor(F.col("archive") / fanout), "up": F.lit(0).cast("long")})
            else:
                divide = range_bytes if level == 0 else fanout
                up = lambda side, d=divide: side.withColumns({"up_archive": F.col("archive"), "up": F.floor(F.col("node") / d)})
            parents = wrong.select(F.col("archive").alias("up_archive"), F.col("node").alias("up"))
            a, b = (up(side).join(parents, ["up_archive", "up"], "left_semi") for side in (a, b))
        sides = a.select("archive", "node", F.col("digest").alias("mine")).join(b.select("archive", "node", F.col("digest").alias("yours")), ["archive", "node"], "full")
        wrong = stored(sides.where(~F.col("mine").eqNullSafe(F.col("yours"))), "warc-wrong")
        if not wrong.take(1):
            break
    fixity = F.when(F.col("yours").isNull(), "missing").when(F.col("mine").isNull(), "surplus").otherwise("altered")
    return wrong.select("archive", F.col("node").alias("offset"), fixity.alias("fixity"))


def digests(replica: DataFrame, record: str = "record") -> DataFrame:
    """(archive, offset, digest) of records, hashed where they are read."""
    return replica.select("archive", "offset", F.sha2(F.col(record), 256).alias("digest"))


ROT = 199  # in the audited copy, one page_id in so many is altered and one is missing


def damaged(archives: DataFrame) -> DataFrame:
    """A copy as a failing disk would leave it: by the checksum of page_id, records lack a byte or are gone."""
    case = F.coalesce(F.crc32(F.col("page_id").cast("string")) % ROT, F.lit(-1))
    half = F.floor(F.octet_length("record") / 2).cast("int")
    bad = F.concat(F.substring("record", F.lit(1), half), F.substring("record", half + 2, F.octet_length("record")))
    return archives.where(case != 1).withColumn("record", F.when(case == 0, bad).otherwise(F.col("record")))


def op10_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every page's record, its digest in the archive, and what the audit of a damaged copy found."""
    archives = write_archives(table(spark, sf_dir, "pages"))
    named = stored(archives.select("archive", "seq", F.sha2("record", 256).alias("digest")).join(index(archives), ["archive", "seq"]), "warc-index")
    copy = damaged(archives).select("archive", "seq", F.sha2("record", 256).alias("digest")).join(named.select("archive", "seq", "offset"), ["archive", "seq"])
    found = audit(named.select("archive", "offset", "digest"), copy.select("archive", "offset", "digest"))
    return named.join(found, ["archive", "offset"], "left").select(
        "page_id", F.col("bytes").alias("record_bytes"), F.col("digest").alias("record_sha256"), F.coalesce("fixity", F.lit("intact")).alias("fixity")
    )
