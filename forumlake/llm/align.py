"""Cross-tokenizer alignment, once per distinct text.

Texts are shuffled by their full text, which counts how often each occurs; copies combine
before the shuffle. Every distinct text is encoded by both tokenizers and aligned once: byte
offsets at which tokens of both end cut the tokens into groups, and the two tokens that end
at such an offset are a link. Pair counts are sums over distinct texts of links times
copies, so they are those of the whole corpus. A text's measures are then joined to the rows
that have it by the text's sha256.

Pair counts reach the links in blocks of at most `BLOCK_PAIRS` pairs, which are broadcast:
one block while the corpus has no more pairs, one more scan of the stored links per further
block, with the same sums. Texts of which one row in `HOT` is a copy are at most `HOT` texts,
so their measures are broadcast to the rows; the others meet by digest. No key, whatever its
share of the rows, is gathered in a task.

The first tokenizer gets a blank before the text, the second adds it itself; neither adds
special tokens, whose strings inside texts are plain text. Null and empty texts, and texts
that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty
`groups_sha256`. Repeated rows count as often as they occur. Null doc_ids stay null. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forumlake.llm.common import join_facts, ship, stored, table

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
BLOCK_PAIRS = 2_000_000
HOT = 1_000
ROWS = 64
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


def _letter_bytes() -> dict[str, int]:
    """The byte behind each printable character of byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers and the bytes and printed forms of their tokens, one per Python worker.

    Texts of plain Latin characters, which every engine splits alike, go to a faster encoder
    with the first tokenizer's own vocabulary; its ids are in the order of the merges.
    """

    _one: Aligner | None = None

    def __init__(self, paths: tuple[str, str]):
        self.paths = paths
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(paths[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        letters = _letter_bytes()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        spelled = {bytes(map(letters.__getitem__, t)): i for i, t in enumerate(entries) if t not in special}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=spelled, special_tokens={})
        self.bytes_a = [t.encode() if t in special else bytes(map(letters.__getitem__, t)) for t in entries]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes = [np.array([len(t) for t in tokens]) for tokens in (self.bytes_a, self.bytes_b)]
        # a token's printed form inside its group and at the end of it
        self.printed = [
            tuple(np.array([f"{i}{mark}" for i in range(len(tokens))], dtype=object) for mark in marks)
            for tokens, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))
        ]

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Aligner:
        if cls._one is None or cls._one.paths != paths:
            cls._one = cls(paths)
        return cls._one

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Token ids by both tokenizers; None where a text has no tokens."""
        if not text:
            return None
        whole = f" {text}"
        a = self.plain.encode_ordinary(whole) if PLAIN.fullmatch(whole) else self.a.encode(whole, add_special_tokens=False).ids
        b = self.b.encode(text)
        said = whole.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != said or b"".join(map(self.bytes_b.__getitem__, b)) != said:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """Places of the tokens that end groups, in `a` and in `b`, and the printed groups."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        found = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[found] == ends_a)  # the last ends are the same
        last_b = found[last_a]
        at_end_a, at_end_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        at_end_a[last_a], at_end_b[last_b] = True, True
        # a group's A tokens stand after the B tokens of the groups before, its B tokens after its A tokens
        group_a = np.cumsum(at_end_a) - at_end_a
        group_b = np.cumsum(at_end_b) - at_end_b
        before = np.concatenate([[0], last_b + 1])
        printed = np.empty(len(a) + len(b), dtype=object)
        (inner_a, outer_a), (inner_b, outer_b) = self.printed
        printed[np.arange(len(a)) + before[group_a]] = np.where(at_end_a, outer_a[a], inner_a[a])
        printed[np.arange(len(b)) + (last_a + 1)[group_b]] = np.where(at_end_b, outer_b[b], inner_b[b])
        return last_a, last_b, "".join(printed.tolist())[:-1]


ALIGNED = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def aligned(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One row per distinct text: its digest, copies, sizes, groups and distinct links (a, b, times)."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(paths)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = some.column("text").to_pylist()
                sizes, groups, links = [], [], []
                for ids in map(aligner.encode, texts):
                    if ids is None:
                        sizes.append((0, 0, 0, 0))
                        groups.append("")
                        links.append(([], [], []))
                        continue
                    a, b = ids
                    last_a, last_b, printed = aligner.align(a, b)
                    pairs, times = np.unique(a[last_a] << 32 | b[last_b], return_counts=True)
                    sizes.append((len(a), len(b), len(last_a), len(last_a)))  # no token is empty: one link ends each group
                    groups.append(hashlib.sha256(printed.encode()).hexdigest())
                    links.append((pairs >> 32, pairs & 0xFFFFFFFF, times))
                digests = [hashlib.sha256(t.encode()).digest() for t in texts]
                columns = [pa.array(digests, pa.binary()), some.column("copies")]
                columns += [pa.array(c, pa.int64()) for c in zip(*sizes)] + [pa.array(groups, pa.string())]
                columns += [pa.array(c, pa.list_(pa.int32())) for c in zip(*links)]
                yield pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in ALIGNED.split(", ")])

    texts = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return stored(texts.mapInArrow(rows, ALIGNED), "aligned")


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair (a and b in one number), n (links that hold it, all copies counted), best (no pair with its b has more)."""
    links = texts.select("copies", F.explode(F.arrays_zip("a", "b", "times")).alias("l"))
    pair = F.shiftleft(F.col("l.a").cast("long"), 32) + F.col("l.b")
    counts = links.groupBy(pair.alias("pair")).agg(F.sum(F.col("l.times") * F.col("copies")).alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def measures(texts: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """`texts` without their links, with n_best and count_sum over them."""
    counts = stored(counts, "pair-counts")
    blocks = max(1, -(-counts.count() // block_pairs))
    links = texts.select("digest", F.explode(F.arrays_zip("a", "b", "times")).alias("l"))
    links = links.select("digest", (F.shiftleft(F.col("l.a").cast("long"), 32) + F.col("l.b")).alias("pair"), F.col("l.times").alias("times"))
    sums = []
    for block in range(blocks):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block) if blocks > 1 else counts
        here = links.join(F.broadcast(part), "pair")
        sums.append(here.groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")))
    total = reduce(DataFrame.unionByName, sums)
    if blocks > 1:
        total = total.groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return texts.drop("a", "b", "times").join(total, "digest", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_pairs: int = BLOCK_PAIRS, hot: int = HOT) -> DataFrame:
    """doc_id and measures of every row of `docs`."""
    paths = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    texts = aligned(docs, paths)
    found = stored(measures(texts, pair_counts(texts), block_pairs), "measures")
    rows = stored(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")), "text-digests")
    # a text with over 1/hot of the rows: fewer than `hot` of them, however large the table
    often = F.col("copies") * hot > F.lit(rows.count())
    shape = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return join_facts(rows, found, "digest", often).select(*shape)


def op12_align(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
