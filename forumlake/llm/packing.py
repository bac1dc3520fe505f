"""Packing by concatenating and cutting: token offsets from two-pass prefix sums.

The stream has the order of the input files by name (numbers past 99,999 after all shorter
ones) and of the rows in them, which is the order in which a sorted table was written,
however Spark deals files and splits to tasks.

Pass one tokenises every document once, in the tasks that read it, and writes its ids with
the running token count inside its run, the rows of one file that a task reads. The totals
of the runs (one row per split) are summed up in the stream's order and give each run its
base, so base + running count is a document's global offset. Pass two cuts the stream at every multiple of the window; a document that crosses a
cut leaves one boundary record in each sequence it touches. No row is shuffled, and a long
document or a large source makes no task larger than its input split.

Only the last sequence can be short. `padded_length` is what a sequence fills after padding:
the window, or its own length if that is a power of two. Every document ends with the end
id, so null and empty texts are one piece of one token. Repeated rows are packed each by
itself; null doc_ids stay null; other columns are not looked at. An empty table has no
pieces.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forumlake.llm.common import locatable, locator, ship, stored, table

WINDOW = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
CACHED = 500_000
ROWS = 256


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds:
    """Token ids of words between blanks and line ends, remembered per Python worker.

    The model drops white space and never joins tokens across it, so the ids of a text are
    those of its words in order. Latin words with trailing punctuation, nearly all there
    are, go straight to the model's merges; every other word through the whole tokenizer.
    """

    _one: WordIds | None = None

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {"": b""}
        self.letters = _byte_letters()
        self.merge: Callable = self.tokenizer.model.tokenize

    @classmethod
    def of(cls, path: str) -> WordIds:
        if cls._one is None or cls._one.path != path:
            cls._one = cls(path)
        return cls._one

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.width).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.cores.get(part)
        if found is None:
            if part.isascii():
                spelled = part
            else:
                spelled = "".join(self.letters[b] for b in part.encode())
            found = self.cores[part] = self._pack([t.id for t in self.merge(spelled)])
        return found

    def word(self, word: str) -> bytes:
        core = word.rstrip(string.punctuation)
        low = core.lower()
        if not core or (core.isalpha() and max(core) < "ɐ" and low.isalpha() and unicodedata.is_normalized("NFC", word)):
            found = self._part(low) + self._part(word[len(core) :])
        else:
            found = self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self.words) > CACHED:
            self.words = {"": b""}
        if len(self.cores) > CACHED:
            self.cores = {"": b""}
        self.words[word] = found
        return found

    def text(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            known, find = self.words.get, self.word
            return b"".join([b if (b := known(w)) is not None else find(w) for w in words])


def tokenise(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, file, first (row number of its run's first row), start (tokens before it in its run), tokens, ids; written once."""
    docs = locatable(docs, "pack-docs")
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, first, start = WordIds.of(path), None, 0, 0
        last = encoder._pack([end])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids = [encoder.text(t.as_py() or "") + last for t in some.column("text")]
                firsts, starts, tokens = [], [], [len(b) // encoder.width.itemsize for b in ids]
                for file, row, n in zip(some.column("file").to_pylist(), some.column("row").to_pylist(), tokens):
                    if (file, row - 1) != before:
                        first, start = row, 0
                    before = (file, row)
                    firsts.append(first)
                    starts.append(start)
                    start += n
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("file"), *[pa.array(c, pa.int64()) for c in (firsts, starts, tokens)], pa.array(ids, pa.binary())],
                    names=["doc_id", "file", "first", "start", "tokens", "ids"],
                )

    file, row = locator(docs)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), file.alias("file"), row.alias("row"), "text")
    return stored(narrow.mapInArrow(rows, "doc_id long, file string, first long, start long, tokens long, ids binary"), "tokens")


def cut(tokens: DataFrame, width: int = 2, window: int = WINDOW) -> DataFrame:
    """The pieces of the concatenated stream of a `tokenise` table; `width` is the bytes of an id."""
    totals = tokens.groupBy("file", "first").agg(F.sum("tokens").alias("tokens"))
    # one row per split of pass one; writers number their files in five digits and, from there, in more
    before = Window.orderBy(F.length("file"), "file", "first").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "first", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.sum("tokens").over(Window.partitionBy()).alias("total"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "at", "tokens", "total"))
            for doc_id, at, n, total, ids in zip(*columns, batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), dtype=kind).astype("<u4")
                final = (total - 1) // window
                fill = total - final * window
                short = fill if fill & (fill - 1) == 0 else window
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((doc_id, start, length, crc, n, sequence, offset, short if sequence == final else window))
                    start += length
            kinds = [pa.int64()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"],
            )

    placed = tokens.join(F.broadcast(bases), ["file", "first"]).select("doc_id", (F.col("base") + F.col("start")).alias("at"), "tokens", "total", "ids")
    return placed.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    path = path or public_tokenizers.path(VOCABULARY)
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    return cut(tokenise(docs, path, end), width, window)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
