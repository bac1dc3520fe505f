"""Line deduplication with passages against a loop that shares no code with it."""

import re

import duckdb
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from forumlake.llm import line_dedup
from corpus_cases import ODD, odd, sha  # noqa: F401


def cut(lines):
    """Places after which a chunk ends: two neighbouring line hashes decide, or 64 lines."""
    hashes = [xxhash.xxh3_64_intdigest(line.encode()) for line in lines]
    ends, begin = [], 0
    for i in range(len(lines)):
        rolled = (hashes[i - 1] * 0x9E3779B97F4A7C15 + hashes[i]) % 2**64 if i else None
        if (rolled is not None and rolled // 2**24 % 3 == 0) or i + 1 - begin == 64:
            ends.append(i + 1)
            begin = i + 1
    return ends + ([len(lines)] if begin < len(lines) else [])


def compared(lines, least):
    """All (first, after) line ranges that are compared."""
    found, begin = set(), 0
    for end in cut(lines):
        if end - begin > 1:
            found.add((begin, end))
        begin = end
    words = [len(re.findall(r"[^ \t\n\r\x0b\x0c]+", line)) for line in lines]
    solid = [i for i, n in enumerate(words) if n]
    for x, i in enumerate(solid):
        ahead = next((j for j in solid[x:] if sum(words[i : j + 1]) > least), None)
        back = next((j for j in reversed(solid[: x + 1]) if sum(words[j : i + 1]) > least), None)
        if ahead is not None:
            found.add((i, ahead + 1))
        if back is not None:
            found.add((back, i + 1))
    return sorted(found), words


def brute(rows, least=50):
    """(removed lines, text left) by row, in order of `rows`."""
    seen, out = set(), []
    for text in rows:
        lines = (text or "").split("\n")
        found, words = compared(lines, least)
        lost = set()
        for a, b in found:
            body = tuple(lines[a:b])
            if body in seen:
                lost.update(range(a, b))
            seen.add(body)
        filled = sorted(lost)
        for a, b in zip(filled, filled[1:]):
            if not any(words[a + 1 : b]):
                lost.update(range(a, b))
        out.append((len(lost), "\n".join(line for i, line in enumerate(lines) if i not in lost)))
    return out


def test_op1_against_a_loop(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    want = [(i, n, len(t), sha(t)) for (i, _), (n, t) in zip(rows, brute([t for _, t in rows]))]
    got = line_dedup.op1_line_dedup(spark, DATA)
    assert got.columns == ["doc_id", "removed_chunks", "removed_lines", "kept_chars", "kept_sha256"]
    rows = sorted(got.collect())
    assert [(r.doc_id, r.removed_lines, r.kept_chars, r.kept_sha256) for r in rows] == want
    assert all((r.removed_chunks > 0) == (r.removed_lines > 0) for r in rows) and sum(r.removed_lines for r in rows) > 0


@pytest.mark.parametrize("weak", [int, lambda d: d % 5])
def test_passages_odd_rows_and_hot_runs(spark, odd, weak, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    passage = "\n".join(" ".join(f"p{k}x{i}" for k in range(20)) for i in range(4))
    more = [(100 + k, f"head {k}\n{passage}\ntail {k}", "en", "x", 1, "f", "r", "s", "z", "k") for k in range(30)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).withColumn("removed_chunks", F.lit(7)).withColumn("Removed_Lines", F.lit("x"))
    out = line_dedup.drop_repeated_lines(docs, weak, least=line_dedup.LEAST)
    assert out.columns == [*docs.columns, "removed_chunks_", "removed_lines_"]
    got = out.collect()
    assert len(got) == len(ODD) + 30 and sum(r.text is None for r in got) == 1 and {r.removed_chunks for r in got} == {7}
    ordered = sorted([(r[0] is None, r[0] or 0, r[1]) for r in ODD + more], key=lambda r: r[:2])
    # rows with one id differ in their order by file, but here not in what they lose
    assert sorted((r.removed_lines_, r.text or "") for r in got) == sorted(brute([t for *_, t in ordered]))
    assert line_dedup.drop_repeated_lines(docs.limit(0), least=line_dedup.LEAST).count() == 0


def test_a_column_of_the_table_named_like_a_count(spark, tmp_path):
    rows = [(k, "\n".join(" ".join(f"q{k}" for k in range(30)) + f" {i}" for i in range(3)), 99) for k in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, removed_chunks int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got[0].removed_chunks == 0 and got[1].removed_lines == 3 and got[1].kept_sha256 == sha("")
