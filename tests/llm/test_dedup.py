"""Exact, near and line deduplication against plain loops."""

import duckdb
import pytest
import xxhash
from conftest import DATA

from forumlake.llm import exact_dedup, line_dedup, simhash
from forumlake.llm.common import locatable, table
from forumlake.llm.components import components
from corpus_cases import BLANK, ODD, normal, odd, sha  # noqa: F401


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    return sorted((str(i), str(min(groups[normal(t)])[2] if not min(groups[normal(t)])[1] else None), len(groups[normal(t)]), sha(normal(t))) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: exact_dedup.F.substring(exact_dedup.sha256(t), 1, 0)])
def test_exact_odd_rows_and_colliding_digests(spark, odd, digest):
    docs = locatable(odd, "t")
    got = exact_dedup.exact_groups(docs, digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_exact([(r[0], r[1]) for r in ODD])
    assert sum(r.kept for r in got) == len({normal(r[1]) for r in ODD})
    left = exact_dedup.drop_copies(odd, digest)
    assert left.columns == odd.columns and left.count() == len({normal(r[1]) for r in ODD})


def test_exact_empty(spark, odd):
    assert exact_dedup.drop_copies(odd.limit(0)).count() == 0


def brute_print(text):
    words = [w for w in BLANK.split((text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_against_all_pairs(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    prints = {i: brute_print(t) for i, t in rows}
    want = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, DATA).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_every_close_pair_of_prints_meets_once(spark):
    base = 0x0123456789ABCDEF
    masks = [0, 1, 1 << 63, 0b1111, 0xF << 60, 1 | 1 << 13 | 1 << 26 | 1 << 39, 1 << 52 | 1 << 12 | 1 << 25 | 1 << 38, 0b11111, 1 | 1 << 20 | 1 << 30 | 1 << 40 | 1 << 60]
    values = [(base ^ m) - (1 << 64 if (base ^ m) >> 63 else 0) for m in masks]
    got = sorted((r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(v,) for v in values], "print long")).collect())
    assert got == sorted((min(a, b), max(a, b)) for i, a in enumerate(values) for b in values[:i] if 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)


def test_simhash_odd_rows(spark, odd):
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns
    prints = {brute_print(r[1]) for r in ODD}
    assert left.count() == len(set(roots(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]).values()))
    assert simhash.drop_near_copies(odd.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def brute_lines(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        kept, lost = [], 0
        for chunk in line_dedup.chunks(text):
            body = "\n".join(chunk)
            if len(chunk) > 1 and body in seen:
                lost += 1
                continue
            if len(chunk) > 1:
                seen.add(body)
            kept.append(body)
        out.append((doc_id, lost, "\n".join(kept)))
    return out


@pytest.mark.parametrize("weak", [int, lambda d: d % 3])
def test_lines_against_a_loop(spark, weak):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    got = line_dedup.drop_repeated_lines(table(spark, DATA, "documents"), weak).orderBy("doc_id").collect()
    assert [(r.doc_id, r.removed_chunks, r.text) for r in got] == brute_lines(rows)
    assert sum(r.removed_chunks for r in got) > 0


def test_line_chunks_resist_shifts():
    lines = [f"line {i} of the passage" for i in range(60)]
    whole, shifted = line_dedup.chunks("\n".join(lines)), line_dedup.chunks("\n".join(["new", *lines]))
    assert shifted[2:] == whole[-len(shifted[2:]):] and sum(map(len, whole)) == 60


def test_lines_odd_rows(spark, odd):
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == [*odd.columns, "removed_chunks", "removed_lines"]
    got = out.collect()
    assert len(got) == len(ODD) and sum(r.text is None for r in got) == 1
    # the repeated two-line row loses its text once
    assert sorted(r.text for r in got if r.doc_id == 5) in (["", " \n "], [" \n ", " \n "])
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0


def test_lines_find_passages_between_any_neighbours(spark):
    passage = lambda n: [f"passage {n} line {i} " + " ".join(f"w{n}x{i}x{k}" for k in range(60 // n)) for i in range(n)]
    rows = []
    for n in range(1, 13):
        for copy in range(2):
            for trial in range(5):
                before, after = (f"{side} {copy} {n} {trial}" for side in ("before", "after"))
                lines = [line.replace("passage", f"passage {trial}") for line in passage(n)]
                rows.append((1000 * copy + n * 10 + trial, "\n".join([before, *lines, after])))
    # a passage with blank lines in it, in one document twice; one of 50 words; one with an overlap with itself
    long = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows.append((5000, "\n".join(["s", long[0], "", long[1], "m", long[0], "", long[1], "e"])))
    rows += [(6000 + k, f"o{k}\n" + " ".join(f"y{j}" for j in range(50)) + f"\np{k}") for k in range(2)]
    rows.append((7000, "\n".join([" ".join(f"z{k}" for k in range(30))] * 4)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for weak in (int, lambda d: d % 3):
        got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(frame, weak, least=line_dedup.LEAST).collect()}
        for i, text in rows[:120]:
            n = i % 1000 // 10
            lines = text.split("\n")
            assert got[i].text == (text if i < 1000 else "\n".join([lines[0], lines[-1]]))
            assert got[i].removed_lines == (0 if i < 1000 else n)
        assert got[5000].text == "\n".join(["s", long[0], "", long[1], "m", "e"]) and got[5000].removed_lines == 3
        assert all(got[i].removed_lines == 0 for i in (6000, 6001))
        assert got[7000].text == " ".join(f"z{k}" for k in range(30))


def test_op1_leaves_no_passage_twice(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    seen, want = set(), {}
    for doc_id, text in rows:
        lines, found = line_dedup.runs(text, line_dedup.LEAST)
        lost = set()
        for a, n in found:
            body = "\n".join(lines[a : a + n])
            if body in seen:
                lost.update(range(a, a + n))
            seen.add(body)
        want[doc_id] = {i for i in lost if lines[i].split()}
    got = {r.doc_id: r for r in line_dedup.op1_line_dedup(spark, DATA).collect()}
    assert all(got[i].removed_lines >= len(lost) and (got[i].removed_lines > 0) == (len(lost) > 0) for i, lost in want.items())
    assert any(want.values())
