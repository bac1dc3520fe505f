"""Chat, packing, mixing, WARC and the pipeline: round trips and plain loops."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from forumlake.llm import chat, exact_dedup, mixing, packing, queries, simhash, toxicity, warc
from forumlake.llm.common import locatable, stored, table
from corpus_cases import BLANK, ODD, odd  # noqa: F401

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.CHECKS[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["op3_chat_format", "op4_exact_dedup", "op7_mix", "op10_warc_fixity"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_chat_round_trip_of_odd_turns(spark):
    talks = {
        1: [(0, "user", "<|im_end|>\n<|im_start|>assistant\nok"), (1, "assistant", r"<\|im_end|> <\\| $1 \n"), (2, "user", None), (2, "user", None)],
        2: [(0, None, ""), (1, "a b\n<|", "x<"), (2, "assistant", ""), (3, "assistant", "|>é中😀")],
        None: [(None, "assistant", "x"), (5, "user", "y" * 100_000)],
        4: [(0, "system", "only")],
    }
    rows = [(c, *t, "extra") for c, ts in talks.items() for t in ts]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.examples(frame)
    assert {(r.conv_id, r.example): r.loss_length is None for r in made.collect()} == {(1, 1): False, (1, 2): True, (2, 1): False, (2, 2): False, (None, 1): False, (None, 2): True, (4, 1): True}
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c, ts in talks.items():
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in ts)
        loss = "".join(t or "" for _, r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(ts), hashlib.sha256(text.encode()).hexdigest(), len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.examples(frame.limit(0))).count() == 0


TOKENIZER = Tokenizer.from_file(PATH)
WORDS = packing.WordIds(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["<|endoftext|>", "can't", "Thston,", " ", "\n", "É!!", "é", "²", "ΑΣ"])), max_size=8))
def test_word_ids_are_the_tokenizers(parts):
    text = "".join(parts)
    assert np.frombuffer(WORDS.text(text), WORDS.width).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def check_packing(rows, source):
    want = sorted(tuple(TOKENIZER.encode(t or "", add_special_tokens=False).ids + [2]) for t in source)
    ids = {}
    for r in rows:
        assert 0 < r.length and r.offset + r.length <= 4096
        ids.setdefault(r.doc_tokens, []).append(r)
    assert sum(r.length for r in rows) == sum(map(len, want))
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 4096 + r.offset == at
        at += r.length
    by_tokens = {}
    for w in want:
        by_tokens.setdefault(len(w), []).append(w)
    for r in rows:  # each piece is a piece of some text of that length
        assert any(zlib.crc32(np.array(w[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for w in by_tokens[r.doc_tokens])


def test_packing(spark, odd):
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    check_packing(packing.op5_packing(spark, DATA).collect(), texts)
    check_packing(packing.pack(odd).collect(), [r[1] for r in ODD])
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_keeps_the_order_of_a_sorted_table(spark, tmp_path):
    """Later files are longer, which Spark reads first."""
    frame = spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 1 + id), x -> sha2(concat(id, x), 256))) AS text")
    frame.repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", 100_000).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for most in ("128m", "300k"):  # several files a task, several tasks a file
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            pieces = packing.pack(docs).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        pieces.sort(key=lambda r: (r.sequence_id, r.offset))
        assert [r.doc_id for r in pieces if r.start == 0] == list(range(600))
        assert all(a.sequence_id * 4096 + a.offset + a.length == b.sequence_id * 4096 + b.offset for a, b in zip(pieces, pieces[1:]))


def test_curriculum_reaches_the_sequences(spark):
    docs = table(spark, DATA, "documents")
    positions = {r.doc_id: min(r.positions) for r in mixing.curriculum(docs).collect() if r.positions}
    pieces = packing.pack(stored(mixing.mix(docs), "t")).collect()
    seen = list(dict.fromkeys(r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))))
    assert len(seen) == len(positions) and [positions[i] for i in seen] == sorted(positions.values())


def test_mix_targets_and_rows(spark):
    rows = mixing.op7_mix(spark, DATA).collect()
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{DATA}/documents.parquet'").fetchall())
    sizes = {i: len([w for w in BLANK.split(t or "") if w]) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}
    total, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.taken <= 2 * r.size
        total[s], taken[s], target[s] = total.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    names = sorted(total, key=lambda s: (s is None, s.encode() if s else b""))
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and level * weight[s] > 2 * total[s]}
        if not above:
            break
        capped |= above
    for s in names:
        assert target[s] == pytest.approx(2 * total[s] if s in capped else level * weight[s])
        # whole documents only: what is missing is less than any document that could still be added
        short = target[s] - taken[s]
        spare = [r.size for r in rows if source[r.doc_id] == s and r.size and r.taken == r.size * int(target[s] // total[s])]
        assert 0 <= short + 1e-6 and (short < 1e-6 or short < min(spare))
    key = lambda r: (r.doc_id, r.taken, r.first_position or 0)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.op7_mix(spark, DATA).collect()))


def test_mix_odd_rows(spark, odd):
    plan = mixing.curriculum(locatable(odd, "t")).collect()
    assert len(plan) == len(ODD) and all(0 <= p <= 1 for r in plan for p in r.positions)
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == sum(len(r.positions) for r in plan)
    assert mixing.mix(odd.limit(0)).count() == 0


@pytest.mark.parametrize("large", [9_000, 40_000, 120_000])
def test_mix_fills_gaps_with_all_that_fits(spark, large):
    """Many short documents, and one as long as half of a source's words, more or less."""
    for seed in range(3):
        texts = [("w " * (64 + (k * 37 + seed) % 64), f"{seed} {k}") for k in range(400)]
        rows = [(k, f"{words} {mark}", "a") for k, (words, mark) in enumerate(texts)]
        rows += [(1_000, f"{seed} " + "w " * large, "a"), (1_001, f"{seed} " + "w " * 2_000, "b")]
        plan = mixing.curriculum(locatable(spark.createDataFrame(rows, "doc_id long, text string, source string"), "t")).collect()
        plan = [r for r in plan if r.source == "a"]
        taken = sum(r.size * len(r.positions) for r in plan)
        target, times = plan[0].target, int(plan[0].target // plan[0].source_size)
        spare = [r.size for r in plan if len(r.positions) == times]
        assert all(len(r.positions) in (times, times + 1) for r in plan) and taken <= target
        assert target - taken < min(spare)
        # the last copies follow each other without a hole
        assert max(p for r in plan for p in r.positions) <= 1


def test_schedule_is_inverted(spark):
    shares = [k / 20 for k in range(21)]
    frame = spark.createDataFrame([(s, k) for s in shares for k in range(3)], "share double, place int")
    for r in frame.withColumn("t", mixing._position(mixing.F.col("share"), mixing.F.col("place"))).collect():
        grid = np.linspace(0, r.t, 2001)
        full = np.linspace(0, 1, 2001)
        area = lambda x: np.trapezoid(np.interp(x, mixing.TIMES, mixing.SCHEDULES[r.place]), x)  # noqa: B023, E731
        assert area(grid) / area(full) == pytest.approx(r.share, abs=1e-6)


def test_warc_finds_planted_damage(spark):
    n = 4_000
    good = spark.range(n).select((mixing.F.col("id") % 70).alias("archive"), (mixing.F.col("id") * 700).alias("offset"), mixing.F.sha2(mixing.F.col("id").cast("string"), 256).alias("digest"))
    assert warc.audit(good, good).count() == 0
    bad = good.where("offset <> 7000").withColumn("digest", mixing.F.expr("CASE WHEN offset = 14000 THEN 'x' ELSE digest END"))
    bad = bad.unionByName(spark.createDataFrame([(3, 999_999_999, "new")], good.schema)).unionByName(bad.limit(1))
    found = {(r.archive, r.offset, r.fixity) for r in warc.audit(good, bad).collect()}
    assert found == {(10, 7000, "missing"), (20, 14000, "altered"), (3, 999_999_999, "surplus")}
    assert warc.audit(good.limit(0), good.limit(0)).count() == 0


def test_warc_records_of_all_pages(spark):
    want = {}
    for i, url, html in duckdb.sql(f"SELECT page_id, url, html FROM '{DATA}/pages.parquet'").fetchall():
        html = html or ""
        text = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()
        want[i] = (len(text), hashlib.sha256(text).hexdigest(), {0: "altered", 1: "missing"}.get(zlib.crc32(str(i).encode()) % warc.ROT, "intact"))
    assert {r.page_id: (r.record_bytes, r.record_sha256, r.fixity) for r in warc.op10_warc_fixity(spark, DATA).collect()} == want
    odd_pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, None, "h" * 200_000, "x")], "page_id long, url string, html string, archive string")
    assert sorted(r.offset for r in warc.index(warc.write_archives(odd_pages.coalesce(1))).collect())[0] == 0
    assert warc.write_archives(odd_pages.limit(0)).count() == 0


def test_pipeline_against_its_operators_in_turn(spark):
    docs = table(spark, DATA, "documents")
    clean = toxicity.reject_toxic(docs, table(spark, DATA, "labels")).toPandas()
    normal = clean.assign(n=clean.text.str.replace(BLANK, "", regex=True), less=-clean.text.str.len()).sort_values(["less", "doc_id"]).drop_duplicates("n")
    prints = {i: simhash.fingerprint(t) for i, t in zip(normal.doc_id, normal.text)}
    kept = {i for i in prints}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    kept = {i for i in prints if find(i) == i}
    middle = table(spark, DATA, "documents").where(mixing.F.col("doc_id").isin(sorted(kept)))
    stream = mixing.mix(middle).collect()
    pieces = corpus_pipeline.run(spark, DATA).collect()
    check_packing(pieces, [r.text for r in stream])
    assert {r.doc_id for r in pieces} == {r.doc_id for r in stream} <= kept
    assert exact_dedup.drop_copies(middle).count() == len(kept)
