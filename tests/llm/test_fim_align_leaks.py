"""Fill-in-middle, tokenizer alignment and decontamination against plain loops."""

import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forumlake.llm import align, decontaminate, fill_middle
from forumlake.llm.common import locatable, table
from corpus_cases import ODD, odd, sha  # noqa: F401

LINES = re.compile(r"[^\n]*\n|[^\n]+")
MORE = [
    (20, "one\ntwo\r\n\nthree x\n", "en", "x", 1), (21, "\n" * 50, "en", "x", 1), (22, "a <P> b\nc", "en", "x", 1), (23, "<\nS>\n<S\n<M\n", "en", "x", 1),
    (24, "中文 的\n" * 3000 + "é", "zh", "x", 1), (25, "a\x00b   c\td  e\n\n f", "en", "x", 1), (26, "▁ a", "en", "x", 1), (27, "<|endoftext|> <s> </s> <0x41>", "en", "x", 1),
    (28, "ﬁ ² 🎉\n\n\n x　y", "en", "x", 1), (29, "ABC def ghi 1st İx", "en", "x", 1),
]


@pytest.fixture(scope="module")
def rows(spark, odd):
    ddl = odd.schema
    return odd.unionByName(spark.createDataFrame([(*r, "f", "r", "s", "z", "k") for r in MORE], ddl))


ALL = [(r[0], r[1]) for r in ODD + MORE]


def brute_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    digits = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = LINES.findall(text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (str(doc_id), n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(lines[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    spm_form = h[3] % 100 < spm
    out = f"<S>{s}<P>{p}<M>{m}" if spm_form else f"<P>{p}<S>{s}<M>{m}"
    return (str(doc_id), n, "spm" if spm_form else "psm", len(p), len(m), sha(out), sha(text))


def test_fim_odd_rows(spark, rows):
    made = fill_middle.fill_middle(rows, rate=70, spm=30)
    assert made.columns == [*rows.columns, "fim"]
    out = made.select("doc_id", "fim.*").select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)
    )
    got = sorted(str((str(r[0]), *r[1:])) for r in out.collect())
    assert got == sorted(str(brute_fim(i, t, 70, 30)) for i, t in ALL)
    assert fill_middle.fill_middle(rows.limit(0)).count() == 0
    again = fill_middle.fill_middle(rows.withColumn("FIM", F.lit(1)))
    assert again.columns[-2:] == ["FIM", "fim_"]


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_blocks_find_every_cut(block):
    for text in ("", "a", "\n", "\n\n", "ab\ncé\n\n中文字\nlast", "x" * 300 + "\n" + "é\n" * 90):
        lines = LINES.findall(text)
        tree = fill_middle.Blocks(np.frombuffer(text.encode(), dtype=np.uint8), block)
        assert tree.units == len(lines)
        for k in range(len(lines) + 1):
            head = "".join(lines[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def brute_align(pairs):
    a_path, b_path = public_tokenizers.path(align.VOCABULARY_A), public_tokenizers.path(align.VOCABULARY_B)
    first, second = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    first.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    entry_a = [bytes(byte[c] for c in first.id_to_token(i)) for i in range(50_256)]
    entry_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, range(second.get_piece_size()))]

    def ends(ids, entries):
        out, at = [], 0
        for i in ids:
            at += len(entries[i])
            out.append(at)
        return out

    found, counts = [], Counter()
    for doc_id, text in pairs:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        said = (" " + (text or "")).encode()
        if not text or b"".join(entry_a[i] for i in a) != said or b"".join(entry_b[i] for i in b) != said:
            found.append((doc_id, 0, 0, [], ""))
            continue
        ends_a, ends_b = ends(a, entry_a), ends(b, entry_b)
        at = dict(zip(ends_b, b))
        links = [(x, at[e]) for x, e in zip(a, ends_a) if e in at]
        common, groups, low = sorted(set(ends_a) & set(ends_b)), [], 0
        i = j = 0
        for e in common:
            left, right = [], []
            while i < len(a) and ends_a[i] <= e:
                left.append(str(a[i]))
                i += 1
            while j < len(b) and ends_b[j] <= e:
                right.append(str(b[j]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
            low = e
        assert low == len(said)
        found.append((doc_id, len(a), len(b), links, sha(";".join(groups))))
        counts.update(links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (str(i), n_a, n_b, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest)
        for i, n_a, n_b, links, digest in found
    )


def got_align(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_alignment_against_plain_loops(spark):
    pairs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    assert got_align(align.op12_align(spark, DATA)) == brute_align(pairs)


@pytest.mark.parametrize("block_pairs, hot", [(align.BLOCK_PAIRS, align.HOT), (50, 3)])
def test_alignment_odd_rows_blocks_of_pairs_and_hot_texts(rows, block_pairs, hot):
    docs = rows.withColumnsRenamed({"file": "digest", "row": "copies", "size": "pair"})
    docs = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1"))
    pairs = ALL + [(1, ODD[0][1])] * 2
    assert got_align(align.align(docs, block_pairs=block_pairs, hot=hot)) == brute_align(pairs)
    assert align.align(docs.limit(0)).count() == 0


def test_plain_texts_get_the_first_tokenizers_ids():
    aligner = align.Aligner.of((public_tokenizers.path(align.VOCABULARY_A), public_tokenizers.path(align.VOCABULARY_B)))
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["a  b\n\n c\td\n  e \n", " \n ", "\n\n\n word", "A\r\nB", "don't WE'LL 'sx 12ab ¡é½ _x__ ---=== <|endoftext|>"]
    assert all(align.PLAIN.fullmatch(t) for t in texts)
    for text in texts:
        assert aligner.encode(text)[0].tolist() == aligner.a.encode(" " + text, add_special_tokens=False).ids


def low_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_leaks(docs, items, width=10):
    grams = {}
    for item, text in items:
        words = low_words(text)
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            grams.setdefault(tuple(words[i : i + size]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        words = low_words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (g := tuple(words[i : i + size])) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[g]
        listed = sorted(str(i) for i in found if i is not None)
        out.append((str(doc_id), len(words), len(hit), len(listed), sha(",".join(listed))))
    return sorted(out)


ITEMS = [
    (1, "a B c d"), (2, "w " * 14), (3, None), (4, " .,; "), (5, "one TWO\nthree four five six seven eight nine ten eleven twelve"), (None, "other text"), (6, "other-text"), (6, "abcd"),
    (7, "two three four five six seven eight nine ten eleven"), (10, "E é ß"), (11, "ß 中"),
]
LEAKS = [
    (50, "Say: one, two; three four five six seven eight nine ten eleven twelve, thirteen. other text!"), (51, "one two three four five six seven eight nine x ten eleven twelve"),
    (52, "w w w w w w w w w"), (53, "w w w w w w w w w w end"), (54, "OTHER\n\ntext other text"), (55, "..."),
]


@pytest.fixture(scope="module")
def leaky(spark, rows):
    return rows.unionByName(spark.createDataFrame([(*r, "en", "x", 1, "f", "r", "s", "z", "k") for r in LEAKS], rows.schema))


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 400])
def test_leaks_odd_rows_short_items_and_blocks(spark, leaky, block_bytes):
    items = spark.createDataFrame([(*r, 1, "h") for r in ITEMS], "item_id long, text string, words int, hash string")
    found = decontaminate.scan(locatable(leaky, "t"), items, block_bytes=block_bytes)
    found = found.select("doc_id", "n_words", decontaminate.hit_words(F.col("spans")), F.size("items"), F.sha2(F.array_join("items", ","), 256))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == brute_leaks(ALL + LEAKS, ITEMS)


def test_leaks_removed(spark, leaky):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = Counter({k: n for k, n in Counter((i, h) for i, _, h, _, _ in brute_leaks(ALL + LEAKS, ITEMS)).items() if not k[1]})
    kept = decontaminate.without_documents(leaky, items)
    assert kept.columns == leaky.columns and kept.count() == sum(bad.values())
    cut = decontaminate.without_spans(leaky, items)
    assert cut.columns == leaky.columns and cut.count() == leaky.count()
    texts = {r.doc_id: r.text for r in cut.where("doc_id >= 50").collect()}
    assert texts[50] == "Say: , thirteen. !"
    assert texts[51] == LEAKS[1][1] and texts[52] == LEAKS[2][1] and texts[53] == " end" and texts[54] == "" and texts[55] == "..."
    none = decontaminate.without_spans(leaky, items.limit(0))
    assert sorted(str(r.text) for r in none.collect()) == sorted(str(t) for _, t in ALL + LEAKS)
    assert decontaminate.without_documents(leaky.limit(0), items).count() == 0
    assert decontaminate.scan(locatable(leaky.limit(0), "t"), items).count() == 0


def test_leak_scan_has_no_python_worker_and_no_shuffle_of_texts(spark):
    plan = decontaminate.op13_decontaminate(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1
    assert decontaminate.scan(locatable(table(spark, DATA, "documents"), "t"), table(spark, DATA, "benchmark")).where(F.size("spans") > 0).count() > 0
