"""Audits kept by batches against the full audits, and what a batch reads."""

import collections
import glob
import random

import pytest
from conftest import T0

from forumlake.operators import audit
from forumlake.session import shared_dir
from forumlake.streaming import audits
from forumlake.streaming.audits import KEYS, KeptAudit

NAMES = ["users", "posts", "comments", "post_likes", "moderation_logs", "schools"]


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def _state(forum, rng, n):
    maybe = lambda text, k: None if k % 11 == 0 else text
    return forum(
        schools=[{"id": k, "type": rng.choice(["university", "circus"])} for k in range(3)],
        users=[{"id": f"u{rng.randrange(n)}", "email": maybe(f"e{rng.randrange(n)}", k), "school_id": rng.randrange(5)} for k in range(n)],
        posts=[{"id": f"p{rng.randrange(n)}", "user_id": f"u{rng.randrange(2 * n)}", "school_id": maybe(1, k)} for k in range(n)],
        comments=[{"id": k, "post_id": f"p{rng.randrange(n)}", "user_id": "u1", "parent_comment_id": maybe(rng.randrange(2 * n), k)} for k in range(n)],
        post_likes=[{"id": k, "post_id": f"p{rng.randrange(3)}", "user_id": f"u{rng.randrange(4)}"} for k in range(n)],
        moderation_logs=[{"id": k, "moderator_id": rng.choice(["system", "u1", "nobody"])} for k in range(3)],
    )


def _check(kept, tables):
    assert _rows(kept.unique(NAMES)) == _rows(audit.audit_unique(tables, NAMES))
    assert _rows(kept.references_found(NAMES)) == _rows(audit.audit_references(tables, NAMES))
    assert _rows(kept.domains()) == _rows(audit.audit_domains(tables, NAMES))
    assert _rows(kept.checks()) == _rows(audit.audit_checks(tables))


def _only(tables, *names):
    return {n: tables[n] for n in names}


def test_batches_come_and_go(spark, forum, tmp_path):
    rng = random.Random(5)
    first, second = _state(forum, rng, 20), _state(forum, rng, 12)
    kept = KeptAudit(spark, str(tmp_path / "audit"), fold=2, buckets=3)
    kept.apply(0, _only(first, *NAMES))
    _check(kept, first)
    kept.apply(1, _only(second, *NAMES))
    both = {n: first[n].unionByName(second[n]) for n in first}
    _check(kept, both)
    # the parents go, and what they leave behind are orphans; sent twice it counts once
    for _ in range(2):
        kept.apply(2, {}, _only(first, "posts", "users"))
    _check(kept, {**both, "posts": second["posts"], "users": second["users"]})
    # a table's rows are replaced within one batch, another one's rows go and come as they were
    kept.apply(3, {"posts": first["posts"], "comments": second["comments"]}, {"posts": second["posts"], "comments": second["comments"]})
    _check(kept, {**both, "posts": first["posts"], "users": second["users"]})


def test_nothing_yet(spark, forum, tmp_path):
    kept = KeptAudit(spark, str(tmp_path / "audit"))
    assert {r["orphan_rows"] for r in kept.references_found().collect()} == {0}
    kept.apply(0, {})
    assert kept.domains().count() == 0 and {r["repeated_keys"] for r in kept.unique().collect()} == {0}


def test_a_batch_opens_only_the_buckets_of_its_values(spark, forum, tmp_path):
    kept = KeptAudit(spark, str(tmp_path / "audit"), buckets=8)
    kept.apply(0, {"post_likes": forum(post_likes=[{"id": k, "post_id": f"p{k}", "user_id": "u", "created_at": T0} for k in range(64)])["post_likes"]})
    touched = spark.createDataFrame([(["7"],)], "v ARRAY<STRING>")
    opened = kept.keys.before(1, KEYS, touched)
    scans = [line for line in opened._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [" in s and "bucket" in s.split("PartitionFilters: ")[1] for s in scans)
    assert [r["n"] for r in opened.where("key = 'id'").collect()] == [1]


@pytest.mark.parametrize("name", ["users", "posts"])
def test_single_table(spark, forum, tmp_path, name):
    tables = _state(forum, random.Random(9), 10)
    kept = KeptAudit(spark, str(tmp_path / "audit"))
    kept.apply(0, _only(tables, name))
    assert _rows(kept.unique([name])) == _rows(audit.audit_unique(tables, [name]))


def test_a_batch_is_grouped_once_and_not_checkpointed(spark, forum, tmp_path):
    first = _only(_state(forum, random.Random(7), 12), *NAMES)
    folders = lambda: set(glob.glob(f"{shared_dir(spark)}/**/rdd-*", recursive=True))
    before = folders()
    kept = KeptAudit(spark, str(tmp_path / "audit"))
    kept.apply(0, first)
    assert folders() == before
    assert sorted(p.name for p in (tmp_path / "audit").iterdir()) == ["done", "keys", "totals"]
    # a post that is there and used is one row: its rows, and its uses by reference
    want = collections.Counter(r["id"] for r in first["posts"].collect())
    used = collections.Counter(r["post_id"] for n in ("comments", "post_likes") for r in first[n].collect())
    rows = kept.keys.before(1, KEYS).where("table_name = 'posts' AND key = 'id'").collect()
    assert len(rows) == len(set(want) | set(used))
    assert {r["_value"][0]: (r["n"], sum(r["uses"] or [])) for r in rows} == {p: (want[p], used[p]) for p in set(want) | set(used)}


def test_sets_of_rules_of_several_numbers(spark, forum, tmp_path, monkeypatch):
    monkeypatch.setattr(audits, "WORD", 12)
    tables = _state(forum, random.Random(3), 15)
    tables["users"] = tables["users"].selectExpr("* EXCEPT (role, updated_at)", "IF(id > 'u5', 'x', NULL) AS role", "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at")
    kept = KeptAudit(spark, str(tmp_path / "audit"))
    kept.apply(0, _only(tables, "users", "posts"))
    got = {tuple(r) for r in kept.domains().collect()}
    assert got == {tuple(r) for r in audit.audit_domains(tables, ["users", "posts"]).collect()}
    assert {n for _, rule, n in got if rule in ("updated_at not null", "status not null")} == {0, 15}
