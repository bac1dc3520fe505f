"""Moderation batches against a one-by-one simulation of the same requests."""

import random

import pytest
from conftest import NOW, T0, at, requests, verdicts

from forumlake import messages as M
from forumlake.operators import moderation as mod
from forumlake.operators.outcome import apply_outcome

ACTION = (
    "request_id STRING, requested_at TIMESTAMP_NTZ, requesting_user_id STRING, post_id STRING, reason_category STRING, "
    "detailed_reason STRING"
)
REMOVE = "request_id STRING, requested_at TIMESTAMP_NTZ, requesting_user_id STRING, comment_id BIGINT, reason STRING"
REPORT = "id BIGINT, post_id STRING, user_id STRING, reason STRING, created_at TIMESTAMP_NTZ"
COMMENT_REPORT = "id BIGINT, comment_id BIGINT, user_id STRING, reason STRING, created_at TIMESTAMP_NTZ"
ACTORS = ["o1", "o2", "x", "mod", "adm", "system", "ghost", None]


@pytest.fixture(scope="module")
def tables(forum):
    people = [{"id": u, "email": u} for u in ("o1", "o2", "x")] + [
        {"id": "mod", "email": "mod", "role": "moderator"}, {"id": "adm", "email": "adm", "role": "admin"}]
    people += [{"id": f"r{i}", "email": f"r{i}"} for i in range(12)]
    posts = [{"id": f"p{i}", "user_id": ["o1", "o2"][i % 2],
              "status": ["active", "active", "active", "hidden", "deleted"][i % 5],
              "deleted_at": T0 if i % 5 == 4 else None} for i in range(10)]
    comments = [{"id": i, "post_id": f"p{i % 10}", "user_id": ["o1", "x"][i % 2],
                 "deleted_at": T0 if i % 7 == 6 else None} for i in range(20)]
    return forum(users=people, posts=posts, comments=comments)


def _state(tables, name):
    return {r["id"]: r.asDict() for r in tables[name].collect()}


def test_post_deletes(tables, frame):
    rng = random.Random(1)
    batch = requests([{"requesting_user_id": rng.choice(ACTORS), "post_id": f"p{rng.randrange(12)}",
                       "reason_category": "other", "detailed_reason": f"d{i}"} for i in range(120)])
    posts, want, log = _state(tables, "posts"), {}, []
    for r in batch:
        post, actor = posts.get(r["post_id"]), r["requesting_user_id"]
        if post is None or post["deleted_at"] is not None:
            want[r["request_id"]] = ("noop", None)
            continue
        code = {post["user_id"]: "user", "system": "system", "mod": "mod", "adm": "mod"}.get(actor)
        if code is None:
            want[r["request_id"]] = ("rejected", M.POST_DELETE_DENIED)
            continue
        post.update(deleted_at=NOW, status="deleted", deleted_reason=code)
        want[r["request_id"]] = ("applied", None)
        if actor != post["user_id"]:
            log.append((len(log) + 1, actor, "DELETE_POST", r["post_id"], "post", r["detailed_reason"]))
    outcome = mod.apply_post_deletes(tables, frame(ACTION, batch), NOW)
    assert verdicts(outcome) == want
    after = apply_outcome(tables, outcome)
    for key, row in _state(after, "posts").items():
        assert (row["status"], row["deleted_reason"]) == (posts[key]["status"], posts[key]["deleted_reason"])
        assert row["updated_at"] == T0
    names = ("id", "moderator_id", "action", "target_id", "target_type", "reason")
    assert sorted(tuple(r[n] for n in names) for r in after["moderation_logs"].collect()) == log


def test_post_hides(tables, frame):
    rng = random.Random(2)
    batch = requests([{"requesting_user_id": rng.choice(ACTORS[:-1]), "post_id": f"p{rng.randrange(12)}",
                       "reason_category": "spam", "detailed_reason": "d"} for _ in range(80)])
    posts, want = _state(tables, "posts"), {}
    for r in batch:
        post, actor = posts.get(r["post_id"]), r["requesting_user_id"]
        if actor not in ("system", "mod", "adm"):
            want[r["request_id"]] = ("rejected", M.POST_HIDE_DENIED)
        elif post is None:
            want[r["request_id"]] = ("rejected", M.POST_NOT_FOUND)
        elif post["status"] != "active":
            want[r["request_id"]] = ("rejected", M.POST_NOT_ACTIVE)
        else:
            post.update(status="hidden", hidden_reason="spam")
            want[r["request_id"]] = ("applied", None)
    outcome = mod.apply_post_hides(tables, frame(ACTION, batch), NOW)
    assert verdicts(outcome) == want
    after = apply_outcome(tables, outcome)
    assert {k: (r["status"], r["hidden_reason"]) for k, r in _state(after, "posts").items()} == {
        k: (r["status"], r["hidden_reason"]) for k, r in posts.items()}
    assert after["moderation_logs"].count() == sum(v[0] == "applied" for v in want.values())


def test_comment_deletes(tables, frame):
    rng = random.Random(3)
    batch = requests([{"requesting_user_id": rng.choice(ACTORS), "comment_id": rng.randrange(22), "reason": "why"}
                      for _ in range(150)])
    posts, comments, want, logged = _state(tables, "posts"), _state(tables, "comments"), {}, 0
    for r in batch:
        comment, actor = comments.get(r["comment_id"]), r["requesting_user_id"]
        if comment is None or comment["deleted_at"] is not None:
            want[r["request_id"]] = ("noop", None)
            continue
        if actor == "system":
            code = M.DELETED_BY_SYSTEM
        elif actor == comment["user_id"]:
            code = M.DELETED_BY_OWNER
        elif actor in ("mod", "adm"):
            code = M.DELETED_BY_MODERATOR
        elif actor == posts[comment["post_id"]]["user_id"]:
            code = M.DELETED_BY_POST_OWNER
        else:
            want[r["request_id"]] = ("rejected", M.COMMENT_DELETE_DENIED)
            continue
        comment.update(deleted_at=NOW, content=f"pre::{code}")
        want[r["request_id"]] = ("applied", None)
        logged += actor != comment["user_id"]
    outcome = mod.apply_comment_deletes(tables, frame(REMOVE, batch), NOW, prefix="pre::")
    assert verdicts(outcome) == want
    after = apply_outcome(tables, outcome)
    assert {k: r["content"] for k, r in _state(after, "comments").items()} == {
        k: r["content"] for k, r in comments.items()}
    assert after["moderation_logs"].count() == logged


def _simulate_reports(tables, reports, threshold):
    posts = {k: r["status"] for k, r in _state(tables, "posts").items()}
    users = set(_state(tables, "users"))
    stored = {(r["post_id"], r["user_id"]) for r in tables["post_reports"].collect()}
    want, log = {}, {}
    for r in sorted(reports, key=lambda r: (r["created_at"], r["id"])):
        pair = (r["post_id"], r["user_id"])
        if pair in stored:
            want[r["id"]] = ("rejected", M.DUPLICATE_VALUE.format("post_id, user_id"))
        elif r["post_id"] not in posts:
            want[r["id"]] = ("rejected", M.UNKNOWN_REFERENCE.format("post_id"))
        elif r["user_id"] not in users:
            want[r["id"]] = ("rejected", M.UNKNOWN_REFERENCE.format("user_id"))
        else:
            count = sum(p == r["post_id"] for p, _ in stored) + 1
            if count >= threshold and posts[r["post_id"]] != "active":
                want[r["id"]] = ("rejected", M.POST_NOT_ACTIVE)
                continue
            stored.add(pair)
            want[r["id"]] = ("applied", None)
            if count >= threshold:
                posts[r["post_id"]] = "hidden"
                log[r["post_id"]] = f"{M.AUTO_HIDE_PREFIX}{count}/{threshold}{M.AUTO_HIDE_SUFFIX}"
    return want, posts, log


def _random_reports(seed, n, key, values):
    rng = random.Random(seed)
    return [{"id": i, key: rng.choice(values), "user_id": rng.choice([f"r{rng.randrange(12)}", "r0", "nobody"]),
             "reason": "spam", "created_at": at(rng.randrange(30))} for i in range(n)]


@pytest.mark.parametrize("threshold,stored", [(3, 0), (1, 0), (4, 3), (2, 5), (9999, 1)])
def test_report_threshold(tables, forum, frame, threshold, stored):
    kept = [{"id": 1000 + i, "post_id": f"p{i % 2}", "user_id": f"r{i}"} for i in range(stored)]
    own = {**tables, "post_reports": forum(post_reports=kept)["post_reports"]}
    reports = _random_reports(threshold, 150, "post_id", ["p0", "p0", "p1", "p3", "p5", "p4", "p99"])
    want, posts, log = _simulate_reports(own, reports, threshold)
    outcome = mod.hide_reported_posts(own, frame(REPORT, reports), NOW, threshold)
    assert verdicts(outcome, "id") == want
    after = apply_outcome(own, outcome)
    assert {k: r["status"] for k, r in _state(after, "posts").items()} == posts
    assert {r["target_id"]: r["reason"] for r in after["moderation_logs"].collect()} == log
    assert after["post_reports"].count() == stored + sum(v[0] == "applied" for v in want.values())


@pytest.mark.parametrize("threshold,stored", [(3, 0), (4, 3), (2, 3)])
def test_comment_report_threshold(tables, forum, frame, threshold, stored):
    kept = [{"id": 1000 + i, "comment_id": 0, "user_id": f"r{i}"} for i in range(stored)]
    own = {**tables, "comment_reports": forum(comment_reports=kept)["comment_reports"]}
    reports = _random_reports(9, 100, "comment_id", [0, 0, 1, 2, 6, 77])
    users, comments = set(_state(own, "users")), _state(own, "comments")
    pairs, want = {(r["comment_id"], r["user_id"]) for r in kept}, {}
    for r in sorted(reports, key=lambda r: (r["created_at"], r["id"])):
        pair = (r["comment_id"], r["user_id"])
        if pair in pairs:
            want[r["id"]] = ("rejected", M.DUPLICATE_VALUE.format("comment_id, user_id"))
        elif r["comment_id"] not in comments:
            want[r["id"]] = ("rejected", M.UNKNOWN_REFERENCE.format("comment_id"))
        elif r["user_id"] not in users:
            want[r["id"]] = ("rejected", M.UNKNOWN_REFERENCE.format("user_id"))
        else:
            pairs.add(pair)
            want[r["id"]] = ("applied", None)
            comment = comments[r["comment_id"]]
            if comment["deleted_at"] is None and sum(c == r["comment_id"] for c, _ in pairs) >= threshold:
                comment.update(deleted_at=NOW, content="pre::" + M.DELETED_BY_SYSTEM)
    outcome = mod.delete_reported_comments(own, frame(COMMENT_REPORT, reports), NOW, threshold, prefix="pre::")
    assert verdicts(outcome, "id") == want
    after = apply_outcome(own, outcome)
    assert {k: r["content"] for k, r in _state(after, "comments").items()} == {
        k: r["content"] for k, r in comments.items()}


def test_threshold_setting(forum):
    settings = forum(system_settings=[
        {"key": M.COMMENT_THRESHOLD_KEY, "value": "5"}, {"key": "bad", "value": "many"}])["system_settings"]
    assert mod.report_threshold(settings, M.COMMENT_THRESHOLD_KEY) == 5
    assert mod.report_threshold(settings, M.POST_THRESHOLD_KEY) == 9999  # another key in the settings does not count
    assert mod.report_threshold(settings, "bad", 7) == 7


def test_threshold_of_the_settings_counts(forum, frame):
    now = forum(
        users=[{"id": u, "email": u} for u in "abc"], posts=[{"id": "p", "user_id": "a"}],
        system_settings=[{"key": M.POST_THRESHOLD_KEY, "value": "2"}],
    )
    rows = [{"id": i, "post_id": "p", "user_id": u, "reason": "spam", "created_at": at(i)} for i, u in enumerate("abc")]
    new = frame("id BIGINT, post_id STRING, user_id STRING, reason STRING, created_at TIMESTAMP_NTZ", rows)
    got = {r.id: (r.outcome, r.hides) for r in mod.hide_reported_posts(now, new, NOW).decided.collect()}
    assert got == {0: ("applied", False), 1: ("applied", True), 2: ("rejected", False)}


def test_deletes_without_a_reason(forum, frame):
    now = forum(users=[{"id": "a", "role": "moderator"}], posts=[{"id": "p", "user_id": "b"}])
    asked = frame("request_id STRING, requested_at TIMESTAMP_NTZ, requesting_user_id STRING, post_id STRING, reason_category STRING",
                  [{"request_id": "r", "requested_at": at(0), "requesting_user_id": "a", "post_id": "p", "reason_category": "mod"}])
    log = mod.apply_post_deletes(now, asked, NOW).inserts["moderation_logs"].collect()
    assert [(r.moderator_id, r.reason) for r in log] == [("a", None)]
