from decimal import Decimal

import pytest
from conftest import NOW, requests, verdicts

from forumlake import messages as M
from forumlake.operators.outcome import apply_outcome
from forumlake.operators.posts import apply_post_edits, ingest_posts, post_key

POST = (
    "request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, school_id INT, content STRING, "
    "topic_ids ARRAY<BIGINT>, topic_scores ARRAY<DECIMAL(10,4)>, image_ids ARRAY<STRING>, status STRING, "
    "hidden_reason STRING, comment_permission STRING, view_permission STRING"
)
GOOD = dict(
    user_id="u1", school_id=1, content="hello", topic_ids=[1], topic_scores=[Decimal("0.5")], image_ids=[],
    status="active", comment_permission="all", view_permission="all",
)
ONE = Decimal(1)


@pytest.fixture(scope="module")
def tables(forum):
    return forum(
        users=[{"id": "u1"}, {"id": "u2", "status": "pending"}, {"id": "u3"},
               {"id": "mod", "role": "moderator"}, {"id": "adm", "role": "admin"}],
        schools=[{"id": 1}, {"id": 2, "is_active": False}],
        topics=[{"id": 1}, {"id": 2}],
        images=[{"id": "i1"}, {"id": "i2"}],
    )


CASES = [
    ({}, None),
    ({"content": "   "}, M.POST_EMPTY),
    ({"content": ""}, M.POST_EMPTY),
    ({"content": "\t"}, None),  # only spaces are trimmed
    ({"content": "x" * 3001}, M.POST_TOO_LONG),
    ({"content": "ữ" * 3000}, None),  # characters, not bytes
    ({"content": None}, M.NULL_VALUE.format("content")),
    ({"image_ids": [f"i{n}" for n in range(11)]}, M.POST_TOO_MANY_IMAGES),
    ({"user_id": "nobody"}, M.POST_BAD_USER),
    ({"user_id": "u2"}, M.POST_BAD_USER),
    ({"user_id": None}, M.POST_BAD_USER),
    ({"school_id": 2}, M.POST_BAD_SCHOOL),
    ({"school_id": 9}, M.POST_BAD_SCHOOL),
    ({"topic_ids": []}, M.POST_NO_TOPIC),
    ({"topic_ids": None}, M.POST_NO_TOPIC),
    ({"topic_ids": [1, 2]}, M.POST_TOPIC_MISMATCH),
    ({"topic_scores": []}, M.POST_TOPIC_MISMATCH),  # an empty score list is a mismatch too
    ({"topic_scores": [None]}, M.NULL_VALUE.format("score")),
    ({"topic_scores": [Decimal(10)]}, M.BAD_RANGE.format("score")),
    ({"topic_ids": [None]}, M.NULL_VALUE.format("topic_id")),
    ({"topic_ids": [1, 1], "topic_scores": [ONE, ONE]}, M.DUPLICATE_VALUE.format("topic_id")),
    ({"topic_ids": [1, 7], "topic_scores": [ONE, ONE]}, M.UNKNOWN_REFERENCE.format("topic_id")),
    ({"image_ids": ["i1", "i1"]}, M.DUPLICATE_VALUE.format("image_id")),
    ({"image_ids": ["i1", "zz"]}, M.UNKNOWN_REFERENCE.format("image_id")),
    ({"image_ids": ["i1", None]}, M.NULL_VALUE.format("image_id")),
    ({"image_ids": None}, None),
    ({"status": "odd"}, M.BAD_ENUM.format("status")),
    ({"status": None}, M.NULL_VALUE.format("status")),
    ({"view_permission": None}, M.NULL_VALUE.format("view_permission")),
    ({"comment_permission": "some"}, M.BAD_ENUM.format("comment_permission")),
    ({"content": " ", "user_id": "nobody"}, M.POST_EMPTY),  # the first failing guard speaks
    ({"status": "hidden", "hidden_reason": "sensitive"}, None),
]


def test_rules(tables, frame):
    batch = frame(POST, requests([{**GOOD, **change} for change, _ in CASES]))
    got = verdicts(ingest_posts(tables, batch, NOW))
    for i, (change, reason) in enumerate(CASES):
        assert got[f"r{i:04d}"][1] == reason, change


def test_rows(tables, frame):
    batch = frame(POST, requests([
        {**GOOD, "topic_ids": [2, 1], "topic_scores": [Decimal("0.25"), Decimal("0.75")], "image_ids": ["i2", "i1"]},
        {**GOOD, "content": " "},
        {**GOOD, "image_ids": ["i1"]},
    ]))
    outcome = ingest_posts(tables, batch, NOW)
    after = apply_outcome(tables, outcome)
    posts = {r["id"]: r for r in after["posts"].collect()}
    keys = [r[0] for r in batch.select(post_key("request_id")).collect()]
    assert set(posts) == {keys[0], keys[2]} and all(len(k) == 12 for k in keys)
    topics = [(r["id"], r["post_id"], r["topic_id"], r["score"]) for r in after["post_topics"].orderBy("id").collect()]
    assert topics == [
        (1, keys[0], 2, Decimal("0.2500")), (2, keys[0], 1, Decimal("0.7500")), (3, keys[2], 1, Decimal("0.5000")),
    ]
    images = [(r["id"], r["post_id"], r["image_id"]) for r in after["post_images"].orderBy("id").collect()]
    assert images == [(1, keys[0], "i2"), (2, keys[0], "i1"), (3, keys[2], "i1")]
    assert [r["id"] for r in after["post_permissions"].orderBy("id").collect()] == [1, 2]


def test_id_already_taken(tables, frame, forum):
    batch = frame(POST, requests([GOOD]))
    first, second = batch.select(post_key("request_id"), post_key("request_id", 1)).first()
    taken = {**tables, "posts": forum(posts=[{"id": first}])["posts"]}
    assert [r.post_id for r in ingest_posts(taken, batch, NOW).applied.collect()] == [second]


def test_short_ids_never_reject(tables, frame, forum, monkeypatch):
    from forumlake.operators import posts as module

    monkeypatch.setattr(module, "ID_LENGTH", 1)  # 64 ids, 43 turns a hash
    batch = frame(POST, requests([GOOD if i % 5 else {**GOOD, "content": " "} for i in range(50)]))
    with_some = {**tables, "posts": forum(posts=[{"id": c} for c in "abcdefgh"])["posts"]}
    got = [sorted((r.request_id, r.post_id) for r in ingest_posts(with_some, batch.repartition(n), NOW).applied.collect()) for n in (1, 3)]
    ids = [i for _, i in got[0]]
    assert got[0] == got[1] and len(ids) == len(set(ids)) == 40 and not set(ids) & set("abcdefgh")
    keys = {r[0]: r[1] for r in batch.select("request_id", post_key("request_id")).collect()}
    seen = set("abcdefgh")
    for request, i in got[0]:  # who comes first to a free id keeps it
        if keys[request] not in seen:
            assert i == keys[request]
        seen.add(keys[request])


EDIT = (
    "request_id STRING, requested_at TIMESTAMP_NTZ, requesting_user_id STRING, post_id STRING, content STRING, "
    "comment_permission STRING, view_permission STRING, moderation_reason STRING"
)


def test_edits(tables, frame, forum):
    posts = [{"id": "p1", "user_id": "u1"}, {"id": "p2", "user_id": "u1", "status": "hidden"},
             {"id": "p3", "user_id": "u1", "status": "deleted", "deleted_at": "gone"}]
    from conftest import T0
    posts[2]["deleted_at"] = T0
    own = {**tables, **{k: v for k, v in forum(
        posts=posts, post_permissions=[{"id": 1, "post_id": "p1"}]).items() if k in ("posts", "post_permissions")}}
    cases = [
        ({"requesting_user_id": "u1", "post_id": "p1"}, M.POST_NO_UPDATE),
        ({"requesting_user_id": "u1", "post_id": "px", "content": "c"}, M.POST_NOT_FOUND),
        ({"requesting_user_id": "u1", "post_id": "p3", "content": "c"}, M.POST_UPDATE_DELETED),
        ({"requesting_user_id": "u1", "post_id": "p2", "content": "c"}, M.POST_UPDATE_HIDDEN),
        ({"requesting_user_id": "u2", "post_id": "p1", "content": "c"}, M.POST_UPDATE_DENIED),
        ({"requesting_user_id": "ghost", "post_id": "p1", "content": "c"}, M.POST_UPDATE_DENIED),  # unknown actors too
        ({"requesting_user_id": "u1", "post_id": "p1", "content": "first", "view_permission": "none"}, None),
        ({"requesting_user_id": "mod", "post_id": "p1", "content": "second", "moderation_reason": "rude"}, None),
        ({"requesting_user_id": "u1", "post_id": "p1", "comment_permission": "school_only"}, None),
    ]
    outcome = apply_post_edits(own, frame(EDIT, requests([c for c, _ in cases])), NOW)
    got = verdicts(outcome)
    assert [got[f"r{i:04d}"][1] for i in range(len(cases))] == [r for _, r in cases]
    after = apply_outcome(own, outcome)
    p1 = after["posts"].where("id = 'p1'").first()
    assert p1["content"] == "second" and str(p1["updated_at"]) == NOW
    perm = after["post_permissions"].first()
    assert (perm["comment_permission"], perm["view_permission"]) == ("school_only", "none")
    log = after["moderation_logs"].collect()
    assert [(r["moderator_id"], r["action"], r["target_id"], r["reason"]) for r in log] == [
        ("mod", "UPDATE_POST", "p1", "rude")]


def test_permission_edit_keeps_updated_at(tables, frame, forum):
    from conftest import T0
    own = {**tables, **{k: v for k, v in forum(posts=[{"id": "p1", "user_id": "u1"}],
                                               post_permissions=[{"id": 1, "post_id": "p1"}]).items()
                        if k in ("posts", "post_permissions")}}
    batch = frame(EDIT, requests([{"requesting_user_id": "u1", "post_id": "p1", "view_permission": "none"}]))
    after = apply_outcome(own, apply_post_edits(own, batch, NOW))
    assert after["posts"].first()["updated_at"] == T0


def test_absent_columns_take_their_defaults(tables, frame, forum):
    ddl = "request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, school_id INT, content STRING"
    plain = frame(ddl, requests([{"user_id": "u1", "school_id": 1, "content": "hello"}]))
    assert verdicts(ingest_posts(tables, plain, NOW)) == {"r0000": ("rejected", M.POST_NO_TOPIC)}  # no topic by default
    ddl += ", topic_ids ARRAY<BIGINT>, topic_scores ARRAY<DECIMAL(10,4)>"
    some = frame(ddl, requests([{"user_id": "u1", "school_id": 1, "content": "hello", "topic_ids": [1], "topic_scores": [ONE]}]))
    outcome = ingest_posts(tables, some, NOW)
    post, rights = outcome.inserts["posts"].first(), outcome.inserts["post_permissions"].first()
    assert (post["status"], post["hidden_reason"], rights["comment_permission"], rights["view_permission"]) == ("active", None, "all", "all")
    now = forum(posts=[{"id": "p", "user_id": "u1"}], users=[{"id": "u1"}])
    edit = frame("request_id STRING, requested_at TIMESTAMP_NTZ, requesting_user_id STRING, post_id STRING, content STRING",
                 requests([{"requesting_user_id": "u1", "post_id": "p", "content": "new"}]))
    assert apply_outcome(now, apply_post_edits(now, edit, NOW))["posts"].first()["content"] == "new"
