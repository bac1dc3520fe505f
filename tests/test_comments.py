import pytest
from conftest import NOW, T0, requests, verdicts

from forumlake import messages as M
from forumlake.operators.comments import apply_comment_edits, ingest_comments, ingest_replies
from forumlake.operators.outcome import apply_outcome

COMMENT = "request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, post_id STRING, content STRING"
REPLY = "request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, parent_comment_id BIGINT, content STRING"
EDIT = "request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, comment_id BIGINT, content STRING"


@pytest.fixture(scope="module")
def tables(forum):
    return forum(
        users=[{"id": "a", "school_id": 1}, {"id": "b", "school_id": 2}, {"id": "n"},
               {"id": "p", "status": "pending"}, {"id": "d", "deleted_at": T0}],
        posts=[{"id": "open", "school_id": 1}, {"id": "closed", "school_id": 1}, {"id": "local", "school_id": 1},
               {"id": "hidden", "status": "hidden"}, {"id": "bare", "school_id": 1}],
        post_permissions=[{"id": 1, "post_id": "open"}, {"id": 2, "post_id": "closed", "comment_permission": "none"},
                          {"id": 3, "post_id": "local", "comment_permission": "school_only"},
                          {"id": 4, "post_id": "hidden"}],
        comments=[{"id": 10, "post_id": "open", "user_id": "a"},
                  {"id": 11, "post_id": "open", "user_id": "b", "parent_comment_id": 10},
                  {"id": 12, "post_id": "open", "user_id": "a", "deleted_at": T0},
                  {"id": 13, "post_id": "hidden", "user_id": "a"}, {"id": 14, "post_id": "closed", "user_id": "a"},
                  {"id": 15, "post_id": "local", "user_id": "a"}],
    )


def _check(outcome, cases):
    got = verdicts(outcome)
    assert [got[f"r{i:04d}"][1] for i in range(len(cases))] == [reason for _, reason in cases]


def test_comment_rules(tables, frame):
    good = {"user_id": "a", "post_id": "open", "content": "hi"}
    cases = [
        (good, None),
        ({**good, "content": "  "}, M.COMMENT_EMPTY),
        ({**good, "content": "x" * 1001}, M.COMMENT_TOO_LONG),
        ({**good, "content": "x" * 1000}, None),
        ({**good, "user_id": "p"}, M.COMMENT_BAD_USER),
        ({**good, "user_id": "d"}, M.COMMENT_BAD_USER),
        ({**good, "post_id": "hidden"}, M.COMMENT_BAD_POST),
        ({**good, "post_id": "none"}, M.COMMENT_BAD_POST),
        ({**good, "post_id": "closed"}, M.COMMENT_DISABLED),
        ({**good, "post_id": "local"}, None),
        ({**good, "post_id": "local", "user_id": "b"}, M.COMMENT_SCHOOL_ONLY),
        ({**good, "post_id": "local", "user_id": "n"}, M.COMMENT_SCHOOL_ONLY),  # no school is another school
        ({**good, "post_id": "bare", "user_id": "b"}, None),  # no permission row allows
        ({**good, "content": None}, M.NULL_VALUE.format("content")),
    ]
    outcome = ingest_comments(tables, frame(COMMENT, requests([c for c, _ in cases])), NOW)
    _check(outcome, cases)
    rows = outcome.inserts["comments"].orderBy("id").collect()
    assert [r["id"] for r in rows] == [16, 17, 18, 19]  # after the highest id, in arrival order
    assert [r["post_id"] for r in rows] == ["open", "open", "local", "bare"]


def test_reply_rules(tables, frame):
    good = {"user_id": "b", "parent_comment_id": 10, "content": "re"}
    cases = [
        (good, None),
        ({**good, "content": ""}, M.COMMENT_EMPTY),
        ({**good, "content": "x" * 1001}, M.COMMENT_TOO_LONG),
        ({**good, "user_id": "zz"}, M.COMMENT_BAD_USER),
        ({**good, "parent_comment_id": 99}, M.REPLY_BAD_PARENT),
        ({**good, "parent_comment_id": 12}, M.REPLY_BAD_PARENT),
        ({**good, "parent_comment_id": 11}, M.REPLY_TOO_DEEP),
        ({**good, "parent_comment_id": 13}, M.REPLY_BAD_POST),
        ({**good, "parent_comment_id": 14}, M.REPLY_DISABLED),
        ({**good, "parent_comment_id": 15}, M.COMMENT_SCHOOL_ONLY),
    ]
    outcome = ingest_replies(tables, frame(REPLY, requests([c for c, _ in cases])), NOW)
    _check(outcome, cases)
    row = outcome.inserts["comments"].first()
    assert (row["id"], row["post_id"], row["parent_comment_id"]) == (16, "open", 10)


def test_edits(tables, frame):
    good = {"user_id": "a", "comment_id": 10, "content": "one"}
    cases = [
        (good, None),
        ({**good, "content": " "}, M.COMMENT_EMPTY),
        ({**good, "comment_id": 99}, M.EDIT_MISSING),
        ({**good, "comment_id": 12}, M.EDIT_DELETED),
        ({**good, "user_id": "b"}, M.EDIT_DENIED),
        ({**good, "content": "y" * 5000}, None),  # edits have no length limit
        ({**good, "content": "last"}, None),
    ]
    outcome = apply_comment_edits(tables, frame(EDIT, requests([c for c, _ in cases])), NOW)
    _check(outcome, cases)
    after = apply_outcome(tables, outcome)["comments"]
    row = after.where("id = 10").first()
    assert row["content"] == "last" and str(row["updated_at"]) == NOW
    assert after.where("id = 11").first()["updated_at"] == T0
