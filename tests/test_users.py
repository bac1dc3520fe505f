"""Account batches against a one-by-one simulation of the same requests."""

import random

from conftest import NOW, T0, at, requests, verdicts

from forumlake import messages as M
from forumlake.functions import groups
from forumlake.functions.groups import link_groups
from forumlake.operators import users as U
from forumlake.operators.outcome import apply_outcome
from forumlake.session import freeze

SIGNUP = (
    "request_id STRING, requested_at TIMESTAMP_NTZ, id STRING, email STRING, password_hash STRING, "
    "login_method STRING, status STRING"
)
ALIAS = "request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, alias_id STRING"
SCHOOL = "request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, school_id INT"
DEVICE = (
    "request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, fcm_token STRING, device_id STRING, platform STRING"
)


def _simulate_signups(existing, batch, returning):
    ids, emails = set(existing), {e: i for i, e in existing.items()}
    result = {}
    for r in batch:
        if r["email"] in emails:
            result[r["request_id"]] = ("noop", emails[r["email"]]) if returning else ("rejected", None)
        elif r["id"] in ids:
            result[r["request_id"]] = ("rejected", None)
        else:
            ids.add(r["id"])
            emails[r["email"]] = r["id"]
            result[r["request_id"]] = ("applied", r["id"])
    return result


def test_signups_match_one_by_one_inserts(forum, frame):
    rng = random.Random(3)
    tables = forum(users=[{"id": "i1", "email": "e1"}, {"id": "i2", "email": "e2", "status": "banned"}])
    # few ids and emails, so that they are contested crosswise over several rounds
    batch = requests([
        {"id": f"i{rng.randrange(40)}", "email": f"e{rng.randrange(40)}", "login_method": "email", "status": "pending"}
        for _ in range(150)
    ])
    data = frame(SIGNUP, batch)
    for mode in ("reject", "return"):
        outcome = U.register_users(tables, data, NOW, on_existing=mode)
        got = {r["request_id"]: (r["outcome"], r["user_id"]) for r in outcome.decided.collect()}
        assert got == _simulate_signups({"i1": "e1", "i2": "e2"}, batch, mode == "return")
    after = apply_outcome(tables, outcome)["users"]
    assert after.count() == after.select("id").distinct().count() == after.select("email").distinct().count()


def _one_by_one(tables, data, batch, existing=()):
    outcome = U.register_users(tables, data, NOW)
    got = {r["request_id"]: (r["outcome"], r["user_id"]) for r in outcome.decided.collect()}
    assert got == _simulate_signups(dict(existing), batch, False)


def test_chain_of_claims_takes_few_rounds(monkeypatch, forum, frame):
    """Each claim loses to or wins over the one before it: a thousand links in a row."""
    frozen = []
    monkeypatch.setattr(groups, "freeze", lambda df: frozen.append(1) or freeze(df))
    links = [(f"i{(k + 1) // 2}", f"e{k // 2}") for k in range(1000)]
    batch = requests([{"id": i, "email": e, "login_method": "email", "status": "pending"} for i, e in links])
    _one_by_one(forum(users=[]), frame(SIGNUP, batch), batch)
    assert len(frozen) <= 2 + 12


def test_hot_email_and_hot_id(forum, frame):
    """Most requests ask for one email or one id, whose first claims are contested crosswise."""
    rng = random.Random(11)
    some = [("a", "x"), ("a", "hot"), ("hot", "x"), ("hot", "hot")]
    some += [(f"n{k}", "hot") for k in range(60)] + [("hot", f"n{k}") for k in range(60)]
    some += [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(60)]
    for seed in (1, 2):
        random.Random(seed).shuffle(some)
        batch = requests([{"id": i, "email": e, "login_method": "email", "status": "pending"} for i, e in some])
        _one_by_one(forum(users=[]), frame(SIGNUP, batch), batch)


def test_contenders_keep_only_crosswise_claims(frame):
    rows = requests([{"id": f"n{k}", "email": "hot"} for k in range(30)] + [{"id": "n7", "email": "b"}, {"id": "n7", "email": "c"}])
    ddl = "request_id STRING, requested_at TIMESTAMP_NTZ, id STRING, email STRING"
    claims = frame(ddl, rows).select("id", "email", "requested_at", "request_id")
    kept = {(r["id"], r["email"]) for r in U._contenders(claims).collect()}
    assert kept == {("n0", "hot"), ("n7", "hot"), ("n7", "b")}


def test_link_groups(spark):
    rng = random.Random(4)
    pairs = [(f"a{rng.randrange(80)}", f"b{rng.randrange(80)}") for _ in range(60)] + [("z", "z")]
    want = {n: n for p in pairs for n in p}
    for _ in pairs:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = link_groups(spark.createDataFrame(pairs, "a STRING, b STRING"))
    assert {r["node"]: r["grp"] for r in got.collect()} == want
    assert link_groups(spark.createDataFrame([], "a STRING, b STRING")).count() == 0


def test_signup_rules(forum, frame):
    tables = forum(users=[{"id": "i1", "email": "e1"}])
    good = {"id": "n", "email": "new", "login_method": "google", "status": "pending"}
    cases = [
        ({**good, "login_method": "sms"}, M.BAD_ENUM.format("login_method")),
        ({**good, "status": "odd"}, M.BAD_ENUM.format("status")),
        ({**good, "email": None}, M.NULL_VALUE.format("email")),
        ({**good, "id": None}, M.NULL_VALUE.format("id")),
        ({**good, "id": "i1"}, M.DUPLICATE_VALUE.format("id")),
        ({**good, "email": "e1"}, M.DUPLICATE_VALUE.format("email")),
        ({**good, "email": "E1"}, None),  # emails are case-sensitive
    ]
    got = verdicts(U.register_users(tables, frame(SIGNUP, requests([c for c, _ in cases])), NOW))
    assert [got[f"r{i:04d}"][1] for i in range(len(cases))] == [r for _, r in cases]


def _simulate_aliases(users, counters, batch):
    users, counters = {k: dict(v) for k, v in users.items()}, dict(counters)
    answers = {}
    for r in batch:
        user = users.get(r["user_id"])
        if user is None or user["status"] == "banned" or r["alias_id"] not in counters:
            answers[r["request_id"]] = ("rejected", None)
            continue
        if user["alias_id"] != r["alias_id"]:
            user["alias_id"], user["alias_index"] = r["alias_id"], counters[r["alias_id"]]
            counters[r["alias_id"]] += 1
            answers[r["request_id"]] = ("applied", user["alias_index"])
        else:
            answers[r["request_id"]] = ("noop", user["alias_index"])
        if user["status"] == "pending" and user["school_id"] is not None:
            user["status"] = "active"
    return users, counters, answers


def test_aliases_match_one_by_one_updates(forum, frame):
    rng = random.Random(5)
    users = {
        f"u{i}": {"school_id": i % 2 or None, "alias_id": [None, "a0"][i % 2], "alias_index": [None, i][i % 2],
                  "status": ["pending", "active", "banned"][i % 3]}
        for i in range(12)
    }
    tables = forum(
        users=[{"id": k, "email": k, **v} for k, v in users.items()],
        aliases=[{"id": f"a{i}", "next_user_index": 10 * i + 1} for i in range(3)],
    )
    batch = requests([
        {"user_id": rng.choice(["u0", "u0", "u1", f"u{rng.randrange(14)}"]),
         "alias_id": rng.choice(["a0", "a0", "a1", "a2", "none"])}
        for _ in range(200)
    ])
    want_users, want_counters, want = _simulate_aliases(users, {f"a{i}": 10 * i + 1 for i in range(3)}, batch)
    outcome = U.assign_aliases(tables, frame(ALIAS, batch), NOW)
    got = {r["request_id"]: (r["outcome"], r["alias_index"]) for r in outcome.decided.collect()}
    assert got == want
    after = apply_outcome(tables, outcome)
    assert {r["id"]: r["next_user_index"] for r in after["aliases"].collect()} == want_counters
    for row in after["users"].collect():
        state = want_users[row["id"]]
        assert (row["alias_id"], row["alias_index"], row["status"]) == (
            state["alias_id"], state["alias_index"], state["status"])


def test_same_alias_is_no_change(forum, frame):
    tables = forum(users=[{"id": "u", "alias_id": "a", "alias_index": 4}], aliases=[{"id": "a", "next_user_index": 9}])
    after = apply_outcome(tables, U.assign_aliases(tables, frame(ALIAS, requests([{"user_id": "u", "alias_id": "a"}])), NOW))
    row = after["users"].first()
    assert (row["alias_index"], row["updated_alias_at"], str(row["updated_at"])) == (4, None, NOW)
    assert after["aliases"].first()["next_user_index"] == 9


def test_schools(forum, frame):
    tables = forum(
        users=[{"id": "p", "status": "pending", "alias_id": "a", "email": "1"}, {"id": "q", "status": "pending", "email": "2"},
               {"id": "b", "status": "banned", "email": "3"}, {"id": "d", "deleted_at": T0, "email": "4"}],
        schools=[{"id": 1}, {"id": 2, "is_active": False}],
    )
    batch = [("p", 1), ("p", 2), ("q", 1), ("b", 1), ("d", 1), ("q", 9), ("x", 1)]
    outcome = U.assign_schools(
        tables, frame(SCHOOL, requests([{"user_id": u, "school_id": s} for u, s in batch])), NOW)
    got = verdicts(outcome)
    assert [got[f"r{i:04d}"][0] for i in range(7)] == ["applied"] * 3 + ["rejected"] * 4
    rows = {r["id"]: (r["school_id"], r["status"]) for r in apply_outcome(tables, outcome)["users"].collect()}
    assert rows == {"p": (2, "active"), "q": (1, "pending"), "b": (None, "banned"), "d": (None, "active")}


def test_devices(forum, frame):
    tables = forum(
        users=[{"id": "u"}],
        user_fcms=[{"id": 1, "user_id": "u", "fcm_token": "t", "device_id": "old"},
                   {"id": 2, "user_id": "u", "fcm_token": "t", "device_id": "twin"}],
    )
    rows = [("u", "t", None, "ios"), ("u", "t", "new", None), ("u", "t", None, "web"), ("u", "s", "d1", None),
            ("u", "s", None, "ios"), ("x", "t", None, None), ("u", None, None, None)]
    names = ("user_id", "fcm_token", "device_id", "platform")
    outcome = U.upsert_devices(tables, frame(DEVICE, requests([dict(zip(names, r)) for r in rows])), NOW)
    got = verdicts(outcome)
    assert [got[f"r{i:04d}"][0] for i in range(7)] == ["applied"] * 5 + ["rejected"] * 2
    after = {r["id"]: (r["fcm_token"], r["device_id"], r["platform"], r["created_at"]) for r in
             apply_outcome(tables, outcome)["user_fcms"].collect()}
    assert after[1][:3] == ("t", "new", "web") and after[2][:3] == ("t", "twin", None)  # the lowest id is kept up
    assert after[3][:3] == ("s", "d1", "ios") and len(after) == 3


def test_logins(forum, frame):
    tables = forum(users=[{"id": "u"}], user_logins=[{"id": 7, "user_id": "u"}])
    ddl = ("request_id STRING, requested_at TIMESTAMP_NTZ, user_id STRING, ip_address STRING, user_agent STRING, "
           "device_info STRING, platform STRING")
    outcome = U.append_logins(tables, frame(ddl, requests([{"user_id": "u"}, {"user_id": "x"}, {"user_id": "u"}])))
    assert [(r["id"], r["logged_in_at"]) for r in outcome.inserts["user_logins"].orderBy("id").collect()] == [
        (8, at(0)), (9, at(2))]
    assert outcome.rejected.count() == 1
