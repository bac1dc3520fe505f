from conftest import NOW, T0, at
from pyspark.sql import functions as F

from forumlake.operators import audit, purge
from forumlake.operators.outcome import update_stored
from forumlake.sources.tables import append_events, load_dimension, load_tables, register_views, write_snapshot


def test_load_dimension_fills_defaults(spark, tmp_path):
    path = tmp_path / "topics.csv"
    path.write_text('id,value,label,category,is_hot\n1,music,"Nhạc, phim",social,true\n2,sport,Thể thao,event,\n')
    rows = load_dimension(spark, str(path), "topics", NOW).orderBy("id").collect()
    assert [(r["is_hot"], r["is_hidden"], r["display_order"]) for r in rows] == [(True, False, 0), (False, False, 0)]
    assert rows[0]["label"] == "Nhạc, phim" and str(rows[0]["created_at"]) == NOW


def test_snapshot_roundtrip(spark, forum, tmp_path):
    tables = forum(users=[{"id": "u", "school_id": 1}], schools=[{"id": 1}])
    for name in ("users", "schools"):
        write_snapshot(tables[name], str(tmp_path), name)
    loaded = load_tables(spark, str(tmp_path), ["users", "schools"])
    assert loaded["users"].collect() == tables["users"].collect()
    register_views(loaded, "forum_")
    assert spark.sql("SELECT count(*) FROM forum_users JOIN forum_schools s ON school_id = s.id").first()[0] == 1


def test_append_events_by_day(spark, forum, tmp_path):
    logins = forum(user_logins=[{"id": i, "user_id": "u", "logged_in_at": at(i * 1000)} for i in range(4)])["user_logins"]
    path = append_events(logins, str(tmp_path), "user_logins", "logged_in_at")
    append_events(logins, str(tmp_path), "user_logins", "logged_in_at")
    assert spark.read.parquet(path).count() == 8
    assert len([p for p in (tmp_path / "user_logins").iterdir() if p.name.startswith("day=")]) == 3


def test_update_rewrites_touched_partitions_only(spark, forum, frame, tmp_path):
    rows = [{"id": i, "post_id": "p", "user_id": "u", "created_at": at(i * 1440)} for i in range(6)]
    path = str(tmp_path / "comments")
    comments = forum(comments=rows)["comments"].withColumn("day", F.to_date("created_at"))
    comments.write.partitionBy("day").parquet(path)
    before = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "comments").glob("day=*")}
    delta = frame("id BIGINT, content STRING", [{"id": 2, "content": "new"}, {"id": 77, "content": "none"}])
    touched = update_stored(path, delta, "id", "day")
    after = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "comments").glob("day=*")}
    assert [str(d) for d in touched] == ["2024-01-03"]
    assert {d for d in before if before[d] != after[d]} == {"day=2024-01-03"}
    stored = spark.read.parquet(path)
    assert stored.count() == 6 and [r["id"] for r in stored.where("content = 'new'").collect()] == [2]
    assert update_stored(path, delta.where("id = 77"), "id", "day") == []


def _counts(df, *labels):
    return {tuple(r[c] for c in labels): r for r in df.collect()}


def test_domain_audit(forum):
    tables = forum(schools=[{"id": 1, "short_name": "x" * 11}, {"id": 2, "type": "circus"}, {"id": None}])
    found = {k[1]: r["violations"] for k, r in _counts(audit.audit_domains(tables, ["schools"]), "table_name", "rule").items()}
    assert found["short_name length <= 10"] == 1 and found["type in school_types"] == 1 and found["id not null"] == 1
    assert found["name not null"] == 0


def test_unique_audit(forum):
    rows = [{"id": i, "post_id": "p", "user_id": u} for i, u in enumerate(["a", "a", "a", "b", None, None])]
    tables = forum(post_likes=rows)
    found = _counts(audit.audit_unique(tables, ["post_likes"]), "key")
    assert tuple(found[("post_id, user_id",)])[2:] == (1, 2)  # NULLs do not compete
    assert tuple(found[("id",)])[2:] == (0, 0)


def test_unique_audit_counts_values_under_a_number(forum):
    likes = [{"id": i // 2, "post_id": f"p{i}", "user_id": "u"} for i in range(4)]
    tables = forum(post_likes=likes, users=[{"id": "0", "email": "e"}, {"id": "1", "email": "e"}, {"id": "1", "email": None}])
    found = audit.audit_unique(tables, ["users", "post_likes"])
    assert {k: tuple(r)[2:] for k, r in _counts(found, "table_name", "key").items()} == {
        ("users", "id"): (1, 1), ("users", "email"): (1, 1), ("post_likes", "id"): (2, 2), ("post_likes", "post_id, user_id"): (0, 0),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    groups = [line for line in plan if "Aggregate [" in line and "_value" in line]
    assert groups and not any("table_name" in line for line in groups)  # names are not part of every group


def test_reference_audit(forum):
    tables = forum(
        users=[{"id": "u"}],
        moderation_logs=[{"id": 1, "moderator_id": "system"}, {"id": 2, "moderator_id": "u"}, {"id": 3, "moderator_id": "x"}],
        comments=[{"id": 1, "post_id": "p", "user_id": "u"}, {"id": 2, "post_id": "p", "user_id": "u", "parent_comment_id": 9}],
    )
    found = {k: r["orphan_rows"] for k, r in _counts(
        audit.audit_references(tables, ["moderation_logs", "comments"]), "reference").items()}
    assert found[("moderator_id -> users",)] == 1  # the reserved actor is no orphan
    assert found[("post_id -> posts",)] == 2 and found[("parent_comment_id -> comments",)] == 1


def test_check_audit(forum):
    tables = forum(posts=[{"id": "a"}, {"id": "b", "post_type": "poll"}, {"id": "c", "school_id": 1}])
    assert audit.audit_checks(tables).first()["violations"] == 1


def _thread(forum):
    return forum(
        images=[{"id": "i"}], aliases=[{"id": "al", "icon_image_id": "i"}],
        users=[{"id": "a", "email": "a", "alias_id": "al"}, {"id": "b", "email": "b", "alias_id": "al"}],
        posts=[{"id": "pa", "user_id": "a"}, {"id": "pb", "user_id": "b"}],
        comments=[{"id": 1, "post_id": "pb", "user_id": "a"}, {"id": 2, "post_id": "pb", "user_id": "b", "parent_comment_id": 1},
                  {"id": 3, "post_id": "pb", "user_id": "b"}, {"id": 4, "post_id": "pa", "user_id": "b"}],
        comment_likes=[{"id": i, "comment_id": i, "user_id": "b"} for i in (1, 2, 3, 4)],
        user_blocks=[{"id": 1, "owner_id": "b", "target_id": "a"}],
        post_views=[{"id": 1, "user_id": None, "post_id": "pa"}, {"id": 2, "user_id": None, "post_id": "pb"}],
    )


def test_purge_cascades(forum, frame):
    tables = _thread(forum)
    after = purge.purge(tables, "users", frame("id STRING", [{"id": "a"}]))
    left = {n: sorted(r["id"] for r in after[n].collect()) for n in (
        "users", "posts", "comments", "comment_likes", "user_blocks", "post_views", "aliases")}
    assert left == {"users": ["b"], "posts": ["pb"], "comments": [3], "comment_likes": [3], "user_blocks": [],
                    "post_views": [2], "aliases": ["al"]}


def test_purge_of_a_comment_takes_its_replies(forum, frame):
    after = purge.purge(_thread(forum), "comments", frame("id BIGINT", [{"id": 1}]))
    assert sorted(r["id"] for r in after["comments"].collect()) == [3, 4]
    assert sorted(r["id"] for r in after["comment_likes"].collect()) == [3, 4]


def test_purge_clears_optional_links(forum, frame):
    tables = _thread(forum)
    after = purge.purge(tables, "aliases", frame("id STRING", [{"id": "al"}]))
    assert [r["alias_id"] for r in after["users"].collect()] == [None, None] and after["aliases"].count() == 0
    after = purge.purge(tables, "images", frame("id STRING", [{"id": "i"}]))
    assert after["aliases"].first()["icon_image_id"] is None


def test_signup_day(forum):
    from forumlake.plans.views import signup_stats
    rows = signup_stats(forum(users=[{"id": "a", "email": "a"}, {"id": "b", "email": "b"}])).collect()
    assert [(r["signup_date"], r["new_user_count"]) for r in rows] == [(T0.date(), 2)]
