"""Bulk account operations: registration, alias and school changes, devices, logins."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake import messages as M
from forumlake.functions.exprs import first_reason, in_domain, is_distinct, ntz, usable, with_optional
from forumlake.functions.groups import link_groups
from forumlake.functions.ranking import ROW, SLICE, carry_forward, keyed_slices, row_index, slice_rows
from forumlake.operators.outcome import Outcome, decide, stamp, with_serial
from forumlake.schema import ENUMS
from forumlake.session import freeze
from forumlake.sources.tables import Tables

ORDER = ("requested_at", "request_id")


def _promoted(status: Column, alias: Column, school: Column) -> Column:
    ready = (status == "pending") & alias.isNotNull() & school.isNotNull()
    return F.when(ready, F.lit("active")).otherwise(status)


def promote_users(users: DataFrame) -> DataFrame:
    """Pending accounts become active once alias and school are both set."""
    return users.withColumn("status", _promoted(F.col("status"), F.col("alias_id"), F.col("school_id")))


# ------------------------------------------------------------------ registration


def _first_claims(open_: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that come first for each of their keys; no earlier open row competes."""
    order = F.struct(*ORDER)
    claimed = open_
    for key in keys:
        first = open_.groupBy(key).agg(F.min(order).alias(f"_first_{key}"))
        claimed = claimed.join(first, key, "left")
    won = F.lit(True)
    for key in keys:
        won = won & (F.col(f"_first_{key}") == order)
    return claimed.withColumn("_won", won)


def register_users(
    tables: Tables, requests: DataFrame, as_of: datetime | str, on_existing: str = "reject"
) -> Outcome:
    """New accounts. Requests: id, email, login_method, status (absent: pending), password_hash (optional).

    In arrival order, the first request for an email and an id creates the account.
    With `on_existing="reject"` a later one with the same email is rejected; with
    `"return"` it is a no-op and `user_id` names the existing account, whatever its
    status. Emails match exactly. Feed the accepted `user_id`s to `user_profiles`.
    """
    requests = with_optional(requests, status="'pending'")
    returning = on_existing == "return"
    users = tables["users"]
    by_email = users.select(F.col("email").alias("_email"), F.col("id").alias("_holder"))
    by_id = users.select(F.col("id").alias("_same_id"))
    known = requests.join(by_email, requests["email"] == by_email["_email"], "left")
    known = known.join(by_id, known["id"] == by_id["_same_id"], "left")
    enum_checks = [
        (~in_domain("login_method", ENUMS["login_method"]), M.BAD_ENUM.format("login_method")),
        (~in_domain("status", ENUMS["user_status"]), M.BAD_ENUM.format("status")),
    ]
    null_checks = [
        (F.col(c).isNull(), M.NULL_VALUE.format(c)) for c in ("id", "email", "login_method", "status")
    ]
    found = F.col("_holder").isNotNull()
    insert_checks = null_checks + [(F.col("_same_id").isNotNull(), M.DUPLICATE_VALUE.format("id"))]
    judged = known.select(
        *[requests[c] for c in requests.columns],
        F.col("_holder"),
        first_reason(*enum_checks).alias("_call_error"),
        F.when(~found | F.lit(not returning), first_reason(*insert_checks)).alias("_insert_error"),
    )

    free = F.col("_call_error").isNull() & F.col("_holder").isNull()
    claims = judged.where(free & F.col("_insert_error").isNull()).select("id", "email", *ORDER)
    winners = _settle_claims(claims)
    order = F.struct(*ORDER)
    emails = winners.select(F.col("email").alias("_won_email"), F.col("id").alias("_won_id"), order.alias("_won_at"))
    ids = winners.select(F.col("id").alias("_used_id"), order.alias("_used_at"))
    settled = judged.join(emails, judged["email"] == emails["_won_email"], "left")
    settled = settled.join(ids, settled["id"] == ids["_used_id"], "left")
    is_winner = F.coalesce(free & F.col("_insert_error").isNull() & (F.col("_won_at") == order), F.lit(False))
    email_taken = F.coalesce(free & (F.col("_won_at") < order), F.lit(False))
    id_error = F.when(F.col("_used_at") < order, F.lit(M.DUPLICATE_VALUE.format("id")))
    insert_error = F.coalesce("_insert_error", id_error)
    if returning:  # a known email is answered before an insert could fail
        reason = F.coalesce("_call_error", F.when(~found & ~email_taken, insert_error))
    else:
        taken = F.when(found | email_taken, F.lit(M.DUPLICATE_VALUE.format("email")))
        reason = F.coalesce("_call_error", insert_error, taken)
    user_id = F.coalesce("_holder", F.when(email_taken, F.col("_won_id")), F.when(is_winner, F.col("id")))
    decided = settled.select(
        *[judged[c] for c in requests.columns],
        F.when(reason.isNull(), user_id).alias("user_id"),
        F.coalesce(is_winner, F.lit(False)).alias("_created"),
        reason.alias("reason"),
    )
    decided = decide(decided, noop=~F.col("_created")).drop("_created")

    def build(outcome: Outcome):
        rows = outcome.applied
        password = F.col("password_hash") if "password_hash" in rows.columns else F.lit(None).cast("string")
        created = rows.select(
            "id", "email", password.alias("password_hash"), "login_method", F.lit("student").alias("role"),
            "status", ntz(as_of).alias("created_at"),
        )
        return {"users": stamp(created, as_of)}, {}

    return Outcome(decided, build)


def _settle_claims(claims: DataFrame) -> DataFrame:
    """Winners among competing (id, email) claims, exactly as one-by-one inserts would pick them.

    A claim wins when no earlier open claim shares its id or email; claims that share
    one with a winner are out. One such round settles everything, unless ids and emails
    are contested crosswise. What is left is thinned out, falls into groups without a
    common id or email, and each group is settled in arrival order.
    """
    columns = claims.columns
    judged = _first_claims(claims, ["id", "email"])
    won = judged.where("_won").select(*columns)
    left = freeze(
        judged.where(~F.col("_won"))
        .select(*columns)
        .join(won.select("id"), "id", "left_anti")
        .join(won.select("email"), "email", "left_anti")
        .select(*columns)
    )
    if left.isEmpty():
        return won
    open_ = freeze(_contenders(left))
    groups = link_groups(
        open_.select(F.concat(F.lit("i"), "id").alias("a"), F.concat(F.lit("e"), "email").alias("b"))
    )
    grouped = open_.join(groups, F.concat(F.lit("i"), "id") == groups["node"]).select("grp", *columns)
    dealt = grouped.repartition("grp").sortWithinPartitions("grp", *ORDER)
    return won.unionByName(freeze(dealt.mapInPandas(_in_arrival_order, claims.schema)))


def _contenders(claims: DataFrame) -> DataFrame:
    """Claims that can still win: of equal ones the first, of those that share an email and whose
    ids nobody else claims the first, and the same with id and email exchanged.

    However many ask for one id or email, only those contested on both sides stay.
    """
    pairs = claims.groupBy("id", "email").agg(F.min(F.struct(*ORDER)).alias("_at"))
    for key, other in (("id", "email"), ("email", "id")):
        asked = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        shared = F.when(F.col("_n") > 1, F.col(key)).alias("_key")
        pairs = (
            pairs.join(asked, key).groupBy(other, shared).agg(F.min(F.struct("_at", key)).alias("_best"))
            .select(F.col(f"_best.{key}").alias(key), other, F.col("_best._at").alias("_at"))
        )
    return pairs.select(*[c if c in ("id", "email") else F.col(f"_at.{c}").alias(c) for c in claims.columns])


def _in_arrival_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Takes claims one by one, group after group; remembers the taken keys of one group only."""
    group, taken = None, set()
    for batch in batches:
        wins = []
        for grp, id_, email in zip(batch["grp"], batch["id"], batch["email"]):
            if grp != group:
                group, taken = grp, set()
            keys = {("id", id_), ("email", email)}
            wins.append(not keys & taken)
            if wins[-1]:
                taken |= keys
        yield batch.loc[wins].drop(columns="grp")


# ------------------------------------------------------------------ alias and school


def assign_aliases(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Alias changes. Requests: user_id, alias_id. `alias_index` is the answer per request.

    A real change takes the alias's next index, in arrival order; asking for the alias
    one already has is a no-op that answers the current index. Indexes come from range
    slices, so an alias or user with most of the requests is spread over tasks.
    """
    users = tables["users"].where(usable()).select(
        F.col("id").alias("_user"),
        F.col("alias_id").alias("_alias"),
        F.col("alias_index").cast("bigint").alias("_index"),
        F.col("school_id").alias("_school"),
        F.col("status").alias("_status"),
    )
    aliases = tables["aliases"].select(F.col("id").alias("_known"), F.col("next_user_index").alias("_next"))
    checked = requests.join(users, requests["user_id"] == users["_user"], "left")
    checked = checked.join(aliases, checked["alias_id"] == aliases["_known"], "left")
    valid = F.col("_user").isNotNull() & F.col("_known").isNotNull()
    rejected = checked.where(~valid).select(
        *[requests[c] for c in requests.columns],
        F.lit(None).cast("bigint").alias("alias_index"),
        F.lit(False).alias("changed"),
        F.lit(M.INVALID_ALIAS).alias("reason"),
    )

    sliced = slice_rows(checked.where(valid), ["user_id"], ORDER)
    before = carry_forward(sliced, "alias_id", "_before", inclusive=False)
    marked = before.withColumn("changed", is_distinct("alias_id", F.coalesce("_before", "_alias")))
    # the order is the same for users and aliases, so the slices are
    changes = marked.where("changed").select(SLICE, ROW, "request_id", "alias_id", "_next")
    numbered = row_index(keyed_slices(changes, ["alias_id"]), "_n").select(
        F.col("request_id").alias("_of"), (F.col("_next") + F.col("_n") - 1).alias("_taken")
    )
    joined = marked.join(numbered, marked["request_id"] == numbered["_of"], "left")
    answered = carry_forward(keyed_slices(joined, ["user_id"]), "_taken", "_latest").select(
        *[F.col(c) for c in requests.columns],
        F.coalesce("_latest", "_index").alias("alias_index"),
        "changed",
        F.lit(None).cast("string").alias("reason"),
    )
    decided = decide(answered.unionByName(rejected), noop=~F.col("changed"))

    def build(outcome: Outcome):
        order = F.struct(*ORDER)
        rows = outcome.accepted
        final = rows.groupBy("user_id").agg(
            F.max_by("alias_id", order).alias("alias_id"),
            F.max_by("alias_index", order).alias("alias_index"),
            F.max("changed").alias("changed"),
        )
        current = tables["users"].select(
            F.col("id").alias("user_id"), "school_id", "status", F.col("updated_alias_at").alias("_at")
        )
        delta = final.join(current, "user_id").select(
            F.col("user_id").alias("id"),
            "alias_id",
            "alias_index",
            F.when(F.col("changed"), ntz(as_of)).otherwise(F.col("_at")).alias("updated_alias_at"),
            _promoted(F.col("status"), F.col("alias_id"), F.col("school_id")).alias("status"),
        )
        taken = rows.where("changed").groupBy(F.col("alias_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
        counters = taken.join(tables["aliases"].select("id", "next_user_index"), "id").select(
            "id", (F.col("next_user_index") + F.col("_n")).alias("next_user_index")
        )
        return {}, {"users": stamp(delta, as_of), "aliases": stamp(counters, as_of)}

    return Outcome(decided, build)


def assign_schools(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """School changes. Requests: user_id, school_id. The school need not be active."""
    users = tables["users"].where(usable()).select(F.col("id").alias("_user"))
    schools = tables["schools"].select(F.col("id").alias("_school"))
    checked = requests.join(users, requests["user_id"] == users["_user"], "left")
    checked = checked.join(schools, checked["school_id"] == schools["_school"], "left")
    reason = first_reason((F.col("_user").isNull() | F.col("_school").isNull(), M.INVALID_SCHOOL))
    decided = decide(checked.select(*[requests[c] for c in requests.columns], reason.alias("reason")))

    def build(outcome: Outcome):
        last = outcome.applied.groupBy("user_id").agg(F.max_by("school_id", F.struct(*ORDER)).alias("school_id"))
        current = tables["users"].select(F.col("id").alias("user_id"), "alias_id", "status")
        delta = last.join(current, "user_id").select(
            F.col("user_id").alias("id"),
            "school_id",
            _promoted(F.col("status"), F.col("alias_id"), F.col("school_id")).alias("status"),
        )
        return {}, {"users": stamp(delta, as_of)}

    return Outcome(decided, build)


# ------------------------------------------------------------------ devices and logins


def _user_exists(tables: Tables, requests: DataFrame) -> DataFrame:
    users = tables["users"].select(F.col("id").alias("_user"))
    return requests.join(users, requests["user_id"] == users["_user"], "left")


def _account_reason() -> tuple:
    return (
        (F.col("user_id").isNull(), M.NULL_VALUE.format("user_id")),
        (F.col("_user").isNull(), M.UNKNOWN_REFERENCE.format("user_id")),
    )


def append_logins(tables: Tables, requests: DataFrame) -> Outcome:
    """Login events. Requests: user_id, ip_address, user_agent, device_info, platform."""
    checked = _user_exists(tables, requests)
    reason = first_reason(*_account_reason())
    decided = decide(checked.select(*[requests[c] for c in requests.columns], reason.alias("reason")))

    def build(outcome: Outcome):
        rows = outcome.applied.select(
            "user_id", "ip_address", "user_agent", "device_info", "platform",
            F.col("requested_at").alias("logged_in_at"), "request_id",
        )
        return {"user_logins": with_serial(tables, "user_logins", rows, "logged_in_at", "request_id").drop("request_id")}, {}

    return Outcome(decided, build)


def upsert_devices(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Push tokens. Requests: user_id, fcm_token, device_id, platform.

    The batch is folded per (user, token): given values replace, missing ones keep.
    Where a token is stored more than once the lowest id is the one updated.
    """
    checked = _user_exists(tables, requests)
    reason = first_reason(*_account_reason(), (F.col("fcm_token").isNull(), M.NULL_VALUE.format("fcm_token")))
    decided = decide(checked.select(*[requests[c] for c in requests.columns], reason.alias("reason")))

    def build(outcome: Outcome):
        key = ["user_id", "fcm_token"]
        folded = outcome.applied.groupBy(*key).agg(
            _last_given("device_id"), _last_given("platform"), F.min(F.struct(*ORDER)).alias("_first")
        )
        named = tables["user_fcms"].join(folded.select(*key), key, "left_semi")
        held = named.groupBy(*key).agg(
            F.min(F.struct("id", "device_id", "platform")).alias("_held")
        )
        both = folded.join(held, key, "left")
        updated = both.where(F.col("_held").isNotNull()).select(
            F.col("_held.id").alias("id"),
            F.coalesce("device_id", "_held.device_id").alias("device_id"),
            F.coalesce("platform", "_held.platform").alias("platform"),
            ntz(as_of).alias("last_used_at"),
        )
        fresh = both.where(F.col("_held").isNull()).select(
            *key, "device_id", "platform",
            ntz(as_of).alias("created_at"), ntz(as_of).alias("last_used_at"),
            F.col("_first.requested_at").alias("requested_at"), F.col("_first.request_id").alias("request_id"),
        )
        return (
            {"user_fcms": lambda: with_serial(tables, "user_fcms", fresh, *ORDER).drop(*ORDER)},
            {"user_fcms": updated},
        )

    return Outcome(decided, build)


def _last_given(column: str) -> Column:
    order = ", ".join(ORDER)
    return F.expr(f"max_by({column}, struct({order})) FILTER (WHERE {column} IS NOT NULL)").alias(column)
