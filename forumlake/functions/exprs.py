"""Column expressions shared by the operators. Built-ins only."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.schema import MODERATORS, SYSTEM_ACTOR


def ntz(moment: datetime | str) -> Column:
    """A zone-less timestamp literal; every `now` of the library is one of these."""
    text = moment.isoformat(sep=" ") if isinstance(moment, datetime) else moment
    return F.lit(text).cast("timestamp_ntz")


def with_optional(requests: DataFrame, **defaults: str) -> DataFrame:
    """The requests with the optional columns they lack (SQL of their default); a given NULL stays."""
    absent = {c: F.expr(default) for c, default in defaults.items() if c not in requests.columns}
    return requests.withColumns(absent) if absent else requests


def image_url(base_url, image_id, image_format) -> Column:
    """base + id + '.' + format, NULL when there is no image."""
    image_id = F.col(image_id) if isinstance(image_id, str) else image_id
    return F.when(image_id.isNotNull(), F.concat_ws("", base_url, image_id, F.lit("."), image_format))


def live(status: str = "status", deleted_at: str = "deleted_at") -> Column:
    """Active and not soft-deleted."""
    return (F.col(status) == "active") & F.col(deleted_at).isNull()


def usable(status: str = "status", deleted_at: str = "deleted_at") -> Column:
    """Accounts that may change their profile: anything but banned or deleted."""
    return F.col(deleted_at).isNull() & (F.col(status) != "banned")


def blank(text: str) -> Column:
    """Only spaces. NULL text gives NULL, so it is not blank."""
    return F.trim(F.col(text)) == ""


def is_distinct(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return ~a.eqNullSafe(b)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds of two zone-less timestamps, free of the session zone."""
    gap = end - start
    parts = {"DAY": 86400.0, "HOUR": 3600.0, "MINUTE": 60.0, "SECOND": 1.0}
    return reduce(
        lambda a, b: a + b,
        [F.extract(F.lit(unit), gap).cast("double") * F.lit(size) for unit, size in parts.items()],
    )


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Message of the first check that holds; NULL when all pass.

    A check that evaluates to NULL does not fire, like a guard on NULL.
    """
    return F.coalesce(*[F.when(condition, F.lit(message)) for condition, message in checks])


def actor_key(column: str) -> Column:
    """Actors are compared as text since the reserved one is not an id."""
    return F.col(column).cast("string")


def is_system(column: str) -> Column:
    return F.coalesce(actor_key(column) == SYSTEM_ACTOR, F.lit(False))


def is_moderator(role: str = "role") -> Column:
    return F.col(role).isin(*MODERATORS)


def order_key(*columns: str) -> Column:
    """A comparable key for min/max aggregates over (time, id) orders."""
    return F.struct(*columns)


def in_domain(column: str, values) -> Column:
    return F.col(column).isin(*values)
