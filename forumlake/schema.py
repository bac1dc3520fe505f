"""Data model: tables, column rules, keys and the foreign-key graph.

Everything the audits, the loaders and the purge need is derived from the
`TABLES` declaration, so a rule is stated once, next to its column.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
BOOL, TIME, SCORE = T.BooleanType(), T.TimestampNTZType(), T.DecimalType(5, 4)

NOW = object()  # column default that is filled with the caller's as_of

# Enum domains of the data model.
ENUMS: dict[str, tuple[str, ...]] = {
    "school_types": ("university", "academy", "college"),
    "user_roles": ("admin", "moderator", "school_admin", "teacher", "student", "npc"),
    "user_status": ("active", "pending", "banned", "deleted"),
    "login_method": ("email", "google"),
    "banned_reason": ("system", "mod", "violation", "other"),
    "post_status": ("active", "hidden", "deleted"),
    "post_types": ("confession", "class_announcement", "class_document", "advertisement", "poll"),
    "permission_type": ("school_only", "all", "none"),
    "hidden_reason": ("report", "sensitive", "spam", "ml_error", "other"),
    "deleted_reason": ("user", "system", "mod", "violation", "other"),
    "topic_category": ("social", "academic", "utility", "event"),
}

SYSTEM_ACTOR = "system"
MODERATORS = ("moderator", "admin")


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    required: bool = False
    length: int | None = None
    enum: str | None = None
    default: Any = None
    ref: str | None = None
    on_delete: str = "cascade"


def _text(name, length=None, **rules):
    return Column(name, STRING, length=length, **rules)


def _enum(name, domain, **rules):
    return Column(name, STRING, enum=domain, **rules)


def _now(name, **rules):
    return Column(name, TIME, required=rules.pop("required", True), default=NOW)


def _serial(name="id", type_=LONG):
    return Column(name, type_, required=True)


def _ref(name, table, type_=STRING, required=True, **rules):
    return Column(name, type_, required=required, ref=table, **rules)


_POST = _ref("post_id", "posts", length=12)
_USER = _ref("user_id", "users", length=128)
_COMMENT = _ref("comment_id", "comments", LONG)

TABLES: dict[str, tuple[Column, ...]] = {
    "system_settings": (
        _text("key", 64, required=True),
        _text("value", 255, required=True),
        _text("description"),
        _now("updated_at"),
        Column("deleted_at", TIME),
    ),
    "images": (
        _text("id", 128, required=True),
        _text("base_url", 255, required=True),
        _text("format", 10, required=True),
        Column("width", INT, required=True),
        Column("height", INT, required=True),
        Column("size", LONG, required=True),
        _now("created_at"),
    ),
    "schools": (
        _serial(type_=INT),
        Column("is_active", BOOL, required=True, default=False),
        _ref("logo_image_id", "images", required=False, length=128, on_delete="set null"),
        _text("name", 255, required=True),
        _text("short_name", 10, required=True),
        _enum("type", "school_types", required=True),
        _now("created_at"),
        _now("updated_at"),
    ),
    "aliases": (
        _text("id", required=True),
        _ref("icon_image_id", "images", required=False, length=128, on_delete="set null"),
        _text("display_name", 100, required=True),
        Column("next_user_index", LONG, required=True, default=1),
        _now("created_at"),
        _now("updated_at"),
    ),
    "users": (
        _text("id", 128, required=True),
        _ref("school_id", "schools", INT, required=False),
        _ref("alias_id", "aliases", required=False, on_delete="set null"),
        _text("email", 255, required=True),
        _text("password_hash", 255),
        _enum("login_method", "login_method", required=True),
        _enum("role", "user_roles", required=True, default="student"),
        _enum("status", "user_status", required=True),
        _enum("banned_reason", "banned_reason"),
        _enum("deleted_reason", "deleted_reason"),
        Column("alias_index", INT),
        Column("updated_alias_at", TIME),
        Column("updated_user_name_at", TIME),
        _now("created_at"),
        _now("updated_at"),
        Column("deleted_at", TIME),
    ),
    "user_logins": (
        _serial(), _USER,
        _text("ip_address"), _text("user_agent"), _text("device_id", 255),
        _text("device_info"), _text("platform", 50), _text("location"),
        _now("logged_in_at"),
    ),
    "user_fcms": (
        _serial(), _USER,
        _text("fcm_token", required=True), _text("device_id", 255), _text("platform", 50),
        _now("created_at"), _now("last_used_at"),
    ),
    "user_blocks": (
        _serial(),
        _ref("owner_id", "users", length=128),
        _ref("target_id", "users", length=128),
        _now("created_at"),
    ),
    "topics": (
        _serial(),
        _enum("category", "topic_category", required=True),
        _text("value", 255, required=True),
        _text("label", required=True),
        Column("is_hot", BOOL, required=True, default=False),
        Column("is_hidden", BOOL, required=True, default=False),
        Column("display_order", INT, default=0),
        _now("created_at", required=False),
        _now("updated_at"),
    ),
    "posts": (
        _text("id", 12, required=True),
        _enum("post_type", "post_types", required=True),
        _USER,
        _ref("school_id", "schools", INT, required=False),
        _enum("status", "post_status", required=True, default="active"),
        _text("content", required=True),
        _enum("hidden_reason", "hidden_reason"),
        _enum("deleted_reason", "deleted_reason"),
        _now("created_at"),
        _now("updated_at"),
        Column("deleted_at", TIME),
    ),
    "post_topics": (
        _serial(), _POST, _ref("topic_id", "topics", LONG),
        Column("score", SCORE, required=True, default=0),
        _now("created_at"),
    ),
    "post_images": (
        _serial(), _POST, _ref("image_id", "images", length=128), _now("created_at"),
    ),
    "post_permissions": (
        _serial(), _POST,
        _enum("comment_permission", "permission_type", required=True, default="all"),
        _enum("view_permission", "permission_type", required=True, default="all"),
        _now("created_at"),
    ),
    "post_likes": (_serial(), _POST, _USER, _now("created_at")),
    "post_dislikes": (_serial(), _POST, _USER, _now("created_at")),
    "post_saves": (_serial(), _POST, _USER, _now("created_at")),
    "post_reports": (_serial(), _POST, _USER, _text("reason", required=True), _now("created_at")),
    "post_views": (
        _serial(), _ref("user_id", "users", required=False, length=128), _POST,
        _text("device_id", 255), Column("view_duration_ms", INT), _now("viewed_at"),
    ),
    "post_shares": (_serial(), _POST, _USER, _text("platform", 50), _now("created_at")),
    "comments": (
        _serial(), _POST, _USER,
        _ref("parent_comment_id", "comments", LONG, required=False),
        _text("content", required=True),
        _now("created_at"),
        _now("updated_at"),
        Column("deleted_at", TIME),
    ),
    "comment_likes": (_serial(), _COMMENT, _USER, _now("created_at")),
    "comment_dislikes": (_serial(), _COMMENT, _USER, _now("created_at")),
    "comment_reports": (_serial(), _COMMENT, _USER, _text("reason", required=True), _now("created_at")),
    "notifications": (
        _serial(),
        _text("type", 50, required=True), _text("title", required=True), _text("body", required=True),
        _text("data"),
        _text("target_type", 20, required=True), _text("target_id", 128),
        _now("created_at"),
    ),
    "notification_reads": (
        _serial(), _ref("notification_id", "notifications", LONG), _USER,
        Column("is_read", BOOL, required=True, default=False),
        _now("created_at"),
    ),
    "email_logs": (
        _serial(), _text("email", 255, required=True), _text("content", required=True), _now("created_at"),
    ),
    "moderation_logs": (
        _serial(),
        _ref("moderator_id", "users", length=128),
        _text("action", 50, required=True),
        _text("target_id", 128, required=True), _text("target_type", 20, required=True),
        _text("reason"),
        _now("created_at"),
    ),
}

UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "users": ("email",),
    "user_blocks": ("owner_id", "target_id"),
    "topics": ("value",),
    "post_topics": ("post_id", "topic_id"),
    "post_images": ("post_id", "image_id"),
    "post_permissions": ("post_id",),
    "post_likes": ("post_id", "user_id"),
    "post_dislikes": ("post_id", "user_id"),
    "post_saves": ("post_id", "user_id"),
    "post_reports": ("post_id", "user_id"),
    "comment_likes": ("comment_id", "user_id"),
    "comment_dislikes": ("comment_id", "user_id"),
    "comment_reports": ("comment_id", "user_id"),
    "notification_reads": ("notification_id", "user_id"),
}


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    on_delete: str


def primary_key(table: str) -> str:
    return TABLES[table][0].name


def struct_type(table: str) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.type, not c.required) for c in TABLES[table]])


FOREIGN_KEYS: tuple[ForeignKey, ...] = tuple(
    ForeignKey(table, c.name, c.ref, c.on_delete)
    for table, columns in TABLES.items()
    for c in columns
    if c.ref
)
