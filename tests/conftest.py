import os
import sys
import tempfile
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql.types import StructField, StructType  # noqa: E402

from forumlake.schema import TABLES  # noqa: E402
from forumlake.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
NOW = "2024-06-01 00:00:00"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="warehouse-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


_DEFAULTS = {
    "type": "university", "login_method": "email", "role": "student", "status": "active", "post_type": "confession",
    "category": "social", "is_active": True, "is_hot": False, "is_hidden": False, "content": "text", "label": "l",
    "score": Decimal(0), "comment_permission": "all", "view_permission": "all", "reason": "spam", "next_user_index": 1,
    "name": "n", "short_name": "s", "display_name": "d", "base_url": "http://x/", "format": "png", "width": 1,
    "height": 1, "size": 1, "value": "v", "is_read": False,
}


@pytest.fixture(scope="session")
def forum(spark):
    """Builds the full table set from sparse row dicts; required columns get plain values."""

    schemas = {n: StructType([StructField(c.name, c.type) for c in TABLES[n]]) for n in TABLES}
    empties = {n: spark.createDataFrame([], schemas[n]) for n in TABLES}

    def build(**rows):
        tables = dict(empties)
        for name in list(rows):
            data = []
            for row in rows.pop(name):
                full = {}
                for c in TABLES[name]:
                    value = row.get(c.name)
                    if value is None and c.required and c.name not in row:
                        value = T0 if c.name.endswith("_at") else _DEFAULTS.get(c.name, f"{c.name}-{row.get('id')}")
                    full[c.name] = value
                data.append(tuple(full[c.name] for c in TABLES[name]))
            tables[name] = spark.createDataFrame(data, schemas[name])
        assert not rows, rows
        return tables

    return build


@pytest.fixture(scope="session")
def frame(spark):
    """A frame from dicts with a DDL schema; absent keys are NULL."""

    def build(ddl, rows):
        names = [part.split()[0] for part in ddl.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)

    return build


def requests(rows):
    """Numbers request rows in arrival order."""
    return [{"request_id": f"r{i:04d}", "requested_at": at(i), **row} for i, row in enumerate(rows)]


def verdicts(outcome, key="request_id"):
    return {r[key]: (r["outcome"], r["reason"]) for r in outcome.decided.collect()}


def reasons(outcome):
    return [v[1] for _, v in sorted(verdicts(outcome).items())]
