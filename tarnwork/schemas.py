"""Declared schemas of the lake, stream and governance tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

ORDERS = _struct(
    ("order_id", _L),
    ("customer_name", _S),
    ("region", _S),
    ("product", _S),
    ("amount", T.DecimalType(10, 2)),
    ("order_date", T.DateType()),
)

DEVICE_EVENT = _struct(
    ("event_id", _L),
    ("device_id", _S),
    ("event_type", _S),
    ("value", _D),
    ("event_time", _TS),
)

WINDOW_COUNT = _struct(("window_start", _TS), ("window_end", _TS), ("device_id", _S), ("event_count", _L))

EMPLOYEES = _struct(
    ("employee_id", _S),
    ("username", _S),
    ("name", _S),
    ("email", _S),
    ("department", _S),
    ("title", _S),
    ("manager_id", _S),
)

MEMBERSHIPS = _struct(("username", _S), ("group", _S))

# Times stay text here: a blank expiry means "never" and text that is no time
# must survive a load (see plans/access.py).
GRANTS = _struct(
    ("username", _S),
    ("table_fqn", _S),
    ("security_level", _I),
    ("granted_at", _S),
    ("expires_at", _S),
)

TABLE_REQUESTS = _struct(
    ("id", _L),
    ("username", _S),
    ("table_fqn", _S),
    ("security_level", _I),
    ("table_owner", _S),
    ("reason", _S),
    ("status", _S),
    ("requested_at", _TS),
    ("decided_at", _TS),
    ("note", _S),
)

APPROVAL_STEPS = _struct(
    ("id", _L),
    ("request_id", _L),
    ("step_order", _I),
    ("approver_role", _S),
    ("approver_username", _S),
    ("status", _S),
    ("decided_at", _TS),
    ("activated_at", _TS),
)

REGISTRATIONS = _struct(
    ("id", _L),
    ("requested_by", _S),
    ("table_fqn", _S),
    ("owner", _S),
    ("security_level", _I),
    ("columns_raw", _S),
    ("table_status", _S),
    ("catalog_status", _S),
    ("note", _S),
    ("created_at", _TS),
)

JOB_CONFIG = _struct(
    (
        "sink",
        T.ArrayType(_struct(("plugin_name", _S), ("namespace", _S), ("table", _S))),
    ),
)

CATALOG_ENTITY = _struct(
    ("fullyQualifiedName", _S),
    ("tags", T.ArrayType(_struct(("tagFQN", _S)))),
    ("owners", T.ArrayType(_struct(("type", _S), ("name", _S)))),
    ("extension", _struct(("securityLevel", _I), ("registeredOwner", _S))),
    ("columns", T.ArrayType(_struct(("name", _S), ("dataType", _S)))),
)
