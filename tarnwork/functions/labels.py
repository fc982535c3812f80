"""Column functions on series labels and log lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.functions.once import let

# key=value or key="quoted value"
_PAIR = r'([A-Za-z_][\w.\-/]*)=("(?:[^"\\]|\\.)*"|\S*)'


def _anchored(pattern: str) -> str:
    return rf"^(?s:{pattern})\z"


def label_matches(label: Column, pattern: str) -> Column:
    """``=~``: the whole label matches; a missing label counts as empty text."""
    return F.coalesce(label, F.lit("")).rlike(_anchored(pattern))


def label_not_matches(label: Column, pattern: str) -> Column:
    return ~label_matches(label, pattern)


def label_replace(target: Column, replacement: str, source: Column, pattern: str) -> Column:
    """New value of ``target`` where all of ``source`` matches, else ``target``.

    ``${1}``, ``$1`` and ``${name}`` refer to groups.  An empty result drops the label.
    """
    # Braces are for names only in Java; a backslash-free escape keeps a digit that follows apart.
    java = re.sub(r"\$\{(\d+)\}(?=(\d?))", lambda m: f"${m[1]}" + ("\\" if m[2] else ""), replacement)
    text = F.coalesce(source, F.lit(""))
    whole = _anchored(pattern)
    return F.when(text.rlike(whole), F.nullif(F.regexp_replace(text, whole, java), F.lit(""))).otherwise(target)


def line_contains(line: Column, text: str) -> Column:
    return F.contains(line, F.lit(text))


def line_matches(line: Column, pattern: str) -> Column:
    return line.rlike(pattern)


def logfmt_value(line: Column, key: str) -> Column:
    """One field of a ``key=value`` line, without building a map."""
    escaped = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in key)
    raw = F.regexp_extract(line, rf'(?:^|\s){escaped}=("(?:[^"\\]|\\.)*"|\S*)', 1)
    return F.nullif(_unquote(raw), F.lit(""))


def _unquote(raw: Column) -> Column:
    inner = F.regexp_replace(F.regexp_extract(raw, r'^"((?s:.)*)"\z', 1), r"\\(.)", "$1")
    return F.when(raw.startswith('"'), inner).otherwise(raw)


def logfmt_fields(line: Column) -> Column:
    """map(key -> value) of a ``key=value`` line; the first of equal keys counts."""
    found = F.struct(
        F.regexp_extract_all(line, F.lit(_PAIR), F.lit(1)).alias("keys"),
        F.regexp_extract_all(line, F.lit(_PAIR), F.lit(2)).alias("values"),
    )

    def first_values(pair: Column) -> Column:
        entries = F.transform(
            pair["keys"], lambda k, i: F.struct(k.alias("key"), _unquote(F.get(pair["values"], i)).alias("value"))
        )
        return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(pair["keys"], e["key"]) == i + 1))

    return let(found, first_values)


def pod_log_labels(path: Column) -> Column:
    """struct(namespace, pod, container, job) from a pod log path.

    Layout: ``.../<namespace>_<pod>_<uid>/<container>/<n>.log``.
    """
    layout = r"/([^/_]+)_([^/_]+)_[^/]+/([^/]+)/[^/]+\.log\z"
    namespace = F.nullif(F.regexp_extract(path, layout, 1), F.lit(""))
    container = F.nullif(F.regexp_extract(path, layout, 3), F.lit(""))
    return F.struct(
        namespace.alias("namespace"),
        F.nullif(F.regexp_extract(path, layout, 2), F.lit("")).alias("pod"),
        container.alias("container"),
        F.when(namespace.isNotNull(), F.concat_ws("/", namespace, container)).alias("job"),
    )
