"""Bounded summaries of stored JSON results."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Bounds of a preview, and the mark of references that must survive.
MOST_BYTES = 64 * 1024
MOST_KEYS, MOST_DEPTH, MOST_ITEMS, MOST_CHARS = 128, 3, 8, 1_024
MOST_NODES, MOST_REFS = 200_000, 64
REFERENCE = "downstream_orchestrator"
REFERENCE_KEYS = ("ok", "skipped", "delegated", "classification", "stage", "reason", "source_path")


def _dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def references(value: Any) -> list[dict] | None:
    """Marked references anywhere in a value, in order; None if there is too much to search or to keep."""
    found: list[dict] = []
    stack, seen = [value], 0
    while stack:
        item = stack.pop()
        seen += 1
        if seen > MOST_NODES:
            return None
        if isinstance(item, dict):
            if item.get("classification") == REFERENCE:
                if len(found) >= MOST_REFS:
                    return None
                found.append({k: item[k] for k in REFERENCE_KEYS if k in item})
            else:
                stack.extend(reversed(list(item.values())))
        elif isinstance(item, list):
            stack.extend(reversed(item))
    return found


def preview(value: Any, depth: int = 0) -> Any:
    """A value cut to a bounded depth, width and length, with what was left out counted."""
    if isinstance(value, str):
        return value if len(value) <= MOST_CHARS else {"_type": "string", "chars": len(value), "preview": value[:MOST_CHARS]}
    if not isinstance(value, (dict, list)):
        return value
    if depth >= MOST_DEPTH:
        return {"_type": type(value).__name__, "items": len(value)}
    left = len(value) - MOST_ITEMS
    if isinstance(value, list):
        rows = [preview(v, depth + 1) for v in value[:MOST_ITEMS]]
        return [*rows, {"_omitted_items": left}] if left > 0 else rows
    if value.get("classification") == REFERENCE:
        return {"_type": f"{REFERENCE}_ref", "stage": value.get("stage")}
    out = {k[:256]: preview(v, depth + 1) for k, v in list(value.items())[:MOST_ITEMS]}
    return out | ({"_omitted_items": left} if left > 0 else {})


def compact(raw: str | None, most: int = MOST_BYTES) -> str | None:
    """A result above `most` bytes as a summary with its digest; smaller and already compact ones stay."""
    if raw is None or len(raw.encode()) <= most:
        return raw
    try:
        value = json.loads(raw)
    except ValueError:
        value = None
    if isinstance(value, dict) and isinstance(value.get("_compacted"), dict):
        return raw
    kept = references(value)
    if kept is None:
        return raw
    head = {"schema": 1, "original_bytes": len(raw.encode()), "original_sha256": hashlib.sha256(raw.encode()).hexdigest(), "original_type": "invalid_json" if value is None else type(value).__name__}
    out: dict[str, Any] = {"_compacted": head, "downstream_refs": kept, "summary": {}}
    if isinstance(value, dict):
        size = len(_dump(out).encode())
        for key, item in list(value.items())[:MOST_KEYS]:
            entry = {key[:256]: preview(item)}
            more = len(_dump(entry).encode())
            if size + more <= most:
                out["summary"] |= entry
                size += more
    made = _dump(out)
    return made if len(made.encode()) < len(raw.encode()) else raw


@pandas_udf(T.StringType())
def compact_json(values: pd.Series) -> pd.Series:
    return values.map(lambda v: compact(v) if isinstance(v, str) else None)


def compacted(value: Column, most: int = MOST_BYTES) -> Column:
    """Only rows above the bound go to Python."""
    return F.when(F.octet_length(value) > most, compact_json(value)).otherwise(value)


def patch_digest(fields: Column) -> Column:
    """A digest of a patch, independent of the order of its fields."""
    pairs = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"], e["value"])))
    return F.substring(F.sha1(F.to_json(F.map_from_entries(pairs))), 1, 16)


def chosen_keys(value: Column, keys: tuple[str, ...]) -> Column:
    """A map cut to some keys."""
    return F.map_filter(value, lambda k, v: k.isin(*keys))


def is_strict_json(value: Column) -> Column:
    """Whether a text is JSON without repeated keys."""
    return F.try_parse_json(value).isNotNull()


def project_json(payload: Column, paths: dict[str, str]) -> list[Column]:
    """Columns of nested JSON values as text: name to path; missing ones and wrong types are null."""
    value = F.try_parse_json(payload)
    return [F.try_variant_get(value, path, "string").alias(name) for name, path in paths.items()]


def patch_json(payload: Column, changes: dict[str, Column]) -> Column:
    """A flat JSON object of texts with some values set; null if it is no object."""
    fields = F.from_json(payload, "map<string,string>")
    new = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("string"))])
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*changes))
    return F.when(fields.isNotNull(), F.to_json(F.map_concat(kept, new)))


def failure_count(result: Column) -> Column:
    """Failed jobs and problem documents of a batch result (JSON), missing ones as 0."""
    v = F.try_parse_json(result)
    count = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "long"), F.lit(0))
    return count("failed") + count("problem_documents")
