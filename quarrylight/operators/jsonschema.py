"""A small JSON-Schema interpreter that returns every error with its path (GAT-24), and a search for keys in nested JSON (GAT-26)."""

from __future__ import annotations

import datetime
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def _plain(value):
    """1.0 and 1 are one number."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _same(a, b) -> bool:
    return json.dumps(_plain(a), sort_keys=True) == json.dumps(_plain(b), sort_keys=True)


def errors(value, schema: dict, root: dict | None = None, path: str = "$") -> list[str]:
    """All violations of a schema, each as 'path: what'."""
    root = schema if root is None else root
    if "$ref" in schema:
        node = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            node = node.get(part) if isinstance(node, dict) else None
        if not node:
            return [f"{path}: no such schema as {schema['$ref']}"]
        return errors(value, node, root, path)
    out: list[str] = []
    if "oneOf" in schema:
        hits = sum(not errors(value, s, root, path) for s in schema["oneOf"])
        if hits != 1:
            out.append(f"{path}: matches {hits} of oneOf, not one")
        return out
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{path}: not the constant")
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        out.append(f"{path}: not in the enumeration")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [*out, f"{path}: not of type {' or '.join(kinds)}"]
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: shorter than {schema['minLength']}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: does not match {schema['pattern']}")
        if schema.get("format") == "date":
            try:
                if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
                    raise ValueError(value)
                datetime.date.fromisoformat(value)
            except ValueError:
                out.append(f"{path}: not a date")
    elif _is(value, "number"):
        if value < schema.get("minimum", value):
            out.append(f"{path}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{path}: above {schema['maximum']}")
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{path}: {len(value)} items")
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            out.append(f"{path}: items repeat")
        for i, v in enumerate(value):
            out += errors(v, schema.get("items", {}), root, f"{path}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += errors(v, known[k], root, f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    return out


def errors_udf(schema: dict):
    """errors() over Arrow batches of JSON text; text that does not parse is one error, null is null."""

    def one(text: str) -> list[str]:
        try:
            value = json.loads(text)
        except ValueError:
            return ["$: not JSON"]
        return errors(value, schema)

    @F.pandas_udf(ArrayType(StringType()))
    def f(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return f


def key_paths(value, key: str, path: str = "$") -> list[str]:
    """The path of every occurrence of a key, at any depth."""
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            out += [f"{path}.{k}"] * (k == key) + key_paths(v, key, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += key_paths(v, key, f"{path}[{i}]")
    return out


def key_paths_udf(key: str):
    @F.pandas_udf(ArrayType(StringType()))
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: key_paths(json.loads(x), key), na_action="ignore")

    return f
