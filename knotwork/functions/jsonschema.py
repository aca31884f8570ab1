"""Validation of JSON documents against a JSON Schema, for one document or a column of them.

The keywords that describe resources: type, enum, const, properties, required, additionalProperties, patternProperties,
items, minItems, maxItems, minLength, maxLength, pattern, minimum, maximum, exclusive bounds, allOf, anyOf, oneOf, not,
and $ref into the same schema. Other keywords are passed over, as the standard asks of unknown ones.
"""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from knotwork.functions.strictjson import INVALID, decode

_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(),
}


def _target(root: Any, ref: str) -> Any:
    at = root
    for part in ref.lstrip("#").strip("/").split("/") if ref not in ("#", "") else []:
        at = at[part.replace("~1", "/").replace("~0", "~")]
    return at


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON: true is not 1."""
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def is_valid(value: Any, schema: Any, root: Any = None) -> bool:
    """Whether a decoded value meets the schema; a schema is an object or true or false."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return schema
    within = lambda v, s: is_valid(v, s, root)
    if "$ref" in schema and not within(value, _target(root, schema["$ref"])):
        return False
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_KINDS[k](value) for k in kinds):
            return False
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        return False
    if "const" in schema and not _same(value, schema["const"]):
        return False
    if not all(within(value, s) for s in schema.get("allOf", [])):
        return False
    if "anyOf" in schema and not any(within(value, s) for s in schema["anyOf"]):
        return False
    if "oneOf" in schema and sum(within(value, s) for s in schema["oneOf"]) != 1:
        return False
    if "not" in schema and within(value, schema["not"]):
        return False
    if isinstance(value, dict):
        fields, patterns, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        if any(name not in value for name in schema.get("required", [])):
            return False
        for name, own in value.items():
            rules = [fields[name]] if name in fields else []
            rules += [s for p, s in patterns.items() if re.search(p, name)]
            if not all(within(own, s) for s in rules or [rest]):
                return False
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", float("inf")):
            return False
        return "items" not in schema or all(within(x, schema["items"]) for x in value)
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", float("inf")):
            return False
        return "pattern" not in schema or re.search(schema["pattern"], value) is not None
    elif _KINDS["number"](value):
        low, high = schema.get("minimum", float("-inf")), schema.get("maximum", float("inf"))
        return low <= value <= high and schema.get("exclusiveMinimum", float("-inf")) < value < schema.get("exclusiveMaximum", float("inf"))
    return True


def meets(document: Column | str, schema: Any) -> Column:
    """Whether the documents of a column meet a schema; null and invalid JSON do not."""

    def check(texts: pd.Series) -> pd.Series:
        return pd.Series([(v := decode(x)) is not INVALID and is_valid(v, schema) for x in texts], dtype="bool")

    check.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(check, BooleanType())(document)


def meets_by_type(document: Column | str, kind: Column | str, schemas: dict[str, Any]) -> Column:
    """Whether documents meet the schema of their type; a type without schema takes any object."""

    def check(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        values = ((decode(x), schemas.get(k, {"type": "object"})) for x, k in zip(texts, kinds))
        return pd.Series([v is not INVALID and is_valid(v, s) for v, s in values], dtype="bool")

    check.__annotations__ = {"texts": pd.Series, "kinds": pd.Series, "return": pd.Series}
    return F.pandas_udf(check, BooleanType())(document, kind)
