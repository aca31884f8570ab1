"""JSON attributes as typed values: comparison and order by storage class, as the document stores have it.

NULL comes before numbers, numbers before text; true and false are the numbers 1 and 0, lists and objects their
JSON text. A number never equals a text: 30 is not "30". Everything here is built-in VARIANT code, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PREDICATES = ("=", "LIKE", ">", "<")
JOINERS = ("AND", "OR", "NOT")


def path_of(key: str) -> str:
    """JSON path of a key; dots go down into objects."""
    return "$" + "".join(f"['{part}']" if "'" not in part else f'["{part}"]' for part in key.split("."))


def extract(document: Column | str, key: str) -> tuple[Column, Column, Column]:
    """(class, number, text) of the value at ``key``: class 0 null or missing or no JSON, 1 number, 2 text."""
    document = F.col(document) if isinstance(document, str) else document
    value = F.try_variant_get(F.try_parse_json(document), path_of(key), "variant")
    kind = F.schema_of_variant(value)
    truth = kind == "BOOLEAN"
    number = truth | kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    cls = F.when(value.isNull() | (kind == "VOID"), 0).when(number, 1).otherwise(2)
    num = F.when(truth, F.try_variant_get(value, "$", "boolean").cast("double")).when(
        number, F.try_variant_get(value, "$", "double")
    )
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(cls == 2, F.to_json(value))
    return cls, num, text


def compare(typed: tuple[Column, Column, Column], predicate: str, value: object) -> Column:
    """Compare extracted values with a Python value. Null on either side is no match."""
    if predicate not in PREDICATES:
        raise ValueError(f"predicate must be one of {PREDICATES}")
    cls, num, text = typed
    if value is None:
        return F.lit(False)
    if predicate == "LIKE":
        shown = F.when(cls == 1, F.regexp_replace(num.cast("string"), r"\.0$", "")).otherwise(text)
        return (cls > 0) & F.coalesce(shown.ilike(str(value).replace("\\", "\\\\")), F.lit(False))
    if isinstance(value, (bool, int, float)):
        value = F.lit(float(value))
        found = {
            "=": (cls == 1) & (num == value),
            ">": (cls == 2) | ((cls == 1) & (num > value)),
            "<": (cls == 1) & (num < value),
        }[predicate]
    else:
        value = F.lit(str(value))
        found = {
            "=": (cls == 2) & (text == value),
            ">": (cls == 2) & (text > value),
            "<": (cls == 1) | ((cls == 2) & (text < value)),
        }[predicate]
    return F.coalesce(found, F.lit(False))


def clause(key: str, predicate: str = "=", value: object = None, document: str = "attributes") -> Column:
    """A condition on one attribute."""
    return compare(extract(document, key), predicate, value)


def join_clauses(clauses: list[Column], joiners: list[str]) -> Column:
    """Clauses joined from the left; "NOT" means "and not"."""
    if len(joiners) != len(clauses) - 1:
        raise ValueError("one joiner between any two clauses")
    steps = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b, "NOT": lambda a, b: a & ~b}
    return reduce(lambda a, pair: steps[pair[0]](a, pair[1]), zip(joiners, clauses[1:]), clauses[0])


def order_by(key: str, descending: bool = False, document: str = "attributes") -> list[Column]:
    """Sort columns for an attribute; an empty key is no order."""
    if not key:
        return []
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in extract(document, key)]
