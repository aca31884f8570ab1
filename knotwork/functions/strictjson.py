"""One definition of "a valid JSON value" and of its canonical spelling, shared by every operator.

Strict JSON: NaN and Infinity are no values, trailing text is an error, a repeated field keeps its last value.
Canonical text: fields sorted, no layout, ASCII escapes, integral floats written as integers, so two texts have
one spelling exactly if they hold the same JSON value.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


class INVALID:
    """Stands for "no valid JSON". A class, since it stays the same object where functions are sent by value."""



def _no_constant(name: str) -> None:
    raise ValueError(name)


def _number(text: str) -> float | int:
    value = float(text)
    if value == value and value not in (float("inf"), float("-inf")) and value.is_integer():
        return int(value)
    return value


_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_float=_number)
_encoder = json.JSONEncoder(sort_keys=True, separators=(",", ":"))


def decode(text: str | None) -> object:
    """The value of a JSON text; INVALID if it is null, cut off, not JSON or nested beyond the parser's depth."""
    if text is None:
        return INVALID
    try:
        return _decoder.decode(text)
    except ValueError as error:
        if "integer string conversion" in str(error):
            limit = sys.get_int_max_str_digits()
            sys.set_int_max_str_digits(0)
            try:
                return _decoder.decode(text)
            except ValueError:
                return INVALID
            finally:
                sys.set_int_max_str_digits(limit)
        return INVALID
    except RecursionError:
        return INVALID


def encode(value: object) -> str:
    """Canonical text of a decoded value; plain strings take the short way."""
    return _encoder.encode(value)


def printable(text: str) -> str:
    """A field name as storable text: lone surrogates, which UTF-8 can't hold, become U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@F.pandas_udf(BooleanType())
def _is_object(texts: pd.Series) -> pd.Series:
    return pd.Series([isinstance(decode(x), dict) for x in texts], dtype="bool")


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return pd.Series([None if (v := decode(x)) is INVALID else encode(v) for x in texts], dtype="object")


def is_json_object(column: Column | str) -> Column:
    """True if the text is a valid JSON object; false for null and for anything else."""
    return _is_object(column)


def canonical_json(column: Column | str) -> Column:
    """Canonical text of a JSON text; null where it is not valid."""
    return _canonical(column)
