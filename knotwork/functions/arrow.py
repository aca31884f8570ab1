"""Arrow schemas for Python stages, made on the driver and sent along."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; needs a session, so not for use inside a task."""
    return to_arrow_schema(_parse_datatype_string(ddl))
