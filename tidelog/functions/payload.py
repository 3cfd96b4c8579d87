"""Payloads: JSON text in and out of typed columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def encode(*columns: Column | str) -> Column:
    """A JSON object of the columns; null fields are written, so that a payload shows all its fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def field(payload: Column | str, path: str, kind: str | DataType = "string") -> Column:
    """One field by JSON path, without parsing the rest into columns."""
    return F.get_json_object(payload, path).cast(kind)


def decode_strict(payload: Column | str, schema: StructType | str) -> Column:
    """A payload as a struct; one that is not JSON of this shape fails the query instead of turning into nulls."""
    return F.from_json(payload, schema, {"mode": "FAILFAST"})
