"""In-plan checks: a broken rule fails the job in the task that meets it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {str: "string", int: "bigint", bool: "boolean", float: "double"}


def required(value: Column, message: str | Column, default: str | int) -> Column:
    """The value, or an error if it is null.

    ``default`` is never returned. Being a literal it makes the column non-nullable, so Spark adds no
    null filters for it in joins.
    """
    kind = _TYPES[type(default)]
    message = F.lit(message) if isinstance(message, str) else message
    return F.coalesce(value.cast(kind), F.raise_error(message).cast(kind), F.lit(default).cast(kind))
