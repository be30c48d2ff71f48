"""Join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_nulls(key: str, row_id: str) -> Column:
    """The key, or a value of the row's own that matches nothing.

    A null key never matches either, but an outer join would send all rows
    with a null key to one task.
    """
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(row_id)))
