"""Pages by the position of the last row seen.

A page number makes Spark order all earlier rows again. A cursor, the sort values of the last row of a page, is
a filter that reaches the scan: every page costs what the first one does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns with their directions, True for descending. Nulls come first in ascending order and last in descending order.
Order = Sequence[tuple[str, bool]]


def sorted_by(order: Order) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]


def _same(column: str, value) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def _beyond(column: str, descending: bool, value) -> Column:
    c = F.col(column)
    if value is None:
        return F.lit(False) if descending else c.isNotNull()
    return (c < F.lit(value)) | c.isNull() if descending else c > F.lit(value)


def after(order: Order, cursor: Sequence) -> Column:
    """Rows behind the cursor: later in the first column, or equal there and later in the next, and so on."""
    if len(cursor) != len(order):
        raise ValueError("a cursor has one value for each column of the order")
    steps = []
    for i, (column, descending) in enumerate(order):
        equal = [_same(c, v) for (c, _), v in zip(order[:i], cursor)]
        steps.append(reduce(lambda a, b: a & b, equal + [_beyond(column, descending, cursor[i])]))
    return reduce(lambda a, b: a | b, steps)


def page_after(rows: DataFrame, order: Order, size: int, cursor: Sequence | None = None, skipped: int = 0) -> DataFrame:
    """The first ``size`` rows behind the cursor, or of all rows. The order must end in a unique column.

    ``skipped`` pages are left out; each costs as much as if it were read.
    """
    if size < 1 or skipped < 0:
        raise ValueError("a page must not be before the first, and its size must be at least 1")
    behind = (rows if cursor is None else rows.filter(after(order, cursor))).orderBy(*sorted_by(order))
    return (behind.offset(skipped * size) if skipped else behind).limit(size)


def cursor_of(page: DataFrame, order: Order) -> tuple | None:
    """Where the next page begins; None after an empty page. A page is as long as was asked, so it may be looked at here."""
    last = page.select(*[c for c, _ in order]).tail(1)
    return tuple(last[0]) if last else None


def nth_page(rows: DataFrame, order: Order, size: int, number: int) -> DataFrame:
    """The page reached by following ``number`` cursors."""
    page = page_after(rows, order, size)
    for _ in range(number):
        cursor = cursor_of(page, order)
        if cursor is None:
            return page
        page = page_after(rows, order, size, cursor)
    return page
