"""Semantic queries: measures by dimensions, with filters, segments, a date range and an order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.periods import GRAINS, relative_range
from ledgerloom.plans.cubes import Cube, customer_cube, org_cube
from ledgerloom.schemas import TOTAL

ALL_ORGS = "*"


def in_scope(summary: DataFrame, cube: Cube, scope: str | None) -> DataFrame:
    """The rows the caller may see. A cube without a scope member ignores the scope."""
    if not cube.scope_member:
        return summary
    if scope is None:
        raise PermissionError(f"{cube.name} needs the caller's {cube.scope_member}")
    return summary if scope == ALL_ORGS else summary.filter(F.col(cube.scope_member) == scope)


def cube_query(
    summary: DataFrame,
    cube: Cube,
    measures: Sequence[str],
    dimensions: Sequence[str] = (),
    filters: Mapping[str, Sequence] | None = None,
    segments: Sequence[str] = (),
    granularity: str | None = None,
    date_range: tuple | list | str | None = None,
    as_of: dt.date | str | None = None,
    order: Mapping[str, str] | None = None,
    limit: int | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Filter, group, aggregate, sort, limit.

    ``scope`` is the organisation the caller may see, or ``ALL_ORGS`` for an
    operator of the platform. ``filters`` maps a dimension to allowed values.
    Shares are taken of everything the filters leave, before the limit.
    """
    filters = filters or {}
    cube.check(measures, "measures")
    cube.check([*dimensions, *filters], "dimensions")
    cube.check(segments, "segments")
    missing = {n for m in measures for n in cube.measures[m].needs} - set(summary.columns)
    if missing:
        raise ValueError(f"the chosen source has no {sorted(missing)}")

    rows = in_scope(summary, cube, scope)
    if date_range is not None:
        low, high = relative_range(date_range, as_of)
        rows = rows.filter((F.col(cube.time_member) >= F.lit(low)) & (F.col(cube.time_member) < F.lit(high)))
    for name, values in filters.items():
        rows = rows.filter(cube.dimensions[name].isin(*values))
    for name in segments:
        rows = rows.filter(cube.segments[name])

    keys = [cube.dimensions[d].alias(d) for d in dimensions]
    if granularity is not None:
        keys.append(GRAINS[granularity](cube.time_member).alias(f"{cube.time_member}_{granularity}"))
    aggregates = [cube.measures[m].aggregate.alias(m) for m in measures]
    result = rows.groupBy(*keys).agg(*aggregates) if keys else rows.agg(*aggregates)

    # The grand totals are one row, read from the same rows without the grouping shuffle.
    shares = [m for m in measures if cube.measures[m].share]
    if shares:
        totals = rows.agg(*[cube.measures[m].aggregate.cast("double").alias(m) for m in shares])
        total = totals.select(F.struct(*shares).alias("t")).scalar()
        result = result.withColumns({
            m: F.col(m).cast("double") / F.nullif(total.getField(m), F.lit(0.0)) for m in shares})

    if order:
        named = [F.desc_nulls_last(c) if d == "desc" else F.asc_nulls_last(c) for c, d in order.items()]
        ties = [c for c in [*dimensions] if c not in order]
        result = result.orderBy(*named, *ties)
    return result if limit is None else result.limit(limit)


def segment_totals(summary: DataFrame, cube: Cube, scope: str | None = None) -> DataFrame:
    """Transactions and amount of every segment, in one pass over the summary."""
    totals = in_scope(summary, cube, scope).agg(*[
        F.struct(F.lit(name).alias("segment"), F.sum(F.when(inside, F.col("txn_count"))).alias("total_transactions"),
                 F.sum(F.when(inside, F.col("total_amount"))).cast(TOTAL).alias("total_amount")).alias(name)
        for name, inside in cube.segments.items()])
    return totals.select(F.inline(F.array(*cube.segments)))


# ---- dashboard queries ----------------------------------------------------------------------------------------

def kpi_tiles(summary: DataFrame, cube: Cube, **choice) -> DataFrame:
    names = ["total_amount", "total_transactions", "success_rate", "unique_counterparties", "fee_rate"]
    return cube_query(summary, cube, names, **choice)


def party_distribution(summary: DataFrame, cube: Cube, limit: int = 15, **choice) -> DataFrame:
    filters = {**(choice.pop("filters", None) or {}), "status": ["COMPLETED"]}
    return cube_query(summary, cube, ["total_amount"],
                      ["counterparty_name", "counterparty_id", "counterparty_type"], filters=filters,
                      order={"total_amount": "desc"}, limit=limit, **choice)


def weekly_trend(summary: DataFrame, cube: Cube, by: Sequence[str] = (), **choice) -> DataFrame:
    return cube_query(summary, cube, ["total_amount", "total_transactions"], by, granularity="week",
                      order={"txn_date_week": "asc"}, **choice)


def status_donut(summary: DataFrame, cube: Cube, **choice) -> DataFrame:
    return cube_query(summary, cube, ["total_transactions", "total_txn_pct"], ["status"],
                      order={"total_transactions": "desc"}, **choice)


def top_parties(summary: DataFrame, cube: Cube, limit: int = 10, **choice) -> DataFrame:
    return cube_query(summary, cube, ["total_amount", "total_transactions", "success_rate"],
                      ["counterparty_id", "counterparty_name"], order={"total_amount": "desc"}, limit=limit, **choice)


DRILL_LEVELS = ("org_id", "division_id", "counterparty_id", "txn_date")


def drill_down(summary: DataFrame, cube: Cube, path: Mapping[str, str] | None = None, **choice) -> DataFrame:
    """The next level below ``path``: organisation, division, party, day. Each step adds one filter."""
    path = dict(path or {})
    depth = len(path)
    if tuple(path) != DRILL_LEVELS[:depth] or depth >= len(DRILL_LEVELS):
        raise ValueError(f"a drill path is a prefix of {DRILL_LEVELS[:-1]}")
    return cube_query(summary, cube, ["total_amount", "total_transactions", "success_rate"],
                      DRILL_LEVELS[: depth + 1], filters={k: [v] for k, v in path.items()},
                      order={"total_amount": "desc"}, **choice)


# ---- pre-aggregated rollups -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rollup:
    """A stored aggregate of a cube at a time grain, laid out in month or year partitions."""

    subject: str
    measures: tuple[str, ...]
    dimensions: tuple[str, ...]
    grain: str
    partition: str = "month"
    refresh_minutes: int = 60


# The stored rollups.
ROLLUPS = {
    "org_party_monthly": Rollup("org", ("total_transactions", "total_amount", "total_net_amount", "total_fees", "completed_amount"), (
        "org_id", "division_id", "counterparty_id", "counterparty_name", "counterparty_type", "status",
        "transfer_type"), "month"),
    "org_weekly_trend": Rollup("org", ("total_transactions", "total_amount", "total_net_amount", "total_fees"), ("org_id", "division_id", "transfer_type", "status"), "week"),
    "org_monthly_summary": Rollup("org", ("total_transactions", "total_amount", "total_net_amount", "total_fees", "completed_amount"), ("org_id", "division_id", "transfer_type", "status"), "month"),
    "org_daily_detail": Rollup("org", ("total_transactions", "total_amount", "total_net_amount"), (
        "org_id", "division_id", "counterparty_id", "counterparty_name", "status", "transfer_type"), "day",
        refresh_minutes=30),
    "org_status_quarterly": Rollup("org", ("total_transactions", "total_amount"), ("org_id", "division_id", "status", "transfer_type"),
                                   "quarter", "year"),
    "cust_party_monthly": Rollup("customer", ("total_transactions", "total_amount", "total_net_amount", "total_fees", "completed_amount"), (
        "customer_id", "counterparty_id", "counterparty_name", "counterparty_type", "status", "transfer_type"),
        "month"),
    "cust_weekly_trend": Rollup("customer", ("total_transactions", "total_amount", "total_net_amount"), ("customer_id", "transfer_type", "status"), "week"),
    "cust_daily_detail": Rollup("customer", ("total_transactions", "total_amount", "total_net_amount"), (
        "customer_id", "counterparty_id", "counterparty_name", "status", "transfer_type"), "day",
        refresh_minutes=30),
}


def _cube_of(spec: Rollup) -> Cube:
    return org_cube() if spec.subject == "org" else customer_cube()


def build_rollup(daily: DataFrame, name: str) -> DataFrame:
    """All of one rollup; its period column is ``txn_period``."""
    spec = ROLLUPS[name]
    built = cube_query(daily, _cube_of(spec), spec.measures, spec.dimensions, granularity=spec.grain, scope=ALL_ORGS)
    return built.withColumnRenamed(f"txn_date_{spec.grain}", "txn_period")


def partition_of(spec: Rollup, period: str = "txn_period"):
    if spec.partition == "year":
        return F.year(period)
    return F.year(period) * 100 + F.month(period)


def as_summary(stored: DataFrame, name: str) -> DataFrame:
    """Present a stored rollup with the column names of a daily summary, so semantic queries can read it.

    Sums of sums are exact; measures that a rollup cannot answer are refused by the query.
    """
    return stored.withColumnsRenamed({"total_transactions": "txn_count", "txn_period": "txn_date"})
