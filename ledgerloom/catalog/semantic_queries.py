"""Semantic queries and stored rollups over the sample daily summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.oracle_tables import rate2, with_tables
from ledgerloom.operators import rollups
from ledgerloom.plans import cubes, jobs
from ledgerloom.plans import semantic as sem
from ledgerloom.session import fresh_dir
from ledgerloom.sources import sample_tables as st


def org_daily(spark, sf_dir) -> DataFrame:
    return rollups.daily_rollup(st.org_facts(spark, sf_dir), "org")


def customer_daily(spark, sf_dir) -> DataFrame:
    return rollups.daily_rollup(st.customer_facts(spark, sf_dir), "customer")


def _all_orgs(build):
    return lambda s, d: build(org_daily(s, d), cubes.org_division_view(), scope=sem.ALL_ORGS)


def _dimensions(daily: DataFrame, cube: cubes.Cube) -> DataFrame:
    return daily.select(*[column.alias(name) for name, column in cube.dimensions.items()], "txn_count", "total_amount")


def _rollup(name: str):
    source = org_daily if sem.ROLLUPS[name].subject == "org" else customer_daily
    return lambda s, d: sem.build_rollup(source(s, d), name)


def _trend_from_rollup(s, d) -> DataFrame:
    stored = sem.build_rollup(org_daily(s, d), "org_weekly_trend")
    return sem.weekly_trend(sem.as_summary(stored, "org_weekly_trend"), cubes.org_division_view(), ["transfer_type"],
                            scope=sem.ALL_ORGS)


def _changed_rollup(name: str):
    """A rollup that is stored, changed twice (a month emptied; amounts doubled, one change run again) and read back."""

    def run(s, d) -> DataFrame:
        path = fresh_dir(s, "stored-rollup")
        daily = org_daily(s, d)
        jobs.rebuild_rollup(daily, name, path)
        emptied = daily.filter("txn_date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
        jobs.change_rollup(emptied, emptied.limit(0), name, path, 1)
        before = daily.filter("txn_date BETWEEN DATE '1997-05-10' AND DATE '1997-06-02'")
        after = before.withColumn("total_amount", (F.col("total_amount") * 2).cast("decimal(24,2)"))
        for _ in range(2):
            jobs.change_rollup(before, after, name, path, 2)
        return jobs.read_rollup(s, path)

    return run


_ORG_MEASURES = ["total_transactions", "unique_counterparties", "total_amount", "total_net_amount", "total_fees",
                 "completed_amount", "avg_transaction_amount", "max_single_txn", "min_single_txn",
                 "total_amount_pct", "total_txn_pct", "success_rate", "failure_rate", "fee_rate"]

SCOPE = "ORG8"  # the organisation whose user asks

QUERIES = {
    "org_dimensions": lambda s, d: _dimensions(org_daily(s, d), cubes.org_cube()),
    "customer_dimensions": lambda s, d: _dimensions(customer_daily(s, d), cubes.customer_cube()),
    "org_measures": lambda s, d: sem.cube_query(
        org_daily(s, d), cubes.org_cube(), _ORG_MEASURES, ["org_division_key"], scope=sem.ALL_ORGS),
    "customer_measures": lambda s, d: sem.cube_query(
        customer_daily(s, d), cubes.customer_cube(), ["unique_customers", *_ORG_MEASURES],
        ["counterparty_name", "txn_year"]),
    "org_segments": lambda s, d: sem.segment_totals(org_daily(s, d), cubes.org_cube(), sem.ALL_ORGS),
    "customer_segments": lambda s, d: sem.segment_totals(customer_daily(s, d), cubes.customer_cube()),
    "cube_query": lambda s, d: sem.cube_query(
        org_daily(s, d), cubes.org_cube(), ["total_amount", "success_rate"], ["org_id", "amount_bucket"],
        filters={"transfer_type": ["WALLET_TO_WALLET", "WALLET_TO_ACCOUNT"]}, segments=["completed_only"],
        granularity="quarter", date_range=("last year", "now"), as_of="2000-05-15", scope=sem.ALL_ORGS),
    "org_view_query": lambda s, d: sem.cube_query(
        org_daily(s, d), cubes.org_division_view(), ["total_amount", "total_amount_pct"],
        ["counterparty_type", "txn_week"], scope=sem.ALL_ORGS),
    "kpi_tiles": _all_orgs(sem.kpi_tiles),
    "party_distribution": _all_orgs(sem.party_distribution),
    "weekly_trend": lambda s, d: sem.weekly_trend(
        org_daily(s, d), cubes.org_division_view(), ["transfer_type"], scope=sem.ALL_ORGS),
    "status_donut": _all_orgs(sem.status_donut),
    "top_parties": _all_orgs(sem.top_parties),
    "drill_down": _all_orgs(sem.drill_down),
    "drill_down_division": lambda s, d: sem.drill_down(
        org_daily(s, d), cubes.org_division_view(), {"org_id": SCOPE}, scope=SCOPE),
    "top_parties_in_scope": lambda s, d: sem.top_parties(org_daily(s, d), cubes.org_division_view(), scope=SCOPE),
    "weekly_trend_from_rollup": _trend_from_rollup,
    "share_of_total": lambda s, d: sem.cube_query(
        customer_daily(s, d), cubes.customer_cube(), ["total_amount", "total_amount_pct", "total_txn_pct"],
        ["counterparty_id"]),
    **{name: _rollup(name) for name in sem.ROLLUPS},
    **{f"changed_{name}": _changed_rollup(name) for name in ("org_weekly_trend", "org_party_monthly", "org_status_quarterly")},
}

_NAME = "coalesce(nullif(trim(counterparty_name),''), counterparty_id)"
_DIVISION = "coalesce(nullif(trim(division_id),''), 'ORG_LEVEL')"
_BUCKET = """CASE WHEN total_amount < 1000 THEN 'A: < ₹1K' WHEN total_amount < 10000 THEN 'B: ₹1K – ₹10K'
 WHEN total_amount < 100000 THEN 'C: ₹10K – ₹1L' WHEN total_amount < 1000000 THEN 'D: ₹1L – ₹10L' ELSE 'E: > ₹10L' END"""
_DIMS = f"""txn_date, CAST(year(txn_date) AS INTEGER) AS txn_year, CAST(quarter(txn_date) AS INTEGER) AS txn_quarter,
 CAST(month(txn_date) AS INTEGER) AS txn_month, CAST(date_trunc('week', txn_date) AS DATE) AS txn_week,
 counterparty_id, {_NAME} AS counterparty_name, counterparty_type, transfer_type, status, {_BUCKET} AS amount_bucket,
 txn_count, total_amount"""
_COUNT = "CAST(sum(txn_count) AS BIGINT)"


def _sum(column: str) -> str:
    return f"CAST(sum({column}) AS DECIMAL(24,2))"


_DONE = "CAST(sum(CASE WHEN status='COMPLETED' THEN total_amount ELSE 0 END) AS DECIMAL(24,2))"
_SUCCESS = rate2("sum(CASE WHEN status='COMPLETED' THEN txn_count ELSE 0 END)", "sum(txn_count)")
_FAILURE = rate2("sum(CASE WHEN status IN ('FAILED','REVERSED') THEN txn_count ELSE 0 END)", "sum(txn_count)")
_FEE = rate2("sum(total_fees)*100", "sum(total_amount)*100")
_AVG = ("CAST(CAST(((CAST(sum(avg_amount)*1000000 AS HUGEINT)*2 + count(*)) // (2*count(*))) AS DECIMAL(30,0))"
        " * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(24,6))")


def _measures(table: str, where: str = "") -> str:
    return f"""{_COUNT} AS total_transactions, count(DISTINCT counterparty_id) AS unique_counterparties,
 {_sum('total_amount')} AS total_amount, {_sum('total_net_amount')} AS total_net_amount, {_sum('total_fees')} AS total_fees,
 {_DONE} AS completed_amount, {_AVG} AS avg_transaction_amount, max(max_amount) AS max_single_txn,
 min(min_amount) AS min_single_txn,
 CAST(sum(total_amount) AS DOUBLE) / (SELECT CAST(sum(total_amount) AS DOUBLE) FROM {table}) AS total_amount_pct,
 CAST(sum(txn_count) AS DOUBLE) / (SELECT CAST(sum(txn_count) AS DOUBLE) FROM {table}) AS total_txn_pct,
 {_SUCCESS} AS success_rate, {_FAILURE} AS failure_rate, {_FEE} AS fee_rate"""


_SEGMENTS = {
    "completed_only": "status = 'COMPLETED'", "failed_only": "status IN ('FAILED','REVERSED')",
    "pending_only": "status NOT IN ('COMPLETED','FAILED','REVERSED')",
    "wallet_transfers": "transfer_type = 'WALLET_TO_WALLET'",
    "bank_payouts": "transfer_type IN ('WALLET_TO_ACCOUNT','ACCOUNT_TO_ACCOUNT')",
}


def _segment_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS segment, {_COUNT} AS total_transactions, {_sum('total_amount')} AS total_amount "
        f"FROM {table} WHERE {w}" for n, w in _SEGMENTS.items())


def _rollup_sql(table: str, dims: dict[str, str], count: int, grain: str) -> str:
    sums = [f"{_COUNT} AS total_transactions", f"{_sum('total_amount')} AS total_amount",
            f"{_sum('total_net_amount')} AS total_net_amount", f"{_sum('total_fees')} AS total_fees",
            f"{_DONE} AS completed_amount"][:count]
    columns = ", ".join(f"{e} AS {n}" for n, e in dims.items())
    return with_tables(f"""SELECT {columns}, CAST(date_trunc('{grain}', txn_date) AS DATE) AS txn_period, {', '.join(sums)}
FROM {table} GROUP BY {', '.join(dims.values())}, date_trunc('{grain}', txn_date)""")


def _d(*names: str) -> dict[str, str]:
    special = {"division_id": _DIVISION, "counterparty_name": _NAME}
    return {n: special.get(n, n) for n in names}


_TREND = f"""SELECT transfer_type, CAST(date_trunc('week', txn_date) AS DATE) AS txn_date_week,
 {_sum('total_amount')} AS total_amount, {_COUNT} AS total_transactions FROM org_daily GROUP BY 1, 2"""

ORACLE = {
    "org_dimensions": with_tables(f"""SELECT org_id, {_DIVISION} AS division_id,
 org_id||' / '||{_DIVISION} AS org_division_key, {_DIMS} FROM org_daily"""),
    "customer_dimensions": with_tables(f"SELECT customer_id, {_DIMS} FROM customer_daily"),
    "org_measures": with_tables(f"""SELECT org_id||' / '||{_DIVISION} AS org_division_key, {_measures('org_daily')}
FROM org_daily GROUP BY 1"""),
    "customer_measures": with_tables(f"""SELECT {_NAME} AS counterparty_name, CAST(year(txn_date) AS INTEGER) AS txn_year,
 count(DISTINCT customer_id) AS unique_customers, {_measures('customer_daily')} FROM customer_daily
GROUP BY {_NAME}, year(txn_date)"""),
    "org_segments": with_tables(_segment_sql("org_daily")),
    "customer_segments": with_tables(_segment_sql("customer_daily")),
    "cube_query": with_tables(f"""SELECT org_id, {_BUCKET} AS amount_bucket,
 CAST(date_trunc('quarter', txn_date) AS DATE) AS txn_date_quarter, {_sum('total_amount')} AS total_amount,
 {_SUCCESS} AS success_rate
FROM org_daily WHERE transfer_type IN ('WALLET_TO_WALLET','WALLET_TO_ACCOUNT') AND status = 'COMPLETED'
 AND txn_date >= DATE '1999-01-01' AND txn_date <= DATE '2000-05-15'
GROUP BY org_id, {_BUCKET}, date_trunc('quarter', txn_date)"""),
    "org_view_query": with_tables(f"""SELECT counterparty_type, CAST(date_trunc('week', txn_date) AS DATE) AS txn_week,
 {_sum('total_amount')} AS total_amount,
 CAST(sum(total_amount) AS DOUBLE) / (SELECT CAST(sum(total_amount) AS DOUBLE) FROM org_daily) AS total_amount_pct
FROM org_daily GROUP BY 1, 2"""),
    "kpi_tiles": with_tables(f"""SELECT {_sum('total_amount')} AS total_amount, {_COUNT} AS total_transactions,
 {_SUCCESS} AS success_rate, count(DISTINCT counterparty_id) AS unique_counterparties, {_FEE} AS fee_rate FROM org_daily"""),
    "party_distribution": with_tables(f"""SELECT {_NAME} AS counterparty_name, counterparty_id, counterparty_type,
 {_sum('total_amount')} AS total_amount FROM org_daily WHERE status='COMPLETED'
GROUP BY {_NAME}, counterparty_id, counterparty_type ORDER BY total_amount DESC, 1, 2, 3 LIMIT 15"""),
    "weekly_trend": with_tables(_TREND),
    "status_donut": with_tables(f"""SELECT status, {_COUNT} AS total_transactions,
 CAST(sum(txn_count) AS DOUBLE) / (SELECT CAST(sum(txn_count) AS DOUBLE) FROM org_daily) AS total_txn_pct
FROM org_daily GROUP BY 1"""),
    "top_parties": with_tables(f"""SELECT counterparty_id, {_NAME} AS counterparty_name,
 {_sum('total_amount')} AS total_amount, {_COUNT} AS total_transactions, {_SUCCESS} AS success_rate
FROM org_daily GROUP BY counterparty_id, {_NAME} ORDER BY total_amount DESC, 1, 2 LIMIT 10"""),
    "drill_down": with_tables(f"""SELECT org_id, {_sum('total_amount')} AS total_amount, {_COUNT} AS total_transactions,
 {_SUCCESS} AS success_rate FROM org_daily GROUP BY 1"""),
    "drill_down_division": with_tables(f"""SELECT org_id, {_DIVISION} AS division_id, {_sum('total_amount')} AS total_amount,
 {_COUNT} AS total_transactions, {_SUCCESS} AS success_rate FROM org_daily WHERE org_id = '{SCOPE}' GROUP BY 1, 2"""),
    "top_parties_in_scope": with_tables(f"""SELECT counterparty_id, {_NAME} AS counterparty_name,
 {_sum('total_amount')} AS total_amount, {_COUNT} AS total_transactions, {_SUCCESS} AS success_rate
FROM org_daily WHERE org_id = '{SCOPE}' GROUP BY counterparty_id, {_NAME} ORDER BY total_amount DESC, 1, 2 LIMIT 10"""),
    "weekly_trend_from_rollup": with_tables(_TREND),
    "share_of_total": with_tables(f"""SELECT counterparty_id, {_sum('total_amount')} AS total_amount,
 CAST(sum(total_amount) AS DOUBLE) / (SELECT CAST(sum(total_amount) AS DOUBLE) FROM customer_daily) AS total_amount_pct,
 CAST(sum(txn_count) AS DOUBLE) / (SELECT CAST(sum(txn_count) AS DOUBLE) FROM customer_daily) AS total_txn_pct
FROM customer_daily GROUP BY 1"""),
    "org_party_monthly": _rollup_sql("org_daily", _d(
        "org_id", "division_id", "counterparty_id", "counterparty_name", "counterparty_type", "status",
        "transfer_type"), 5, "month"),
    "org_weekly_trend": _rollup_sql("org_daily", _d("org_id", "division_id", "transfer_type", "status"), 4, "week"),
    "org_monthly_summary": _rollup_sql("org_daily", _d("org_id", "division_id", "transfer_type", "status"), 5, "month"),
    "org_daily_detail": _rollup_sql("org_daily", _d(
        "org_id", "division_id", "counterparty_id", "counterparty_name", "status", "transfer_type"), 3, "day"),
    "org_status_quarterly": _rollup_sql("org_daily", _d("org_id", "division_id", "status", "transfer_type"), 2, "quarter"),
    "cust_party_monthly": _rollup_sql("customer_daily", _d(
        "customer_id", "counterparty_id", "counterparty_name", "counterparty_type", "status", "transfer_type"), 5, "month"),
    "cust_weekly_trend": _rollup_sql("customer_daily", _d("customer_id", "transfer_type", "status"), 3, "week"),
    "cust_daily_detail": _rollup_sql("customer_daily", _d(
        "customer_id", "counterparty_id", "counterparty_name", "status", "transfer_type"), 3, "day"),
}

_CHANGED = """(SELECT * REPLACE (CASE WHEN txn_date BETWEEN DATE '1997-05-10' AND DATE '1997-06-02'
 THEN CAST(total_amount * 2 AS DECIMAL(24,2)) ELSE total_amount END AS total_amount)
FROM org_daily WHERE txn_date NOT BETWEEN DATE '1996-02-01' AND DATE '1996-02-29')"""
for _name, _count, _grain in (("org_weekly_trend", 4, "week"), ("org_party_monthly", 5, "month"), ("org_status_quarterly", 2, "quarter")):
    ORACLE[f"changed_{_name}"] = _rollup_sql(_CHANGED, _d(*sem.ROLLUPS[_name].dimensions), _count, _grain)
