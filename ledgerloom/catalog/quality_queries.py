"""Quality checks over sample facts with rule-made defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog.oracle_tables import with_tables
from ledgerloom.catalog.rollup_queries import _marks_after_run, ORACLE as ROLLUP_ORACLE
from ledgerloom.operators import quality as q
from ledgerloom.operators import rollups
from ledgerloom.sources import sample_tables as st

AS_OF = "2024-01-31 00:30:00"
CHECKED_RUN = "1998-03-05"


def flawed_customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer facts where some ids are null and some amounts negative."""
    key = F.substring("txn_id", 2, 20).cast("long")
    return st.customer_facts(spark, sf_dir).withColumns({
        "customer_id": F.when(key % 211 != 0, F.col("customer_id")),
        "amount": F.when(key % 223 == 0, -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)"),
    })


_FLAWED = """(SELECT * REPLACE (CASE WHEN k%211<>0 THEN customer_id END AS customer_id,
 CAST(CASE WHEN k%223=0 THEN -amount ELSE amount END AS DECIMAL(18,2)) AS amount)
FROM (SELECT *, CAST(substr(txn_id,2) AS BIGINT) AS k FROM customer_facts))"""


def _checks(spark: SparkSession, sf_dir: str) -> dict:
    customers = flawed_customer_facts(spark, sf_dir)
    orgs = st.org_facts(spark, sf_dir)
    clean = st.customer_facts(spark, sf_dir)
    return {
        "null_customer_ids": lambda: q.null_ids(customers, "customer_id"),
        "null_org_ids": lambda: q.null_ids(orgs, "org_id"),
        "negative_amounts": lambda: q.negative_amounts(customers, orgs),
        "duplicate_transfers": lambda: q.duplicate_check(customers, orgs),
        "summary_vs_raw_totals": lambda: q.summary_vs_raw(
            customers, rollups.daily_rollup(clean, "customer", CHECKED_RUN), orgs,
            rollups.daily_rollup(orgs, "org", CHECKED_RUN), CHECKED_RUN),
        "stale_watermarks": lambda: q.stale_marks(_marks_after_run(spark, sf_dir), AS_OF),
    }


def _fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, orgs = st.customer_facts(spark, sf_dir), st.org_facts(spark, sf_dir)
    return q.fact_checks(flawed_customer_facts(spark, sf_dir), rollups.daily_rollup(clean, "customer", CHECKED_RUN), orgs,
                         rollups.daily_rollup(orgs, "org", CHECKED_RUN), CHECKED_RUN)


def _all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = _checks(spark, sf_dir)
    return q.union_checks([_fact_checks(spark, sf_dir), alone["duplicate_transfers"](), alone["stale_watermarks"]()])


QUERIES = {
    "dq_null_customer": lambda s, d: _checks(s, d)["null_customer_ids"](),
    "dq_null_org": lambda s, d: _checks(s, d)["null_org_ids"](),
    "dq_negative_amounts": lambda s, d: _checks(s, d)["negative_amounts"](),
    "dq_duplicate_transfers": lambda s, d: _checks(s, d)["duplicate_transfers"](),
    "dq_duplicate_org_transfers": lambda s, d: q.duplicate_transfers(st.org_facts(s, d)),
    "dq_duplicate_examples": lambda s, d: q.duplicate_examples(st.org_facts(s, d)),
    "dq_summary_vs_raw": lambda s, d: _checks(s, d)["summary_vs_raw_totals"](),
    "dq_summary_vs_raw_by_day": lambda s, d: q.summary_vs_raw_by_day(
        flawed_customer_facts(s, d), rollups.daily_rollup(st.customer_facts(s, d), "customer")),
    "dq_stale_watermarks": lambda s, d: q.mark_ages(_marks_after_run(s, d), AS_OF),
    "dq_stale_check": lambda s, d: _checks(s, d)["stale_watermarks"](),
    "dq_fact_checks": _fact_checks,
    "dq_report": lambda s, d: q.report(_all_checks(s, d)),
    "freshness": lambda s, d: q.freshness(_marks_after_run(s, d), AS_OF),
}

_AGES = f"""(SELECT *, round(date_diff('microsecond', last_processed_at, TIMESTAMP '{AS_OF}') / 3600000000.0, 3) AS hours_since_update
FROM ({ROLLUP_ORACLE['marks_after_run']}))"""

_DUP = "(SELECT transfer_id, count(*) AS cnt FROM {t} WHERE transfer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
_RAW_DAY = "WHERE txn_date >= TIMESTAMP '1998-03-04' AND txn_date < TIMESTAMP '1998-03-05'"


def _total(table: str, where: str) -> str:
    return f"(SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(24,2)) FROM {table} {where})"


ORACLE = {
    "dq_null_customer": with_tables(f"""SELECT 'null_customer_ids' AS check_name,
 CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, '{{"null_customer_id_count":'||n||'}}' AS detail,
 CAST(NULL AS VARCHAR) AS error FROM (SELECT count(*) AS n FROM {_FLAWED} WHERE customer_id IS NULL)"""),
    "dq_null_org": with_tables("""SELECT 'null_org_ids' AS check_name,
 CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, '{"null_org_id_count":'||n||'}' AS detail,
 CAST(NULL AS VARCHAR) AS error FROM (SELECT count(*) AS n FROM org_facts WHERE org_id IS NULL)"""),
    "dq_negative_amounts": with_tables(f"""SELECT 'negative_amounts' AS check_name,
 CASE WHEN c + o > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
 '{{"customer_negative_amount_count":'||c||',"org_negative_amount_count":'||o||'}}' AS detail,
 CAST(NULL AS VARCHAR) AS error
FROM (SELECT (SELECT count(*) FROM {_FLAWED} WHERE amount < 0) AS c, (SELECT count(*) FROM org_facts WHERE amount < 0) AS o)"""),
    "dq_duplicate_transfers": with_tables(f"""SELECT 'duplicate_transfers' AS check_name,
 CASE WHEN c + o > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
 '{{"customer_duplicate_transfer_ids":'||c||',"org_duplicate_transfer_ids":'||o||',"customer_examples":['||ex||']}}' AS detail,
 CAST(NULL AS VARCHAR) AS error
FROM (SELECT (SELECT count(*) FROM {_DUP.format(t='customer_facts')}) AS c,
 (SELECT count(*) FROM {_DUP.format(t='org_facts')}) AS o,
 (SELECT string_agg('{{"transfer_id":"'||transfer_id||'","count":'||cnt||'}}', ',' ORDER BY cnt DESC, transfer_id)
  FROM (SELECT * FROM {_DUP.format(t='customer_facts')} ORDER BY cnt DESC, transfer_id LIMIT 20)) AS ex)"""),
    "dq_duplicate_org_transfers": with_tables(f"SELECT * FROM {_DUP.format(t='org_facts')}"),
    "dq_duplicate_examples": with_tables(
        f"SELECT * FROM {_DUP.format(t='org_facts')} ORDER BY cnt DESC, transfer_id LIMIT 20"),
    "dq_summary_vs_raw": with_tables(f"""SELECT 'summary_vs_raw_totals' AS check_name,
 CASE WHEN abs(rc - sc) > 0.01 OR abs(ro - so) > 0.01 THEN 'FAIL' ELSE 'PASS' END AS status,
 '{{"date":"1998-03-04","raw_customer_total":'||rc||',"summary_customer_total":'||sc||',"customer_diff":'||abs(rc-sc)
 ||',"raw_org_total":'||ro||',"summary_org_total":'||so||',"org_diff":'||abs(ro-so)||',"tolerance":0.01}}' AS detail,
 CAST(NULL AS VARCHAR) AS error
FROM (SELECT {_total(_FLAWED, _RAW_DAY)} AS rc, {_total('customer_facts', _RAW_DAY)} AS sc,
 {_total('org_facts', _RAW_DAY)} AS ro, {_total('org_facts', _RAW_DAY)} AS so)"""),
    "dq_summary_vs_raw_by_day": with_tables(f"""
SELECT *, CASE WHEN diff > 0.01 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT *, CAST(abs(raw_total - summary_total) AS DECIMAL(24,2)) AS diff FROM
 (SELECT coalesce(r.day, s.day) AS day, coalesce(raw_total, 0) AS raw_total, coalesce(summary_total, 0) AS summary_total
  FROM (SELECT CAST(txn_date AS DATE) AS day, CAST(sum(amount) AS DECIMAL(24,2)) AS raw_total FROM {_FLAWED} GROUP BY 1) r
  FULL JOIN (SELECT txn_date AS day, CAST(sum(total_amount) AS DECIMAL(24,2)) AS summary_total FROM customer_daily GROUP BY 1) s
  ON r.day = s.day))"""),
    "dq_stale_watermarks": f"""SELECT pipeline_name, last_processed_at, last_run_at, hours_since_update,
 CAST(1.0 AS DOUBLE) AS limit_hours, hours_since_update IS NULL OR hours_since_update > 1.0 AS stale FROM {_AGES}""",
    "dq_stale_check": f"""SELECT 'stale_watermarks' AS check_name,
 CASE WHEN count(*) FILTER (hours_since_update > 1.0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
 '{{"stale_pipelines":['||coalesce(string_agg(e, ',' ORDER BY pipeline_name) FILTER (hours_since_update > 1.0), '')
 ||'],"fresh_pipelines":['||coalesce(string_agg(e, ',' ORDER BY pipeline_name) FILTER (hours_since_update <= 1.0), '')||']}}' AS detail,
 CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, '{{"pipeline_name":"'||pipeline_name||'","last_processed_at":"'||CAST(last_processed_at AS VARCHAR)
 ||'","hours_since_update":'||CAST(hours_since_update AS VARCHAR)||'}}' AS e FROM {_AGES})""",
    "dq_report": with_tables(f"""SELECT CAST(6 AS BIGINT) AS total_checks, CAST(6 - len(f) AS BIGINT) AS passed,
 CAST(len(f) AS BIGINT) AS failed, array_to_string(list_sort(f), ',') AS failed_checks
FROM (SELECT list_filter([
 CASE WHEN EXISTS (SELECT 1 FROM {_FLAWED} WHERE customer_id IS NULL) THEN 'null_customer_ids' END,
 CASE WHEN EXISTS (SELECT 1 FROM org_facts WHERE org_id IS NULL) THEN 'null_org_ids' END,
 CASE WHEN EXISTS (SELECT 1 FROM {_FLAWED} WHERE amount < 0) OR EXISTS (SELECT 1 FROM org_facts WHERE amount < 0)
  THEN 'negative_amounts' END,
 CASE WHEN EXISTS (SELECT 1 FROM {_DUP.format(t='customer_facts')}) OR EXISTS (SELECT 1 FROM {_DUP.format(t='org_facts')})
  THEN 'duplicate_transfers' END,
 CASE WHEN abs({_total(_FLAWED, _RAW_DAY)} - {_total('customer_facts', _RAW_DAY)}) > 0.01 THEN 'summary_vs_raw_totals' END,
 CASE WHEN EXISTS (SELECT 1 FROM {_AGES} WHERE hours_since_update > 1.0) THEN 'stale_watermarks' END
 ], lambda x: x IS NOT NULL) AS f)"""),
    "freshness": f"""SELECT pipeline_name, hours_since_update,
 CASE WHEN hours_since_update IS NULL OR hours_since_update > 2.0 THEN 'WARN' ELSE 'OK' END AS level FROM {_AGES}""",
}

ORACLE["dq_fact_checks"] = " UNION ALL ".join(
    f"SELECT * FROM ({ORACLE[name]})" for name in ("dq_null_customer", "dq_null_org", "dq_negative_amounts", "dq_summary_vs_raw"))
