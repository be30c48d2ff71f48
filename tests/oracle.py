"""Run a query on Spark and its SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return f"{value:.10g}"
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _shape(table) -> dict[str, str]:
    names = {"string": "string", "large_string": "string", "timestamp[us]": "timestamp",
             "timestamp[us, tz=UTC]": "timestamp_tz", "timestamp[us, tz=Etc/UTC]": "timestamp_tz"}
    return {f.name: names.get(str(f.type), str(f.type)) for f in table.schema}


def _rows(table) -> Counter:
    columns = sorted(table.column_names)
    lists = [[_plain(v) for v in table.column(c).to_pylist()] for c in columns]
    return Counter(zip(*lists)) if lists else Counter()


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, str]:
    """Row count and a description of the first difference, empty when equal."""
    ours = query(spark, sf_dir).toArrow()
    theirs = con.execute(sql).to_arrow_table()
    a, b = _shape(ours), _shape(theirs)
    if a != b:
        return ours.num_rows, f"schema differs: {sorted(set(a.items()) ^ set(b.items()))}"
    left, right = _rows(ours), _rows(theirs)
    if left != right:
        names = sorted(a)
        only_left, only_right = list((left - right).items())[:2], list((right - left).items())[:2]
        return ours.num_rows, (f"rows differ ({ours.num_rows} vs {theirs.num_rows}) columns={names}\n"
                               f"  spark only: {only_left}\n  sql only:   {only_right}")
    return ours.num_rows, ""
