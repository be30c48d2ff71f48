"""Small hand-written facts."""

import datetime as dt
from decimal import Decimal

COLUMNS = ("customer_id string, org_id string, division_id string, transfer_id string, transfer_type string, "
           "amount decimal(18,2), fees decimal(18,2), net_amount decimal(18,2), counterparty_id string, "
           "counterparty_name string, counterparty_type string, status string, txn_date timestamp_ntz, "
           "txn_year_month int")


def fact(when, amount="10.00", customer="C1", org="O1", division=None, transfer="T1", kind="WALLET_TO_WALLET",
         party="P1", name="Party", party_type="WALLET", status="COMPLETED", fees="0.10"):
    when = dt.datetime.fromisoformat(when) if isinstance(when, str) else when
    amount, fees = Decimal(amount), Decimal(fees)
    return (customer, org, division, transfer, kind, amount, fees, amount - fees, party, name, party_type, status,
            when, when.year * 100 + when.month)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def plain(df, *columns):
    """Rows as a sorted list, for comparing whole frames."""
    chosen = df.select(*(columns or sorted(df.columns)))
    return sorted((tuple(str(v) for v in r) for r in chosen.collect()))
