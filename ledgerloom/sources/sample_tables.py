"""Payment tables derived from the TPC-H-like sample tables.

Every rule is a plain column expression over whole tables, so the derived
tables grow with the sample data; see FIXTURES.md for the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.periods import year_month


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table, as it is read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def _hours(count: Column) -> Column:
    return F.make_dt_interval(F.lit(0), count.cast("int"))


def _order_columns() -> dict[str, Column]:
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return {
        "key": key,
        "when": F.col("o_orderdate") + _hours(key % 24),
        "amount": F.col("o_totalprice").cast("decimal(18,2)"),
        "priority": F.substring("o_orderpriority", 1, 1),
        "status": status,
    }


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _order_columns()
    key, amount = o["key"], o["amount"]
    fees = (amount * F.lit("0.02").cast("decimal(4,2)")).cast("decimal(18,2)")
    party = key % 20
    return table(spark, sf_dir, "orders").select(
        _text("O", key).alias("txn_id"),
        _text("C", F.col("o_custkey")).alias("customer_id"),
        _text("W", F.col("o_custkey")).alias("source_wallet_id"),
        F.when(key % 50 != 7, _text("T", key - F.when(key % 100 == 1, 1).otherwise(0))).alias("transfer_id"),
        _text("PG", key).alias("pg_order_id"),
        _text("CF", key).alias("cf_payment_id"),
        _text("B", key).alias("bank_reference"),
        F.when(o["priority"] == "1", "WALLET_TO_WALLET")
        .when(o["priority"] == "2", "WALLET_TO_ACCOUNT")
        .when(o["priority"] == "3", "ACCOUNT_TO_WALLET")
        .when(o["priority"] == "5", "ACCOUNT_TO_ACCOUNT").alias("transfer_type"),
        amount.alias("amount"),
        fees.alias("fees"),
        (amount - fees).cast("decimal(18,2)").alias("net_amount"),
        F.lit("INR").alias("currency"),
        F.when(party != 0, _text("CP", party)).alias("counterparty_id"),
        F.when((party != 0) & (party != 3), _text("Party ", party)).alias("counterparty_name"),
        F.when(key % 2 == 0, "WALLET").otherwise("BANK_ACCOUNT").alias("counterparty_type"),
        F.when((o["status"] == "F") & (key % 10 == 0), "REVERSED")
        .when(o["status"] == "F", "COMPLETED")
        .when(o["status"] == "O", "PENDING_PAYMENT")
        .otherwise("FAILED").alias("status"),
        o["when"].alias("txn_date"),
        year_month(o["when"]).alias("txn_year_month"),
        F.lit(None).cast("string").alias("description"),
    )


def org_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # supplier has one row per supplier; the planner compares its size with the broadcast threshold.
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    fees = (amount * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,2)")
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    party = F.col("l_partkey") % 50
    flag, line_status = F.col("l_returnflag"), F.col("l_linestatus")
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey, "inner").select(
        F.concat(F.lit("L"), line).alias("txn_id"),
        _text("ORG", F.col("s_nationkey")).alias("org_id"),
        F.when(F.col("l_suppkey") % 7 != 0, _text("DIV", F.col("l_suppkey"))).alias("division_id"),
        _text("W", F.col("l_suppkey")).alias("source_wallet_id"),
        line.alias("transfer_id"),
        _text("PG", F.col("l_orderkey")).alias("pg_order_id"),
        F.lit(None).cast("string").alias("cf_payment_id"),
        F.lit(None).cast("string").alias("bank_reference"),
        F.when(flag == "R", "WALLET_TO_WALLET").when(flag == "A", "WALLET_TO_ACCOUNT")
        .otherwise("ACCOUNT_TO_ACCOUNT").alias("transfer_type"),
        amount.alias("amount"),
        fees.alias("fees"),
        (amount - fees).cast("decimal(18,2)").alias("net_amount"),
        F.lit("INR").alias("currency"),
        _text("CP", party).alias("counterparty_id"),
        F.when(party != 3, _text("Party ", party)).alias("counterparty_name"),
        F.when(party % 2 == 0, "WALLET").otherwise("BANK_ACCOUNT").alias("counterparty_type"),
        F.when((flag == "R") & (line_status == "F"), "REVERSED")
        .when((flag == "A") & (line_status == "O"), "FAILED")
        .when(line_status == "F", "COMPLETED")
        .otherwise("PENDING_PAYMENT").alias("status"),
        F.col("l_shipdate").alias("txn_date"),
        year_month("l_shipdate").alias("txn_year_month"),
        F.lit(None).cast("string").alias("description"),
    )


def success_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message stream, one success event per row of ``events``."""
    kind, user, number = F.col("event_type"), F.col("user_id"), F.col("event_id")
    source = (
        F.when((kind == "error") & (number % 11 == 0), F.lit(None).cast("string"))
        .when(kind.isin("click", "view"), "INDIVIDUAL")
        .when(kind == "signup", "STANDALONE_PG")
        .when(kind == "purchase", "ENTERPRISE")
        .otherwise("UNKNOWN")
    )
    amount = F.col("value").cast("decimal(18,2)")
    fees = F.when(number % 5 != 0, (amount * F.lit("0.02").cast("decimal(4,2)")).cast("decimal(18,2)"))
    return table(spark, sf_dir, "events").select(
        _text("E", number).alias("event_id"),
        source.alias("source_type"),
        F.when(kind != "purchase", _text("U", user)).alias("customer_id"),
        F.when(kind.isin("click", "view"), _text("W", user)).alias("source_wallet_id"),
        F.when(kind == "purchase", _text("ORG", user % 10)).alias("org_id"),
        F.when((kind == "purchase") & (user % 3 != 0), _text("DIV", user)).alias("division_id"),
        F.when(kind == "purchase", _text("OW", user)).alias("org_wallet_id"),
        _text("T", number - F.when(number % 40 == 1, 1).otherwise(0)).alias("transfer_id"),
        _text("PG", number).alias("pg_order_id"),
        F.lit(None).cast("string").alias("cf_payment_id"),
        F.lit(None).cast("string").alias("bank_reference"),
        F.when(kind == "click", "WALLET_TO_WALLET").when(kind == "view", "WALLET_TO_ACCOUNT")
        .when(kind == "purchase", "ACCOUNT_TO_ACCOUNT").alias("transfer_type"),
        F.when(kind == "purchase", "COMPLETED").when(kind == "error", "FAILED").when(kind == "signup", "REVERSED")
        .when(kind == "view", "PENDING_PAYMENT").otherwise("INITIATED").alias("status"),
        amount.alias("amount"),
        fees.alias("fees"),
        F.when(number % 3 == 0, (amount - F.coalesce(fees, F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)"))
        .alias("net_amount"),
        F.when(number % 4 != 0, "INR").alias("currency"),
        _text("CP", number % 20).alias("counterparty_id"),
        F.lit(None).cast("string").alias("counterparty_name"),
        F.when(number % 2 == 0, "WALLET").otherwise("BANK_ACCOUNT").alias("counterparty_type"),
        F.concat(F.lit("props "), F.col("props")).alias("description"),
        F.col("ts").alias("succeeded_at"),
    )


def activity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts at event-time resolution, for the hourly rollups."""
    return activity_from(table(spark, sf_dir, "events"))


def activity_from(events: DataFrame) -> DataFrame:
    number = F.col("event_id")
    amount = F.col("value").cast("decimal(18,2)")
    fees = (amount * F.lit("0.02").cast("decimal(4,2)")).cast("decimal(18,2)")
    kind = F.col("event_type")
    return events.select(
        _text("E", number).alias("txn_id"),
        _text("U", F.col("user_id")).alias("customer_id"),
        _text("ORG", F.col("user_id") % 10).alias("org_id"),
        F.when(F.col("user_id") % 3 != 0, _text("DIV", F.col("user_id"))).alias("division_id"),
        _text("T", number).alias("transfer_id"),
        F.when(kind == "click", "WALLET_TO_WALLET").when(kind == "view", "WALLET_TO_ACCOUNT")
        .when(kind == "purchase", "ACCOUNT_TO_ACCOUNT").alias("transfer_type"),
        amount.alias("amount"), fees.alias("fees"), (amount - fees).cast("decimal(18,2)").alias("net_amount"),
        F.when(number % 20 != 0, _text("CP", number % 20)).alias("counterparty_id"),
        F.when(number % 20 > 3, _text("Party ", number % 20)).alias("counterparty_name"),
        F.when(number % 2 == 0, "WALLET").otherwise("BANK_ACCOUNT").alias("counterparty_type"),
        F.when(kind == "purchase", "COMPLETED").when(kind == "error", "FAILED").when(kind == "signup", "REVERSED")
        .when(kind == "view", "PENDING_PAYMENT").alias("status"),
        F.col("ts").alias("txn_date"),
        year_month("ts").alias("txn_year_month"),
    )


def individual_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(key % 3 != 0).select(
        _text("W", key).alias("wallet_id"), F.lit("INDIVIDUAL").alias("wallet_type"),
        _text("C", key).alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), F.lit("INR").alias("currency"),
        F.lit("ACTIVE").alias("status"),
    )


def enterprise_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(key % 3 == 0).select(
        _text("W", key).alias("wallet_id"), F.lit("ENTERPRISE").alias("wallet_type"),
        _text("ORG", F.col("c_nationkey")).alias("org_id"),
        F.when(key % 9 != 0, _text("DIV", key)).alias("division_id"), F.col("c_name").alias("wallet_name"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), F.lit("INR").alias("currency"),
        F.lit("ACTIVE").alias("status"),
    )


def wallet_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _order_columns()
    key, amount = o["key"], o["amount"]
    kind = (
        F.when(o["priority"] == "2", "WALLET_TO_ACCOUNT").when(o["priority"] == "3", "ACCOUNT_TO_WALLET")
        .when(o["priority"] == "5", "ACCOUNT_TO_ACCOUNT").otherwise("WALLET_TO_WALLET")
    )
    from_wallet = o["priority"].isin("1", "2", "4")
    to_wallet = o["priority"].isin("1", "3", "4")
    fees = (amount * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(18,2)")
    customer = F.col("o_custkey")
    wallet = F.when(key % 37 == 0, _text("WX", customer)).otherwise(_text("W", customer))
    open_status = (
        F.when(key % 4 == 0, "PENDING_PAYMENT").when(key % 4 == 1, "COLLECTING")
        .when(key % 4 == 2, "DEBITED").otherwise("PAYOUT_INITIATED")
    )
    status = (
        F.when((o["status"] == "F") & (key % 10 == 0), "REVERSED").when(o["status"] == "F", "COMPLETED")
        .when(o["status"] == "P", "FAILED").otherwise(open_status)
    )
    destination = key % 200
    return table(spark, sf_dir, "orders").select(
        _text("T", key).alias("transfer_id"),
        _text("K", key).alias("idempotency_key"),
        kind.alias("transfer_type"),
        F.when(from_wallet, wallet).alias("source_wallet_id"),
        F.when(from_wallet & (key % 41 != 0), F.when(customer % 3 == 0, "ENTERPRISE").otherwise("INDIVIDUAL"))
        .alias("source_wallet_type"),
        F.when(~from_wallet, _text("ACC", customer)).alias("source_account_number"),
        F.when(~from_wallet, _text("Holder ", customer)).alias("source_account_name"),
        F.when(to_wallet, _text("W", destination)).alias("destination_wallet_id"),
        F.when(to_wallet, F.when(destination % 3 == 0, "ENTERPRISE").otherwise("INDIVIDUAL"))
        .alias("destination_wallet_type"),
        F.when(~to_wallet, _text("ACC", destination)).alias("destination_account_number"),
        F.when(~to_wallet, _text("IFSC", destination % 7)).alias("destination_ifsc"),
        F.when(destination % 11 != 0, _text("Payee ", destination)).alias("destination_account_name"),
        amount.alias("amount"),
        F.lit("INR").alias("currency"),
        fees.alias("fees"),
        (amount - fees).cast("decimal(18,2)").alias("net_amount"),
        status.alias("status"),
        F.when(o["status"] == "P", "declined").alias("failure_reason"),
        F.when(~from_wallet, _text("PG", key)).alias("pg_order_id"),
        F.when(~from_wallet, _text("CF", key)).alias("cf_payment_id"),
        F.when(~to_wallet, _text("PO", key)).alias("cf_payout_id"),
        F.when(o["status"] == "F", _text("B", key)).alias("bank_reference"),
        F.lit(None).cast("string").alias("description"),
        o["when"].alias("initiated_at"),
        (o["when"] + _hours(F.lit(2))).alias("updated_at"),
    )


def payment_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _order_columns()
    key, amount = o["key"], o["amount"]
    status = (
        F.when(o["status"] == "F", "SUCCESS")
        .when((o["status"] == "P") & (key % 4 == 0), "EXPIRED").when((o["status"] == "P") & (key % 4 == 1), "ERROR")
        .when(o["status"] == "P", "FAILED")
        .when(key % 2 == 0, "PENDING_PAYMENT").otherwise("PROCESSING")
    )
    return table(spark, sf_dir, "orders").select(
        _text("PT", key).alias("transaction_id"),
        _text("ORD", key).alias("order_id"),
        F.when(key % 7 != 0, _text("IK", key - key % 5)).alias("idempotency_key"),
        _text("CFO", key).alias("cf_order_id"),
        F.when(o["status"] == "F", _text("CF", key)).alias("cf_payment_id"),
        F.when(o["status"] == "F", _text("B", key)).alias("bank_reference"),
        _text("C", F.col("o_custkey")).alias("debitor_id"),
        _text("CR", key % 30).alias("creditor_id"),
        _text("Creditor ", key % 30).alias("creditor_name"),
        _text("ACC", key % 30).alias("creditor_account"),
        amount.cast("decimal(15,2)").alias("amount"),
        F.lit("INR").alias("currency"),
        F.when(key % 3 == 0, "UPI").when(key % 3 == 1, "CARD").otherwise("ACCOUNT_TRANSFER").alias("payment_method"),
        status.alias("status"),
        F.when(o["status"] == "P", F.when(key % 2 == 0, "declined").otherwise("timeout")).alias("failure_reason"),
        o["when"].alias("initiated_at"),
        (o["when"] + F.make_dt_interval(F.lit(0), F.lit(0), (key % 90).cast("int"))).alias("updated_at"),
    )


def ledger_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows before balances are known."""
    number = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        _text("L", number).alias("transaction_id"),
        _text("T", number).alias("transfer_id"),
        _text("U", F.col("user_id")).alias("wallet_id"),
        F.when(F.col("user_id") % 3 == 0, "ENTERPRISE").otherwise("INDIVIDUAL").alias("wallet_type"),
        F.when(F.col("event_type").isin("purchase", "error"), "DEBIT").otherwise("CREDIT").alias("transaction_type"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.lit("INR").alias("currency"),
        F.col("event_type").alias("description"),
        F.col("ts").alias("created_at"),
    )


def transfer_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double-entry ledger legs of finished transfers; some legs are missing or wrong by rule."""
    transfers = wallet_transfers(spark, sf_dir).filter(F.col("status") == "COMPLETED")
    key = F.substring("transfer_id", 2, 20).cast("long")
    debit = F.struct(
        F.lit("DEBIT").alias("transaction_type"), F.col("source_wallet_id").alias("wallet_id"),
        F.when(key % 59 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"),
    )
    credit = F.struct(
        F.lit("CREDIT").alias("transaction_type"), F.col("destination_wallet_id").alias("wallet_id"),
        F.col("net_amount").alias("amount"),
    )
    legs = F.explode(F.array(debit, credit)).alias("leg")
    return (
        transfers.select("transfer_id", "initiated_at", legs)
        .select(
            F.concat_ws("-", "transfer_id", "leg.transaction_type").alias("transaction_id"),
            "transfer_id", F.col("leg.wallet_id").alias("wallet_id"),
            F.col("leg.transaction_type").alias("transaction_type"), F.col("leg.amount").alias("amount"),
            F.col("initiated_at").alias("created_at"),
        )
        .filter(F.col("wallet_id").isNotNull() & ~((F.col("transaction_type") == "CREDIT") & (key % 53 == 0)))
    )


def audit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of transfers: a first step and a last step each, some of them not allowed."""
    transfers = wallet_transfers(spark, sf_dir)
    key = F.substring("transfer_id", 2, 20).cast("long")
    middle = F.when(F.col("transfer_type") == "WALLET_TO_ACCOUNT", "DEBITED").otherwise("PENDING_PAYMENT")
    first = F.struct(
        F.lit(1).alias("step"), F.lit("INITIATED").alias("previous_value"), middle.alias("new_value"),
    )
    second = F.struct(
        F.lit(2).alias("step"),
        F.when(key % 61 == 0, F.lit("COLLECTING")).otherwise(middle).alias("previous_value"),
        F.col("status").alias("new_value"),
    )
    return transfers.select("transfer_id", "initiated_at", F.explode(F.array(first, second)).alias("s")).select(
        F.concat_ws("-", "transfer_id", F.col("s.step").cast("string")).alias("audit_id"),
        F.lit("TRANSFER_STATUS").alias("event_type"),
        "transfer_id", F.col("s.previous_value").alias("previous_value"), F.col("s.new_value").alias("new_value"),
        (F.col("initiated_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("s.step"))).alias("created_at"),
    )


def wallet_audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes with the wallet that pays."""
    payers = wallet_transfers(spark, sf_dir).filter("source_wallet_id IS NOT NULL").select("transfer_id", F.col("source_wallet_id").alias("wallet_id"))
    return audit_steps(spark, sf_dir).join(payers, "transfer_id")


def pg_webhook_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw gateway callbacks, two per order.

    One in 97 is cut off and cannot be parsed, the first of every 41st order has no
    readable time, and those of every seventh order carry error details.
    """
    o = _order_columns()
    key = o["key"]
    kind = (
        F.when(o["status"] == "F", "PAYMENT_SUCCESS_WEBHOOK")
        .when((o["status"] == "P") & (key % 2 == 0), "PAYMENT_FAILED_WEBHOOK")
        .when(o["status"] == "P", "PAYMENT_USER_DROPPED_WEBHOOK").otherwise("PAYMENT_PENDING_WEBHOOK")
    )
    order_id = (
        F.when(key % 3 == 0, _text("K", key)).when(key % 3 == 1, _text("T", key))
        .when(key % 2 == 0, _text("ORD", key)).otherwise(_text("CFO", key))
    )
    rows = table(spark, sf_dir, "orders").select(
        key.alias("k"), o["when"].alias("t"), o["amount"].alias("amount"), kind.alias("kind"),
        order_id.alias("order_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"),
    )
    k, n = F.col("k"), F.col("n")
    stamp = F.date_format(F.col("t") + F.make_dt_interval(F.lit(0), F.lit(0), n * 7 + 1), "yyyy-MM-dd'T'HH:mm:ss")
    body = F.to_json(F.struct(
        F.when((n == 1) & (k % 5 == 0), "PAYMENT_FAILED_WEBHOOK").otherwise(F.col("kind")).alias("type"),
        F.when((k % 41 == 0) & (n == 0), "unknown").otherwise(stamp).alias("event_time"),
        F.struct(
            F.struct(F.col("order_id"), F.col("amount").alias("order_amount"), F.lit("INR").alias("order_currency"))
            .alias("order"),
            F.struct(_text("CF", k).alias("cf_payment_id"), F.lit("X").alias("payment_status"),
                     F.col("amount").alias("payment_amount"), F.lit("INR").alias("payment_currency"),
                     _text("message ", k % 9).alias("payment_message"), _text("B", k).alias("bank_reference"))
            .alias("payment"),
            F.when(k % 7 == 0, F.struct(_text("E", k % 5).alias("error_code"), _text("error ", k % 3).alias("error_description")))
            .alias("error_details"),
            F.lit("ignored").alias("unknown_field"),
        ).alias("data"),
    ))
    broken = F.when((k + n) % 97 == 0, F.substring(body, 1, 60)).otherwise(body)
    return rows.select(F.concat_ws("-", k.cast("string"), n.cast("string")).alias("webhook_id"), broken.alias("body"))


def payout_webhook_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payout callbacks, two per order."""
    o = _order_columns()
    key = o["key"]
    kind = (
        F.when(o["status"] == "F", "TRANSFER_SUCCESS").when(o["status"] == "P", "TRANSFER_FAILED")
        .when(key % 2 == 0, "TRANSFER_REVERSED").otherwise("TRANSFER_PENDING")
    )
    transfer = (
        F.when(key % 3 == 0, _text("PAYOUT-T", key)).when(key % 3 == 1, _text("T", key)).otherwise(_text("NONE", key))
    )
    rows = table(spark, sf_dir, "orders").select(
        key.alias("k"), o["when"].alias("t"), o["amount"].alias("amount"), kind.alias("kind"),
        transfer.alias("transfer"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"),
    )
    k, n = F.col("k"), F.col("n")
    stamp = F.date_format(F.col("t") + F.make_dt_interval(F.lit(0), F.lit(1), n * 7), "yyyy-MM-dd'T'HH:mm:ss")
    body = F.to_json(F.struct(
        F.when((n == 1) & (k % 5 == 0), "TRANSFER_FAILED").otherwise(F.col("kind")).alias("type"),
        stamp.alias("event_time"),
        F.struct(F.struct(
            F.col("transfer").alias("transfer_id"), _text("PO", k).alias("cf_transfer_id"),
            F.lit("X").alias("transfer_status"), F.col("amount").alias("transfer_amount"),
            _text("U", k).alias("bank_reference"), _text("reason ", k % 4).alias("failure_reason"),
        ).alias("transfer")).alias("data"),
    ))
    return rows.select(F.concat_ws("-", k.cast("string"), n.cast("string")).alias("webhook_id"), body.alias("body"))


def settlement_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle = F.col("l_suppkey") % 3
    number = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("INV"), F.concat_ws("-", *number)).alias("invoice_id"),
        F.lit("PLATFORM").alias("payer_party_id"), _text("S", F.col("l_suppkey")).alias("payee_party_id"),
        F.when(cycle == 0, "NET_7").when(cycle == 1, "NET_15").otherwise("NET_30").alias("payment_cycle"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("gross_amount"),
        F.to_date("l_shipdate").alias("approved_on"),
        F.when(F.col("l_linestatus") == "F", "APPROVED").otherwise("PENDING").alias("status"),
    )


def contract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(key % 13 != 0).select(
        _text("S", key).alias("payee_party_id"),
        F.when(key % 2 == 0, F.lit("0.05")).otherwise(F.lit("0.0325")).cast("decimal(6,4)").alias("commission_pct"),
        F.when(key % 5 == 0, F.lit("0.02")).otherwise(F.lit("0.01")).cast("decimal(6,4)").alias("tds_rate"),
    )


def bank_entries(settlements: DataFrame) -> DataFrame:
    """Credits for settlements: some missing, some short, some in two parts, and some of unknown origin."""
    key = F.regexp_extract("payee_party_id", "([0-9]+)", 1).cast("long")
    half = (F.col("net_payable") / 2).cast("decimal(24,2)")
    first = F.struct(
        F.when(key % 11 == 0, F.concat(F.lit("X"), F.col("bank_ref"))).otherwise(F.col("bank_ref")).alias("bank_ref"),
        F.when(key % 5 == 0, F.col("net_payable") - 1).when(key % 4 == 0, half).otherwise(F.col("net_payable"))
        .cast("decimal(24,2)").alias("amount"),
        F.date_add("due_date", F.when(key % 6 == 0, 3).otherwise(0)).alias("value_date"),
    )
    second = F.struct(
        F.col("bank_ref"), (F.col("net_payable") - half).cast("decimal(24,2)").alias("amount"),
        F.col("due_date").alias("value_date"),
    )
    two_parts = (key % 4 == 0) & (key % 5 != 0) & (key % 11 != 0)
    parts = F.when(two_parts, F.array(first, second)).otherwise(F.array(first))
    return settlements.filter(key % 7 != 0).select(F.inline(parts))


def refund_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _order_columns()
    key = o["key"]
    rows = table(spark, sf_dir, "orders").select(
        key.alias("k"), o["when"].alias("t"), o["amount"].alias("amount"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    k, n = F.col("k"), F.col("n")
    # The third request fits most payments whose second is refused.
    share = F.when(k % 4 == 0, F.lit("0.30")).when(n == 2, F.lit("0.40")).otherwise(F.lit("0.60")).cast("decimal(4,2)")
    return rows.select(
        F.concat_ws("-", F.lit("R"), k.cast("string"), n.cast("string")).alias("refund_id"),
        _text("PT", k).alias("transaction_id"), (F.col("amount") * share).cast("decimal(18,2)").alias("refund_amount"),
        (F.col("t") + F.make_dt_interval(((k % 70) * 3 + n).cast("int"))).alias("requested_at"))


def billing_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_from(table(spark, sf_dir, "events"))


def attempts_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        _text("SUB", F.col("user_id")).alias("subscription_id"), F.to_date("ts").alias("cycle_start"),
        F.col("ts").alias("attempted_at"), kind.isin("purchase", "signup").alias("succeeded"))


def payment_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _order_columns()
    key = o["key"]
    return table(spark, sf_dir, "orders").select(
        _text("PI", key).alias("intent_id"), _text("C", F.col("o_custkey")).alias("customer_id"),
        o["amount"].alias("amount"),
        F.when(o["status"] == "F", "CAPTURED").when(o["status"] == "P", "PROCESSING").otherwise("CREATED")
        .alias("status"),
        (o["when"] + F.make_dt_interval(F.lit(0), F.lit(0), (key % 60).cast("int"))).alias("expires_at"))
