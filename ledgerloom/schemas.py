"""Schemas of the tables and messages the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(24, 2)
AVERAGE = T.DecimalType(24, 6)
RATE = T.DecimalType(9, 2)

_FACT_TAIL = (
    "source_wallet_id string, transfer_id string, pg_order_id string, cf_payment_id string, "
    "bank_reference string, transfer_type string, amount decimal(18,2), fees decimal(18,2), "
    "net_amount decimal(18,2), currency string, counterparty_id string, counterparty_name string, "
    "counterparty_type string, status string, txn_date timestamp_ntz, txn_year_month int, description string"
)

CUSTOMER_FACTS = f"txn_id string, customer_id string, {_FACT_TAIL}"
ORG_FACTS = f"txn_id string, org_id string, division_id string, {_FACT_TAIL}"

SUCCESS_EVENT = (
    "event_id string, source_type string, customer_id string, source_wallet_id string, org_id string, "
    "division_id string, org_wallet_id string, transfer_id string, pg_order_id string, cf_payment_id string, "
    "bank_reference string, transfer_type string, status string, amount decimal(18,2), fees decimal(18,2), "
    "net_amount decimal(18,2), currency string, counterparty_id string, counterparty_name string, "
    "counterparty_type string, description string, succeeded_at timestamp_ntz"
)

PIPELINE_MARKS = (
    "pipeline_name string, last_processed_at timestamp_ntz, last_run_at timestamp_ntz, records_processed bigint"
)

# Wire names of the success event are camelCase; unknown fields are ignored by from_json.
SUCCESS_MESSAGE = (
    "eventId string, sourceType string, customerId string, sourceWalletId string, orgId string, "
    "divisionId string, orgWalletId string, transferId string, pgOrderId string, cfPaymentId string, "
    "bankReference string, transferType string, status string, amount decimal(18,2), fees decimal(18,2), "
    "netAmount decimal(18,2), currency string, counterpartyId string, counterpartyName string, "
    "counterpartyType string, description string, succeededAt timestamp_ntz"
)

PG_WEBHOOK = (
    "type string, event_time string, data struct<"
    "order: struct<order_id: string, order_amount: decimal(18,2), order_currency: string>, "
    "payment: struct<cf_payment_id: string, payment_status: string, payment_amount: decimal(18,2), "
    "payment_currency: string, payment_message: string, payment_time: string, bank_reference: string>, "
    "customer_details: struct<customer_id: string, customer_name: string, customer_email: string, "
    "customer_phone: string>, "
    "error_details: struct<error_code: string, error_description: string, error_reason: string, "
    "error_source: string>>"
)

PAYOUT_WEBHOOK = (
    "type string, event_time string, data struct<transfer: struct<transfer_id: string, cf_transfer_id: string, "
    "transfer_status: string, transfer_amount: decimal(18,2), bank_reference: string, failure_reason: string>>"
)
