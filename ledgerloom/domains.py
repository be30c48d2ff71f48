"""Closed sets of values carried by the payment tables."""

# Fixed values.
TERMINAL_TRANSFER_STATUSES = ("COMPLETED", "FAILED", "REVERSED")
FAILED_STATUSES = ("FAILED", "REVERSED")

# Fixed values.
TERMINAL_GATEWAY_STATUSES = ("SUCCESS", "FAILED", "EXPIRED", "CANCELLED", "REFUNDED")

# States a transfer of each type passes through, in order, and the states it may end in.
STATUS_PATHS = {
    "WALLET_TO_WALLET": (("INITIATED",), ("COMPLETED", "FAILED")),
    "WALLET_TO_ACCOUNT": (("INITIATED", "DEBITED", "PAYOUT_INITIATED"), ("COMPLETED", "FAILED", "REVERSED")),
    "ACCOUNT_TO_WALLET": (("INITIATED", "PENDING_PAYMENT", "COLLECTING"), ("COMPLETED", "FAILED")),
    "ACCOUNT_TO_ACCOUNT": (
        ("INITIATED", "PENDING_PAYMENT", "COLLECTING", "PAYOUT_INITIATED"),
        ("COMPLETED", "FAILED", "REVERSED"),
    ),
}

# Fixed values.
TRANSFER_STATUS_TEXT = {
    "INITIATED": "Transfer initiated",
    "PENDING_PAYMENT": "Awaiting payment — redirect user to paymentLink",
    "COLLECTING": "Payment received, processing payout",
    "DEBITED": "Source wallet debited, payout pending",
    "PAYOUT_INITIATED": "Payout initiated, awaiting bank settlement",
    "COMPLETED": "Transfer completed successfully",
    "FAILED": "Transfer failed",
    "REVERSED": "Transfer reversed — funds returned to source",
}

# Fixed values; statuses not listed are shown by their own name.
GATEWAY_STATUS_TEXT = {
    "INITIATED": "Payment initiated",
    "PENDING_PAYMENT": "Awaiting user payment",
    "PROCESSING": "Payment processing",
    "SUCCESS": "Payment successful",
    "FAILED": "Payment failed",
    "EXPIRED": "Payment order expired",
    "CANCELLED": "Payment cancelled by user",
    "REFUNDED": "Payment refunded",
}

# Months back from now per named history period.
HISTORY_PERIODS = {
    "LAST_MONTH": 1, "LAST_3_MONTHS": 3, "LAST_6_MONTHS": 6, "LAST_YEAR": 12,
    "LAST_2_YEARS": 24, "LAST_3_YEARS": 36, "LAST_5_YEARS": 60, "LAST_7_YEARS": 84,
}
MAX_HISTORY_YEARS = 7

# Pipelines that keep a high-water mark, and where a new one starts.
PIPELINES = (
    "customer_hourly_rollup", "customer_daily_rollup", "customer_monthly_rollup",
    "org_hourly_rollup", "org_daily_rollup", "org_monthly_rollup",
)
FIRST_MARK = "2020-01-01 00:00:00"

DEFAULT_CURRENCY = "INR"
PAYOUT_PREFIX = "PAYOUT-"
