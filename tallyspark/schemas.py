"""Column lists, codes, slabs and thresholds, in one place."""

from __future__ import annotations

from pyspark.sql import types as T

# Header lists of the three source files.
ORDER_COLUMNS = ["order_id", "amount_paise", "currency", "created_at", "status"]
LINE_COLUMNS = [
    "entity_id", "type", "order_id", "payment_id", "method", "currency", "debit_paise", "credit_paise", "amount_paise", "fee_paise", "tax_paise",
    "settlement_id", "settled_at", "settlement_utr", "settlement_status", "settlement_net_amount_paise", "settlement_fee_paise", "settlement_tax_paise", "settlement_created_at",
]
BANK_COLUMNS = ["bank_txn_id", "value_date", "description", "credit", "debit", "running_balance"]

#: Where a source has it: each record's place in the order of its files, as the readers give it. "First" and "last" go by it.
ORDINAL = "file_order"

# Domains, codes and causes, in the order they are declared in.
LINE_TYPES = ["payment", "refund", "adjustment"]
SETTLEMENT_STATUSES = ["processed", "on_hold"]
CODES = [
    "DUPLICATE_ORDER_PAIR", "ORDER_WITHOUT_SETTLEMENT", "ORPHAN_SETTLEMENT_LINE", "SHORT_CAPTURE", "SETTLEMENT_DELAY", "SETTLEMENT_WITHOUT_BANK_CREDIT",
    "BANK_CREDIT_WITHOUT_SETTLEMENT", "NET_MISMATCH", "UNEXPECTED_BANK_CREDIT_ON_HOLD", "FEE_SLAB_MISMATCH", "SETTLEMENT_ON_HOLD", "ORDER_STATUS_CONTRADICTION",
]
CAUSES = ["LATE_SETTLEMENT", "REFUND_NETTED", "PARTIAL_CAPTURE", "FEE_VARIANCE", "ON_HOLD", "DUPLICATE_WEBHOOK", "SILENT_UPI_FAIL", "CHARGEBACK_DEBIT", "UNEXPLAINED"]
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"
NO_DEFECT = "(no defect)"

# Fee slabs in basis points, tax on fees in percent.
FEE_BP = {"upi": 0, "card": 200, "netbanking": 180, "wallet": 220}
GST_PERCENT = 18

# Thresholds.
DUPLICATE_WINDOW_SECONDS = 90
NET_TOLERANCE_PAISE = 1
CANDIDATE_WINDOW_PAISE = 50_000
EXPECTED_DAY_DELTA = 2
CONFIDENCE_THRESHOLD = 0.70
OPENING_BALANCE_PAISE = 25_000_000

# What a human is told to do, by kind of case.
ACTION_HOLD = "chase the gateway to release the held settlement; do not book revenue as received"
ACTION_UNEXPLAINED = "flag for dashboard follow-up — trace the UTR with the bank"
ACTION_STATUS = "reconcile the order status to paid; no money movement required"
ACTION_SHORT = "book the shortfall against the order or void the uncaptured balance"
ACTION_FEE = ("book fee variance adjustment of ", " paise")
ACTION_CHARGEBACK = "raise a chargeback dispute and provision the debit"
ACTION_REFUND = "no action — refund of a prior-cycle payment, netted into this batch"
ACTION_DUPLICATE = "void the duplicate order row; revenue is overstated, no money is missing"
ACTION_LATE = "no action — timing only"
ACTION_NORMAL = "no action — likely normal T+2 settlement, not a defect"
ACTION_OPEN = "flag for dashboard follow-up"

# What a line resolves to, and why a record is a candidate.
RESOLVES_ADJUSTMENT = "neither an order nor a payment in the merchant's records"
RESOLVES_REFUND = "no payment line anywhere in this settlement report"
RESOLVES_PAYMENT = "no order in the merchant's ledger"
TWIN_SETTLED = "twin with a settlement line — the surviving candidate"
TWIN_UNSETTLED = "twin with no settlement line — the likely duplicate write"
NEAR_BANK = "bank credit close to the expected net but carrying a different UTR"
NEAR_BATCH = "settlement whose net is close to this credit but whose UTR differs"
PARENT = "payment line with an identical gross amount — possible parent"
NOT_EXPECTED = "NO_MONEY_MOVEMENT_EXPECTED"

LABELS = T.StructType([T.StructField(c, T.StringType()) for c in ("record_type", "record_id", "true_cause", "note")])
CLASSIFICATION = T.StructType(
    [
        T.StructField("residue_id", T.StringType()),
        T.StructField("predicted_cause", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("proposed_adjusting_entry", T.StructType([T.StructField("action", T.StringType()), T.StructField("amount_paise", T.LongType())])),
        T.StructField("requires_human_review", T.BooleanType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("residue_id", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("gate_forced_review", T.BooleanType()),
        T.StructField("validation_errors", T.ArrayType(T.StringType())),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("classification", CLASSIFICATION),
    ]
)
AUDIT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("residue_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("original_prediction", T.StringType()),
        T.StructField("final_cause", T.StringType()),
        T.StructField("reviewer_note", T.StringType()),
        T.StructField("original_confidence", T.DoubleType()),
        T.StructField("gate_forced", T.BooleanType()),
    ]
)
