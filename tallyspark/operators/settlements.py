"""Stage 3: settlement batches against bank credits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.joins import nearest_k
from tallyspark.operators.orders import line_order
from tallyspark.schemas import CANDIDATE_WINDOW_PAISE, NET_TOLERANCE_PAISE

#: What of a batch's first line is kept as it stood in the file.
_RAW_HEADER = ["settlement_id", "settlement_utr", "settlement_status", "settlement_net_amount_paise", "settlement_created_at"]


def group_settlements(lines: DataFrame) -> DataFrame:
    """One row for each batch; header fields, and their raw cells if the lines have any, come from its first line. Lines are summed up, not gathered."""
    cells = [F.struct(*(F.coalesce(F.col("raw")[k], F.lit("")).alias(k) for k in _RAW_HEADER)).alias("raw")] if "raw" in lines.columns else []
    head = F.min_by(F.struct("settlement_utr", "settlement_status", "settled_at", "settlement_net_amount_paise", *cells), F.struct(*line_order(lines)))
    g = lines.groupBy("settlement_id").agg(head.alias("h"), F.sum(F.col("credit_paise") - F.col("debit_paise")).alias("expected_net_paise"), F.count("*").alias("line_count"))
    return g.select("settlement_id", F.col("h.settlement_utr").alias("utr"), F.col("h.settlement_status").alias("status"), F.col("h.settled_at").alias("settled_at"), "expected_net_paise", F.col("h.settlement_net_amount_paise").alias("stated_net_paise"), "line_count", *([F.col("h.raw").alias("raw")] if cells else []))


def tie_settlement_to_bank(groups: DataFrame, bank: DataFrame) -> DataFrame:
    """Batches with the first bank row of their reference and how many there are."""
    first = bank.groupBy("utr").agg(F.min_by(F.struct("bank_txn_id", "credit_paise"), "bank_txn_id").alias("b"), F.count("*").alias("n"))
    tied = groups.join(first, "utr", "left")
    return tied.select(*(k for k in groups.columns if k != "raw"), F.col("b.bank_txn_id").alias("bank_txn_id"), F.col("b.credit_paise").alias("bank_credit_paise"), F.coalesce("n", F.lit(0)).alias("bank_rows_for_utr"))


_GROUP = ["settlement_id", "utr", "status", "settled_at", "expected_net_paise", "stated_net_paise", "line_count"]


def find_on_hold(tied: DataFrame) -> DataFrame:
    return tied.where("status = 'on_hold' and bank_txn_id is null").select(*_GROUP, F.col("expected_net_paise").alias("withheld_paise"))


def find_unexpected_credit_on_hold(tied: DataFrame) -> DataFrame:
    return tied.where("status = 'on_hold' and bank_txn_id is not null").select(*_GROUP, "bank_txn_id", "bank_credit_paise")


def find_missing_bank_credit(tied: DataFrame) -> DataFrame:
    return tied.where("status != 'on_hold' and bank_txn_id is null").select(*_GROUP, "bank_rows_for_utr")


def _off(tolerance_paise: int):
    return (F.abs(F.col("bank_credit_paise") - F.col("expected_net_paise")) > tolerance_paise) | (F.col("stated_net_paise") != F.col("expected_net_paise"))


def find_net_mismatch(tied: DataFrame, tolerance_paise: int = NET_TOLERANCE_PAISE) -> DataFrame:
    found = tied.where("status != 'on_hold' and bank_txn_id is not null").where(_off(tolerance_paise))
    return found.select(*_GROUP, "bank_txn_id", "bank_credit_paise", (F.col("bank_credit_paise") - F.col("expected_net_paise")).alias("delta_paise"), (F.col("stated_net_paise") - F.col("expected_net_paise")).alias("header_vs_lines_delta_paise"))


def failing_reason(tolerance_paise: int = NET_TOLERANCE_PAISE):
    """The code of the finding that a tied batch brings, null where it reconciles: the four of them in one pass."""
    held, open_, credited = F.col("status") == "on_hold", F.col("status") != "on_hold", F.col("bank_txn_id").isNotNull()
    reason = F.when(held & ~credited, "SETTLEMENT_ON_HOLD").when(held, "UNEXPECTED_BANK_CREDIT_ON_HOLD")
    return reason.when(open_ & ~credited, "SETTLEMENT_WITHOUT_BANK_CREDIT").when(open_ & _off(tolerance_paise), "NET_MISMATCH")


def reconciled(tied: DataFrame, tolerance_paise: int = NET_TOLERANCE_PAISE) -> DataFrame:
    """The batches that tie to their bank row."""
    return tied.where("status != 'on_hold' and bank_txn_id is not null").where(~_off(tolerance_paise)).select("settlement_id", "bank_txn_id", "expected_net_paise")


def find_unclaimed_bank_credits(groups: DataFrame, bank: DataFrame) -> DataFrame:
    return bank.join(groups.select("utr").distinct(), "utr", "left_anti").select("bank_txn_id", "utr", "description", "description_format", "credit_paise", "value_date")


def nearby_bank_candidates(groups: DataFrame, bank: DataFrame, window_paise: int = CANDIDATE_WINDOW_PAISE, k: int = 5) -> DataFrame:
    """For each batch the nearest bank rows by amount; ties by id."""
    rows = bank.select("bank_txn_id", "credit_paise", F.col("utr"), "value_date")
    near = nearest_k(groups.select("settlement_id", "expected_net_paise"), rows, "expected_net_paise", "credit_paise", "bank_txn_id", window_paise, k)
    return near.select("settlement_id", "rank", "bank_txn_id", "credit_paise", (F.col("credit_paise") - F.col("expected_net_paise")).alias("delta_paise"), "utr", "value_date")


def nearby_settlement_candidates(bank: DataFrame, groups: DataFrame, window_paise: int = CANDIDATE_WINDOW_PAISE, k: int = 5) -> DataFrame:
    """For each bank row the nearest batches by net; ties by id."""
    near = nearest_k(bank.select("bank_txn_id", "credit_paise"), groups.select("settlement_id", "expected_net_paise", "utr", "settled_at"), "credit_paise", "expected_net_paise", "settlement_id", window_paise, k)
    return near.select("bank_txn_id", "rank", "settlement_id", "expected_net_paise", (F.col("credit_paise") - F.col("expected_net_paise")).alias("delta_paise"), "utr", "settled_at")


def settlement_ownership(failed: DataFrame, lines: DataFrame, orders: DataFrame) -> DataFrame:
    """What a failed batch owns: itself, its lines, the known orders of its payment lines, the bank row if it names one. settlement_id, kind, id.

    An order id that no order has isn't owned: its line is an orphan in its own right.
    """
    own = failed.select("settlement_id", F.lit("settlement").alias("kind"), F.col("settlement_id").alias("id"))
    if "bank_txn_id" in failed.columns:
        own = own.unionByName(failed.where("bank_txn_id is not null").select("settlement_id", F.lit("bank_txn").alias("kind"), F.col("bank_txn_id").alias("id")))
    both = lines.join(failed.select("settlement_id"), "settlement_id", "left_semi")
    own = own.unionByName(both.select("settlement_id", F.lit("settlement_line").alias("kind"), F.col("entity_id").alias("id")))
    paid = both.where("type = 'payment' and order_id is not null").join(orders.select("order_id"), "order_id", "left_semi")
    return own.unionByName(paid.select("settlement_id", F.lit("order").alias("kind"), F.col("order_id").alias("id")))
