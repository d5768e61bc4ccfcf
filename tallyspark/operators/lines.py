"""Stage 2: settlement lines against orders, payments and the fee slabs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import cells as c
from tallyspark.operators.joins import top_k_per_key
from tallyspark.operators.orders import line_order
from tallyspark.schemas import ORDINAL, RESOLVES_ADJUSTMENT, RESOLVES_PAYMENT, RESOLVES_REFUND

_ORPHAN = ["debit_paise", "credit_paise", "amount_paise", "settlement_id", "settled_at"]


def find_orphan_adjustments(lines: DataFrame) -> DataFrame:
    resolves = F.lit(RESOLVES_ADJUSTMENT).alias("resolves_to")
    return lines.where("type = 'adjustment'").select(F.col("entity_id").alias("line_id"), F.col("type").alias("line_type"), *_ORPHAN, resolves)


def find_orphan_refunds(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Refunds whose payment has no line in the report."""
    paid = lines.where("type = 'payment'").select(F.col("entity_id").alias("payment_id"))
    refunds = lines.where("type = 'refund'").join(paid, "payment_id", "left_anti")
    known = orders.select("order_id", F.lit(1).alias("known")).distinct()
    found = refunds.join(known, "order_id", "left")
    return found.select(
        F.col("entity_id").alias("line_id"), F.col("type").alias("line_type"), *_ORPHAN, F.lit(RESOLVES_REFUND).alias("resolves_to"),
        F.coalesce("payment_id", F.lit("")).alias("missing_payment_id"), F.coalesce("order_id", F.lit("")).alias("missing_order_id"), F.coalesce("known", F.lit(0)).alias("order_known_to_merchant"),
    )


def refund_parent_candidates(orphan_refunds: DataFrame, lines: DataFrame, k: int = 5) -> DataFrame:
    """The first k payment lines of a refund's amount. They are ranked before the join: no amount brings more than k rows."""
    paid = lines.where("type = 'payment'").select("amount_paise", F.col("entity_id").alias("candidate_id"), F.col("settlement_id"), "settled_at", "order_id", "entity_id", *(k for k in line_order(lines) if k == ORDINAL))
    first = top_k_per_key(paid, ["amount_paise"], line_order(lines), k).drop("entity_id")
    return orphan_refunds.select("line_id", "amount_paise").join(first, "amount_paise").select("line_id", "rank", "candidate_id", "amount_paise", "settlement_id", "settled_at", "order_id")


def payment_lines_with_order(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Payment lines beside their order (null columns where it is unknown): joined once, used by all checks of payments, which take it as ``joined`` where it is at hand."""
    known = orders.select("order_id", F.col("amount_paise").alias("order_amount_paise"), F.col("created_at").alias("order_created_at"), F.lit(True).alias("known"))
    return lines.where("type = 'payment'").join(known, "order_id", "left")


def find_orphan_payments(orders: DataFrame, lines: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    found = (joined or payment_lines_with_order(orders, lines)).where("known is null")
    return found.select(F.col("entity_id").alias("line_id"), F.col("type").alias("line_type"), *_ORPHAN, F.lit(RESOLVES_PAYMENT).alias("resolves_to"), F.coalesce("order_id", F.lit("")).alias("missing_order_id"))


def find_short_captures(orders: DataFrame, lines: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    found = (joined or payment_lines_with_order(orders, lines)).where("amount_paise < order_amount_paise")
    short = F.col("order_amount_paise") - F.col("amount_paise")
    # half up in whole numbers, then two decimals
    hundredths = F.call_function("div", short * 20_000 + F.col("order_amount_paise"), F.col("order_amount_paise") * 2)
    return found.select("order_id", F.col("entity_id").alias("line_id"), "order_amount_paise", F.col("amount_paise").alias("captured_amount_paise"), short.alias("shortfall_paise"), (hundredths / 100).alias("shortfall_pct"), "settlement_id")


def find_fee_mismatches(orders: DataFrame, lines: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """Lines whose fee or tax is off the slab; orphans and short captures aren't looked at, nor lines without a method."""
    found = (joined or payment_lines_with_order(orders, lines)).where("known and amount_paise >= order_amount_paise and method is not null")
    found = found.withColumn("slab_bp", c.slab_bp("method")).withColumn("expected_fee_paise", c.expected_fee("amount_paise", "method")).withColumn("expected_tax_paise", c.expected_tax("expected_fee_paise"))
    found = found.where("expected_fee_paise != fee_paise or expected_tax_paise != tax_paise")
    hundredths = F.call_function("div", F.col("fee_paise") * 2_000_000 + F.col("amount_paise"), F.greatest(F.col("amount_paise"), F.lit(1)) * 2)
    return found.select(
        "order_id", F.col("entity_id").alias("line_id"), "method", "amount_paise", "slab_bp", "expected_fee_paise", F.col("fee_paise").alias("actual_fee_paise"), (F.col("fee_paise") - F.col("expected_fee_paise")).alias("fee_delta_paise"),
        "expected_tax_paise", F.col("tax_paise").alias("actual_tax_paise"), (F.col("tax_paise") - F.col("expected_tax_paise")).alias("tax_delta_paise"),
        F.when(F.col("amount_paise") == 0, 0.0).otherwise(hundredths / 100).alias("effective_bp"), "settlement_id",
    )


def tainted_lines(*findings: DataFrame) -> DataFrame:
    """The lines that a stage-2 finding owns."""
    out = findings[0].select("line_id")
    for f in findings[1:]:
        out = out.unionByName(f.select("line_id"))
    return out.distinct()
