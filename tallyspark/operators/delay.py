"""Stage 4: how many calendar days settlement took."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.lines import payment_lines_with_order
from tallyspark.schemas import EXPECTED_DAY_DELTA


def settlement_day_delta(orders: DataFrame, lines: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """Payment lines with a known order: difference of calendar dates."""
    known = (joined or payment_lines_with_order(orders, lines)).where("known")
    days = F.datediff(F.to_date("settled_at"), F.to_date("order_created_at"))
    return known.select("order_id", F.col("entity_id").alias("line_id"), days.alias("day_delta"), F.col("order_created_at").alias("created_at"), "settled_at", "settlement_id", "amount_paise", "method")


def day_delta_histogram(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("day_delta").agg(F.count("*").alias("lines")).orderBy("day_delta")


def find_settlement_delays(deltas: DataFrame, expected: int = EXPECTED_DAY_DELTA) -> DataFrame:
    return deltas.where(F.col("day_delta") > expected).select("*", F.lit(expected).alias("expected_day_delta"), (F.col("day_delta") - expected).alias("excess_days"))
