"""Stage 1: orders against the payment lines that settle them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.joins import last_per_key, runs_by_gap
from tallyspark.schemas import DUPLICATE_WINDOW_SECONDS, NOT_EXPECTED, ORDINAL

#: The order in which "last" and "first" are meant for lines that don't carry their place in the file.
LINE_ORDER = ["settled_at", "settlement_id", "entity_id"]


def line_order(lines: DataFrame) -> list[str]:
    return [ORDINAL] if ORDINAL in lines.columns else LINE_ORDER


def payment_line_per_order(lines: DataFrame) -> DataFrame:
    """Payment lines with an order id, one for each order: the last."""
    return last_per_key(lines.where("type = 'payment' and order_id is not null"), "order_id", line_order(lines))


def duplicate_groups(orders: DataFrame, window_seconds: int = DUPLICATE_WINDOW_SECONDS) -> DataFrame:
    """Orders of equal amount, each at most so many seconds after the one before: group_id, order_id, amount_paise, created_at, status."""
    runs = runs_by_gap(orders.select("order_id", "amount_paise", "created_at", "status"), "amount_paise", "created_at", "order_id", window_seconds)
    several = runs.groupBy("amount_paise", "run").agg(F.count("*").alias("n"), F.min("order_id").alias("group_id")).where("n > 1").drop("n")
    return runs.join(several, ["amount_paise", "run"]).select("group_id", "order_id", "amount_paise", "created_at", "status")


def with_settling_line(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with the line that settles them (null columns where none does) and the duplicate group they are in. The one join stage 1 needs; its operators take it as ``seen`` where it is at hand."""
    kept = [k for k in ("type", "order_id", "entity_id", "amount_paise", "settlement_id", "settled_at", "method", ORDINAL) if k in lines.columns]
    paid = payment_line_per_order(lines.select(*kept)).select("order_id", F.col("entity_id").alias("line_id"), F.col("amount_paise").alias("settled_amount_paise"), "settlement_id", "settled_at", "method")
    groups = duplicate_groups(orders).select("order_id", "group_id")
    return orders.join(paid, "order_id", "left").join(groups, "order_id", "left")


def duplicate_twins(orders: DataFrame, lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The orders of all duplicate groups, one row for each: group_id, order_id, amount_paise, created_at, status, settled, line_id.

    A group has no bound: a chain of 90-second steps may go on, and with dates for times all orders of one amount and day are one group.
    """
    seen = (seen or with_settling_line(orders, lines)).where("group_id is not null")
    return seen.select("group_id", "order_id", "amount_paise", "created_at", "status", F.col("line_id").isNotNull().alias("settled"), "line_id")


def count_duplicate_orders(twins: DataFrame) -> DataFrame:
    """DUPLICATE_ORDER_PAIR, one row for each group with its counts; its orders stay in the long table. Combined before the shuffle."""
    at = lambda best: F.unix_timestamp(best("created_at", "order_id"))
    g = twins.groupBy("group_id").agg(F.first("amount_paise").alias("amount_paise"), F.abs(at(F.max_by) - at(F.min_by)).alias("seconds_apart"), F.count("*").alias("orders_in_group"), F.count("line_id").alias("settled_orders"))
    return g.withColumn("unsettled_orders", F.col("orders_in_group") - F.col("settled_orders"))


def find_duplicate_orders(orders: DataFrame, lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """DUPLICATE_ORDER_PAIR, one row for each group: its representative (group_id, the least order) and counts. duplicate_twins lists its members."""
    return count_duplicate_orders(duplicate_twins(orders, lines, seen))


def duplicate_orders_with_members(orders: DataFrame, lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """DUPLICATE_ORDER_PAIR with all it owns, one row for each order of a group: the order, the line that settles it and the group's counts. No group is gathered into a row."""
    twins = duplicate_twins(orders, lines, seen)
    counts = count_duplicate_orders(twins).drop("amount_paise")
    return twins.join(counts, "group_id").select("group_id", "order_id", "amount_paise", "created_at", "status", "line_id", "seconds_apart", "orders_in_group", "settled_orders", "unsettled_orders")


def unsettled_orders(orders: DataFrame, lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """ORDER_WITHOUT_SETTLEMENT: paid orders that no payment line settles; those with twins name their duplicate group."""
    seen = (seen or with_settling_line(orders, lines)).where("status = 'paid' and line_id is null")
    return seen.select("order_id", F.col("status").alias("order_status"), "amount_paise", "created_at", F.col("group_id").alias("duplicate_group"))


def find_orders_without_settlement(orders: DataFrame, lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """unsettled_orders, those with twins beside their group's counts; duplicate_twins lists the twins, so the result grows like the orders."""
    seen = seen or with_settling_line(orders, lines)
    counts = find_duplicate_orders(orders, lines, seen).select(F.col("group_id").alias("duplicate_group"), (F.col("orders_in_group") - 1).alias("twins"), F.col("settled_orders").alias("settled_twins"))
    open_ = unsettled_orders(orders, lines, seen).join(counts, "duplicate_group", "left")
    return open_.select("order_id", "order_status", "amount_paise", "created_at", "duplicate_group", F.coalesce("twins", F.lit(0)).alias("twins"), F.coalesce("settled_twins", F.lit(0)).alias("settled_twins"))


def orders_without_settlement_with_twins(orders: DataFrame, lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """ORDER_WITHOUT_SETTLEMENT with the twins it names, as class rows: the findings (without_settlement true) and, once for each group that has any, its other orders (false).

    What an order is a duplicate of are the other rows of its duplicate_group, so the result grows like the orders and not like the pairs.
    """
    seen = seen or with_settling_line(orders, lines)
    open_ = (F.col("status") == "paid") & F.col("line_id").isNull()
    groups = seen.where("group_id is not null").groupBy("group_id").agg((F.count("*") - 1).alias("twins"), F.count("line_id").alias("settled_twins"), F.max(open_).alias("any_open"))
    all_ = seen.withColumn("without_settlement", open_).join(groups, "group_id", "left").where("without_settlement or any_open")
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in ("twins", "settled_twins")]
    return all_.select("order_id", F.col("status").alias("order_status"), "amount_paise", "created_at", F.col("group_id").alias("duplicate_group"), *counts, "line_id", "without_settlement")


def find_status_contradictions(orders: DataFrame, lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """ORDER_STATUS_CONTRADICTION: orders not paid, yet settled, outside duplicate groups."""
    seen = (seen or with_settling_line(orders, lines)).where("status != 'paid' and line_id is not null and group_id is null")
    return seen.select("order_id", "line_id", F.col("status").alias("order_status"), "settled_amount_paise", F.col("amount_paise").alias("order_amount_paise"), "settlement_id", "settled_at", "method")


def excluded_orders(orders: DataFrame, lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Orders that no money is expected for: not paid, not settled, outside duplicate groups."""
    seen = (seen or with_settling_line(orders, lines)).where("status != 'paid' and line_id is null and group_id is null")
    return seen.select("order_id", F.lit(NOT_EXPECTED).alias("reason"), "status", "amount_paise")
