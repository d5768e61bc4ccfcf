"""Building settlements: lines from payments, batches, reports and the bank statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import cells as c
from tallyspark.operators.joins import asof_forward, running_sum
from tallyspark.schemas import OPENING_BALANCE_PAISE


def expected_payment_lines(payments: DataFrame, lag_days: int = 2) -> DataFrame:
    """payments (payment_id, order_id, amount_paise, method, captured_at) -> lines with fee, tax, credit and settle day."""
    rows = payments.withColumn("fee_paise", c.expected_fee("amount_paise", "method")).withColumn("tax_paise", c.expected_tax("fee_paise"))
    return rows.select(
        F.col("payment_id").alias("entity_id"), F.lit("payment").alias("type"), "order_id", "payment_id", "method", F.lit(0).cast("bigint").alias("debit_paise"),
        (F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")).alias("credit_paise"), "amount_paise", "fee_paise", "tax_paise", F.date_add(F.to_date("captured_at"), lag_days).alias("settle_day"),
    )


def assign_debits_to_batch(debits: DataFrame, batch_days: DataFrame, by: str | None = None) -> DataFrame:
    """debits (due_day, ...) get batch_day: the first batch day from there on, else the last one."""
    return asof_forward(debits, batch_days, "due_day", "batch_day", "batch_day", by)


def settlement_headers(lines: DataFrame) -> DataFrame:
    return lines.groupBy("settlement_id").agg(F.sum(F.col("credit_paise") - F.col("debit_paise")).alias("net_amount_paise"), F.sum("fee_paise").alias("fee_paise"), F.sum("tax_paise").alias("tax_paise"))


def debit_cap(payments: DataFrame, floor_paise: int = 10_000) -> DataFrame:
    """cap_paise: half the lower median of the days' gross, at least the floor. There is one row for each day."""
    days = payments.groupBy("settle_day").agg(F.sum("amount_paise").alias("gross"))
    w = Window.partitionBy(F.lit(1)).orderBy("gross", "settle_day")
    ranked = days.select("gross", F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("total"))
    return ranked.where(F.col("n") == c.div(F.col("total") + 1, 2)).select(F.greatest(c.div(F.col("gross"), 2), F.lit(floor_paise)).alias("cap_paise"))


def settlement_report(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines beside their batch's header; a line without one is an error."""
    h = headers.select("settlement_id", F.col("net_amount_paise").alias("settlement_net_amount_paise"), F.col("fee_paise").alias("settlement_fee_paise"), F.col("tax_paise").alias("settlement_tax_paise"), *[k for k in headers.columns if k not in ("settlement_id", "net_amount_paise", "fee_paise", "tax_paise")])
    both = lines.join(h, "settlement_id", "left")
    sure = F.when(F.col("settlement_net_amount_paise").isNull(), F.raise_error(F.concat(F.lit("no header for "), "settlement_id")).cast("bigint")).otherwise(F.col("settlement_net_amount_paise"))
    return both.withColumn("settlement_net_amount_paise", sure)


def bank_statement(headers: DataFrame, opening_paise: int = OPENING_BALANCE_PAISE) -> DataFrame:
    """headers (settlement_id, utr, status, day, net_amount_paise) -> a credit for each processed batch, with running balance, also as rendered text."""
    rows = headers.where("status = 'processed'").select(
        F.concat(F.lit("txn"), "utr").alias("bank_txn_id"), F.col("day").alias("value_date"), F.concat(F.lit("NEFT CR-"), "utr", F.lit("-RAZORPAY SOFTWARE PVT LTD")).alias("description"),
        F.col("net_amount_paise").alias("credit_paise"), F.lit(0).cast("bigint").alias("debit_paise"), F.lit("main").alias("account"),
    )
    rows = running_sum(rows, F.col("credit_paise") - F.col("debit_paise"), "account", ["value_date", "bank_txn_id"], "running_balance_paise").drop("account")
    rows = rows.withColumn("running_balance_paise", F.col("running_balance_paise") + opening_paise)
    return rows.select("*", c.slash_date("value_date").alias("value_date_text"), c.format_indian_rupees("credit_paise").alias("credit_text"), c.format_indian_rupees("running_balance_paise").alias("running_balance_text"))
