"""The driver's order and line-item tables seen as an order ledger, a settlement report and a bank statement.

All three follow from the tables by whole-number arithmetic on their keys, so that SQL elsewhere can restate them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import cells as c
from tallyspark.schemas import OPENING_BALANCE_PAISE
from tallyspark.sources.shared import discard, stored, stored_all

_paise = lambda x: F.round(F.col(x) * 100).cast("bigint")
_key = lambda prefix, k="key": F.concat(F.lit(prefix), F.col(k).cast("string"))


def _every(n: int, k: str = "key") -> Column:
    return F.col(k) % n == 0


def _base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus").isin("F", "P"), "paid").when(_every(2, "o_orderkey"), "pending").otherwise("cancelled")
    return o.select(F.col("o_orderkey").alias("key"), _paise("o_totalprice").alias("amount_paise"), F.col("o_orderdate").cast("timestamp").alias("created_at"), status.alias("status"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base_orders(spark, sf_dir)
    twins = base.where((F.col("status") == "paid") & _every(97)).select(_key("order_dup_").alias("order_id"), "amount_paise", F.lit("INR").alias("currency"), (F.col("created_at") + F.expr("interval 45 seconds")).alias("created_at"), "status")
    return base.select(_key("order_").alias("order_id"), "amount_paise", F.lit("INR").alias("currency"), "created_at", "status").unionByName(twins)


def bare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement lines without the batch header."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    item = item.select(F.col("l_orderkey").alias("key"), nth.alias("nth"), "l_returnflag", _paise("l_extendedprice").alias("line_paise"), F.to_date("l_shipdate").alias("ship_day")).where("nth <= 3")
    both = item.join(_base_orders(spark, sf_dir), "key")
    paid = (F.col("status") == "paid") | _every(29)
    kind = F.when((F.col("nth") == 1) & paid, "payment").when((F.col("nth") == 2) & (F.col("l_returnflag") == "R") & paid, "refund").when((F.col("nth") == 3) & (F.col("l_returnflag") == "A") & _every(11), "adjustment")
    both = both.withColumn("type", kind).where("type is not null")
    pays, refunds = F.col("type") == "payment", F.col("type") == "refund"
    amount = F.when(pays & _every(37), c.div(F.col("amount_paise") * 80, 100)).when(pays, F.col("amount_paise")).otherwise(F.col("line_paise"))
    both = both.withColumn("gross", amount).withColumn("method", F.when(pays, F.element_at(F.array(*map(F.lit, ("upi", "card", "netbanking", "wallet"))), (F.col("key") % 4 + 1).cast("int"))))
    fee = F.when(pays, F.when(_every(41), c.div(F.col("gross") * (c.slab_bp("method") + 40) + 5000, 10_000)).otherwise(c.expected_fee("gross", "method"))).otherwise(F.lit(0).cast("bigint"))
    both = both.withColumn("fee_paise", fee).withColumn("tax_paise", c.expected_tax("fee_paise"))
    late = F.when(_every(43), 3).otherwise(0) + F.when(_every(31), 1).otherwise(0)
    day = F.when(pays, F.date_add(F.to_date("created_at"), F.lit(2) + late)).otherwise(F.col("ship_day"))
    return both.select(
        F.when(pays, _key("pay_")).when(refunds, _key("rfnd_")).otherwise(_key("adj_")).alias("entity_id"),
        "type",
        F.when(pays & _every(101), _key("order_unknown_")).when(pays | refunds, _key("order_")).alias("order_id"),
        F.when(pays, _key("pay_")).when(refunds & _every(53), _key("pay_prior_")).when(refunds, _key("pay_")).alias("payment_id"),
        "method",
        F.when(pays | refunds, F.lit("INR")).alias("currency"),
        F.when(pays, F.lit(0).cast("bigint")).otherwise(F.col("gross")).alias("debit_paise"),
        F.when(pays, F.col("gross") - F.col("fee_paise") - F.col("tax_paise")).otherwise(F.lit(0).cast("bigint")).alias("credit_paise"),
        F.col("gross").alias("amount_paise"),
        "fee_paise",
        "tax_paise",
        F.concat(F.lit("setl_"), F.date_format(day, "yyyyMMdd")).alias("settlement_id"),
        day.cast("timestamp").alias("settled_at"),
    )


def _with_day_number(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn("day_no", F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")))


def headers(bare: DataFrame) -> DataFrame:
    """One row for each batch day: settlement_id, settled_at, net, fee and tax, stated net, status, utr, day_no."""
    h = bare.groupBy("settlement_id", "settled_at").agg(F.sum(F.col("credit_paise") - F.col("debit_paise")).alias("net"), F.sum("fee_paise").alias("settlement_fee_paise"), F.sum("tax_paise").alias("settlement_tax_paise"))
    h = _with_day_number(h, "settled_at")
    stated = F.col("net") + F.when(_every(59, "day_no"), 7).otherwise(0)
    return h.select("*", F.concat(F.lit("2025"), F.date_format("settled_at", "yyyyMMdd")).alias("settlement_utr"), F.when(_every(17, "day_no"), "on_hold").otherwise("processed").alias("settlement_status"), stated.alias("settlement_net_amount_paise"), F.col("settled_at").alias("settlement_created_at"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = bare_lines(spark, sf_dir)
    return _lines(bare, headers(bare))


def _lines(bare: DataFrame, h: DataFrame) -> DataFrame:
    head = h.select("settlement_id", "settlement_utr", "settlement_status", "settlement_net_amount_paise", "settlement_fee_paise", "settlement_tax_paise", "settlement_created_at")
    return bare.join(head, "settlement_id").select(*[k for k in bare.columns if k != "settled_at"], "settled_at", *head.columns[1:])


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bank(headers(bare_lines(spark, sf_dir)))


def _bank(h: DataFrame) -> DataFrame:
    h = h.select("settled_at", "settlement_utr", "settlement_status", "net", "day_no")
    held = F.col("settlement_status") == "on_hold"
    real = h.where((~held & ~_every(47, "day_no")) | (held & _every(85, "day_no")))
    slip = F.when(~held & _every(23, "day_no"), 3).when(~held & _every(19, "day_no"), 1).otherwise(0)
    real = real.select("settled_at", "day_no", F.lit(1).alias("n"), F.col("settlement_utr").alias("utr"), (F.col("net") + slip).alias("credit_paise"))
    ghosts = h.where(_every(29, "day_no")).select("settled_at", "day_no", F.lit(2).alias("n"), F.concat(F.lit("9999"), F.date_format("settled_at", "yyyyMMdd")).alias("utr"), (F.col("net") + 100).alias("credit_paise"))
    rows = real.unionByName(ghosts)
    form = F.col("day_no") % 4
    text = (
        F.when(form == 0, F.concat(F.lit("RAZORPAY SETTLEMENT "), "utr"))
        .when(form == 1, F.concat(F.lit("NEFT CR-"), "utr", F.lit("-RAZORPAY SOFTWARE PVT LTD")))
        .when(form == 2, F.concat(F.lit("IMPS/"), "utr", F.lit("/RAZORPAYSOFT")))
        .otherwise(F.concat(F.lit("TRANSFER REF "), "utr", F.lit(" OK")))
    )
    name = F.element_at(F.array(*map(F.lit, ("RAZORPAY_SETTLEMENT", "NEFT_CR", "IMPS", "UNKNOWN_FORMAT"))), (form + 1).cast("int"))
    rows = rows.select(F.concat(F.lit("txn"), F.date_format("settled_at", "yyyyMMdd"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("bank_txn_id"), F.to_date("settled_at").alias("value_date"), text.alias("description"), "utr", name.alias("description_format"), "credit_paise", F.lit(0).cast("bigint").alias("debit_paise"), F.lit("main").alias("account"))
    # a statement has one row or two for each day, so this window's size is the number of days
    so_far = Window.partitionBy("account").orderBy("value_date", "bank_txn_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_balance_paise", F.sum(F.col("credit_paise") - F.col("debit_paise")).over(so_far) + OPENING_BALANCE_PAISE).drop("account")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """orders, lines, bank and labels, stored: the line items are ranked and joined once for all of them."""
    base, bare = stored_all(orders(spark, sf_dir), bare_lines(spark, sf_dir))
    head = stored(headers(bare))
    credits = stored(_bank(head))
    # a row for each batch day goes to all tasks, so the lines aren't shuffled by their few batches
    both = stored(_lines(bare, F.broadcast(head)))
    truth = stored(_labels(bare, head, credits, _base_orders(spark, sf_dir)))
    discard(bare, head)
    return base, both, credits, truth


# --- the same with dirt, all cells text, for the normalisers ------------------------------------------------------


def _iso(x: str) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _dirty(x: str, number: str) -> Column:
    """Every 13th id padded and upper-cased."""
    n = F.regexp_extract(F.col(number), r"(\d+)$", 1).cast("bigint")
    return F.coalesce(F.when(n % 13 == 0, F.concat(F.lit("  "), F.upper(x), F.lit("\t"))).otherwise(F.col(x)), F.lit(""))


def raw_orders(spark: SparkSession, sf_dir: str, o: DataFrame | None = None) -> DataFrame:
    """``o``: the orders where they are at hand; so with the lines and the bank."""
    o = o or orders(spark, sf_dir)
    return o.select(_dirty("order_id", "order_id").alias("order_id"), F.col("amount_paise").cast("string").alias("amount_paise"), "currency", _iso("created_at").alias("created_at"), "status")


def raw_lines(spark: SparkSession, sf_dir: str, ln: DataFrame | None = None) -> DataFrame:
    ln = ln or lines(spark, sf_dir)
    ids = {"entity_id", "order_id", "payment_id", "settlement_id"}
    out = []
    for k in ln.columns:
        out.append((_dirty(k, "entity_id") if k in ids else _iso(k) if k in ("settled_at", "settlement_created_at") else F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k))
    return ln.select(*out)


def raw_bank(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    b = b or bank(spark, sf_dir)
    odd = F.dayofmonth("value_date") % 2 == 1
    return b.select(
        _dirty("bank_txn_id", "bank_txn_id").alias("bank_txn_id"),
        F.when(odd, c.slash_date("value_date")).otherwise(c.iso_date("value_date")).alias("value_date"),
        "description",
        c.format_indian_rupees("credit_paise").alias("credit"),
        F.lit("").alias("debit"),
        c.format_indian_rupees("running_balance_paise").alias("running_balance"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: record_type, record_id, true_cause, note."""
    bare = bare_lines(spark, sf_dir)
    return _labels(bare, headers(bare), bank(spark, sf_dir), _base_orders(spark, sf_dir))


def _labels(bare: DataFrame, h: DataFrame, credits: DataFrame, base: DataFrame) -> DataFrame:
    ln = bare.select("entity_id", "type", "settlement_id", F.regexp_extract("entity_id", r"(\d+)$", 1).cast("bigint").alias("key"))
    pays = F.col("type") == "payment"

    def rows(df: DataFrame, kind: str, id_: Column | str, cause: str) -> DataFrame:
        return df.select(F.lit(kind).alias("record_type"), (F.col(id_) if isinstance(id_, str) else id_).alias("record_id"), F.lit(cause).alias("true_cause"))

    # a record carries one cause, the first of these that fits it
    one = F.when(_every(37), "PARTIAL_CAPTURE").when(_every(41), "FEE_VARIANCE").when(_every(43), "LATE_SETTLEMENT")
    known = ln.where(pays & ~_every(101)).select(F.lit("payment").alias("record_type"), F.col("entity_id").alias("record_id"), one.alias("true_cause")).where("true_cause is not null")
    parts = [
        known,
        rows(ln.where((F.col("type") == "refund") & _every(53)), "refund", "entity_id", "REFUND_NETTED"),
        rows(ln.where("type = 'adjustment'"), "settlement_line", "entity_id", "CHARGEBACK_DEBIT"),
        rows(base.where((F.col("status") == "paid") & _every(97)), "order", _key("order_dup_"), "DUPLICATE_WEBHOOK"),
        rows(base.where((F.col("status") == "pending") & _every(29)).join(ln.where(pays & ~_every(101)), "key", "left_semi"), "order", _key("order_"), "SILENT_UPI_FAIL"),
        rows(h.where("settlement_status = 'on_hold'"), "settlement", "settlement_id", "ON_HOLD"),
        rows(credits.where("utr like '9999%'"), "bank_txn", "bank_txn_id", "UNEXPLAINED"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("note", F.concat(F.lit("planted on "), "record_id"))
