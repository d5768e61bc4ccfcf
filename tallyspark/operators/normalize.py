"""Raw text tables to typed ones, with the raw row kept, an audit of what changed, and quarantine of what can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import cells as c
from tallyspark.schemas import LINE_TYPES, ORDINAL, SETTLEMENT_STATUSES


def _typed(raw: DataFrame, fields: dict[str, tuple[str, Column]], optional: tuple[str, ...] = ()) -> DataFrame:
    """fields: name -> (source column, value). A required value that came out null is an error with field and raw text. A record's place in the file stays beside it."""
    bad = [F.when(v.isNull(), F.struct(F.lit(name).alias("field"), F.col(source).alias("raw"))) for name, (source, v) in fields.items() if name not in optional]
    row = F.create_map(*(x for k in raw.columns if k != ORDINAL for x in (F.lit(k), F.col(f"`{k}`"))))
    return raw.select(*(v.alias(k) for k, (_, v) in fields.items()), *(k for k in raw.columns if k == ORDINAL), row.alias("raw"), F.array_compact(F.array(*bad)).alias("errors"))


def _one_of(name: str, domain: list[str]) -> Column:
    t = c.trim_all(name)
    return F.when(t.isin(domain), t)


def normalize_orders(raw: DataFrame) -> DataFrame:
    return _typed(
        raw,
        {
            "order_id": ("order_id", c.optional_id("order_id")),
            "amount_paise": ("amount_paise", c.parse_integer_paise("amount_paise")),
            "currency": ("currency", c.trim_all("currency")),
            "created_at": ("created_at", c.normalize_timestamp("created_at")),
            "status": ("status", c.trim_all("status")),
        },
    )


def normalize_lines(raw: DataFrame) -> DataFrame:
    ids, money = ("order_id", "payment_id"), ("debit_paise", "credit_paise", "amount_paise", "fee_paise", "tax_paise")
    fields = {"entity_id": ("entity_id", c.optional_id("entity_id")), "type": ("type", _one_of("type", LINE_TYPES))}
    fields |= {k: (k, c.optional_id(k)) for k in ids}
    fields |= {k: (k, F.nullif(c.trim_all(k), F.lit(""))) for k in ("method", "currency")}
    fields |= {k: (k, c.parse_integer_paise(k)) for k in money}
    fields |= {"settlement_id": ("settlement_id", c.optional_id("settlement_id")), "settled_at": ("settled_at", c.normalize_timestamp("settled_at"))}
    fields |= {"settlement_utr": ("settlement_utr", c.normalize_id("settlement_utr")), "settlement_status": ("settlement_status", _one_of("settlement_status", SETTLEMENT_STATUSES))}
    fields |= {k: (k, c.parse_integer_paise(k)) for k in ("settlement_net_amount_paise", "settlement_fee_paise", "settlement_tax_paise")}
    fields |= {"settlement_created_at": ("settlement_created_at", c.normalize_timestamp("settlement_created_at"))}
    return _typed(raw, fields, optional=(*ids, "method", "currency"))


def normalize_bank(raw: DataFrame) -> DataFrame:
    utr = c.extract_utr("description")
    return _typed(
        raw,
        {
            "bank_txn_id": ("bank_txn_id", c.optional_id("bank_txn_id")),
            "value_date": ("value_date", c.normalize_date("value_date")),
            "description": ("description", c.trim_all("description")),
            "utr": ("description", utr["utr"]),
            "description_format": ("description", utr["format"]),
            "credit_paise": ("credit", c.parse_paise("credit")),
            "debit_paise": ("debit", c.parse_paise("debit")),
            "running_balance_paise": ("running_balance", c.parse_paise("running_balance")),
        },
    )


def quarantine(df: DataFrame, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects: field, raw, reason). In strict mode reading the good rows fails on the first bad one."""
    rejects = df.select(F.explode("errors").alias("e")).select("e.field", "e.raw", F.concat(F.lit("unreadable "), "e.field").alias("reason"))
    if mode == "strict":
        first = F.get("errors", F.lit(0))
        checked = F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("unreadable "), first["field"], F.lit(": "), first["raw"]))).otherwise(F.lit(True))
        return df.where(checked.cast("boolean")).drop("errors"), rejects
    return df.where(F.size("errors") == 0).drop("errors"), rejects


def corrections(orders: DataFrame, lines: DataFrame, bank: DataFrame) -> DataFrame:
    """source, field, raw, normalized, and if all three carry it the record's place in the file with the cell's in the record: every cell whose text changed; all transfer references found; amounts written with ``,`` or ``.``"""

    ordered = all(ORDINAL in df.columns for df in (orders, lines, bank))

    def changed(df: DataFrame, source: str, cells: list[tuple[str, str, Column]]) -> DataFrame:
        made = []
        for field, column, value in cells:
            raw = F.col("raw")[column]
            if field.startswith("description"):
                made.append(F.struct(F.concat(F.lit("description["), F.col("description_format"), F.lit("]")).alias("field"), raw.alias("raw"), value.alias("normalized"), F.lit(True).alias("keep")))
            elif field in ("credit", "debit", "running_balance"):
                made.append(F.struct(F.lit(field).alias("field"), raw.alias("raw"), value.cast("string").alias("normalized"), raw.rlike("[,.]").alias("keep")))
            else:
                text = F.coalesce(value.cast("string"), F.lit(""))
                made.append(F.struct(F.lit(field).alias("field"), raw.alias("raw"), text.alias("normalized"), (raw != text).alias("keep")))
        place = [k for k in df.columns if k == ORDINAL and ordered]
        rows = df.select(*place, F.posexplode(F.array(*made)).alias("cell", "x")).where("x.keep")
        return rows.select(F.lit(source).alias("source"), F.col("x.field"), F.col("x.raw"), F.col("x.normalized"), *place, *(["cell"] if place else []))

    def same(*names: str) -> list[tuple[str, str, Column]]:
        return [(k, k, F.col(k)) for k in names]

    parts = [
        changed(orders, "orders", same("order_id")),
        changed(lines, "settlement_report", same("entity_id", "order_id", "payment_id", "settlement_id", "settlement_utr")),
        changed(bank, "bank_statement", [*same("bank_txn_id"), ("value_date", "value_date", c.iso_date("value_date")), ("description", "description", F.col("utr")), ("credit", "credit", F.col("credit_paise")), ("debit", "debit", F.col("debit_paise")), ("running_balance", "running_balance", F.col("running_balance_paise"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source", F.concat_ws(".", "source", "field").alias("field"), *out.columns[2:])


def correction_counts(orders: DataFrame, lines: DataFrame, bank: DataFrame) -> DataFrame:
    """field, corrections, and a row ``total``."""
    found = corrections(orders, lines, bank)
    return found.rollup("field").agg(F.count("*").alias("corrections"), F.grouping("field").alias("all")).select(F.when(F.col("all") == 1, "total").otherwise(F.col("field")).alias("field"), "corrections")


def correction_samples(orders: DataFrame, lines: DataFrame, bank: DataFrame, per_field: int = 3) -> DataFrame:
    """The first few corrections of each field, in the order of the files if the records carry it; else the first few distinct ones, by raw text."""
    found = corrections(orders, lines, bank)
    if ORDINAL in found.columns:
        first = F.row_number().over(Window.partitionBy("field").orderBy(ORDINAL, "cell"))  # Spark cuts each task's rows before the shuffle
        return found.withColumn("rank", first).where(F.col("rank") <= per_field).select("field", "rank", "raw", "normalized")
    found = found.select("field", "raw", "normalized")
    # only the least few of each group leave a task: distinct pairs first, then a rank that Spark limits before the shuffle
    ranked = found.distinct().select("*", F.row_number().over(Window.partitionBy("field").orderBy("raw", "normalized")).alias("rank")).where(F.col("rank") <= per_field)
    return ranked.select("field", "rank", "raw", "normalized")


def rows_by_source(orders: DataFrame, lines: DataFrame, bank: DataFrame) -> DataFrame:
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), "rows") for name, df in (("orders", orders), ("settlement_report", lines), ("bank_statement", bank))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
