"""Checks of a dataset, independent of the matching: each gives check, passed, failures and a sample failure.

Not imported by the matching or classifying modules, nor the other way round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import cells as c
from tallyspark.operators.joins import running_sum
from tallyspark.schemas import CAUSES, DUPLICATE_WINDOW_SECONDS, OPENING_BALANCE_PAISE, ORDINAL
from tallyspark.sources.shared import stored


def _check(name: str, failures: DataFrame, what: Column, times: str | None = None) -> DataFrame:
    """One row: check, passed, failures (how many; a row counts ``times``), detail (the least of them)."""
    return failures.agg((F.coalesce(F.sum(times), F.lit(0)) if times else F.count("*")).alias("failures"), F.min(what).alias("detail")).select(F.lit(name).alias("check"), (F.col("failures") == 0).alias("passed"), "failures", F.coalesce("detail", F.lit("")).alias("detail"))


def batches(lines: DataFrame) -> DataFrame:
    """settlement_id, utr, status, nets (distinct header nets), net, computed."""
    return lines.groupBy("settlement_id").agg(F.min("settlement_utr").alias("utr"), F.min("settlement_status").alias("status"), F.count_distinct("settlement_net_amount_paise").alias("nets"), F.min("settlement_net_amount_paise").alias("net"), F.sum(F.col("credit_paise") - F.col("debit_paise")).alias("computed"))


def check_settlement_net(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Each batch's header net is the same on all its lines and is their sum. The detail says how many batches carry a label."""
    bad = batches(lines).where("nets != 1 or net != computed")
    marked = lines.select("settlement_id", F.explode(F.array("settlement_id", "entity_id", "order_id", "payment_id")).alias("id")).join(labels.select(c.normalize_id("record_id").alias("id")).distinct(), "id", "left_semi").agg(F.count_distinct("settlement_id").alias("labelled"))
    out = _check("settlement net is credits less debits", bad, F.concat("settlement_id", F.lit(": "), F.col("computed").cast("string"), F.lit(" in lines, "), F.col("net").cast("string"), F.lit(" in header")))
    return out.crossJoin(marked).select("check", "passed", "failures", F.concat("detail", F.lit(" ["), F.col("labelled").cast("string"), F.lit(" batches carry a label]")).alias("detail"))


def check_one_credit_per_batch(lines: DataFrame, bank: DataFrame) -> DataFrame:
    rows = bank.groupBy("utr").agg(F.count("*").alias("n"), F.min("credit_paise").alias("credit"))
    both = batches(lines).join(rows, "utr", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = both.where("(status = 'processed' and (n != 1 or credit != net)) or (status != 'processed' and n != 0)")
    return _check("a processed batch has exactly one equal bank credit, a held one none", bad, F.col("settlement_id"))


def check_running_balance(bank: DataFrame, order: list[str], opening_paise: int = OPENING_BALANCE_PAISE, account: str | None = None) -> DataFrame:
    rows = bank if account else bank.withColumn("_account", F.lit(1))
    found = running_sum(rows, F.col("credit_paise") - F.col("debit_paise"), account or "_account", order, "_balance")
    bad = found.where(F.col("running_balance_paise") != F.col("_balance") + opening_paise)
    return _check("the running balance adds up", bad, F.col("bank_txn_id"))


def check_label_count(labels: DataFrame, expected: int) -> DataFrame:
    bad = labels.agg(F.count("*").alias("n")).where(F.col("n") != expected)
    return _check("there are as many labels as expected", bad, F.col("n").cast("string"))


def record_ids(orders: DataFrame, lines: DataFrame, bank: DataFrame) -> DataFrame:
    """kind, id of every record that a label may name; a record that stands several times may be listed as often."""
    one = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return one(orders, "order", "order_id").unionByName(one(lines, "line", "entity_id")).unionByName(one(lines, "settlement", "settlement_id").distinct()).unionByName(one(bank, "bank_txn", "bank_txn_id"))


def check_label_integrity(labels: DataFrame, orders: DataFrame, lines: DataFrame, bank: DataFrame) -> DataFrame:
    kind = F.when(F.col("record_type").isin("order", "settlement", "bank_txn"), F.col("record_type")).otherwise("line")
    named = labels.select(kind.alias("kind"), c.normalize_id("record_id").alias("id"), "record_type")
    missing = named.join(record_ids(orders, lines, bank), ["kind", "id"], "left_anti").select("id")
    twice = named.groupBy("record_type", "id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    return _check("every label names one record and no record has two", missing.unionByName(twice), F.col("id"))


def check_label_leak(labels: DataFrame, **sources: DataFrame) -> DataFrame:
    """No suspicious header, no cause's name in any raw cell (a status column may hold one), no label note verbatim, inside longer words too. Each cell counts once.

    Distinct cells are joined with notes on one piece of eight letters (or a shorter note itself), for each note the piece that
    fewest notes have, and then searched; so neither side is broadcast or crossed whole. A cell shorter than every note, and without
    a cause's name, holds nothing and is left out before any shuffle.
    """
    parts = []
    notes = labels.select("note").where("length(note) > 0").distinct()
    shortest = notes.agg(F.min(F.length("note")).alias("n")).first().n
    causes = "|".join(CAUSES)
    for name, df in sources.items():
        heads = [h for h in df.columns if any(t in h.lower().replace(" ", "_") for t in ("true_cause", "truecause", "defect", "label", "ground_truth", "groundtruth", "anomal", "injected"))]
        texts = [k for k in df.columns if k != "settlement_status"]
        cells = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("column"), F.col(f"`{k}`").cast("string").alias("cell")) for k in texts))).alias("x")).select(F.lit(name).alias("source"), "x.*").where("cell is not null")
        parts.append((name, heads, cells))
    long_enough = F.lit(False) if shortest is None else F.length("cell") >= shortest
    worth = long_enough | ((F.length("cell") >= min(map(len, CAUSES))) & F.upper("cell").rlike(causes))
    cells = stored(reduce(DataFrame.unionByName, [p[2].where(worth) for p in parts]).groupBy("source", "column", "cell").agg(F.count("*").alias("n")))
    size = 8
    pieces = lambda text, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
    long = notes.where(F.length("note") >= size).select("note", F.explode(pieces(F.col("note"), size)).alias("piece"))
    spread = long.join(long.groupBy("piece").agg(F.count("*").alias("notes")), "piece")
    keyed = stored(spread.groupBy("note").agg(F.min_by("piece", F.struct("notes", "piece")).alias("piece")).unionByName(notes.where(F.length("note") < size).select("note", F.col("note").alias("piece"))))
    sizes = [r.n for r in keyed.select(F.length("piece").alias("n")).distinct().collect()]  # at most eight
    told = []
    for n in sizes:
        cut = cells.where(F.length("cell") >= n).select("source", "column", "cell", "n", F.explode(pieces(F.col("cell"), n)).alias("piece"))
        told.append(cut.join(keyed, "piece").where(F.contains("cell", F.col("note"))).select("source", "column", "cell", "n"))
    named = cells.where(F.upper("cell").rlike(causes))
    bad = reduce(DataFrame.unionByName, [named, *told]).distinct().select(F.concat_ws(".", "source", "column").alias("at"), "n")
    heads = [(f"{n}: header {h}", 1) for n, hs, _ in parts for h in hs]
    if heads:
        bad = bad.unionByName(labels.sparkSession.createDataFrame(heads, "at string, n long"))
    return _check("nothing of the labels is in the sources", bad, F.col("at"), "n")


def check_chronological(name: str, df: DataFrame, at: str, seq: str = ORDINAL) -> DataFrame:
    """A source is sorted by its own time. ``seq`` is the order of its rows, by itself their place in the file.

    Rows are compared with the row before within range partitions of seq, and partitions by their edges.
    """
    parted = stored(df.select(F.col(seq).alias("_s"), F.col(at).alias("_t")).repartitionByRange("_s").withColumn("_p", F.spark_partition_id()))
    inside = parted.withColumn("_before", F.lag("_t").over(Window.partitionBy("_p").orderBy("_s"))).where("_t < _before").select("_s")
    edges = parted.groupBy("_p").agg(F.min_by("_t", "_s").alias("a"), F.max_by("_t", "_s").alias("b"), F.min("_s").alias("_s"))
    over = Window.partitionBy(F.lit(1)).orderBy("_p")  # one row for each partition
    between = edges.withColumn("_before", F.lag("b").over(over)).where("a < _before").select("_s")
    return _check(f"{name} is in order of time", inside.unionByName(between), F.col("_s").cast("string"))


def check_integer_money(**sources: DataFrame) -> DataFrame:
    """All raw ``*_paise`` cells are whole numbers."""
    parts = []
    for name, df in sources.items():
        money = [k for k in df.columns if k.endswith("_paise")]
        if money:
            parts.append(df.select(F.explode(F.array(*(F.struct(F.lit(f"{name}.{k}").alias("at"), F.col(k).alias("cell")) for k in money))).alias("x")).where(~F.coalesce(c.trim_all("x.cell").rlike(r"^-?\d+$"), F.lit(False))).select("x.at"))
    return _check("every amount is a whole number of paise", reduce(DataFrame.unionByName, parts), F.col("at"))


def off_slab_lines(lines: DataFrame) -> DataFrame:
    """entity_id, settlement_id, delta of payment lines whose fee and tax aren't the slab's."""
    fee = c.expected_fee("amount_paise", "method")
    rows = lines.where("type = 'payment'").withColumn("_fee", fee)
    return rows.select("entity_id", "settlement_id", (F.col("fee_paise") + F.col("tax_paise") - F.col("_fee") - c.expected_tax("_fee")).alias("delta")).where("delta != 0")


def check_fee_reconstruction(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Batches rebuilt from gross amounts and slabs miss their net by exactly the off-slab deltas, and the off-slab lines are the labelled ones."""
    rows = lines.withColumn("_fee", F.when(F.col("type") == "payment", c.expected_fee("amount_paise", "method")))
    part = F.when(F.col("type") == "payment", F.col("amount_paise") - F.col("_fee") - c.expected_tax("_fee")).otherwise(-F.col("debit_paise"))
    delta = F.when(F.col("type") == "payment", F.col("fee_paise") + F.col("tax_paise") - F.col("_fee") - c.expected_tax("_fee")).otherwise(0)
    built = rows.groupBy("settlement_id").agg(F.sum(part).alias("rebuilt"), F.sum(delta).alias("delta"), F.min("settlement_net_amount_paise").alias("net"))
    misses = built.where(F.col("rebuilt") - F.col("net") != F.col("delta")).select(F.col("settlement_id").alias("at"))
    marked = labels.where("true_cause = 'FEE_VARIANCE'").select(c.normalize_id("record_id").alias("at"))
    off = off_slab_lines(lines).select(F.col("entity_id").alias("at"))
    odd = marked.join(off, "at", "left_anti").unionByName(off.join(marked, "at", "left_anti"))
    return _check("nets rebuild from the fee slabs", misses.unionByName(odd), F.col("at"))


def detect_defects(orders: DataFrame, lines: DataFrame, bank: DataFrame) -> DataFrame:
    """cause, record_id: nine detectors that look at the sources alone."""
    say = lambda df, cause, key: df.select(F.lit(cause).alias("cause"), F.col(key).alias("record_id"))
    pays = lines.where("type = 'payment'")
    both = pays.join(orders.select("order_id", F.col("amount_paise").alias("ordered"), "created_at", "status"), "order_id")
    lag = F.unix_timestamp("settled_at") - F.unix_timestamp("created_at")
    refunds = lines.where("type = 'refund'").join(pays.select("payment_id").distinct(), "payment_id", "left_anti")
    w = Window.partitionBy("amount_paise", "_day").orderBy("created_at", "order_id")
    # twins up to 90 s apart may stand on both sides of midnight: each order is looked at in its own day and in the one it nearly reaches
    near = orders.select("order_id", "amount_paise", "created_at", "status", F.explode(F.array_distinct(F.array(*(F.to_date(F.col("created_at") + F.expr(f"interval {s} seconds")) for s in (-DUPLICATE_WINDOW_SECONDS, DUPLICATE_WINDOW_SECONDS))))).alias("_day"))
    t = F.unix_timestamp("created_at")
    twins = near.withColumn("_twin", F.coalesce(t - F.lag(t).over(w) <= DUPLICATE_WINDOW_SECONDS, F.lit(False)) | F.coalesce(F.lead(t).over(w) - t <= DUPLICATE_WINDOW_SECONDS, F.lit(False))).where("_twin and status = 'paid'")
    twins = twins.join(pays.select("order_id"), "order_id", "left_anti")
    parts = [
        say(both.where(lag > 3.5 * 86400), "LATE_SETTLEMENT", "entity_id"),
        say(both.where("amount_paise < ordered"), "PARTIAL_CAPTURE", "entity_id"),
        say(both.where("status = 'pending'"), "SILENT_UPI_FAIL", "order_id"),
        say(off_slab_lines(lines), "FEE_VARIANCE", "entity_id"),
        say(lines.where("type = 'adjustment'"), "CHARGEBACK_DEBIT", "entity_id"),
        say(refunds, "REFUND_NETTED", "entity_id"),
        say(lines.where("settlement_status = 'on_hold'"), "ON_HOLD", "settlement_id"),
        say(bank.join(lines.select(F.col("settlement_utr").alias("utr")).distinct(), "utr", "left_anti"), "UNEXPLAINED", "bank_txn_id"),
        say(twins, "DUPLICATE_WEBHOOK", "order_id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def defect_conformance(detected: DataFrame, labels: DataFrame) -> DataFrame:
    """cause, labelled, detected, recalled, missed, extra."""
    truth = labels.select(F.col("true_cause").alias("cause"), c.normalize_id("record_id").alias("record_id"), F.lit(1).alias("truth")).distinct()
    both = truth.join(detected.withColumn("found", F.lit(1)), ["cause", "record_id"], "full").select("cause", F.coalesce("truth", F.lit(0)).alias("t"), F.coalesce("found", F.lit(0)).alias("f"))
    return both.groupBy("cause").agg(F.sum("t").alias("labelled"), F.sum("f").alias("detected"), F.sum(F.col("t") * F.col("f")).alias("recalled"), F.sum(F.col("t") * (1 - F.col("f"))).alias("missed"), F.sum((1 - F.col("t")) * F.col("f")).alias("extra"))


def check_conformance(detected: DataFrame, labels: DataFrame) -> DataFrame:
    """Each cause's labels show in the sources, and no record looks defective without a label: a failure for each cause and kind of miss."""
    rows = defect_conformance(detected, labels)
    told = F.array(F.when(F.col("missed") > 0, F.concat("cause", F.lit(": "), F.col("missed").cast("string"), F.lit(" labels don't show"))), F.when(F.col("extra") > 0, F.concat("cause", F.lit(": "), F.col("extra").cast("string"), F.lit(" records without a label look defective"))))
    bad = rows.select(F.explode(F.array_compact(told)).alias("what"))
    return _check("every defect shows exactly as its cause says", bad, F.col("what"))


def verification_report(*checks: DataFrame) -> DataFrame:
    """All checks, and a row ``all`` that passes if they all do. They run one after the other, as one plan of them all outgrows the driver."""
    every = reduce(DataFrame.unionByName, [stored(x) for x in checks])
    total = every.agg(F.min("passed").alias("passed"), F.sum("failures").alias("failures")).select(F.lit("all").alias("check"), "passed", "failures", F.lit("").alias("detail"))
    return every.unionByName(total)
