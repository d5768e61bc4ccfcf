"""Cells, files, each kind of finding, the partition, cases, classification, review and settlement building on small tables."""

import csv
import json
import os
import random
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import cells as c
from tallyspark.operators import assemble as a
from tallyspark.operators import classify as cl
from tallyspark.operators import joins as jn
from tallyspark.operators import lines as ln
from tallyspark.operators import normalize as nm
from tallyspark.operators import orders as od
from tallyspark.operators import review as rv
from tallyspark.operators import score as sc
from tallyspark.operators import settle as se
from tallyspark.operators import settlements as st
from tallyspark.operators import verify as vf
from tallyspark.operators.components import connected_components, star_components
from tallyspark.plans import queries as q
from tallyspark.plans.oracle import sql
from tallyspark.plans.reconcile import reconcile
from tallyspark.schemas import BANK_COLUMNS, LINE_COLUMNS, ORDER_COLUMNS, RECORD, TWIN_UNSETTLED
from tallyspark.sources import files, log, shared
from tallyspark.sources.blocks import CsvCells, read_records

T0 = datetime(2025, 5, 1, 12, 0, 0)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr("x").alias("y")).first().y


@pytest.mark.parametrize("text,want", [("5.", 500), ("1.239", 123), ("-1,24,530.00", -12453000), ("", 0), ("x", None), ("1.2.3", None), ("99999999999999999999999", None)])
def test_parse_paise(spark, text, want):
    assert one(spark, c.parse_paise, text) == want


@pytest.mark.parametrize("text,want", [("5.", None), ("1.239", None), ("1,24,530.05", 12453005), ("", 0), ("7.5", 750)])
def test_parse_indian_rupees(spark, text, want):
    assert one(spark, c.parse_indian_rupees, text) == want


@pytest.mark.parametrize("paise,want", [(12453000, "1,24,530.00"), (5, "0.05"), (-100000, "-1,000.00"), (1234567890, "1,23,45,678.90"), (99999, "999.99")])
def test_format_round_trip(spark, paise, want):
    r = spark.createDataFrame([(paise,)], "x long").select(c.format_indian_rupees("x").alias("t")).select("t", c.parse_paise("t").alias("p")).first()
    assert (r.t, r.p) == (want, paise)


def test_ids_dates_references(spark):
    assert one(spark, c.normalize_id, "  Order_A\t") == "order_a"
    assert one(spark, c.normalize_date, "03/05/2025") == date(2025, 5, 3) == one(spark, c.normalize_date, " 2025-05-03 ")
    assert one(spark, c.normalize_date, "31/02/2025") is None and one(spark, c.normalize_date, "5/3/2025") is None
    assert one(spark, c.normalize_timestamp, "2025-05-01T00:23:12Z") == datetime(2025, 5, 1, 0, 23, 12) and one(spark, c.normalize_timestamp, "2025-05-01 00:23:12") is None
    for text, want in [("NEFT CR-123456789012-RAZORPAY SOFTWARE PVT LTD", "NEFT_CR"), ("IMPS/123456789012/RAZORPAYSOFT", "IMPS"), ("RAZORPAY SETTLEMENT 123456789012", "RAZORPAY_SETTLEMENT"), ("ref 123456789012.", "UNKNOWN_FORMAT")]:
        assert tuple(one(spark, c.extract_utr, text)) == ("123456789012", want)
    assert one(spark, c.extract_utr, "1234567890123") is None


def fnv(text):
    h = 2166136261
    for x in text.encode():
        h = (h ^ x) * 16777619 % 2**32
    return f"{h:08x}"


def test_fnv_and_fees(spark):
    assert one(spark, c.fnv1a32, "order:a|bank_txn:b") == fnv("order:a|bank_txn:b") and one(spark, c.fnv1a32, "") == fnv("")
    rows = spark.createDataFrame([(12345, "card"), (25, "netbanking"), (100, "upi"), (227, "wallet"), (10, None)], "a long, m string").select(c.expected_fee("a", "m").alias("f")).select("f", c.expected_tax("f").alias("t")).collect()
    assert [tuple(r) for r in rows] == [(247, 44), (0, 0), (0, 0), (5, 1), (None, None)]
    with pytest.raises(Exception, match="unknown payment method"):
        spark.createDataFrame([(1, "cash")], "a long, m string").select(c.expected_fee("a", "m")).collect()


def test_quoted_files_across_blocks(spark, tmp_path):
    """Quotes, line ends of all kinds and long cells across block edges: the records, their order, and as many tasks as blocks."""
    draw = random.Random(3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for block in (300, 10**8):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            folder, want = tmp_path / str(block), []
            folder.mkdir()
            for k, end in enumerate(("\n", "\r\n")):
                rows = [[draw.choice(["a", "", 'q"x', "l\nm", '",\n"\n\r', " s ", "é,日"]) + str(i) + "z\n" * draw.choice([0, 0, 0, 0, 200]), f"p{k}", draw.choice(["", "x"])] for i in range(120)]
                with (folder / f"f{k}.csv").open("w", newline="") as out:
                    w = csv.writer(out, lineterminator=end)
                    w.writerow(["extra", "  order_id ", "status"] if k else ["status", "order_id", "extra"])
                    w.writerows([[r[2], r[0], r[1]] if k else [r[1], r[0], r[2]] for r in rows])
                want += [(r[0], r[1], "") for r in rows]
            got = read_records(spark, str(folder), CsvCells(["order_id", "status", "absent"]), "at")
            if block == 300:
                assert got.rdd.getNumPartitions() > sum(f.stat().st_size for f in folder.iterdir()) // 400
            found = got.orderBy("at").collect()
            assert [(r.order_id, r.status, r["absent"]) for r in found] == want and len({r["at"] for r in found}) == len(found)
            labels = [{"record_type": "t", "record_id": f"r{i}", "true_cause": draw.choice(["A}", 'B"{', "C\\"]), "note": draw.choice(["x}", "\n", None]), "more": {"a": [{}, "}"]}} for i in range(60)]
            for indent in (None, 2):
                (tmp_path / "a.json").write_text(json.dumps(labels, indent=indent))
                read = files.read_labels_json(spark, str(tmp_path / "a.json"), "at").orderBy("at").collect()
                assert [(r.record_id, r.true_cause, r.note) for r in read] == [(x["record_id"], x["true_cause"], x["note"]) for x in labels]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv_dialect(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'\xef\xbb\xbforder_id,status\r\r\n\n"",\na"b,c"d,e,extra\r"x""y",""\nlast')
    got = read_records(spark, str(tmp_path / "x.csv"), CsvCells(["status", "order_id"]), "at").orderBy("at").collect()
    assert [(r.order_id, r.status) for r in got] == [("", ""), ("ab,cd", "e"), ('x"y', ""), ("last", "")]
    (tmp_path / "none.csv").write_bytes(b"")
    assert read_records(spark, str(tmp_path / "none.csv"), CsvCells(["status"])).count() == 0


@pytest.mark.parametrize("text", ['{"record_id":"a"}', "null", '[{"record_id":"a"} x]', "[1]", '[{"record_id":"a"} {"record_id":"b"}]', '[{"x":1}]', '[{"record_id":"a"}'])
def test_labels_that_are_no_array_of_objects(spark, tmp_path, text):
    (tmp_path / "l.json").write_text(text)
    with pytest.raises(Exception, match="array of objects"):
        files.read_labels_json(spark, str(tmp_path / "l.json")).collect()


def test_logged_calls_are_not_made_twice(spark, tmp_path):
    """A run that breaks off half-way: the next one asks only for cases without a committed record."""
    asked, path = tmp_path / "asked", str(tmp_path / "log")
    asked.mkdir()
    briefs = spark.createDataFrame([(f"r{i}", f"CASE r{i}") for i in range(40)], "residue_id string, brief string")

    def provider(brief):
        with (asked / brief.split()[1]).open("a") as f:
            f.write("x")
        return {"predicted_cause": "ON_HOLD", "confidence": 0.9, "reasoning": "r", "proposed_adjusting_entry": None, "requires_human_review": False}

    half = cl.classify_logged(briefs.where("residue_id < 'r25'"), provider, "p", "m", path, batches=3)
    n = half.count()
    assert 0 < n < 40 and half.where("status != 'ok'").isEmpty()
    got = cl.classify_logged(briefs, provider, "p", "m", path, batches=3)
    assert got.count() == got.select("residue_id").distinct().count() == 40 and got.columns == RECORD.names
    assert {f.read_text() for f in asked.iterdir()} == {"x"} and len(list(asked.iterdir())) == 40
    with pytest.raises(ValueError, match="another provider"):
        cl.classify_logged(briefs, provider, "q", "m", path, batches=1)


def test_log_keeps_the_order_of_appends(spark, tmp_path):
    path, schema = str(tmp_path / "log"), T.StructType([T.StructField("residue_id", T.StringType()), T.StructField("status", T.StringType())])
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert log.append(make(("a", "1"), ("b", "1"), ("c", "1"), (None, "x")), path, "residue_id", 8) == 1
    assert log.compact(spark, path, schema, "residue_id") == []  # nothing superseded, nothing rewritten
    assert log.append(make(("a", "2"), ("b", "2"), ("b", "3")).coalesce(1), path, "residue_id", 8) == 2
    log.claim(spark, path)  # an append that failed after its claim
    assert log.append(make(("a", "0")), path, "residue_id", 8) == 4
    spark.createDataFrame([('{"residue_id":"c","sta', 3)], "value string, bucket long").write.mode("append").partitionBy("bucket").text(path)
    last = lambda: {r.residue_id: (r.status, r.commit) for r in log.latest(log.read(spark, path, schema, "residue_id")[0], "residue_id").collect()}
    want = {"a": ("0", 4), "b": ("3", 2), "c": ("1", 1)}
    assert last() == want and log.read(spark, path, schema, "residue_id")[1].count() == 1
    home = {k: spark.createDataFrame([(k,)], "k string").select(F.pmod(F.xxhash64("k"), F.lit(8))).first()[0] for k in "abc"}
    kept = {f for f in (tmp_path / "log").rglob("*.json") if f.parent.name not in {f"bucket={b}" for b in (home["a"], home["b"], 3)}}
    assert log.compact(spark, path, schema, "residue_id") == sorted({home["a"], home["b"], 3})
    rows, torn = log.read(spark, path, schema, "residue_id")
    assert last() == want and rows.count() == 3 and torn.count() == 0 and all(f.exists() for f in kept)
    assert log.compact(spark, path, schema, "residue_id") == []


def test_first_and_last_by_file_order(spark):
    row = lambda place, id_, order, amount: (place, id_, "payment", order, amount, "s", datetime(2025, 1, 9 - place), "u")
    lines = spark.createDataFrame([row(2, "pay_a", "o", 5), row(1, "pay_b", "o", 5), row(3, "pay_c", "p", 5)], "file_order long, entity_id string, type string, order_id string, amount_paise long, settlement_id string, settled_at timestamp, payment_id string")
    assert {r.order_id: r.entity_id for r in od.payment_line_per_order(lines).collect()} == {"o": "pay_a", "p": "pay_c"}
    assert {r.order_id: r.entity_id for r in od.payment_line_per_order(lines.drop("file_order")).collect()} == {"o": "pay_b", "p": "pay_c"}


def test_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text(",".join(ORDER_COLUMNS) + '\r\n"a ""q""\nb",1,INR,2025-05-01T00:00:00Z,paid\r\nshort,2\r\n')
    got = files.read_orders_csv(spark, str(tmp_path / "o.csv")).collect()
    assert got[0].order_id == 'a "q"\nb' and (got[1].order_id, got[1].status) == ("short", "")
    df = spark.createDataFrame([(' lead', 'a,"b"'), ("x", "line\nbreak")], "p string, q string")
    files.write_csv(df, str(tmp_path / "w"))
    back = spark.read.csv(str(tmp_path / "w"), header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "l.json").write_text(json.dumps([{"record_type": "order", "record_id": "o", "true_cause": "X", "note": "n"}]))
    assert files.read_labels_json(spark, str(tmp_path / "l.json")).count() == 1
    (tmp_path / "bad.json").write_text("[1, 2")
    with pytest.raises(Exception):
        files.read_labels_json(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "c.jsonl").write_text('{"residue_id": "r1", "status": "ok"}\n{"resid\n\n{"status": "ok"}\n')
    rows, torn = files.read_jsonl_tolerant(spark, str(tmp_path / "c.jsonl"), RECORD)
    assert [r.residue_id for r in rows.collect()] == ["r1"] and torn.count() == 2
    for k in range(2):
        files.append_jsonl(spark.createDataFrame([(f"r{k}",)], "residue_id string"), str(tmp_path / "log"))
    assert files.read_jsonl_tolerant(spark, str(tmp_path / "log"), RECORD)[0].count() == 2
    files.write_normalize_log({"corrections": df}, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n" / "corrections")).count() == 2


def test_normalize_and_quarantine(spark):
    raw = spark.createDataFrame([(" ORDER_1 ", "100", "INR", "2025-05-01T00:00:00Z", "paid"), ("order_2", "1.5", "INR", "yesterday", "paid")], ORDER_COLUMNS)
    good, bad = nm.quarantine(nm.normalize_orders(raw))
    assert good.first().order_id == "order_1" and good.first().raw["order_id"] == " ORDER_1 "
    assert sorted((r.field, r.raw) for r in bad.collect()) == [("amount_paise", "1.5"), ("created_at", "yesterday")]
    with pytest.raises(Exception, match="1.5"):
        nm.quarantine(nm.normalize_orders(raw), "strict")[0].collect()
    line = dict.fromkeys(LINE_COLUMNS, "0") | {"entity_id": "adj_1", "type": "adjustment", "order_id": "", "payment_id": "", "method": "", "currency": "", "settlement_id": "setl_1", "settled_at": "2025-05-01T00:00:00Z", "settlement_created_at": "2025-05-01T00:00:00Z", "settlement_utr": " 123456789012", "settlement_status": "frozen"}
    row = nm.normalize_lines(spark.createDataFrame([line]).select(LINE_COLUMNS)).first()
    assert row.order_id is None and row.settlement_utr == "123456789012" and [(e.field, e.raw) for e in row.errors] == [("settlement_status", "frozen")]
    bank = spark.createDataFrame([("txn1", "03/05/2025", "IMPS/123456789012/RAZORPAYSOFT", "44,735.78", "", "2,94,735.78")], BANK_COLUMNS)
    b = nm.normalize_bank(bank)
    assert (b.first().credit_paise, b.first().debit_paise, b.first().running_balance_paise) == (4473578, 0, 29473578)
    counts = {r.field: r.corrections for r in nm.correction_counts(good, nm.normalize_lines(spark.createDataFrame([line]).select(LINE_COLUMNS)), b).collect()}
    assert counts == {"orders.order_id": 1, "settlement_report.settlement_utr": 1, "bank_statement.value_date": 1, "bank_statement.description[IMPS]": 1, "bank_statement.credit": 1, "bank_statement.running_balance": 1, "total": 6}


# --- a small ledger on which every code fires ---------------------------------------------------------------------------


def small(spark):
    orders, lines, bank = [], [], []

    def order(i, amount=10_000, status="paid", at=T0):
        orders.append((f"order_{i}", amount, "INR", at, status))

    def line(i, batch, kind="payment", amount=10_000, order=None, payment=None, method="upi", day=2, fee=0, tax=0, status="processed"):
        debit, credit = (0, amount - fee - tax) if kind == "payment" else (amount, 0)
        lines.append([f"{i}", kind, order, payment, method if kind == "payment" else None, "INR", debit, credit, amount, fee, tax, batch, T0 + timedelta(days=day), f"utr_{batch}", status])

    spaced = iter(range(1, 100))
    plain = lambda i, **k: order(i, 10_000 + next(spaced), **k)
    amount = lambda i: next(o[1] for o in orders if o[0] == f"order_{i}")
    plain("ok")
    line("pay_ok", "s1", order="order_ok", payment="pay_ok", amount=amount("ok"))
    line("rfnd_ok", "s1", "refund", 50, "order_ok", "pay_ok")
    for k, sec in (("d1", 0), ("d2", 60), ("d3", 120)):  # one chain of 120 seconds
        order(k, 777, at=T0 + timedelta(seconds=sec))
    line("pay_d1", "s1", order="order_d1", payment="pay_d1", amount=777)
    order("e1", 555, at=T0), order("e2", 555, at=T0 + timedelta(seconds=91))  # too far apart
    line("pay_e1", "s1", order="order_e1", payment="pay_e1", amount=555)
    line("pay_e2", "s1", order="order_e2", payment="pay_e2", amount=555)
    plain("pending", status="pending")
    line("pay_pending", "s1", order="order_pending", payment="pay_pending", amount=amount("pending"))
    plain("gone", status="cancelled")
    plain("open")
    plain("short")
    line("pay_short", "s1", order="order_short", payment="pay_short", amount=amount("short") - 1000)
    plain("over")
    line("pay_over", "s1", order="order_over", payment="pay_over", amount=amount("over") + 1)
    plain("fee")
    line("pay_fee", "s1", order="order_fee", payment="pay_fee", amount=amount("fee"), method="card", fee=999, tax=180)
    plain("nometh")
    line("pay_nometh", "s1", order="order_nometh", payment="pay_nometh", amount=amount("nometh"), method=None, fee=3)
    line("adj_1", "s1", "adjustment", 30)
    line("rfnd_orphan", "s1", "refund", 777, "order_ok", "pay_before")
    line("pay_lost", "s1", order="order_nowhere", payment="pay_lost")
    plain("late", at=datetime(2025, 5, 1, 23, 59, 0))
    line("pay_late", "s1", order="order_late", payment="pay_late", amount=amount("late"), day=4)
    for k, status, text in (("hold", "on_hold", 0), ("held_paid", "on_hold", 0), ("missing", "processed", 0), ("off2", "processed", 2), ("off1", "processed", 1), ("head", "processed", 0), ("two", "processed", 0)):
        plain(k)
        line(f"pay_{k}", k, order=f"order_{k}", payment=f"pay_{k}", amount=amount(k), status=status)
        if k not in ("hold", "missing"):
            bank.append((f"txn_{k}", date(2025, 5, 3), "IMPS", f"utr_{k}", "IMPS", amount(k) + text, 0, 0))
    bank.append(("txn_two_b", date(2025, 5, 3), "IMPS", "utr_two", "IMPS", 1, 0, 0))
    bank.append(("txn_ghost", date(2025, 5, 3), "IMPS", "utr_none", "IMPS", 12_345, 0, 0))
    nets = {}
    for x in lines:
        nets[x[11]] = nets.get(x[11], 0) + x[7] - x[6]
    bank.append(("txn_s1", date(2025, 5, 3), "IMPS", "utr_s1", "IMPS", nets["s1"], 0, 0))
    full = [tuple([*x, nets[x[11]] + (5 if x[11] == "head" else 0), 0, 0, x[12]]) for x in lines]
    return (
        spark.createDataFrame(orders, "order_id string, amount_paise long, currency string, created_at timestamp, status string"),
        spark.createDataFrame(full, "entity_id string, type string, order_id string, payment_id string, method string, currency string, debit_paise long, credit_paise long, amount_paise long, fee_paise long, tax_paise long, settlement_id string, settled_at timestamp, settlement_utr string, settlement_status string, settlement_net_amount_paise long, settlement_fee_paise long, settlement_tax_paise long, settlement_created_at timestamp"),
        spark.createDataFrame(bank, "bank_txn_id string, value_date date, description string, utr string, description_format string, credit_paise long, debit_paise long, running_balance_paise long"),
    )


@pytest.fixture(scope="module")
def tables(spark):
    return small(spark)


@pytest.fixture(scope="module")
def result(tables):
    return reconcile(*tables)


def ids(df, key):
    return sorted(r[0] for r in df.select(key).collect())


def test_stage_1(tables):
    o, li, _ = tables
    dup = od.find_duplicate_orders(o, li).collect()
    assert [(d.group_id, d.seconds_apart, d.orders_in_group, d.settled_orders, d.unsettled_orders) for d in dup] == [("order_d1", 120, 3, 1, 2)]
    assert sorted((t.group_id, t.order_id, t.line_id) for t in od.duplicate_twins(o, li).collect()) == [("order_d1", "order_d1", "pay_d1"), ("order_d1", "order_d2", None), ("order_d1", "order_d3", None)]
    assert {r.order_id: (r.duplicate_group, r.twins, r.settled_twins) for r in od.find_orders_without_settlement(o, li).collect()} == {"order_d2": ("order_d1", 2, 1), "order_d3": ("order_d1", 2, 1), "order_open": (None, 0, 0)}
    assert ids(od.find_status_contradictions(o, li), "order_id") == ["order_pending"] and ids(od.excluded_orders(o, li), "order_id") == ["order_gone"]


def test_duplicates_come_with_all_their_orders_and_lines(spark, tables):
    """From the queries' rows alone: what the first SQL of c3 and c4 lists of every group and of every open order."""
    o, li, _ = tables
    got = sorted((x.group_id, x.order_id, x.line_id, x.orders_in_group, x.settled_orders) for x in od.duplicate_orders_with_members(o, li).collect())
    assert got == [("order_d1", "order_d1", "pay_d1", 3, 1), ("order_d1", "order_d2", None, 3, 1), ("order_d1", "order_d3", None, 3, 1)]
    got = {x.order_id: (x.without_settlement, x.duplicate_group, x.twins, x.settled_twins, x.line_id) for x in od.orders_without_settlement_with_twins(o, li).collect()}
    assert got == {"order_d1": (False, "order_d1", 2, 1, "pay_d1"), "order_d2": (True, "order_d1", 2, 1, None), "order_d3": (True, "order_d1", 2, 1, None), "order_open": (True, None, 0, 0, None)}
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(sql("""SELECT group_id, string_agg(order_id, ',' ORDER BY order_id) AS order_ids, any_value(amount) AS amount_paise,
      CAST(abs(epoch(max_by(created, order_id)) - epoch(min_by(created, order_id))) AS BIGINT) AS seconds_apart, count(*) AS orders_in_group, count(line_id) AS settled_orders, count(*) - count(line_id) AS unsettled_orders,
      coalesce(string_agg(line_id, ',' ORDER BY order_id), '') AS line_ids FROM seen WHERE group_id IS NOT NULL GROUP BY group_id""")).fetchall()
    groups = {}
    for x in q.QUERIES["c3_duplicate_orders"](spark, folder).orderBy("order_id").collect():
        groups.setdefault((x.group_id, x.amount_paise, x.seconds_apart, x.orders_in_group, x.settled_orders, x.unsettled_orders), []).append(x)
    assert want and sorted(want) == sorted((k[0], ",".join(x.order_id for x in g), *k[1:], ",".join(x.line_id for x in g if x.line_id)) for k, g in groups.items())
    want = db.execute(sql("""SELECT order_id, status AS order_status, amount AS amount_paise, strftime(created, '%Y-%m-%d %H:%M:%S') AS created_at,
      (SELECT string_agg(t.order_id, ',' ORDER BY t.order_id) FROM dup t WHERE t.group_id = seen.group_id AND t.order_id <> seen.order_id) AS duplicate_of FROM seen WHERE status = 'paid' AND line_id IS NULL""")).fetchall()
    found, members = q.QUERIES["c4_orders_without_settlement"](spark, folder).orderBy("order_id").collect(), {}
    for x in found:
        members.setdefault(x.duplicate_group, []).append(x.order_id)
    of = lambda x: ",".join(k for k in members[x.duplicate_group] if k != x.order_id) if x.duplicate_group else None
    assert any(x[-1] for x in want) and sorted(want) == sorted((x.order_id, x.order_status, x.amount_paise, x.created_at, of(x)) for x in found if x.without_settlement)


def test_stage_2(tables):
    o, li, _ = tables
    assert ids(ln.find_orphan_adjustments(li), "line_id") == ["adj_1"]
    orphan = ln.find_orphan_refunds(o, li)
    assert [(r.line_id, r.missing_payment_id, r.order_known_to_merchant) for r in orphan.collect()] == [("rfnd_orphan", "pay_before", 1)]
    assert [(r.line_id, r.candidate_id) for r in ln.refund_parent_candidates(orphan, li).collect()] == [("rfnd_orphan", "pay_d1")]
    assert ids(ln.find_orphan_payments(o, li), "line_id") == ["pay_lost"]
    short = ln.find_short_captures(o, li).collect()
    assert [(s.line_id, s.shortfall_paise) for s in short] == [("pay_short", 1000)] and abs(short[0].shortfall_pct - 100_000 / short[0].order_amount_paise) < 0.006
    fee = ln.find_fee_mismatches(o, li).collect()
    assert [(f.line_id, f.slab_bp, f.actual_fee_paise, f.expected_fee_paise) for f in fee] == [("pay_fee", 200, 999, 200)]


def test_stage_3_and_4(tables):
    o, li, b = tables
    tied = st.tie_settlement_to_bank(st.group_settlements(li), b)
    assert ids(st.find_on_hold(tied), "settlement_id") == ["hold"] and ids(st.find_unexpected_credit_on_hold(tied), "settlement_id") == ["held_paid"]
    assert ids(st.find_missing_bank_credit(tied), "settlement_id") == ["missing"] and ids(st.find_net_mismatch(tied), "settlement_id") == ["head", "off2"]
    assert ids(st.reconciled(tied), "settlement_id") == ["off1", "s1", "two"] and {r.settlement_id: r.bank_rows_for_utr for r in tied.collect()}["two"] == 2
    assert ids(st.find_unclaimed_bank_credits(st.group_settlements(li), b), "bank_txn_id") == ["txn_ghost"]
    from tallyspark.operators import delay

    late = delay.find_settlement_delays(delay.settlement_day_delta(o, li)).collect()
    assert [(r.line_id, r.day_delta, r.excess_days) for r in late] == [("pay_late", 4, 2)]


def test_partition_has_only_the_second_row_of_a_reference(result):
    # a batch compares with the first of two bank rows; the other belongs to nothing, and the audit says so
    assert [tuple(r) for r in result["audit"].collect()] == [("bank_txn", "txn_two_b", "unaccounted for")]


def test_clean_refund_of_a_tainted_order_matches(result, tables):
    lines = ids(result["matched"], "line_id")
    assert "rfnd_ok" in lines and "pay_ok" in lines and "pay_over" in lines and "pay_nometh" in lines and "pay_short" not in lines
    m = result["metrics"].first()
    assert m.total_orders == tables[0].count() and m.auto_matched_count == len(lines)


def test_audit_reports_dropped_and_doubled(tables, result):
    o, li, b = tables
    fewer = result["matched"].where("line_id != 'rfnd_ok'")
    got = {tuple(r) for r in a.partition_audit(o, li, b, fewer, result["reconciled"], result["residue_entities"], result["excluded"]).collect()}
    assert ("settlement_line", "rfnd_ok", "unaccounted for") in got
    twice = result["residue_entities"].unionByName(result["residue_entities"].where("id = 'adj_1'").withColumn("residue_id", F.lit("res_x")))
    got = {tuple(r) for r in a.partition_audit(o, li, b, result["matched"], result["reconciled"], twice, result["excluded"]).collect()}
    assert ("settlement_line", "adj_1", "in two cases") in got
    with pytest.raises(ValueError, match="unaccounted"):
        a.partition_audit(o, li, b, fewer, result["reconciled"], result["residue_entities"], result["excluded"], strict=True)


def test_payment_of_an_unknown_order_in_a_held_batch(spark, tables):
    """The line is an orphan and belongs to the held batch; its order id is nobody's, so the partition stays whole."""
    o, li, b = tables
    held = li.where("settlement_status = 'on_hold' and type = 'payment'").limit(1).withColumn("order_id", F.lit("order_nowhere")).withColumn("entity_id", F.lit("pay_nowhere")).withColumn("payment_id", F.lit("pay_nowhere"))
    assert held.count() == 1
    both = li.unionByName(held)
    r = reconcile(o, both, b)
    case = {x.kind + ":" + x.id: x.residue_id for x in r["residue_entities"].collect()}
    assert "order:order_nowhere" not in case and case["settlement_line:pay_nowhere"] == case["settlement:" + held.first().settlement_id]
    codes = {x.residue_id: set(x.finding_types) for x in r["residue"].collect()}
    assert {"ORPHAN_SETTLEMENT_LINE", "SETTLEMENT_ON_HOLD"} <= codes[case["settlement_line:pay_nowhere"]]
    assert r["audit"].where("problem = 'not in the input'").count() == 0
    near = r["residue_candidates"].where("kind = 'bank_txn'").first()
    assert near is None or set(near.evidence) == {"credit_paise", "delta_paise", "utr", "value_date"}


def test_order_of_rows_and_partitions_does_not_matter(tables, result):
    again = reconcile(*(t.orderBy(F.rand(7)).repartition(3) for t in tables))
    key = lambda r: sorted((x.residue_id, x.kind, x.id) for x in r["residue_entities"].collect())
    assert key(again) == key(result)


def test_short_ids(tables):
    r = reconcile(*tables, ids="fnv")
    keys = {}
    for x in r["residue_entities"].collect():
        keys.setdefault(x.residue_id, []).append(f"{x.kind}:{x.id}")
    assert keys and all(k == "res_" + fnv("|".join(sorted(v))) for k, v in keys.items())


def test_short_ids_of_cases_over_several_partitions(spark):
    cases = {"a": [f"order:{k}" for k in range(900)], "b": ["order:x"], "c": [f"line:\u20ac{k}\u00e9" for k in range(700)], "d": ["order:y", "order:z"]}
    keys = spark.createDataFrame([(k, x) for k, v in cases.items() for x in v + v[:2]], "residue_id string, key string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.residue_id: r.short_id for r in a.short_ids(keys, "residue_id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = lambda keys: one(spark, c.fnv1a32, "|".join(sorted(keys)))
    assert got == {k: "res_" + plain(v) for k, v in cases.items()}


def test_brief_of_a_large_case_is_paged(spark):
    residue = spark.createDataFrame([("r", ["A"], {"x": "1"}), ("s", ["A"], {"x": "2"})], "residue_id string, finding_types array<string>, evidence map<string,string>")
    own = [("r", "order", f"o{k:03d}", 5, "{}") for k in range(450)] + [("s", "order", "o", 7, "{}")]
    entities = spark.createDataFrame(own, "residue_id string, kind string, id string, amount_paise long, normalized string")
    near = spark.createDataFrame([("r", "order", "n", "why", (1, "0:a", 1))], "residue_id string, kind string, id string, reason string, first struct<stage:int,place:string,rank:int>")
    brief = {r.residue_id: r.brief for r in cl.case_brief(residue, entities, near).collect()}
    assert "order: 450, 2250 paise" in brief["r"] and "3 pages" in brief["r"] and len(brief["r"]) < 200 and "  - order o: {}" in brief["s"]
    pages = cl.case_pages(residue, entities, near).where("residue_id = 'r'").orderBy("page").collect()
    lines = [x for p in pages for x in p.text.split("\n")]
    assert [p.page for p in pages] == [1, 2, 3] and lines == [f"  - order o{k:03d}: {{}}" for k in range(450)] + ["  ~ order n: why"]
    assert cl.case_lines(residue, entities, near).count() == 2 + 2 + 451 + 1


def test_evidence_merge(spark):
    rows = [("f1", 1, "0:a", "A", {"x": "1", "y": "2"}), ("f2", 2, "0:b", "B", {"x": "3"}), ("f3", 2, "0:c", "B", {"x": "4", "z": "5"})]
    findings = spark.createDataFrame(rows, "finding_id string, stage int, place string, code string, evidence map<string,string>")
    cases = spark.createDataFrame([(f"f{k}", "r") for k in (1, 2, 3)], "finding_id string, residue_id string")
    assert a.residue_evidence(findings, cases).first().evidence == {"x": "1", "y": "2", "B.x": "4", "z": "5"}


def test_evidence_and_candidates_of_a_large_duplicate_group(spark, tables):
    o, li, b = tables
    day = datetime(2025, 5, 2)
    many = [f"order_m{k:03d}" for k in range(300)]
    r = reconcile(o.unionByName(spark.createDataFrame([(k, 4321, "INR", day, "paid") for k in many], o.schema)), li, b)
    case = r["residue_entities"].where("id = 'order_m007'").first().residue_id
    evidence = r["residue"].where(F.col("residue_id") == case).first()
    assert evidence.n_findings == 301 and evidence.n_entities == 300 and max(map(len, evidence.evidence.values())) < 100
    assert evidence.evidence["duplicate_group"] == "order_m000" and evidence.evidence["orders_in_group"] == "300"
    near = r["residue_candidates"].where(F.col("residue_id") == case).orderBy("first").collect()
    assert [x.id for x in near] == many and {x.reason for x in near} == {TWIN_UNSETTLED}
    assert ids(r["duplicate_twins"].where("group_id = 'order_m000'"), "order_id") == many


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)}


def test_runs_past_midnight(spark):
    start = datetime(2025, 5, 1, 23, 58, 0)
    rows = [(f"o{k}", 5, start + timedelta(seconds=60 * k)) for k in range(6)] + [("x", 5, start + timedelta(hours=3)), ("y", 6, start)]
    got = {r.id: r.run for r in jn.runs_by_gap(spark.createDataFrame(rows, "id string, amount long, at timestamp"), "amount", "at", "id", 90).collect()}
    assert got == {**{f"o{k}": "o0" for k in range(6)}, "x": "x", "y": "y"}


def test_runs_of_one_instant_are_summed_up_before_the_shuffle(spark):
    """Half of all orders have one amount and one time: they meet as one row, and no window holds them."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") * 200))
    df = spark.range(200_000).select(F.concat(F.lit("o"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("id"), F.lit(5).cast("long").alias("amount"), at.alias("at"))
    runs = jn.runs_by_gap(df, "amount", "at", "id", 90)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    got = runs.groupBy("run").count().agg(F.count("*"), F.max("count"), F.min("run")).first()
    assert tuple(got) == (100_001, 100_000, "o0000000")
    some = spark.createDataFrame([("a", None, datetime(2025, 1, 1)), ("b", 1, None), ("c", 1, datetime(2025, 1, 1))], "id string, amount long, at timestamp")
    assert {r.id: r.run for r in jn.runs_by_gap(some, "amount", "at", "id", 90).collect()} == {"a": None, "b": None, "c": "c"}


def nearest_by_hand(left, right, width, k):
    return sorted((a, i + 1, b, n) for a, x in left for i, (_, b, n) in enumerate(sorted((abs(x - n), b, n) for b, n in right if abs(x - n) <= width)[:k]))


def test_nearest_k(spark):
    draw = random.Random(6)
    for spread, width in ((10, 3), (2000, 50), (3, 0)):
        left = [(f"l{i}", draw.randint(-spread, spread)) for i in range(80)]
        right = [(f"r{i}", draw.randint(-spread, spread)) for i in range(90)]
        a = spark.createDataFrame([*left, ("none", None)], "a string, x long").repartition(3)
        b = spark.createDataFrame([*right, ("none", None)], "b string, y long").repartition(5)
        got = jn.nearest_k(a, b, "x", "y", "b", width, 5)
        assert sorted((r.a, r["rank"], r.b, r.y) for r in got.collect()) == nearest_by_hand(left, right, width, 5)
    assert jn.nearest_k(a, b.where("y > 99"), "x", "y", "b", 5, 2).count() == 0 == jn.nearest_k(a.where("x > 99"), b, "x", "y", "b", 5, 2).count()


def test_nearest_k_of_equal_amounts(spark):
    """10^5 equal amounts on both sides: five rows for each, and no pair more is made."""
    n = 100_000
    left = spark.range(n).select("id", F.lit(7).cast("long").alias("x"))
    right = spark.range(n).select(F.col("id").alias("b"), F.lit(9).cast("long").alias("y"))
    got = jn.nearest_k(left, right, "x", "y", "b", 50, 5)
    assert tuple(got.agg(F.count("*"), F.max("b"), F.count_distinct("id")).first()) == (5 * n, 4, n)


def test_asof_running(spark):
    days = [date(2025, 1, 5), date(2025, 3, 2), date(2025, 3, 9)]
    due = [date(2025, 1, 1), date(2025, 1, 5), date(2025, 1, 6), date(2025, 3, 5), date(2025, 4, 1)]
    got = {r.due_day: r.batch_day for r in se.assign_debits_to_batch(spark.createDataFrame([(x,) for x in due], "due_day date"), spark.createDataFrame([(x,) for x in days], "batch_day date")).collect()}
    assert got == dict(zip(due, [days[0], days[0], days[1], days[2], days[2]]))
    rows = spark.createDataFrame([("k" if i % 3 else "j", i, i * i) for i in range(100)], "k string, i long, v long")
    for r in jn.running_sum(rows, F.col("v"), "k", ["i"], "s").collect():
        assert r.s == sum(i * i for i in range(r.i + 1) if ("k" if i % 3 else "j") == r.k)


def test_classification(result, spark):
    verdicts = {r.residue_id: r for r in cl.rule_verdict(result["residue"]).collect()}
    by_line = {x.id: verdicts[x.residue_id] for x in result["residue_entities"].collect()}
    assert [by_line[k].cause for k in ("hold", "held_paid", "txn_ghost", "pay_pending", "pay_short", "pay_fee", "adj_1", "rfnd_orphan", "order_d2", "pay_late")] == [
        "ON_HOLD", "ON_HOLD", "UNEXPLAINED", "SILENT_UPI_FAIL", "PARTIAL_CAPTURE", "FEE_VARIANCE", "CHARGEBACK_DEBIT", "REFUND_NETTED", "DUPLICATE_WEBHOOK", "LATE_SETTLEMENT",
    ]
    assert by_line["order_open"].confidence == 0.3 and by_line["missing"].confidence == 0.2 and by_line["pay_fee"].amount_paise == 799 + 180 - 36
    records = cl.rules_classification(result["residue"])
    assert cl.validate_classification(records).where(F.size("errors") > 0).count() == 0
    queue = rv.review_queue(result["residue"], records).collect()
    buckets = [q.bucket for q in queue]
    assert buckets == sorted(buckets, reverse=True) and set(buckets) == {"review", "auto"}
    with pytest.raises(ValueError, match="other/1"):
        cl.assert_single_provider(records.withColumn("provider", F.lit("other")).withColumn("model", F.lit("1")), "rules-baseline", "deterministic-rules-v1")
    cl.assert_single_provider(records, "rules-baseline", "deterministic-rules-v1")


def test_provider_is_asked_again_and_never_fails_the_job(spark):
    def provider(brief):
        good = {"predicted_cause": "ON_HOLD", "confidence": 0.5, "reasoning": "r", "proposed_adjusting_entry": {"action": "a", "amount_paise": 1}, "requires_human_review": False}
        if "boom" in brief:
            raise RuntimeError("no line")
        if "never" in brief:
            return {"predicted_cause": "X"}
        return good if "good" in brief or "broke the schema" in brief else {**good, "confidence": 7}

    briefs = spark.createDataFrame([(k, k) for k in ("good", "repair", "never", "boom")], "residue_id string, brief string")
    got = {r.residue_id: r for r in cl.classify_with(briefs, provider, "p", "m").collect()}
    assert {k: (r.status, r.attempts) for k, r in got.items()} == {"good": ("ok", 1), "repair": ("repaired", 2), "never": ("schema_failure", 2), "boom": ("transport_failure", 1)}
    assert got["good"].gate_forced_review and got["good"].classification.requires_human_review and got["boom"].classification.predicted_cause == "INSUFFICIENT_EVIDENCE"
    done = spark.createDataFrame(list(got.values()), RECORD)
    cases = briefs.select("residue_id")
    assert ids(cl.pending_cases(cases, done), "residue_id") == ["boom"] and ids(cl.pending_cases(cases, done, retry_failed=True), "residue_id") == ["boom", "never"]
    assert cl.pending_cases(cases, done, fresh=True).count() == 4


def test_verification_finds_what_is_planted(spark, tables):
    o, li, b = tables
    labels = spark.createDataFrame([("payment", "PAY_fee ", "FEE_VARIANCE", "planted on pay_fee"), ("order", "nobody", "ON_HOLD", "")], "record_type string, record_id string, true_cause string, note string")
    said = {r.check: r for r in vf.verification_report(vf.check_settlement_net(li, labels), vf.check_one_credit_per_batch(li, b), vf.check_label_integrity(labels, o, li, b), vf.check_label_count(labels, 2), vf.check_label_leak(labels, orders=o.withColumn("memo", F.lit("x planted on pay_fee y")))).collect()}
    assert [r.failures for r in said.values()] == [1, 6, 1, 0, o.count(), 8 + o.count()] and not said["all"].passed
    bad = spark.createDataFrame([(k, date(2025, 5, 1) + timedelta(days=k), f"t{k}", 100, 0, 25_000_000 + 100 * (k + 1) + (k == 2)) for k in range(5)], "n long, value_date date, bank_txn_id string, credit_paise long, debit_paise long, running_balance_paise long")
    r = vf.check_running_balance(bad, ["value_date"]).first()
    assert (r.failures, r.detail) == (1, "t2")
    r = vf.check_chronological("t", spark.createDataFrame([(k, 10 - (k == 6)) for k in range(9)], "n long, at long"), "at", "n").first()
    assert (r.failures, r.detail) == (1, "6")
    assert vf.check_integer_money(x=spark.createDataFrame([("1",), ("1.5",), (None,)], "a_paise string")).first().failures == 2


def test_decisions(spark):
    queue = spark.createDataFrame([("r1", "ON_HOLD", 0.9, False), ("r2", None, None, False)], "residue_id string, predicted_cause string, confidence double, gate_forced_review boolean")
    rows = [("r1", "approve", None, " ", "1"), ("r1", "reclassify", "UNEXPLAINED", "n", "2"), ("r2", "reject", None, None, "1"), ("r1", "reclassify", "?", None, "3"), ("r9", "approve", None, None, "1"), ("", "approve", None, None, "1"), ("r1", "ponder", None, None, "1")]
    audit, rejects = rv.apply_decisions(queue, spark.createDataFrame(rows, "residue_id string, action string, final_cause string, reviewer_note string, timestamp string"))
    assert sorted((r.residue_id, r.timestamp, r.original_prediction, r.final_cause, r.reviewer_note) for r in audit.collect()) == [("r1", "1", "ON_HOLD", "ON_HOLD", None), ("r1", "2", "ON_HOLD", "UNEXPLAINED", "n"), ("r2", "1", "UNCLASSIFIED", "REJECTED", None)]
    assert sorted((r.residue_id, r.status) for r in rejects.collect()) == [("", 400), ("r1", 400), ("r1", 400), ("r9", 404)]
    assert {r.residue_id: r.final_cause for r in rv.latest_decision(audit).collect()} == {"r1": "UNEXPLAINED", "r2": "REJECTED"}


def test_scoring_stays_apart():
    import pathlib

    root = pathlib.Path(a.__file__).parent
    for name in ("assemble", "orders", "lines", "settlements", "delay", "classify", "normalize"):
        text = (root / f"{name}.py").read_text()
        assert "operators.score" not in text and "operators.verify" not in text and "import score" not in text and "import verify" not in text
    for path in root.parent.rglob("*.py"):
        assert "llm" in path.parts or "tallyspark.llm" not in path.read_text()


def test_missing_header_is_an_error(spark):
    lines = spark.createDataFrame([("l", "s1")], "entity_id string, settlement_id string")
    heads = spark.createDataFrame([("s2", 1, 0, 0)], "settlement_id string, net_amount_paise long, fee_paise long, tax_paise long")
    with pytest.raises(Exception, match="no header for s1"):
        se.settlement_report(lines, heads).collect()


def _tables_read(df):
    """How many tables a frame's plan reads."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_verification_report_runs_check_by_check(spark, monkeypatch):
    # no plan holds all checks, and the line items are read for the shared tables alone
    reads, keep = [], vf.stored
    monkeypatch.setattr(vf, "stored", lambda df: reads.append(_tables_read(df)) or keep(df))
    report = {r["check"]: r.failures for r in q.QUERIES["i12_verification_report"](spark, "/root/testdata/sf0.001").collect()}
    assert len(report) == 13 and report["all"] == sum(n for k, n in report.items() if k != "all")
    assert len(reads) > 12 and max(reads) < 30


def test_label_leak_keeps_no_cell_that_is_too_short(spark, monkeypatch):
    cells, keep = [], vf.stored
    monkeypatch.setattr(vf, "stored", lambda df: cells.append(keep(df)) or cells[-1])
    labels = spark.createDataFrame([("planted on pay_1",)], "note string")
    orders = spark.createDataFrame([("order_1", "a planted on pay_1"), ("order_1", "x"), ("on_hold 2", "planted on pay_2")], "order_id string, status string")
    got = vf.check_label_leak(labels, orders=orders).first()
    assert (got.passed, got.failures, got.detail) == (False, 2, "orders.order_id")
    assert {r.cell for r in cells[0].collect()} == {"a planted on pay_1", "on_hold 2", "planted on pay_2"}
    assert vf.check_label_leak(labels.where("false"), orders=orders).first().failures == 1


def test_one_table_of_a_reconciliation_is_made_without_the_others(tables, monkeypatch):
    def refused(*_):
        raise AssertionError("made for nothing")

    for name in ("plain_findings", "finding_candidates", "residue_entities"):
        monkeypatch.setattr(a, name, refused)
    r = reconcile(*tables)
    assert r["metrics"].first().residue_count > 0
    labels = r.spark.createDataFrame([("order_d2", "DUPLICATE_WEBHOOK"), ("order_gone", "X")], "record_id string, true_cause string")
    assert [tuple(x) for x in sc.capture_by_cause(sc.label_outcome(labels, r)).collect()] == [("DUPLICATE_WEBHOOK", 1, 1), ("X", 1, 0)]


def _kept(spark):
    """The intermediate tables that lie in the shared folder."""
    where = shared._base(spark).removeprefix("file://")
    return set(os.listdir(where)) if os.path.isdir(where) else set()


def test_star_components_leave_two_tables(spark):
    rng = random.Random(3)
    stars = {h: {h, *rng.sample(range(900), rng.randint(0, 4))} for h in rng.sample(range(900), 200)}
    members = spark.createDataFrame([(f"k{h:03d}", f"k{k:03d}") for h, keys in stars.items() for k in keys], "head string, key string")
    before = _kept(spark)
    ends, home = star_components(members)
    got = {r.key: (r.component, r.nodes) for r in ends.join(home, "head").collect()}
    group = {k: {k} for keys in stars.values() for k in keys}
    for keys in stars.values():
        whole = set().union(*(group[k] for k in keys))
        for k in whole:
            group[k] = whole
    assert got == {f"k{k:03d}": (f"k{min(g):03d}", len(g)) for k, g in group.items()}
    assert len(_kept(spark) - before) <= 3  # both, and the last round's labels


def test_brief_reads_no_record_of_a_large_case(spark):
    residue = spark.createDataFrame([("r", ["A"], {"x": "1"}), ("s", ["A"], {"x": "2"})], "residue_id string, finding_types array<string>, evidence map<string,string>")
    slim = spark.createDataFrame([("r", "order", f"o{k:03d}", 5) for k in range(450)] + [("s", "order", "o", 7)], "residue_id string, kind string, id string, amount_paise long")
    near = spark.createDataFrame([("r", "order", "n", "why", (1, "0:a", 1))], "residue_id string, kind string, id string, reason string, first struct<stage:int,place:string,rank:int>")
    asked = []
    brief = {r.residue_id: r.brief for r in cl.case_brief(residue, slim, near, details=lambda own: asked.append(own) or own.withColumn("normalized", F.lit("{}"))).collect()}
    assert ids(asked[0], "id") == ["o"]
    assert "order: 450, 2250 paise" in brief["r"] and "  3 pages" in brief["r"] and "  - order o: {}" in brief["s"]


def test_tidy_leaves_no_shuffle_files_and_no_settings(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with shared.tidy(spark), shared.tidy(spark):
        assert spark.conf.get(key) == "true"
        kept = shared.stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
        assert kept.count() == 7 and shared.at_hand(kept) is kept
    assert spark.conf.get(key) == was
    shared.discard(kept)
    with pytest.raises(Exception):
        kept.count()
