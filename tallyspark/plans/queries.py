"""The registered queries over the driver's tables, each with its SQL restatement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import cells as c
from tallyspark.operators import assemble as a
from tallyspark.operators import classify as cl
from tallyspark.operators import delay as dl
from tallyspark.operators import lines as ln
from tallyspark.operators import normalize as nm
from tallyspark.operators import orders as od
from tallyspark.operators import review as rv
from tallyspark.operators import score as sc
from tallyspark.operators import settle as se
from tallyspark.operators import settlements as st
from tallyspark.operators import verify as vf
from tallyspark.operators.components import star_components
from tallyspark.plans.oracle import at, sql
from tallyspark.plans.reconcile import Tables, reconcile, unreconciled_batches
from tallyspark.schemas import (
    ACTION_CHARGEBACK,
    ACTION_DUPLICATE,
    ACTION_FEE,
    ACTION_HOLD,
    ACTION_LATE,
    ACTION_NORMAL,
    ACTION_OPEN,
    ACTION_REFUND,
    ACTION_SHORT,
    ACTION_STATUS,
    ACTION_UNEXPLAINED,
    CAUSES,
    CODES,
    INSUFFICIENT,
    NEAR_BANK,
    NEAR_BATCH,
    ORDINAL,
    PARENT,
    TWIN_SETTLED,
    TWIN_UNSETTLED,
)
from tallyspark.sources import files, log
from tallyspark.sources import ledger as L
from tallyspark.sources.shared import discard, shared_dir, stored, tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The same without the common table expressions, for queries whose SQL builds on another's.
_SELECTS: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: portable(f(spark, sf_dir))
        if oracle is not None:
            ORACLES[name], _SELECTS[name] = sql(oracle), oracle
        return f

    return put


def portable(df: DataFrame) -> DataFrame:
    """Times, dates, arrays and truth values in forms that any engine prints alike."""
    out = []
    for name, kind in df.dtypes:
        x = F.col(f"`{name}`")
        if kind == "timestamp":
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        elif kind.startswith("array<string"):
            x = F.array_join(x, ",")
        elif kind == "boolean":
            x = x.cast("int")
        elif kind == "int" or kind == "smallint":
            x = x.cast("bigint")
        out.append(x.alias(name))
    return df.select(*out)


_made: dict[tuple, Tables] = {}


def ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return L.orders(spark, sf_dir), L.lines(spark, sf_dir), L.bank(spark, sf_dir)


def result(spark: SparkSession, sf_dir: str) -> Tables:
    """One reconciliation for each Spark application and state of a folder's files; the queries on its tables share it, so the first of them that needs a table bears its cost."""
    tables = [spark.read.format("binaryFile").load(f"{sf_dir}/{t}.parquet").select("path", "modificationTime", "length") for t in ("orders", "lineitem")]
    state = tables[0].unionByName(tables[1]).agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _made:
        with tidy(spark):
            *tables, labels = L.tables(spark, sf_dir)
            made = reconcile(*tables)
        for name in ("residue", "residue_entities", "findings", "finding_entities", "residue_candidates"):
            made[name] = lambda make=made.data[name]: stored(make())
        made["labels"] = labels
        made["records"] = lambda: stored(cl.rules_classification(made["residue"]))
        _made[key] = made
    return _made[key]


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.tie_settlement_to_bank(st.group_settlements(L.lines(spark, sf_dir)), L.bank(spark, sf_dir))


@query("unreconciled_batches", "SELECT settlement_id, utr, code AS reason, net AS expected_net_paise, bank_credit AS bank_credit_paise, line_count FROM tied JOIN failed USING (settlement_id)")
def _(s, d):
    return unreconciled_batches(L.lines(s, d), L.bank(s, d))


# --- A: files, each written to the shared folder and read back --------------------------------------------------------

_RAW_ID = "CASE WHEN {0} IS NULL THEN '' WHEN {1} % 13 = 0 THEN '  ' || upper({0}) || chr(9) ELSE {0} END AS {0}"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ') AS {1}"


def _through_csv(raw: DataFrame, read) -> DataFrame:
    path = shared_dir(raw.sparkSession)
    files.write_csv(raw, path)
    return read(raw.sparkSession, path)


@query("a1_read_orders_csv", f"SELECT {_RAW_ID.format('order_id', 'n')}, CAST(amount AS VARCHAR) AS amount_paise, 'INR' AS currency, {_ISO.format('created', 'created_at')}, status FROM (SELECT *, CAST(regexp_extract(order_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM o)")
def _(s, d):
    return _through_csv(L.raw_orders(s, d), files.read_orders_csv)


@query("a1_read_settlement_csv", f"SELECT {', '.join(_RAW_ID.format(k, 'key') for k in ('entity_id', 'order_id', 'payment_id', 'settlement_id'))}, type, coalesce(method, '') AS method, CASE WHEN type <> 'adjustment' THEN 'INR' ELSE '' END AS currency, CAST(debit AS VARCHAR) AS debit_paise, CAST(credit AS VARCHAR) AS credit_paise, CAST(amount AS VARCHAR) AS amount_paise, CAST(fee AS VARCHAR) AS fee_paise, CAST(tax AS VARCHAR) AS tax_paise, {_ISO.format('settled', 'settled_at')}, utr AS settlement_utr, settlement_status, CAST(stated AS VARCHAR) AS settlement_net_amount_paise, CAST(sfee AS VARCHAR) AS settlement_fee_paise, CAST(stax AS VARCHAR) AS settlement_tax_paise, {_ISO.format('settled', 'settlement_created_at')} FROM ln")
def _(s, d):
    return _through_csv(L.raw_lines(s, d), files.read_settlement_csv)


@query("a1_read_bank_csv", "SELECT CASE WHEN CAST(substr(bank_txn_id, 4) AS BIGINT) % 13 = 0 THEN '  ' || upper(bank_txn_id) || chr(9) ELSE bank_txn_id END AS bank_txn_id, CASE WHEN day(value_date) % 2 = 1 THEN strftime(value_date, '%d/%m/%Y') ELSE strftime(value_date, '%Y-%m-%d') END AS value_date, description, CAST(credit AS VARCHAR) AS credit, '' AS debit, CAST(balance AS VARCHAR) AS running_balance FROM bal")
def _(s, d):
    back = _through_csv(L.raw_bank(s, d), files.read_bank_csv)
    plain = lambda k: F.regexp_replace(k, "[,.]", "").cast("bigint").cast("string")  # noqa: E731  grouping is tested by b12 and b15
    return back.withColumn("credit", plain("credit")).withColumn("running_balance", plain("running_balance"))


@query("a2_write_csv", "SELECT order_id, 'a \"q\" ' || status || chr(10) || ', b ' AS cell FROM o")
def _(s, d):
    path = shared_dir(s)
    files.write_csv(L.orders(s, d).select("order_id", F.concat(F.lit('a "q" '), "status", F.lit("\n, b ")).alias("cell")), path)
    return s.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("a3_read_labels_json", "SELECT record_type, record_id, true_cause, 'planted on ' || record_id AS note FROM lab")
def _(s, d):
    path, lab = shared_dir(s), L.labels(s, d)
    part = F.pmod(F.xxhash64("record_id"), F.lit(64))  # a file holds one array, so labels are dealt over several
    arrays = lab.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct(*lab.columns))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return files.read_labels_json(s, path)


def _logged(s, d) -> tuple[DataFrame, DataFrame]:
    """Rows appended in two goes, and between them lines torn off and lines without a case."""
    path, o = shared_dir(s), L.orders(s, d).select(F.col("order_id").alias("residue_id"), "status", F.col("amount_paise").alias("latency_ms"))
    files.append_jsonl(o.where("status = 'paid'"), path)
    files.append_jsonl(o.where("status != 'paid'"), path)
    torn = F.concat(F.lit('{"residue_id":"'), "residue_id", F.when(F.col("status") == "pending", F.lit("")).otherwise(F.lit('","sta')))
    o.where("status != 'paid'").select(torn.alias("value")).union(o.where("status = 'pending'").select(F.lit('{"status":"ok"}'))).write.mode("append").text(path)
    return files.read_jsonl_tolerant(s, path, T.StructType([T.StructField("residue_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("latency_ms", T.LongType())]))


@query("a4_read_jsonl_torn", """SELECT '{"residue_id":"' || order_id || CASE status WHEN 'pending' THEN '' ELSE '","sta' END AS line FROM o WHERE status <> 'paid' UNION ALL SELECT '{"status":"ok"}' FROM o WHERE status = 'pending'""")
def _(s, d):
    return _logged(s, d)[1]


@query("a7_append_jsonl", "SELECT order_id AS residue_id, status, amount AS latency_ms FROM o")
def _(s, d):
    return _logged(s, d)[0]


def _commits(s, d) -> tuple[str, T.StructType]:
    """A log of three commits and a torn one: all orders, every third anew, every seventh once more."""
    path, o = shared_dir(s), L.orders(s, d).select(F.col("order_id").alias("residue_id"), F.lit("first").alias("status"), F.col("amount_paise").alias("latency_ms"))
    number = F.regexp_extract("residue_id", r"(\d+)$", 1).cast("bigint")
    log.append(o, path, "residue_id")
    log.append(o.where(number % 3 == 0).withColumn("status", F.lit("second")), path, "residue_id")
    log.append(o.where(number % 7 == 0).withColumn("status", F.lit("third")), path, "residue_id")
    torn = o.where(number % 5 == 0).select(F.concat(F.lit('{"residue_id":"'), "residue_id", F.lit('","sta')).alias("value"), F.pmod(F.xxhash64("residue_id"), F.lit(64)).alias("bucket"))
    torn.write.mode("append").partitionBy("bucket").text(path)
    return path, T.StructType([T.StructField("residue_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("latency_ms", T.LongType())])


_LAST = "SELECT order_id AS residue_id, CASE WHEN n % 7 = 0 THEN 'third' WHEN n % 3 = 0 THEN 'second' ELSE 'first' END AS status, amount AS latency_ms, CASE WHEN n % 7 = 0 THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS commit FROM (SELECT *, CAST(regexp_extract(order_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM o)"


@query("a7_append_log", _LAST)
def _(s, d):
    path, schema = _commits(s, d)
    return log.latest(log.read(s, path, schema, "residue_id")[0], "residue_id").drop("ordinal")


@query("h9_compacted_log", f"{_LAST} UNION ALL SELECT 'torn', 'lines', 0, count(*) FROM o WHERE false")
def _(s, d):
    path, schema = _commits(s, d)
    log.compact(s, path, schema, "residue_id")
    rows, torn = log.read(s, path, schema, "residue_id")  # nothing left to choose among
    return rows.drop("ordinal").unionByName(torn.agg(F.count("*").alias("commit")).select(F.lit("torn").alias("residue_id"), F.lit("lines").alias("status"), F.lit(0).cast("long").alias("latency_ms"), "commit"))


@query("a6_write_normalize_log", "SELECT 'orders' AS source, count(*) AS rows FROM o UNION ALL SELECT 'settlement_report', count(*) FROM ln UNION ALL SELECT 'bank_statement', count(*) FROM bk")
def _(s, d):
    path = shared_dir(s)
    files.write_normalize_log({"rows_by_source": nm.rows_by_source(L.raw_orders(s, d), L.raw_lines(s, d), L.raw_bank(s, d))}, path)
    return s.read.json(f"{path}/rows_by_source")


# --- B: normalisation ------------------------------------------------------------------------------------------------


def _odd(*cells: Column) -> Column:
    """One of some odd forms of a cell, by the order's key."""
    out = cells[-1]
    for i, x in enumerate(cells[:-1]):
        out = F.when(F.col("o_orderkey") % len(cells) == i, x).otherwise(out)
    return out


def _cells(s, d, *cells: Column) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").withColumn("k", F.col("o_orderkey").cast("string")).withColumn("p", F.round(F.col("o_totalprice") * 100).cast("bigint")).select("o_orderkey", _odd(*cells).alias("cell"))


def _case(*values: str) -> str:
    return f"CASE o_orderkey % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("b1_normalize_id", f"SELECT o_orderkey, {_case("'order_' || o_orderkey", "'a b' || o_orderkey", "''", "'x' || o_orderkey")} AS value FROM orders")
def _(s, d):
    cell = _cells(s, d, F.concat(F.lit(" \u00a0ORDER_"), "k", F.lit("\t\u3000")), F.concat(F.lit("A b"), "k"), F.lit(" \n"), F.concat(F.lit("\ufeffX"), "k"))
    return cell.select("o_orderkey", c.normalize_id("cell").alias("value"))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query("b2_normalize_date", f"SELECT o_orderkey, {_case(_DAY, _DAY, 'NULL', 'NULL', 'NULL', _DAY)} AS value FROM orders")
def _(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    form = lambda f: F.date_format("o_orderdate", f)
    cell = _odd(form("dd/MM/yyyy"), form("yyyy-MM-dd"), F.concat(F.lit("31/02/"), form("yyyy")), form("yyyy/MM/dd"), F.concat(form("yyyy-MM-dd"), F.lit("x")), F.concat(F.lit(" "), form("dd/MM/yyyy"), F.lit("\t")))
    return o.select("o_orderkey", cell.alias("cell")).select("o_orderkey", c.normalize_date("cell").alias("value"))


_AT = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"


@query("b3_normalize_timestamp", f"SELECT o_orderkey, {_case(_AT, 'NULL', 'NULL', _AT, 'NULL')} AS value FROM orders")
def _(s, d):
    form = lambda f: F.date_format("o_orderdate", f)
    cell = _odd(form("yyyy-MM-dd'T'HH:mm:ss'Z'"), form("yyyy-MM-dd'T'HH:mm:ss"), form("yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.concat(F.lit(" "), form("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.concat(form("yyyy-MM"), F.lit("-31T25:00:00Z")))
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", cell.alias("cell")).select("o_orderkey", c.normalize_timestamp("cell").alias("value"))


_P = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _amounts(s, d) -> DataFrame:
    whole, rest = F.expr("p div 100").cast("string"), F.lpad((F.col("p") % 100).cast("string"), 2, "0")
    exact = F.concat(whole, F.lit("."), rest)
    return _cells(s, d, F.concat(F.lit(" "), exact), F.concat(F.lit("-"), exact), F.concat(whole, F.lit(".")), F.concat(exact, F.lit("9")), F.lit(""), F.concat(exact, F.lit("x")), F.concat(F.lit("1,"), F.lpad(F.expr("p div 100").cast("string"), 9, "0"), F.lit(".5")))


@query("b4_parse_paise", f"SELECT o_orderkey, {_case(_P, f'-{_P}', f'{_P} // 100 * 100', _P, '0', 'NULL', f'100000000000 + {_P} // 100 * 100 + 50')} AS value FROM orders")
def _(s, d):
    return _amounts(s, d).select("o_orderkey", c.parse_paise("cell").alias("value"))


@query("b5_parse_indian_rupees", f"SELECT o_orderkey, {_case(_P, f'-{_P}', 'NULL', 'NULL', '0', 'NULL', f'100000000000 + {_P} // 100 * 100 + 50')} AS value FROM orders")
def _(s, d):
    return _amounts(s, d).select("o_orderkey", c.parse_indian_rupees("cell").alias("value"))


@query("b6_parse_integer_paise", f"SELECT o_orderkey, {_case(_P, f'-{_P}', 'NULL', 'NULL', 'NULL')} AS value FROM orders")
def _(s, d):
    p = F.col("p").cast("string")
    return _cells(s, d, F.concat(F.lit(" "), p), F.concat(F.lit("-"), p), F.concat(p, F.lit(".0")), F.lit(""), F.concat(F.lit("1,"), p)).select("o_orderkey", c.parse_integer_paise("cell").alias("value"))


_UTR = "lpad(CAST(o_orderkey AS VARCHAR), 12, '7')"


@query("b7_extract_utr", f"SELECT o_orderkey, {_case(_UTR, _UTR, _UTR, _UTR, 'NULL', 'NULL', _UTR)} AS utr, {_case(*(f"'{x}'" for x, _ in c.DESCRIPTION_FORMATS), "'UNKNOWN_FORMAT'", 'NULL', 'NULL', "'UNKNOWN_FORMAT'")} AS format FROM orders")
def _(s, d):
    utr = F.lpad("k", 12, "7")
    before_after = [re.match(r"\^(.*)\(\\d\{12\}\)(.*)\$", p).groups() for _, p in c.DESCRIPTION_FORMATS]
    forms = [F.concat(F.lit(a), utr, F.lit(b)) for a, b in before_after]
    cell = _cells(s, d, *forms, F.concat(F.lit("ref "), utr, F.lit(" ok")), F.concat(utr, F.lit("1")), F.concat(F.lit("UPI/"), "k", F.lit("/x")), F.concat(F.lit("a"), utr, F.lit("b 12")))
    got = c.extract_utr("cell")
    return cell.select("o_orderkey", got["utr"].alias("utr"), got["format"].alias("format"))


@query("b8_normalize_orders", f"SELECT order_id, amount AS amount_paise, 'INR' AS currency, {at('created', 'created_at')}, status FROM o")
def _(s, d):
    return nm.quarantine(nm.normalize_orders(L.raw_orders(s, d)))[0].drop("raw")


@query("b9_normalize_lines", f"SELECT entity_id, type, order_id, payment_id, method, CASE WHEN type <> 'adjustment' THEN 'INR' END AS currency, debit AS debit_paise, credit AS credit_paise, amount AS amount_paise, fee AS fee_paise, tax AS tax_paise, settlement_id, {at('settled', 'settled_at')}, utr AS settlement_utr, settlement_status, stated AS settlement_net_amount_paise, sfee AS settlement_fee_paise, stax AS settlement_tax_paise, {at('settled', 'settlement_created_at')} FROM ln")
def _(s, d):
    return nm.quarantine(nm.normalize_lines(L.raw_lines(s, d)))[0].drop("raw")


@query("b10_normalize_bank", "SELECT bank_txn_id, strftime(value_date, '%Y-%m-%d') AS value_date, description, utr, format AS description_format, credit AS credit_paise, CAST(0 AS BIGINT) AS debit_paise, balance AS running_balance_paise FROM bal")
def _(s, d):
    return nm.quarantine(nm.normalize_bank(L.raw_bank(s, d)))[0].drop("raw")


def _normalized(s, d):
    return nm.normalize_orders(L.raw_orders(s, d)), nm.normalize_lines(L.raw_lines(s, d)), nm.normalize_bank(L.raw_bank(s, d))


_CORRECTED = """
, fixed AS (
  SELECT 'orders.order_id' AS field FROM o WHERE CAST(regexp_extract(order_id, '([0-9]+)$', 1) AS BIGINT) % 13 = 0
  UNION ALL SELECT 'settlement_report.' || unnest(['entity_id', 'settlement_id']) FROM bare WHERE key % 13 = 0
  UNION ALL SELECT 'settlement_report.order_id' FROM bare WHERE key % 13 = 0 AND order_id IS NOT NULL
  UNION ALL SELECT 'settlement_report.payment_id' FROM bare WHERE key % 13 = 0 AND payment_id IS NOT NULL
  UNION ALL SELECT 'bank_statement.bank_txn_id' FROM bk WHERE CAST(substr(bank_txn_id, 4) AS BIGINT) % 13 = 0
  UNION ALL SELECT 'bank_statement.value_date' FROM bk WHERE day(value_date) % 2 = 1
  UNION ALL SELECT 'bank_statement.description[' || format || ']' FROM bk
  UNION ALL SELECT 'bank_statement.' || unnest(['credit', 'running_balance']) FROM bk
)
"""


@query("b11_correction_counts")
def _(s, d):
    return nm.correction_counts(*_normalized(s, d))


ORACLES["b11_correction_counts"] = sql(_CORRECTED.strip() + "\nSELECT field, count(*) AS corrections FROM fixed GROUP BY field UNION ALL SELECT 'total', count(*) FROM fixed")


@query("b12_correction_samples")
def _(s, d):
    return nm.correction_samples(*_normalized(s, d))


ORACLES["b12_correction_samples"] = sql(
    """, raws AS (
  SELECT 'orders.order_id' AS field, order_id AS id, CAST(regexp_extract(order_id, '([0-9]+)$', 1) AS BIGINT) AS key FROM o
  UNION ALL SELECT 'settlement_report.' || unnest(['entity_id', 'settlement_id', 'order_id', 'payment_id']), unnest([entity_id, settlement_id, order_id, payment_id]), key FROM bare
  UNION ALL SELECT 'bank_statement.bank_txn_id', bank_txn_id, CAST(substr(bank_txn_id, 4) AS BIGINT) FROM bk
), rupee AS (
  SELECT unnest(['credit', 'running_balance']) AS f, unnest([credit, balance]) AS p FROM bal
), pairs AS (
  SELECT DISTINCT field, '  ' || upper(id) || chr(9) AS raw, id AS normalized FROM raws WHERE key % 13 = 0 AND id IS NOT NULL
  UNION SELECT 'bank_statement.value_date', strftime(value_date, '%d/%m/%Y'), strftime(value_date, '%Y-%m-%d') FROM bk WHERE day(value_date) % 2 = 1
  UNION SELECT 'bank_statement.description[' || format || ']', description, utr FROM bk
  UNION SELECT 'bank_statement.' || f, CASE WHEN p < 0 THEN '-' ELSE '' END
    || CASE WHEN abs(p) >= 100000 THEN reverse(regexp_replace(reverse(CAST(abs(p) // 100000 AS VARCHAR)), '([0-9]{2})', '\\1,', 'g')) || ',' ELSE '' END
    || CASE WHEN abs(p) >= 100000 THEN lpad(CAST((abs(p) // 100) % 1000 AS VARCHAR), 3, '0') ELSE CAST(abs(p) // 100 AS VARCHAR) END || '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0'), CAST(p AS VARCHAR) FROM rupee
), tidy AS (
  SELECT field, CASE WHEN field LIKE '%credit' OR field LIKE '%balance' THEN regexp_replace(raw, '^(-?),', '\\1') ELSE raw END AS raw, normalized FROM pairs
)
SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY raw, normalized) AS BIGINT) AS rank, raw, normalized FROM tidy QUALIFY row_number() OVER (PARTITION BY field ORDER BY raw, normalized) <= 3"""
)


#: In their files orders and lines stand by falling number, and the bank's rows by falling id.
_IN_FILES = """, numbered AS (
  SELECT *, row_number() OVER (ORDER BY CAST(regexp_extract(order_id, '([0-9]+)$', 1) AS BIGINT) DESC, order_id) AS place FROM o
), listed AS (
  SELECT *, row_number() OVER (ORDER BY key DESC, entity_id) AS place FROM ln
), stated AS (
  SELECT *, row_number() OVER (ORDER BY bank_txn_id DESC) AS place FROM bal
)"""


def _from_files(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three sources written as CSV files in the order of _IN_FILES, read back with each record's place, and normalised."""
    number = lambda k: F.regexp_extract(F.trim(F.regexp_replace(k, "\t", "")), r"(\d+)$", 1).cast("bigint").desc()
    plain = lambda k: F.lower(F.trim(F.regexp_replace(k, "\t", "")))
    made = []
    for raw, order, read, clean in (
        (L.raw_orders(s, d), [number("order_id"), plain("order_id")], files.read_orders_csv, nm.normalize_orders),
        (L.raw_lines(s, d), [number("entity_id"), plain("entity_id")], files.read_settlement_csv, nm.normalize_lines),
        (L.raw_bank(s, d), [plain("bank_txn_id").desc()], files.read_bank_csv, nm.normalize_bank),
    ):
        path = shared_dir(s)
        files.write_csv(raw.orderBy(*order), path)  # range partitions, and files in their order
        made.append(clean(read(s, path, ORDINAL)))
    return tuple(made)


@query("b12_first_corrections")
def _(s, d):
    return nm.correction_samples(*_from_files(s, d)).where("field not like '%running_balance' and field not like '%credit'")


ORACLES["b12_first_corrections"] = sql(
    _IN_FILES
    + """, raws AS (
  SELECT 'orders.order_id' AS field, order_id AS id, CAST(regexp_extract(order_id, '([0-9]+)$', 1) AS BIGINT) AS key, place FROM numbered
  UNION ALL SELECT 'settlement_report.' || unnest(['entity_id', 'settlement_id', 'order_id', 'payment_id']), unnest([entity_id, settlement_id, order_id, payment_id]), key, place FROM listed
  UNION ALL SELECT 'bank_statement.bank_txn_id', bank_txn_id, CAST(substr(bank_txn_id, 4) AS BIGINT), place FROM stated
), fixes AS (
  SELECT field, '  ' || upper(id) || chr(9) AS raw, id AS normalized, place FROM raws WHERE key % 13 = 0 AND id IS NOT NULL
  UNION ALL SELECT 'bank_statement.value_date', strftime(value_date, '%d/%m/%Y'), strftime(value_date, '%Y-%m-%d'), place FROM stated WHERE day(value_date) % 2 = 1
  UNION ALL SELECT 'bank_statement.description[' || format || ']', description, utr, place FROM stated
)
SELECT field, CAST(row_number() OVER w AS BIGINT) AS rank, raw, normalized FROM fixes WINDOW w AS (PARTITION BY field ORDER BY place) QUALIFY row_number() OVER w <= 3"""
)


@query("c1_last_line_of_the_file", f"{_IN_FILES} SELECT 'order_' || key % 50 AS order_id, max_by(entity_id, place) AS entity_id, max_by(amount, place) AS amount_paise, max_by(settlement_id, place) AS settlement_id FROM listed WHERE type = 'payment' AND order_id IS NOT NULL GROUP BY key % 50")
def _(s, d):
    # many lines of few orders, so that there is a last one to find
    lines = nm.quarantine(_from_files(s, d)[1])[0]
    few = F.concat(F.lit("order_"), (F.regexp_extract("entity_id", r"(\d+)$", 1).cast("bigint") % 50).cast("string"))
    lines = lines.withColumn("order_id", F.when(F.col("order_id").isNotNull(), few))
    return od.payment_line_per_order(lines).select("order_id", "entity_id", "amount_paise", "settlement_id")


@query("i7_check_file_order", f"""{_IN_FILES} SELECT source, CAST(n = 0 AS BIGINT) AS passed, n AS failures FROM (
  SELECT 'orders' AS source, count(*) AS n FROM (SELECT created < lag(created) OVER (ORDER BY place) AS bad FROM numbered) WHERE bad
  UNION ALL SELECT 'settlement_report', count(*) FROM (SELECT settled < lag(settled) OVER (ORDER BY place) AS bad FROM listed) WHERE bad
  UNION ALL SELECT 'bank_statement', count(*) FROM (SELECT value_date < lag(value_date) OVER (ORDER BY place) AS bad FROM stated) WHERE bad)""")
def _(s, d):
    orders, lines, bank = _from_files(s, d)
    parts = [vf.check_chronological(*x) for x in (("orders", orders, "created_at"), ("settlement_report", lines, "settled_at"), ("bank_statement", bank, "value_date"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(F.split("check", " ")[0].alias("source"), F.col("passed").cast("bigint").alias("passed"), "failures")


@query("b13_rows_by_source", "SELECT 'orders' AS source, count(*) AS rows FROM o UNION ALL SELECT 'settlement_report', count(*) FROM ln UNION ALL SELECT 'bank_statement', count(*) FROM bk")
def _(s, d):
    return nm.rows_by_source(L.raw_orders(s, d), L.raw_lines(s, d), L.raw_bank(s, d))


@query("b14_quarantine", "SELECT 'amount_paise' AS field, amount || 'x' AS raw, 'unreadable amount_paise' AS reason FROM o WHERE amount % 7 = 0")
def _(s, d):
    raw = L.raw_orders(s, d).withColumn("amount_paise", F.when(F.col("amount_paise").cast("bigint") % 7 == 0, F.concat("amount_paise", F.lit("x"))).otherwise(F.col("amount_paise")))
    return nm.quarantine(nm.normalize_orders(raw))[1]


@query("b15_money_round_trip", "SELECT bank_txn_id, credit AS paise, credit AS strict_paise FROM bk")
def _(s, d):
    text = c.format_indian_rupees("credit_paise")
    return L.bank(s, d).select("bank_txn_id", c.parse_paise(text).alias("paise"), c.parse_indian_rupees(text).alias("strict_paise"))


@query("b16_dates", "SELECT bank_txn_id, strftime(value_date, '%d/%m/%Y') AS slash, strftime(value_date, '%Y-%m-%d') AS iso FROM bk")
def _(s, d):
    return L.bank(s, d).select("bank_txn_id", c.slash_date("value_date").alias("slash"), c.iso_date(c.normalize_date(c.slash_date("value_date"))).alias("iso"))


# --- C: orders and payments -----------------------------------------------------------------------------------------


@query("c1_payment_line_per_order", "SELECT order_id, line_id AS entity_id, settled_amount AS amount_paise, settlement_id FROM pl")
def _(s, d):
    return od.payment_line_per_order(L.lines(s, d)).select("order_id", "entity_id", "amount_paise", "settlement_id")


@query("c2_duplicate_groups", f"SELECT group_id, order_id, amount AS amount_paise, {at('created', 'created_at')}, status FROM dup")
def _(s, d):
    return od.duplicate_groups(L.orders(s, d))


_TWINS = "SELECT group_id, any_value(amount) AS amount_paise, CAST(abs(epoch(max_by(created, order_id)) - epoch(min_by(created, order_id))) AS BIGINT) AS seconds_apart, count(*) AS orders_in_group, count(line_id) AS settled_orders, count(*) - count(line_id) AS unsettled_orders FROM seen WHERE group_id IS NOT NULL GROUP BY group_id"


@query("c3_duplicate_orders", f"SELECT group_id, order_id, amount AS amount_paise, {at('created', 'created_at')}, status, line_id, seconds_apart, orders_in_group, settled_orders, unsettled_orders FROM seen JOIN ({_TWINS}) USING (group_id)")
def _(s, d):
    return od.duplicate_orders_with_members(*ledger(s, d)[:2])


@query("c3_duplicate_members", f"SELECT group_id, order_id, amount AS amount_paise, {at('created', 'created_at')}, status, CAST(line_id IS NOT NULL AS BIGINT) AS settled, line_id FROM seen WHERE group_id IS NOT NULL")
def _(s, d):
    return od.duplicate_twins(*ledger(s, d)[:2]).withColumn("settled", F.col("settled").cast("bigint"))


_OPEN = f"""SELECT order_id, status AS order_status, seen.amount AS amount_paise, {at('created', 'created_at')}, group_id AS duplicate_group,
  coalesce(orders_in_group - 1, 0) AS twins, coalesce(settled_orders, 0) AS settled_twins FROM seen LEFT JOIN ({_TWINS}) USING (group_id) WHERE status = 'paid' AND line_id IS NULL"""
#: Evidence has a group's name and counts, no members: the SQL that it is told from, by query.
_COUNTED = {"c3_duplicate_orders": _TWINS, "c4_orders_without_settlement": _OPEN}


@query("c4_orders_without_settlement", f"""SELECT order_id, status AS order_status, seen.amount AS amount_paise, {at('created', 'created_at')}, group_id AS duplicate_group,
  coalesce(orders_in_group - 1, 0) AS twins, coalesce(settled_orders, 0) AS settled_twins, line_id, CAST(status = 'paid' AND line_id IS NULL AS BIGINT) AS without_settlement
  FROM seen LEFT JOIN ({_TWINS}) USING (group_id) WHERE (status = 'paid' AND line_id IS NULL) OR group_id IN (SELECT group_id FROM seen WHERE status = 'paid' AND line_id IS NULL AND group_id IS NOT NULL)""")
def _(s, d):
    return od.orders_without_settlement_with_twins(*ledger(s, d)[:2]).withColumn("without_settlement", F.col("without_settlement").cast("bigint"))


@query("c5_status_contradictions", f"SELECT order_id, line_id, status AS order_status, settled_amount AS settled_amount_paise, amount AS order_amount_paise, settlement_id, {at('settled', 'settled_at')}, method FROM seen WHERE status <> 'paid' AND line_id IS NOT NULL AND group_id IS NULL")
def _(s, d):
    return od.find_status_contradictions(*ledger(s, d)[:2])


@query("c6_excluded_orders", "SELECT order_id, 'NO_MONEY_MOVEMENT_EXPECTED' AS reason, status, amount AS amount_paise FROM excl")
def _(s, d):
    return od.excluded_orders(*ledger(s, d)[:2])


# --- D: lines --------------------------------------------------------------------------------------------------------


@query("d1_expected_fee_and_tax", "SELECT entity_id, (amount * bp + 5000) // 10000 AS expected_fee_paise, (((amount * bp + 5000) // 10000) * 18 + 50) // 100 AS expected_tax_paise FROM ln WHERE type = 'payment'")
def _(s, d):
    pays = L.lines(s, d).where("type = 'payment'").withColumn("expected_fee_paise", c.expected_fee("amount_paise", "method"))
    return pays.select("entity_id", "expected_fee_paise", c.expected_tax("expected_fee_paise").alias("expected_tax_paise"))


_ORPHAN = f"entity_id AS line_id, type AS line_type, debit AS debit_paise, credit AS credit_paise, amount AS amount_paise, settlement_id, {at('settled', 'settled_at')}"


@query("d2_orphan_adjustments", f"SELECT {_ORPHAN}, 'neither an order nor a payment in the merchant''s records' AS resolves_to FROM ln WHERE type = 'adjustment'")
def _(s, d):
    return ln.find_orphan_adjustments(L.lines(s, d))


@query("d3_orphan_refunds", f"SELECT {_ORPHAN}, 'no payment line anywhere in this settlement report' AS resolves_to, payment_id AS missing_payment_id, order_id AS missing_order_id, CAST(order_id IN (SELECT order_id FROM o) AS BIGINT) AS order_known_to_merchant FROM oref")
def _(s, d):
    return ln.find_orphan_refunds(*ledger(s, d)[:2])


@query("d4_refund_parent_candidates", f"""SELECT r.entity_id AS line_id, CAST(p.rank AS BIGINT) AS rank, p.entity_id AS candidate_id, p.amount AS amount_paise, p.settlement_id, {at('p.settled', 'settled_at')}, p.order_id FROM
  (SELECT entity_id, amount // 100000 AS bucket FROM oref) r JOIN (SELECT *, amount // 100000 AS bucket, row_number() OVER (PARTITION BY amount // 100000 ORDER BY settled, settlement_id, entity_id) AS rank FROM ln WHERE type = 'payment') p USING (bucket) WHERE p.rank <= 5""".replace("p.amount AS amount_paise", "bucket AS amount_paise"))
def _(s, d):
    # amounts are all but unique here, so amounts are compared by the thousand rupees to give the join something to find
    lines = L.lines(s, d).withColumn("amount_paise", c.div(F.col("amount_paise"), 100_000))
    return ln.refund_parent_candidates(ln.find_orphan_refunds(L.orders(s, d), lines), lines)


@query("d5_orphan_payments", f"SELECT {_ORPHAN}, 'no order in the merchant''s ledger' AS resolves_to, order_id AS missing_order_id FROM pj WHERE NOT known")
def _(s, d):
    return ln.find_orphan_payments(*ledger(s, d)[:2])


@query("d6_short_captures", "SELECT order_id, entity_id AS line_id, ordered AS order_amount_paise, amount AS captured_amount_paise, ordered - amount AS shortfall_paise, ((ordered - amount) * 20000 + ordered) // (ordered * 2) / 100 AS shortfall_pct, settlement_id FROM pj WHERE amount < ordered")
def _(s, d):
    return ln.find_short_captures(*ledger(s, d)[:2])


_FEE = "(amount * bp + 5000) // 10000"


@query("d7_fee_mismatches", f"SELECT order_id, entity_id AS line_id, method, amount AS amount_paise, CAST(bp AS BIGINT) AS slab_bp, {_FEE} AS expected_fee_paise, fee AS actual_fee_paise, fee - {_FEE} AS fee_delta_paise, ({_FEE} * 18 + 50) // 100 AS expected_tax_paise, tax AS actual_tax_paise, tax - ({_FEE} * 18 + 50) // 100 AS tax_delta_paise, (fee * 2000000 + amount) // (amount * 2) / 100 AS effective_bp, settlement_id FROM pj WHERE known AND amount >= ordered AND (fee <> {_FEE} OR tax <> ({_FEE} * 18 + 50) // 100)")
def _(s, d):
    return ln.find_fee_mismatches(*ledger(s, d)[:2])


@query("d8_tainted_lines", "SELECT DISTINCT id AS line_id FROM fe WHERE kind = 'settlement_line' AND code IN ('ORPHAN_SETTLEMENT_LINE', 'SHORT_CAPTURE', 'FEE_SLAB_MISMATCH')")
def _(s, d):
    o, li, _b = ledger(s, d)
    return ln.tainted_lines(ln.find_orphan_adjustments(li), ln.find_orphan_refunds(o, li), ln.find_orphan_payments(o, li), ln.find_short_captures(o, li), ln.find_fee_mismatches(o, li))


# --- E: settlements and the bank ------------------------------------------------------------------------------------

_G = f"settlement_id, utr, status, {at('settled', 'settled_at')}, net AS expected_net_paise, stated AS stated_net_paise, line_count"


@query("e1_group_settlements", f"SELECT {_G} FROM g")
def _(s, d):
    return st.group_settlements(L.lines(s, d))


@query("e2_tie_settlement_to_bank", f"SELECT {_G}, bank_txn_id, bank_credit AS bank_credit_paise, CAST(bank_rows AS BIGINT) AS bank_rows_for_utr FROM tied")
def _(s, d):
    return tied(s, d)


@query("e3_settlements_on_hold", f"SELECT {_G}, net AS withheld_paise FROM tied WHERE status = 'on_hold' AND bank_txn_id IS NULL")
def _(s, d):
    return st.find_on_hold(tied(s, d))


@query("e4_unexpected_credit_on_hold", f"SELECT {_G}, bank_txn_id, bank_credit AS bank_credit_paise FROM tied WHERE status = 'on_hold' AND bank_txn_id IS NOT NULL")
def _(s, d):
    return st.find_unexpected_credit_on_hold(tied(s, d))


@query("e5_missing_bank_credit", f"SELECT {_G}, CAST(bank_rows AS BIGINT) AS bank_rows_for_utr FROM tied WHERE status <> 'on_hold' AND bank_txn_id IS NULL")
def _(s, d):
    return st.find_missing_bank_credit(tied(s, d))


@query("e6_net_mismatch", f"SELECT {_G}, bank_txn_id, bank_credit AS bank_credit_paise, bank_credit - net AS delta_paise, stated - net AS header_vs_lines_delta_paise FROM tied WHERE status <> 'on_hold' AND bank_txn_id IS NOT NULL AND (abs(bank_credit - net) > 1 OR stated <> net)")
def _(s, d):
    return st.find_net_mismatch(tied(s, d))


@query("e7_unclaimed_bank_credits", "SELECT bank_txn_id, utr, description, format AS description_format, credit AS credit_paise, strftime(value_date, '%Y-%m-%d') AS value_date FROM ghost")
def _(s, d):
    return st.find_unclaimed_bank_credits(st.group_settlements(L.lines(s, d)), L.bank(s, d))


@query("e8_nearby_bank_candidates", "SELECT settlement_id, CAST(row_number() OVER w AS BIGINT) AS rank, bk.bank_txn_id, credit AS credit_paise, credit - net AS delta_paise, bk.utr, strftime(value_date, '%Y-%m-%d') AS value_date FROM tied JOIN bk ON abs(credit - net) <= 50000 WHERE tied.bank_txn_id IS NULL WINDOW w AS (PARTITION BY settlement_id ORDER BY abs(credit - net), bk.bank_txn_id) QUALIFY row_number() OVER w <= 5")
def _(s, d):
    return st.nearby_bank_candidates(tied(s, d).where("bank_txn_id is null"), L.bank(s, d))


@query("e9_nearby_settlement_candidates", f"SELECT bank_txn_id, CAST(row_number() OVER w AS BIGINT) AS rank, settlement_id, net AS expected_net_paise, credit - net AS delta_paise, g.utr, {at('settled', 'settled_at')} FROM ghost JOIN g ON abs(credit - net) <= 50000 WINDOW w AS (PARTITION BY bank_txn_id ORDER BY abs(credit - net), settlement_id) QUALIFY row_number() OVER w <= 5")
def _(s, d):
    groups = st.group_settlements(L.lines(s, d))
    return st.nearby_settlement_candidates(st.find_unclaimed_bank_credits(groups, L.bank(s, d)), groups)


@query("e10_settlement_ownership", "SELECT split_part(finding_id, ':', 2) AS settlement_id, kind, id FROM fe WHERE code IN ('SETTLEMENT_ON_HOLD', 'UNEXPECTED_BANK_CREDIT_ON_HOLD', 'SETTLEMENT_WITHOUT_BANK_CREDIT', 'NET_MISMATCH')")
def _(s, d):
    t = stored(tied(s, d))
    return st.settlement_ownership(t.join(st.reconciled(t), "settlement_id", "left_anti"), L.lines(s, d), L.orders(s, d))


@query("e11_reconciled", "SELECT settlement_id, bank_txn_id, net AS expected_net_paise FROM rec")
def _(s, d):
    return st.reconciled(tied(s, d))


@query("e1_raw_headers", """SELECT settlement_id, min_by(CASE WHEN key % 13 = 0 THEN '  ' || upper(settlement_id) || chr(9) ELSE settlement_id END, (settled, settlement_id, entity_id)) AS raw_settlement_id, any_value(utr) AS raw_utr, any_value(settlement_status) AS raw_status, CAST(any_value(stated) AS VARCHAR) AS raw_net, strftime(any_value(settled), '%Y-%m-%dT%H:%M:%SZ') AS raw_created_at FROM ln GROUP BY settlement_id""")
def _(s, d):
    raw = F.col("raw")
    groups = st.group_settlements(nm.quarantine(nm.normalize_lines(L.raw_lines(s, d)))[0])
    return groups.select("settlement_id", raw["settlement_id"].alias("raw_settlement_id"), raw["settlement_utr"].alias("raw_utr"), raw["settlement_status"].alias("raw_status"), raw["settlement_net_amount_paise"].alias("raw_net"), raw["settlement_created_at"].alias("raw_created_at"))


# --- F: delay --------------------------------------------------------------------------------------------------------

_DELTA = f"order_id, line_id, day_delta, {at('created', 'created_at')}, {at('settled', 'settled_at')}, settlement_id, amount AS amount_paise, method"


@query("f1_settlement_day_delta", f"SELECT {_DELTA} FROM delta")
def _(s, d):
    return dl.settlement_day_delta(*ledger(s, d)[:2])


@query("f2_day_delta_histogram", "SELECT day_delta, count(*) AS lines FROM delta GROUP BY day_delta")
def _(s, d):
    return dl.day_delta_histogram(dl.settlement_day_delta(*ledger(s, d)[:2]))


@query("f3_settlement_delays", f"SELECT {_DELTA}, CAST(2 AS BIGINT) AS expected_day_delta, day_delta - 2 AS excess_days FROM delta WHERE day_delta > 2")
def _(s, d):
    return dl.find_settlement_delays(dl.settlement_day_delta(*ledger(s, d)[:2]))


# --- G: assembly -----------------------------------------------------------------------------------------------------


@query("g1_findings", "SELECT DISTINCT finding_id, code FROM fe")
def _(s, d):
    return result(s, d)["findings"].select("finding_id", "code")


@query("g2_owned_entities", "SELECT kind, id FROM owned")
def _(s, d):
    return a.owned_entities(result(s, d)["finding_entities"])


@query("g3_matched_lines", "SELECT order_id, CASE WHEN type = 'payment' THEN entity_id ELSE payment_id END AS payment_id, entity_id AS line_id, type AS line_type, settlement_id, bank_txn_id, net AS net_paise, amount AS amount_paise, CAST(1 AS BIGINT) AS verified FROM matched")
def _(s, d):
    return result(s, d)["matched"].withColumn("verified", F.col("verified").cast("bigint"))


@query("g4_connected_components", "SELECT node, c AS component FROM comp WHERE node IN (SELECT a FROM edge WHERE a <> b)")
def _(s, d):
    with tidy(s):
        ends, home = star_components(result(s, d)["members"])
    return ends.join(home.where("nodes > 1"), "head").select(F.col("key").alias("node"), "component")


@query("g5_residue_entities", """SELECT rea.residue_id, rea.kind, rea.id, CAST(rea.amount AS BIGINT) AS amount_paise, CASE rea.kind WHEN 'order' THEN o.status || '|' || strftime(o.created, '%Y-%m-%d') WHEN 'settlement_line' THEN ln.type || '|' || ln.settlement_id || '|' || ln.fee || '|' || ln.tax
    WHEN 'bank_txn' THEN bk.utr || '|' || bk.format ELSE g.utr || '|' || g.status || '|' || g.stated || '|' || g.line_count END AS told FROM rea LEFT JOIN o ON rea.kind = 'order' AND o.order_id = rea.id
  LEFT JOIN ln ON rea.kind = 'settlement_line' AND ln.entity_id = rea.id LEFT JOIN bk ON rea.kind = 'bank_txn' AND bk.bank_txn_id = rea.id LEFT JOIN g ON rea.kind = 'settlement' AND g.settlement_id = rea.id""")
def _(s, d):
    cell = lambda k: F.get_json_object("normalized", f"$.{k}")
    told = F.when(F.col("kind") == "order", F.concat_ws("|", cell("status"), F.substring(cell("created_at"), 1, 10))).when(F.col("kind") == "settlement_line", F.concat_ws("|", cell("type"), cell("settlement_id"), cell("fee_paise"), cell("tax_paise")))
    told = told.when(F.col("kind") == "bank_txn", F.concat_ws("|", cell("utr"), cell("description_format"))).otherwise(F.concat_ws("|", cell("utr"), cell("status"), cell("stated_net_paise"), cell("line_count")))
    return result(s, d)["residue_entities"].select("residue_id", "kind", "id", "amount_paise", told.alias("told"))


@query("g6_residue_evidence", """SELECT residue_id, 'day_delta' AS key, CAST(min_by(day_delta, finding_id) AS VARCHAR) AS value FROM cases JOIN delta ON finding_id = 'SETTLEMENT_DELAY:' || line_id GROUP BY residue_id
  UNION ALL SELECT residue_id, 'SETTLEMENT_DELAY.day_delta', CAST(max_by(day_delta, finding_id) AS VARCHAR) FROM cases JOIN delta ON finding_id = 'SETTLEMENT_DELAY:' || line_id GROUP BY residue_id HAVING count(*) > 1
  UNION ALL SELECT residue_id, 'shortfall_paise', CAST(min_by(ordered - amount, finding_id) AS VARCHAR) FROM cases JOIN pj ON finding_id = 'SHORT_CAPTURE:' || entity_id GROUP BY residue_id""")
def _(s, d):
    e = result(s, d)["residue"].select("residue_id", F.explode("evidence").alias("key", "value"))
    return e.where(F.col("key").isin("day_delta", "SETTLEMENT_DELAY.day_delta", "shortfall_paise"))


@query("g7_residue_candidates", f""", cand AS (
  SELECT 'DUPLICATE_ORDER_PAIR:' || group_id AS finding_id, 1 AS stage, '0:' || group_id AS place, row_number() OVER (PARTITION BY group_id ORDER BY order_id) AS k, 'order' AS kind, order_id AS id, CASE WHEN line_id IS NULL THEN '{TWIN_UNSETTLED}' ELSE '{TWIN_SETTLED}' END AS reason,
    'amount_paise=' || amount || ',created_at=' || strftime(created, '%Y-%m-%dT%H:%M:%SZ') || ',status=' || status AS shown FROM seen WHERE group_id IS NOT NULL
  UNION ALL SELECT 'ORPHAN_SETTLEMENT_LINE:' || r.entity_id, 2, '0:' || r.entity_id, p.k, 'settlement_line', p.entity_id, '{PARENT}', 'amount_paise=' || p.amount || ',order_id=' || p.order_id || ',settled_at=' || strftime(p.settled, '%Y-%m-%dT%H:%M:%SZ') || ',settlement_id=' || p.settlement_id
    FROM oref r JOIN (SELECT *, row_number() OVER (PARTITION BY amount ORDER BY settled, settlement_id, entity_id) AS k FROM ln WHERE type = 'payment') p ON p.amount = r.amount AND p.k <= 5
  UNION ALL SELECT code || ':' || settlement_id, 3, '0:' || settlement_id, k, 'bank_txn', id, '{NEAR_BANK}', shown FROM (SELECT f.code, f.settlement_id, bk.bank_txn_id AS id, row_number() OVER (PARTITION BY f.settlement_id ORDER BY abs(credit - net), bk.bank_txn_id) AS k,
    'credit_paise=' || credit || ',delta_paise=' || (credit - net) || ',utr=' || bk.utr || ',value_date=' || strftime(value_date, '%Y-%m-%d') AS shown FROM failed f JOIN g USING (settlement_id) JOIN bk ON abs(credit - net) <= 50000 WHERE f.bank_txn_id IS NULL) WHERE k <= 5
  UNION ALL SELECT 'BANK_CREDIT_WITHOUT_SETTLEMENT:' || bank_txn_id, 3, '1:' || bank_txn_id, k, 'settlement', settlement_id, '{NEAR_BATCH}', shown FROM (SELECT bank_txn_id, settlement_id, row_number() OVER (PARTITION BY bank_txn_id ORDER BY abs(credit - net), settlement_id) AS k,
    'delta_paise=' || (credit - net) || ',expected_net_paise=' || net || ',settled_at=' || strftime(g.settled, '%Y-%m-%dT%H:%M:%SZ') || ',utr=' || g.utr AS shown FROM ghost JOIN g ON abs(credit - net) <= 50000) WHERE k <= 5
) SELECT residue_id, kind, id, reason, CAST(arg_min(k, (stage, place, k)) AS BIGINT) AS rank, arg_min(shown, (stage, place, k)) AS shown FROM cand JOIN cases USING (finding_id) GROUP BY residue_id, kind, id, reason""")
def _(s, d):
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return result(s, d)["residue_candidates"].select("residue_id", "kind", "id", "reason", F.col("first.rank").cast("bigint").alias("rank"), shown.alias("shown"))


@query("g8_residue_findings", "SELECT residue_id, string_agg(DISTINCT code, ',' ORDER BY code) AS finding_types, count(DISTINCT finding_id) AS n_findings, (SELECT count(*) FROM re WHERE re.residue_id = cases.residue_id) AS n_entities FROM cases GROUP BY residue_id")
def _(s, d):
    return result(s, d)["residue"].select("residue_id", "finding_types", "n_findings", "n_entities")


@query("g9_short_residue_ids", """, ks AS (SELECT residue_id, string_agg(kind || ':' || id, '|' ORDER BY kind || ':' || id) AS t FROM re GROUP BY residue_id)
  SELECT residue_id, 'res_' || lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(t, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296))), 8, '0') AS short_id FROM ks""")
def _(s, d):
    keys = result(s, d)["case_records"].select("residue_id", c.entity_key("kind", "id").alias("key"))
    return a.short_ids(keys, "residue_id")


@query("g10_residue_value", "SELECT residue_id, value_paise FROM val")
def _(s, d):
    return a.residue_value(result(s, d)["case_records"])


@query("g11_finding_type_counts", "SELECT code, count(DISTINCT finding_id) AS findings FROM fe GROUP BY code")
def _(s, d):
    return a.finding_type_counts(result(s, d)["findings"])


_MATCHED_VALUE = "(SELECT CAST(sum(amount) AS BIGINT) FROM matched)"
_CASE_VALUE = "(SELECT CAST(sum(value_paise) AS BIGINT) FROM val)"


@query("g12_match_metrics", f"""SELECT (SELECT count(*) FROM o) AS total_orders, (SELECT count(*) FROM ln WHERE type = 'payment') AS total_payments, (SELECT count(*) FROM ln WHERE type = 'refund') AS total_refunds, (SELECT count(*) FROM ln WHERE type = 'adjustment') AS total_adjustments,
  (SELECT count(*) FROM g) AS total_settlements, (SELECT count(*) FROM bk) AS total_bank_rows, (SELECT count(*) FROM matched) AS auto_matched_count, {_MATCHED_VALUE} AS auto_matched_value_paise, (SELECT count(*) FROM val) AS residue_count, {_CASE_VALUE} AS residue_value_paise, (SELECT count(*) FROM excl) AS excluded_count,
  round((SELECT count(*) FROM matched) / ((SELECT count(*) FROM matched) + (SELECT count(*) FROM val)), 4) AS match_rate_by_count, round({_MATCHED_VALUE} / ({_MATCHED_VALUE} + {_CASE_VALUE}), 4) AS match_rate_by_value""")
def _(s, d):
    return result(s, d)["metrics"]


@query("g13_partition_audit", """, input AS (
  SELECT 'order' AS kind, order_id AS id FROM o UNION SELECT 'settlement_line', entity_id FROM ln UNION SELECT 'settlement', settlement_id FROM ln UNION SELECT 'bank_txn', bank_txn_id FROM bk
), placed AS (
  SELECT 'order' AS kind, order_id AS id, 'm' AS bucket FROM matched WHERE type = 'payment' AND order_id IS NOT NULL UNION SELECT 'settlement_line', entity_id, 'm' FROM matched UNION SELECT 'settlement', settlement_id, 'm' FROM rec UNION SELECT 'bank_txn', bank_txn_id, 'm' FROM rec
  UNION SELECT 'order', order_id, 'e' FROM excl UNION SELECT kind, id, residue_id FROM re
) SELECT coalesce(i.kind, p.kind) AS kind, coalesce(i.id, p.id) AS id, CASE WHEN i.id IS NULL THEN 'not in the input' WHEN p.n IS NULL THEN 'unaccounted for' ELSE 'more than once' END AS problem
  FROM input i FULL JOIN (SELECT kind, id, count(*) AS n FROM placed GROUP BY kind, id) p ON p.kind = i.kind AND p.id = i.id WHERE i.id IS NULL OR p.n IS NULL OR p.n > 1""")
def _(s, d):
    return result(s, d)["audit"]


@query("a5_write_match_result", "SELECT 'matched' AS part, count(*) AS rows FROM matched UNION ALL SELECT 'residue', count(*) FROM val UNION ALL SELECT 'excluded', count(*) FROM excl")
def _(s, d):
    path, r = shared_dir(s), result(s, d)
    files.write_match_result({k: r[k] for k in ("matched", "residue", "excluded")}, path)
    counts = [s.read.parquet(f"{path}/{k}").agg(F.count("*").alias("rows")).select(F.lit(k).alias("part"), "rows") for k in ("matched", "residue", "excluded")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("g14_reconcile", "SELECT 'matched' AS part, count(*) AS rows FROM matched UNION ALL SELECT 'excluded', count(*) FROM excl UNION ALL SELECT 'residue', count(*) FROM val UNION ALL SELECT 'residue_entities', count(*) FROM re UNION ALL SELECT 'reconciled', count(*) FROM rec UNION ALL SELECT 'findings', count(DISTINCT finding_id) FROM fe")
def _(s, d):
    r = reconcile(*ledger(s, d))
    out = None
    for part in ("matched", "excluded", "residue", "residue_entities", "reconciled", "findings"):
        row = r[part].agg(F.count("*").alias("rows")).select(F.lit(part).alias("part"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


# --- H: classification ------------------------------------------------------------------------------------------------

_CONF = "CASE v.cause WHEN 'ON_HOLD' THEN 0.95 WHEN 'DUPLICATE_WEBHOOK' THEN 0.85 WHEN 'LATE_SETTLEMENT' THEN 0.85 WHEN 'INSUFFICIENT_EVIDENCE' THEN v.unsure ELSE 0.9 END"


_ACTION = f"""CASE v.cause WHEN 'ON_HOLD' THEN '{ACTION_HOLD}' WHEN 'UNEXPLAINED' THEN '{ACTION_UNEXPLAINED}' WHEN 'SILENT_UPI_FAIL' THEN '{ACTION_STATUS}' WHEN 'PARTIAL_CAPTURE' THEN '{ACTION_SHORT}' WHEN 'FEE_VARIANCE' THEN '{ACTION_FEE[0]}' || amount || '{ACTION_FEE[1]}'
  WHEN 'CHARGEBACK_DEBIT' THEN '{ACTION_CHARGEBACK}' WHEN 'REFUND_NETTED' THEN '{ACTION_REFUND}' WHEN 'DUPLICATE_WEBHOOK' THEN '{ACTION_DUPLICATE}' WHEN 'LATE_SETTLEMENT' THEN '{ACTION_LATE}' ELSE CASE WHEN orphan THEN NULL WHEN late THEN '{ACTION_NORMAL}' WHEN open THEN '{ACTION_OPEN}' END END""".replace("merchant's", "merchant''s")


@query("h1_rule_verdict", f"SELECT residue_id, cause, CAST({_CONF} AS DOUBLE) AS confidence, {_ACTION} AS action, amount AS amount_paise FROM said v")
def _(s, d):
    return cl.rule_verdict(result(s, d)["residue"]).select("residue_id", "cause", "confidence", "action", "amount_paise")


@query("h2_rules_classification", f"SELECT residue_id, 'ok' AS status, v.cause AS predicted_cause, CAST({_CONF} AS DOUBLE) AS confidence, CAST(v.cause = 'INSUFFICIENT_EVIDENCE' AS BIGINT) AS requires_human_review FROM verdict v")
def _(s, d):
    x = F.col("classification")
    return cl.rules_classification(result(s, d)["residue"]).select("residue_id", "status", x["predicted_cause"].alias("predicted_cause"), x["confidence"].alias("confidence"), x["requires_human_review"].cast("bigint").alias("requires_human_review"))


def _changed(records: DataFrame) -> DataFrame:
    """Records as a less careful provider would give them: every case id that begins with 0 to 7 less sure, none sent to review."""
    x = F.col("classification")
    unsure = F.substring("residue_id", 5, 1) < "8"
    return records.withColumn("classification", x.withField("confidence", F.when(unsure, F.round(x["confidence"] - 0.25, 2)).otherwise(x["confidence"])).withField("requires_human_review", F.lit(False)))


_UNSURE = f"SELECT residue_id, v.cause, round(CAST({_CONF} AS DOUBLE) - CASE WHEN substr(residue_id, 5, 1) < '8' THEN 0.25 ELSE 0 END, 2) AS confidence FROM verdict v"


@query("h3_confidence_gate", f"SELECT residue_id, confidence, CAST(confidence < 0.7 OR cause = 'INSUFFICIENT_EVIDENCE' AS BIGINT) AS requires_human_review, CAST(confidence < 0.7 OR cause = 'INSUFFICIENT_EVIDENCE' AS BIGINT) AS gate_forced_review FROM ({_UNSURE})")
def _(s, d):
    x = F.col("classification")
    return cl.confidence_gate(_changed(result(s, d)["records"])).select("residue_id", x["confidence"].alias("confidence"), x["requires_human_review"].cast("bigint").alias("requires_human_review"), F.col("gate_forced_review").cast("bigint").alias("gate_forced_review"))


@query("h4_validate_classification", "SELECT residue_id, CASE WHEN substr(residue_id, 5, 1) < '4' THEN 'confidence: not between 0 and 1' ELSE '' END AS errors FROM verdict")
def _(s, d):
    x = F.col("classification")
    odd = result(s, d)["records"].withColumn("classification", x.withField("confidence", F.when(F.substring("residue_id", 5, 1) < "4", 1.5).otherwise(x["confidence"])))
    return cl.validate_classification(odd).select("residue_id", "errors")


def _told(name: str, code: str, stage: int, place: int, key: str, *leave: str, more: str = "", rename: str = "") -> str:
    """The evidence of one kind of finding: the other columns of its query's SQL, a row for each that isn't null."""
    columns = f"* EXCLUDE ({', '.join([key, *leave])})"
    old, _, new = rename.partition(" ")
    name_of = f"CASE k WHEN '{old}' THEN '{new}' ELSE k END" if rename else "k"
    return f"""SELECT '{code}:' || _id AS finding_id, {stage} AS stage, '{place}:' || _id AS place, '{code}' AS code, {name_of} AS key,
    CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9:]{{8}}') THEN replace(v, ' ', 'T') || 'Z' WHEN k IN ('shortfall_pct', 'effective_bp') THEN regexp_replace(v, '[.]0$', '') ELSE v END AS value
    FROM (UNPIVOT (SELECT {key} AS _id, CAST(COLUMNS({columns}) AS VARCHAR){more} FROM ({_COUNTED.get(name) or _SELECTS[name]})) ON COLUMNS(* EXCLUDE (_id)) INTO NAME k VALUE v)"""


_BATCH = {"key": "settlement_id", "rename": "status settlement_status"}
_EVIDENCE = " UNION ALL ".join(
    [
        _told("c3_duplicate_orders", "DUPLICATE_ORDER_PAIR", 1, 0, "group_id"),
        _told("c4_orders_without_settlement", "ORDER_WITHOUT_SETTLEMENT", 1, 1, "order_id", "twins", "settled_twins"),
        _told("c5_status_contradictions", "ORDER_STATUS_CONTRADICTION", 1, 1, "order_id", "line_id"),
        *(_told(k, "ORPHAN_SETTLEMENT_LINE", 2, 0, "line_id") for k in ("d2_orphan_adjustments", "d3_orphan_refunds", "d5_orphan_payments")),
        _told("d6_short_captures", "SHORT_CAPTURE", 2, 0, "line_id", "order_id"),
        _told("d7_fee_mismatches", "FEE_SLAB_MISMATCH", 2, 0, "line_id", "order_id"),
        _told("e3_settlements_on_hold", "SETTLEMENT_ON_HOLD", 3, 0, more=", '0' AS bank_rows_for_utr", **_BATCH),
        _told("e4_unexpected_credit_on_hold", "UNEXPECTED_BANK_CREDIT_ON_HOLD", 3, 0, **_BATCH),
        _told("e5_missing_bank_credit", "SETTLEMENT_WITHOUT_BANK_CREDIT", 3, 0, **_BATCH),
        _told("e6_net_mismatch", "NET_MISMATCH", 3, 0, more=", '1' AS tolerance_paise", **_BATCH),
        _told("e7_unclaimed_bank_credits", "BANK_CREDIT_WITHOUT_SETTLEMENT", 3, 1, "bank_txn_id"),
        _told("f3_settlement_delays", "SETTLEMENT_DELAY", 4, 0, "line_id", "order_id", rename="created_at order_created_at"),
    ]
)
_JSON_AT = "strftime({0}, '%Y-%m-%dT%H:%M:%S.000Z')"


def _json(*fields: str) -> str:
    """name:value for numbers, name=value for texts; fields that are null are left out."""
    parts = []
    for f in fields:
        name, text, value = f.partition("=") if "=" in f else f.partition(":")
        parts.append(f"""'"{name}":' || """ + (f"""'"' || {value} || '"'""" if text == "=" else f"{value}"))
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_RECORD_JSON = {
    "order": ("o.order_id", "o", _json("order_id=o.order_id", "amount_paise:o.amount", "currency='INR'", f"created_at={_JSON_AT.format('o.created')}", "status=o.status")),
    "settlement_line": ("ln.entity_id", "ln", _json("entity_id=ln.entity_id", "type=ln.type", "order_id=ln.order_id", "payment_id=ln.payment_id", "method=ln.method", "currency=CASE WHEN ln.type IN ('payment', 'refund') THEN 'INR' END", "debit_paise:ln.debit", "credit_paise:ln.credit", "amount_paise:ln.amount", "fee_paise:ln.fee", "tax_paise:ln.tax", "settlement_id=ln.settlement_id", f"settled_at={_JSON_AT.format('ln.settled')}", "settlement_utr=ln.utr", "settlement_status=ln.settlement_status", "settlement_net_amount_paise:ln.stated", "settlement_fee_paise:ln.sfee", "settlement_tax_paise:ln.stax", f"settlement_created_at={_JSON_AT.format('ln.settled')}")),
    "bank_txn": ("bal.bank_txn_id", "bal", _json("bank_txn_id=bal.bank_txn_id", "value_date=strftime(bal.value_date, '%Y-%m-%d')", "description=bal.description", "utr=bal.utr", "description_format=bal.format", "credit_paise:bal.credit", "debit_paise:0", "running_balance_paise:bal.balance")),
    "settlement": ("g.settlement_id", "g", _json("settlement_id=g.settlement_id", "utr=g.utr", "status=g.status", f"settled_at={_JSON_AT.format('g.settled')}", "expected_net_paise:g.net", "stated_net_paise:g.stated", "line_count:g.line_count")),
}


@query(
    "h5_case_brief",
    _SELECTS["g7_residue_candidates"].split(") SELECT residue_id, kind")[0]
    + f"""), evidence AS (
  SELECT residue_id, key, code, min((stage, place, code)) AS first, arg_min(value, (stage, place, code)) AS first_value, max((stage, place, code)) AS last, arg_max(value, (stage, place, code)) AS last_value
  FROM ({_EVIDENCE}) JOIN (SELECT finding_id, residue_id FROM cases) USING (finding_id) GROUP BY residue_id, key, code
), kept AS (
  SELECT *, min(first) OVER (PARTITION BY residue_id, key) AS head FROM evidence
), lines_of AS (
  SELECT residue_id, key, first_value AS value FROM kept WHERE first = head UNION ALL SELECT residue_id, code || '.' || key, last_value FROM kept WHERE last > head
), near AS (
  SELECT residue_id, kind, id, reason, min((stage, place, k)) AS first, arg_min(shown, (stage, place, k)) AS shown, arg_min(stage, (stage, place, k)) AS stage, arg_min(place, (stage, place, k)) AS place, arg_min(k, (stage, place, k)) AS k
  FROM cand JOIN cases USING (finding_id) GROUP BY residue_id, kind, id, reason
)
SELECT DISTINCT residue_id, '1 FINDINGS' AS section, code AS place, code AS text FROM cases
UNION ALL SELECT residue_id, '2 EVIDENCE', key, key || ' = ' || value FROM lines_of
"""
    + "".join(f"UNION ALL SELECT re.residue_id, '3 RECORDS', kind || ':' || id, kind || ' ' || id || ': ' || {made} FROM re JOIN {table} ON kind = '{kind}' AND {key} = id\n" for kind, (key, table, made) in _RECORD_JSON.items())
    + "UNION ALL SELECT residue_id, '4 NEAR MISSES', stage || ':' || place || ':' || lpad(CAST(k AS VARCHAR), 10, '0') || ':' || kind || ':' || id, kind || ' ' || id || ': ' || reason || ' (' || replace(replace(shown, ',', ', '), '=', ' = ') || ')' FROM near",
)
def _(s, d):
    r = result(s, d)
    return cl.case_lines(r["residue"], r["residue_entities"], r["residue_candidates"])


def _by_codes(brief: str) -> dict:
    """A provider: a held batch is on hold, all else isn't known."""
    held = "SETTLEMENT_ON_HOLD" in brief.split("EVIDENCE")[0].replace("UNEXPECTED_BANK_CREDIT_ON_HOLD", "")
    return {"predicted_cause": "ON_HOLD" if held else INSUFFICIENT, "confidence": 0.9, "reasoning": "by its findings", "proposed_adjusting_entry": None, "requires_human_review": not held}


def _briefs(s, d) -> DataFrame:
    r = result(s, d)
    with tidy(s):
        return stored(cl.case_brief(r["residue"], r["case_records"], r["residue_candidates"], details=r.details))


_CALLED = "SELECT residue_id, 'ok' AS status, CASE WHEN bool_or(code = 'SETTLEMENT_ON_HOLD') THEN 'ON_HOLD' ELSE 'INSUFFICIENT_EVIDENCE' END AS predicted_cause FROM cases GROUP BY residue_id"


@query("h6_classify_with", _CALLED)
def _(s, d):
    out = cl.classify_with(_briefs(s, d), _by_codes, "codes", "1")
    return out.select("residue_id", "status", F.col("classification.predicted_cause").alias("predicted_cause"))


@query("h6_classify_logged", _CALLED)
def _(s, d):
    out = cl.classify_logged(_briefs(s, d), _by_codes, "codes", "1", shared_dir(s), batches=2)
    return out.select("residue_id", "status", F.col("classification.predicted_cause").alias("predicted_cause"))


def _with_status(records: DataFrame) -> DataFrame:
    first = F.substring("residue_id", 5, 1)
    return records.withColumn("status", F.when(first == "0", "transport_failure").when(first == "1", "schema_failure").otherwise("ok"))


@query("h7_pending_cases", "SELECT residue_id FROM verdict WHERE substr(residue_id, 5, 1) IN ('0', '1')")
def _(s, d):
    r = result(s, d)
    return cl.pending_cases(r["residue"], _with_status(r["records"]), retry_failed=True).select("residue_id")


@query("h8_assert_single_provider", f"""SELECT 'mixed' AS records, 'records of another provider: ' || string_agg('other/m' || h || ' (' || n || ')', ', ' ORDER BY h) AS said FROM (SELECT substr(residue_id, 5, 1) AS h, count(*) AS n FROM verdict WHERE substr(residue_id, 5, 1) < '3' GROUP BY h)
  UNION ALL SELECT 'rules alone', '' FROM (SELECT count(*) AS n FROM verdict) WHERE n > 0""")
def _(s, d):
    rules, h = result(s, d)["records"], F.substring("residue_id", 5, 1)
    mixed = rules.withColumn("model", F.when(h < "3", F.concat(F.lit("m"), h)).otherwise(F.col("model"))).withColumn("provider", F.when(h < "3", "other").otherwise(F.col("provider")))
    said = []
    for name, records in (("mixed", mixed), ("rules alone", rules)):
        try:
            cl.assert_single_provider(records, cl.RULES_NAME, cl.RULES_MODEL)
            said.append((name, ""))
        except ValueError as e:
            said.append((name, str(e)))
    return s.createDataFrame(said, "records string, said string")


@query("h9_compact_classifications", "SELECT residue_id, CAST(2 AS BIGINT) AS seq FROM verdict WHERE substr(residue_id, 5, 1) <> '0'")
def _(s, d):
    r = _with_status(result(s, d)["records"])
    both = r.withColumn("seq", F.lit(1)).unionByName(r.withColumn("seq", F.lit(2)))
    return cl.compact_classifications(both).select("residue_id", "seq")


@query("h10_ambiguity_rank", """SELECT residue_id, CAST(CASE WHEN count(DISTINCT code) > 1 THEN 3 ELSE 0 END + CASE WHEN min_by(day_delta, CASE WHEN code = 'SETTLEMENT_DELAY' THEN finding_id END) <= 3 THEN 2 ELSE 0 END
  + CASE WHEN bool_or(code = 'ORPHAN_SETTLEMENT_LINE') THEN 1 ELSE 0 END + CASE WHEN bool_or(code = 'ORDER_WITHOUT_SETTLEMENT') THEN 1 ELSE 0 END AS BIGINT) AS rank
  FROM cases LEFT JOIN delta ON cases.finding_id = 'SETTLEMENT_DELAY:' || delta.line_id GROUP BY residue_id""")
def _(s, d):
    return cl.ambiguity_rank(result(s, d)["residue"]).select("residue_id", "rank")


_RANKED = ORACLES["h10_ambiguity_rank"]


@query("h10_hardest_cases")
def _(s, d):
    return cl.ambiguity_rank(result(s, d)["residue"], limit=100).select("residue_id", "rank")


ORACLES["h10_hardest_cases"] = _RANKED + " ORDER BY rank DESC, residue_id LIMIT 100"


@query("h11_classification_summary", "SELECT 'cause' AS measure, cause AS key, count(*) AS n FROM verdict GROUP BY cause UNION ALL SELECT 'status', 'ok', count(*) FROM verdict UNION ALL SELECT 'gate_forced', 'false', count(*) FROM verdict UNION ALL SELECT 'review', CASE WHEN cause = 'INSUFFICIENT_EVIDENCE' THEN 'true' ELSE 'false' END, count(*) FROM verdict GROUP BY ALL")
def _(s, d):
    return cl.classification_summary(result(s, d)["records"])


# --- I: verification --------------------------------------------------------------------------------------------------


@query("i1_check_settlement_net", "SELECT CAST(count(*) = 0 AS BIGINT) AS passed, count(*) AS failures FROM g WHERE stated <> net")
def _(s, d):
    return vf.check_settlement_net(L.lines(s, d), L.labels(s, d)).select(F.col("passed").cast("bigint").alias("passed"), "failures")


_ONE_CREDIT = "SELECT * FROM tied WHERE (status = 'processed' AND (bank_rows <> 1 OR bank_credit <> stated)) OR (status <> 'processed' AND bank_rows <> 0)"


@query("i2_check_one_credit_per_batch", f"SELECT CAST(count(*) = 0 AS BIGINT) AS passed, count(*) AS failures FROM ({_ONE_CREDIT})")
def _(s, d):
    return vf.check_one_credit_per_batch(L.lines(s, d), L.bank(s, d)).select(F.col("passed").cast("bigint").alias("passed"), "failures")


@query("i3_check_running_balance", "SELECT CAST(count(*) = 0 AS BIGINT) AS passed, count(*) AS failures FROM bal WHERE day(value_date) = 7")
def _(s, d):
    off = L.bank(s, d).withColumn("running_balance_paise", F.col("running_balance_paise") + F.when(F.dayofmonth("value_date") == 7, 1).otherwise(0))  # planted
    return vf.check_running_balance(off, ["value_date", "bank_txn_id"]).select(F.col("passed").cast("bigint").alias("passed"), "failures")


@query("i4_check_label_count", "SELECT CAST(count(*) = 100 AS BIGINT) AS passed, CAST(count(*) <> 100 AS BIGINT) AS failures, CASE WHEN count(*) = 100 THEN '' ELSE CAST(count(*) AS VARCHAR) END AS detail FROM lab")
def _(s, d):
    return vf.check_label_count(L.labels(s, d), 100).select(F.col("passed").cast("bigint").alias("passed"), "failures", "detail")


@query("i5_check_label_integrity", "SELECT CAST(count(*) = 0 AS BIGINT) AS passed, count(*) AS failures FROM lab WHERE record_type IN ('bank_txn', 'settlement_line')")
def _(s, d):
    lab = L.labels(s, d)
    twice = lab.where("record_type = 'bank_txn'")  # planted: these a second time, and chargebacks under ids that no record has
    astray = lab.withColumn("record_id", F.when(F.col("record_type") == "settlement_line", F.concat("record_id", F.lit("_lost"))).otherwise(F.col("record_id")))
    return vf.check_label_integrity(astray.unionByName(twice), *ledger(s, d)).select(F.col("passed").cast("bigint").alias("passed"), "failures")


@query("i6_check_label_leak", """, told AS (
  SELECT CASE WHEN key % 2 = 0 THEN 'xplanted on order_dup_' || key || '9 too' ELSE 'planted on order_dup' END AS cell FROM base WHERE status = 'paid' AND key % 97 = 0
) SELECT CAST(count(*) = 0 AS BIGINT) AS passed, count(*) AS failures FROM told WHERE EXISTS (SELECT 1 FROM lab WHERE contains(told.cell, 'planted on ' || lab.record_id))""")
def _(s, d):
    raw, key = L.raw_orders(s, d), F.regexp_extract("order_id", r"(\d+)\s*$", 1)
    # planted in the currency of twins: a note with more letters before and after it, or not quite a note
    leak = F.when(key.cast("bigint") % 2 == 0, F.concat(F.lit("xplanted on order_dup_"), key, F.lit("9 too"))).otherwise(F.lit("planted on order_dup"))
    raw = raw.withColumn("currency", F.when(F.contains(F.lower("order_id"), F.lit("order_dup_")), leak).otherwise(F.col("currency")))
    return vf.check_label_leak(L.labels(s, d), orders=raw, settlement_report=L.raw_lines(s, d), bank_statement=L.raw_bank(s, d)).select(F.col("passed").cast("bigint").alias("passed"), "failures")


_LATE = """SELECT 'orders' AS source, count(*) AS n FROM (SELECT o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS bad FROM orders) WHERE bad
  UNION ALL SELECT 'settlement_report', count(*) FROM (SELECT settled < lag(settled) OVER (ORDER BY entity_id) AS bad FROM ln) WHERE bad
  UNION ALL SELECT 'bank_statement', count(*) FROM (SELECT value_date < lag(value_date) OVER (ORDER BY bank_txn_id) AS bad FROM bk) WHERE bad"""


def _chronology(s, d, lines: DataFrame, bank: DataFrame) -> list[DataFrame]:
    o = s.read.parquet(f"{d}/orders.parquet")
    return [vf.check_chronological(*x) for x in (("orders", o, "o_orderdate", "o_orderkey"), ("settlement_report", lines, "settled_at", "entity_id"), ("bank_statement", bank, "value_date", "bank_txn_id"))]


@query("i7_check_chronological", f"SELECT source, CAST(n = 0 AS BIGINT) AS passed, n AS failures FROM ({_LATE})")
def _(s, d):
    parts = _chronology(s, d, L.lines(s, d), L.bank(s, d))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(F.split("check", " ")[0].alias("source"), F.col("passed").cast("bigint").alias("passed"), "failures")


@query("i8_check_integer_money", "SELECT CAST(sum(n) = 0 AS BIGINT) AS passed, CAST(sum(n) AS BIGINT) AS failures FROM (SELECT count(*) AS n FROM o WHERE amount % 11 = 0 UNION ALL SELECT count(*) FROM ln WHERE fee % 13 = 0)")
def _(s, d):
    off = lambda k, n: F.when(F.col(k).cast("bigint") % n == 0, F.concat(k, F.lit(".5"))).otherwise(F.col(k))  # noqa: E731  planted
    raw, lines = L.raw_orders(s, d), L.raw_lines(s, d)
    return vf.check_integer_money(orders=raw.withColumn("amount_paise", off("amount_paise", 11)), settlement_report=lines.withColumn("fee_paise", off("fee_paise", 13))).select(F.col("passed").cast("bigint").alias("passed"), "failures")


_OFF = f"SELECT entity_id, settlement_id, fee + tax - {_FEE} - ({_FEE} * 18 + 50) // 100 AS delta FROM ln WHERE type = 'payment' AND fee + tax <> {_FEE} + ({_FEE} * 18 + 50) // 100"


_REBUILT = f"""SELECT count(*) AS n FROM g WHERE stated <> net
  UNION ALL SELECT count(*) FROM ({_OFF}) WHERE entity_id NOT IN (SELECT record_id FROM lab WHERE true_cause = 'FEE_VARIANCE')
  UNION ALL SELECT count(*) FROM lab WHERE true_cause = 'FEE_VARIANCE' AND record_id NOT IN (SELECT entity_id FROM ({_OFF}))"""


@query("i9_check_fee_reconstruction", f"SELECT CAST(sum(n) = 0 AS BIGINT) AS passed, CAST(sum(n) AS BIGINT) AS failures FROM ({_REBUILT})")
def _(s, d):
    return vf.check_fee_reconstruction(L.lines(s, d), L.labels(s, d)).select(F.col("passed").cast("bigint").alias("passed"), "failures")


_DETECTED = f"""
  SELECT 'LATE_SETTLEMENT' AS cause, entity_id AS record_id FROM pj WHERE known AND epoch(settled) - epoch(created) > 302400
  UNION SELECT 'PARTIAL_CAPTURE', entity_id FROM pj WHERE amount < ordered
  UNION SELECT 'SILENT_UPI_FAIL', order_id FROM pj WHERE order_status = 'pending'
  UNION SELECT 'FEE_VARIANCE', entity_id FROM ({_OFF})
  UNION SELECT 'CHARGEBACK_DEBIT', entity_id FROM ln WHERE type = 'adjustment'
  UNION SELECT 'REFUND_NETTED', entity_id FROM oref
  UNION SELECT 'ON_HOLD', settlement_id FROM g WHERE status = 'on_hold'
  UNION SELECT 'UNEXPLAINED', bank_txn_id FROM ghost
  UNION SELECT 'DUPLICATE_WEBHOOK', order_id FROM seen WHERE status = 'paid' AND line_id IS NULL AND group_id IS NOT NULL"""


@query("i10_detect_defects", _DETECTED)
def _(s, d):
    return vf.detect_defects(*ledger(s, d))


@query("i11_defect_conformance", f"""SELECT cause, CAST(sum(t) AS BIGINT) AS labelled, CAST(sum(f) AS BIGINT) AS detected, CAST(sum(t * f) AS BIGINT) AS recalled, CAST(sum(t * (1 - f)) AS BIGINT) AS missed, CAST(sum((1 - t) * f) AS BIGINT) AS extra FROM (
  SELECT coalesce(l.true_cause, x.cause) AS cause, CAST(l.record_id IS NOT NULL AS INTEGER) AS t, CAST(x.record_id IS NOT NULL AS INTEGER) AS f FROM lab l FULL JOIN ({_DETECTED}) x ON x.cause = l.true_cause AND x.record_id = l.record_id) GROUP BY cause""")
def _(s, d):
    return vf.defect_conformance(vf.detect_defects(*ledger(s, d)), L.labels(s, d))


_CONFORM = f"""SELECT cause, CAST(sum(t) AS BIGINT) AS labelled, CAST(sum(f) AS BIGINT) AS detected, CAST(sum(t * f) AS BIGINT) AS recalled, CAST(sum(t * (1 - f)) AS BIGINT) AS missed, CAST(sum((1 - t) * f) AS BIGINT) AS extra FROM (
  SELECT coalesce(l.true_cause, x.cause) AS cause, CAST(l.record_id IS NOT NULL AS INTEGER) AS t, CAST(x.record_id IS NOT NULL AS INTEGER) AS f FROM lab l FULL JOIN ({_DETECTED}) x ON x.cause = l.true_cause AND x.record_id = l.record_id) GROUP BY cause"""


_REPORT = f"""SELECT 'every defect shows exactly as its cause says' AS "check", CAST(coalesce(sum(CAST(missed > 0 AS BIGINT) + CAST(extra > 0 AS BIGINT)), 0) AS BIGINT) AS n FROM ({_CONFORM})
  UNION ALL SELECT 'settlement net is credits less debits' AS "check", count(*) AS n FROM g WHERE stated <> net
  UNION ALL SELECT 'a processed batch has exactly one equal bank credit, a held one none', count(*) FROM ({_ONE_CREDIT})
  UNION ALL SELECT 'the running balance adds up', count(*) FROM (SELECT balance, 25000000 + sum(credit) OVER (ORDER BY bank_txn_id ROWS UNBOUNDED PRECEDING) AS b FROM bal) WHERE balance <> b
  UNION ALL SELECT 'there are as many labels as expected', CAST(count(*) <> 100 AS BIGINT) FROM lab
  UNION ALL SELECT 'every label names one record and no record has two', (SELECT count(*) FROM lab WHERE record_id NOT IN (SELECT order_id FROM o UNION SELECT entity_id FROM ln UNION SELECT settlement_id FROM ln UNION SELECT bank_txn_id FROM bk)) + (SELECT count(*) FROM (SELECT 1 FROM lab GROUP BY record_type, record_id HAVING count(*) > 1))
  UNION ALL SELECT 'nothing of the labels is in the sources', (SELECT count(*) FROM o WHERE contains(order_id || status, 'planted on ')) + (SELECT count(*) FROM ln WHERE contains(entity_id || type || utr, 'planted on ')) + (SELECT count(*) FROM bk WHERE contains(bank_txn_id || description, 'planted on '))
  UNION ALL SELECT source || ' is in order of time', n FROM ({_LATE})
  UNION ALL SELECT 'every amount is a whole number of paise', (SELECT count(*) FROM o WHERE amount IS NULL) + (SELECT count(*) FROM ln WHERE amount IS NULL OR fee IS NULL)
  UNION ALL SELECT 'nets rebuild from the fee slabs', CAST(sum(n) AS BIGINT) FROM ({_REBUILT})"""


@query("i11_conformance_check", f"""SELECT "check", CAST(n = 0 AS BIGINT) AS passed, n AS failures, coalesce((SELECT min(t) FROM (SELECT CASE WHEN missed > 0 THEN cause || ': ' || missed || ' labels don''t show' END AS t FROM ({_CONFORM}) UNION ALL SELECT CASE WHEN extra > 0 THEN cause || ': ' || extra || ' records without a label look defective' END FROM ({_CONFORM}))), '') AS detail
  FROM ({_REPORT}) WHERE "check" = 'every defect shows exactly as its cause says'""")
def _(s, d):
    return vf.check_conformance(vf.detect_defects(*ledger(s, d)), L.labels(s, d)).withColumn("passed", F.col("passed").cast("bigint"))


@query("i12_verification_report", f"""SELECT "check", CAST(n = 0 AS BIGINT) AS passed, n AS failures FROM ({_REPORT}) UNION ALL SELECT 'all', CAST(sum(n) = 0 AS BIGINT), CAST(sum(n) AS BIGINT) FROM ({_REPORT})""")
def _(s, d):
    with tidy(s):
        o, li, b, lab = L.tables(s, d)
        raw = {"orders": L.raw_orders(s, d, o), "settlement_report": L.raw_lines(s, d, li)}
        checks = [vf.check_settlement_net(li, lab), vf.check_one_credit_per_batch(li, b), vf.check_running_balance(b, ["value_date", "bank_txn_id"]), vf.check_label_count(lab, 100), vf.check_label_integrity(lab, o, li, b)]
        checks += [vf.check_label_leak(lab, **raw, bank_statement=L.raw_bank(s, d, b)), *_chronology(s, d, li, b), vf.check_integer_money(**raw), vf.check_fee_reconstruction(li, lab), vf.check_conformance(vf.detect_defects(o, li, b), lab)]
        report = vf.verification_report(*checks).select("check", F.col("passed").cast("bigint").alias("passed"), "failures")
        discard(o, li, b, lab)
        return report


# --- J, K: scoring ----------------------------------------------------------------------------------------------------

_OUTCOME = "SELECT record_id, true_cause, CASE WHEN record_id IN (SELECT id FROM re) THEN 'captured' WHEN record_id IN (SELECT id FROM mid) THEN 'falsely_matched' WHEN record_id IN (SELECT order_id FROM excl) THEN 'excluded' ELSE 'unaccounted' END AS outcome FROM lab"


@query("j1_label_outcome", _OUTCOME)
def _(s, d):
    return sc.label_outcome(result(s, d)["labels"], result(s, d))


@query("j2_capture_by_cause", f"SELECT true_cause, count(*) AS labelled, CAST(sum(CASE WHEN outcome = 'captured' THEN 1 ELSE 0 END) AS BIGINT) AS captured FROM ({_OUTCOME}) GROUP BY true_cause")
def _(s, d):
    return sc.capture_by_cause(sc.label_outcome(result(s, d)["labels"], result(s, d)))


@query("j3_clean_match_rate", "SELECT m AS clean_matched, r AS clean_residue, round(m / (m + r), 4) AS rate FROM (SELECT (SELECT count(*) FROM mid WHERE id NOT IN (SELECT record_id FROM lab)) AS m, (SELECT count(DISTINCT id) FROM re WHERE id NOT IN (SELECT record_id FROM lab) AND id NOT IN (SELECT id FROM mid)) AS r)")
def _(s, d):
    return sc.clean_match_rate(result(s, d)["labels"], result(s, d))


@query("j4_residue_precision", 'SELECT n AS entries, w AS with_defect, round(w / n, 4) AS "precision" FROM (SELECT count(DISTINCT residue_id) AS n, count(DISTINCT CASE WHEN id IN (SELECT record_id FROM lab) THEN residue_id END) AS w FROM re)')
def _(s, d):
    return sc.residue_precision(result(s, d)["labels"], result(s, d))


_CROSS = ", ".join(f"CAST(sum(CASE WHEN cause = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{x}\"" for x in [*CAUSES, "noise"])


@query("j5_finding_cause_crosstab", f"SELECT code, {_CROSS} FROM (SELECT DISTINCT finding_id, code, true_cause AS cause FROM fe JOIN lab ON record_id = id UNION ALL SELECT DISTINCT finding_id, code, 'noise' FROM fe WHERE finding_id NOT IN (SELECT finding_id FROM fe JOIN lab ON record_id = id)) GROUP BY code")
def _(s, d):
    return sc.finding_cause_crosstab(result(s, d)["labels"], result(s, d))


@query("j6_findings_never_fired", "SELECT code FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in [*CODES, "NOT_A_CODE"]) + "]) AS code) WHERE code NOT IN (SELECT code FROM fe)")
def _(s, d):
    return sc.findings_never_fired(result(s, d)["findings"], [*CODES, "NOT_A_CODE"])


def _observed(s, d):
    r = result(s, d)
    return sc.observations(r["residue_entities"], r["labels"], r["records"])


@query("k1_observations", "SELECT residue_id, gold, predicted, CAST(auto AS BIGINT) AS auto_approved, CAST(correct AS BIGINT) AS correct FROM ob")
def _(s, d):
    return _observed(s, d).select("residue_id", "gold", "predicted", F.col("auto_approved").cast("bigint").alias("auto_approved"), F.col("correct").cast("bigint").alias("correct"))


@query("k2_accuracy_headline", "SELECT count(*) FILTER (WHERE correct) AS correct, count(DISTINCT residue_id) AS ceiling, (SELECT count(*) FROM lab) AS total, (SELECT count(*) FROM (SELECT residue_id FROM ob WHERE gold <> '(no defect)' GROUP BY residue_id HAVING count(*) > 1)) AS multi_defect_entries, CAST(0 AS BIGINT) AS unclassified_entries FROM ob WHERE gold <> '(no defect)'")
def _(s, d):
    return sc.accuracy_headline(_observed(s, d), result(s, d)["labels"], result(s, d)["residue"])


@query("k3_auto_approval_exposure", "SELECT count(*) AS auto_approved, CAST(sum(amount) AS BIGINT) AS exposure_paise, count(*) FILTER (WHERE NOT ok) AS wrong, CAST(coalesce(sum(amount) FILTER (WHERE NOT ok), 0) AS BIGINT) AS wrong_exposure_paise FROM (SELECT residue_id, bool_or(correct) AS ok, coalesce(any_value(s.amount), 0) AS amount FROM ob JOIN said s USING (residue_id) WHERE auto GROUP BY residue_id)")
def _(s, d):
    r = result(s, d)
    return sc.auto_approval_exposure(r["residue_entities"], r["labels"], r["records"])[0]


@query("k4_gate_split", "SELECT CASE WHEN auto THEN 'auto' ELSE 'review' END AS bucket, count(DISTINCT residue_id) AS entries, count(*) AS defects, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct) / count(*), 4) AS accuracy FROM ob WHERE gold <> '(no defect)' GROUP BY auto")
def _(s, d):
    return sc.gate_split(_observed(s, d))


@query("k5_precision_recall_f1", "SELECT class, a AS actual, p AS predicted, t AS correct, CASE WHEN p > 0 THEN round(t / p, 4) END AS \"precision\", CASE WHEN a > 0 THEN round(t / a, 4) END AS recall, CASE WHEN p > 0 AND a > 0 AND t > 0 THEN round(2 * (t / p) * (t / a) / (t / p + t / a), 4) END AS f1 FROM (SELECT class, (SELECT count(*) FROM ob WHERE gold = class) AS a, (SELECT count(*) FROM ob WHERE predicted = class) AS p, (SELECT count(*) FROM ob WHERE predicted = class AND gold = class) AS t FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in [*CAUSES, INSUFFICIENT]) + "]) AS class))")
def _(s, d):
    return sc.precision_recall_f1(_observed(s, d))


@query("k6_noise_breakdown", f"SELECT predicted, count(*) AS entries, count(*) FILTER (WHERE NOT auto) AS review, round(avg(CAST({_CONF.replace('v.cause', 'predicted').replace('v.', '')} AS DOUBLE)), 4) AS mean_confidence FROM ob WHERE gold = '(no defect)' GROUP BY predicted")
def _(s, d):
    return sc.noise_breakdown(_observed(s, d))


_CONFUSE = ", ".join(f"count(*) FILTER (WHERE predicted = '{x}') AS \"{x}\"" for x in [*CAUSES, INSUFFICIENT])


@query("k7_confusion_matrix", f"SELECT gold, {_CONFUSE}, count(*) AS total FROM ob GROUP BY gold")
def _(s, d):
    return sc.confusion_matrix(_observed(s, d))


# --- L: review --------------------------------------------------------------------------------------------------------


@query("l1_review_queue", "SELECT residue_id, cause AS predicted_cause, CASE WHEN cause = 'INSUFFICIENT_EVIDENCE' THEN 'review' ELSE 'auto' END AS bucket FROM verdict")
def _(s, d):
    return rv.review_queue(result(s, d)["residue"], result(s, d)["records"]).select("residue_id", "predicted_cause", "bucket")


@query("l1_review_first", "SELECT residue_id, CASE WHEN cause = 'INSUFFICIENT_EVIDENCE' THEN 'review' ELSE 'auto' END AS bucket, amount AS proposed_amount_paise FROM said WHERE cause <> 'INSUFFICIENT_EVIDENCE' ORDER BY coalesce(amount, 0) DESC, residue_id LIMIT 100")
def _(s, d):
    queue = rv.review_queue(result(s, d)["residue"], result(s, d)["records"])
    return rv.filter_bucket(queue, "auto").limit(100).select("residue_id", "bucket", "proposed_amount_paise")


def _decisions(s, d) -> DataFrame:
    """Decisions made up from the cases by their ids, some of them not allowed."""
    q = result(s, d)["residue"].select("residue_id")
    h = F.substring("residue_id", 5, 1)
    action = F.when(h < "4", "approve").when(h < "8", "reject").when(h < "c", "reclassify").otherwise("maybe")
    cause = F.when(h == "8", "NOT_A_CAUSE").when(h < "c", "ON_HOLD")
    one = q.select("residue_id", action.alias("action"), cause.alias("final_cause"), F.lit(" ").alias("reviewer_note"), F.lit("2025-01-01T00:00:00Z").alias("timestamp"))
    return one.unionByName(one.where(h < "2").withColumn("action", F.lit("reject")).withColumn("timestamp", F.lit("2025-01-02T00:00:00Z")))


_H = "substr(residue_id, 5, 1)"
_FINAL = f"CASE WHEN {_H} < '4' THEN cause WHEN {_H} < '8' THEN 'REJECTED' ELSE 'ON_HOLD' END"


@query("l2_review_summary", f"SELECT count(*) FILTER (WHERE cause = 'INSUFFICIENT_EVIDENCE') AS review_count, count(*) FILTER (WHERE cause <> 'INSUFFICIENT_EVIDENCE') AS auto_count, count(*) FILTER (WHERE {_H} < 'c' AND {_H} <> '8') AS decided_count, count(*) AS residue_count, (SELECT CAST(sum(value_paise) AS BIGINT) FROM val) AS residue_value_paise FROM verdict")
def _(s, d):
    r = result(s, d)
    q = rv.review_queue(r["residue"], r["records"])
    return rv.review_summary(q, rv.apply_decisions(q, _decisions(s, d))[0], r["metrics"]).select("review_count", "auto_count", "decided_count", "residue_count", "residue_value_paise")


@query("l3_apply_decisions", f"SELECT residue_id, '2025-01-01T00:00:00Z' AS timestamp, cause AS original_prediction, {_FINAL} AS final_cause FROM verdict WHERE {_H} < 'c' AND {_H} <> '8' UNION ALL SELECT residue_id, '2025-01-02T00:00:00Z', cause, 'REJECTED' FROM verdict WHERE {_H} < '2'")
def _(s, d):
    r = result(s, d)
    return rv.apply_decisions(rv.review_queue(r["residue"], r["records"]), _decisions(s, d))[0].select("residue_id", "timestamp", "original_prediction", "final_cause")


@query("l3_rejected_decisions", f"SELECT residue_id, CASE WHEN {_H} = '8' THEN 'unknown final_cause' ELSE 'unknown action' END AS reason, CAST(400 AS BIGINT) AS status FROM verdict WHERE {_H} = '8' OR {_H} >= 'c'")
def _(s, d):
    r = result(s, d)
    return rv.apply_decisions(rv.review_queue(r["residue"], r["records"]), _decisions(s, d))[1].select("residue_id", "reason", "status")


@query("l4_latest_decision", f"SELECT residue_id, CASE WHEN {_H} < '2' THEN 'REJECTED' ELSE {_FINAL} END AS final_cause FROM verdict WHERE {_H} < 'c' AND {_H} <> '8'")
def _(s, d):
    r = result(s, d)
    return rv.latest_decision(rv.apply_decisions(rv.review_queue(r["residue"], r["records"]), _decisions(s, d))[0]).select("residue_id", "final_cause")


@query("l5_filter_bucket", "SELECT residue_id FROM verdict WHERE cause <> 'INSUFFICIENT_EVIDENCE'")
def _(s, d):
    r = result(s, d)
    return rv.filter_bucket(rv.review_queue(r["residue"], r["records"]), "auto").select("residue_id")


# --- M: building settlements -----------------------------------------------------------------------------------------


def _payments(s, d) -> DataFrame:
    li = L.lines(s, d).where("type = 'payment'")
    return li.select("payment_id", "order_id", "amount_paise", "method", F.col("settled_at").alias("captured_at"))


@query("m1_expected_payment_lines", f"SELECT entity_id, amount - {_FEE} - ({_FEE} * 18 + 50) // 100 AS credit_paise, {_FEE} AS fee_paise, ({_FEE} * 18 + 50) // 100 AS tax_paise, strftime(settled + INTERVAL 2 DAY, '%Y-%m-%d') AS settle_day FROM ln WHERE type = 'payment'")
def _(s, d):
    return se.expected_payment_lines(_payments(s, d)).select("entity_id", "credit_paise", "fee_paise", "tax_paise", "settle_day")


@query("m2_assign_debits_to_batch", """, days AS (SELECT DISTINCT CAST(settled AS DATE) AS day FROM ln WHERE type = 'payment' AND date_diff('day', DATE '1970-01-01', CAST(settled AS DATE)) % 40 = 0)
  SELECT entity_id, strftime(coalesce((SELECT min(day) FROM days WHERE day >= CAST(ln.settled AS DATE)), (SELECT max(day) FROM days)), '%Y-%m-%d') AS batch_day FROM ln WHERE type <> 'payment'""")
def _(s, d):
    li = L.lines(s, d)
    day = F.to_date("settled_at")
    days = li.where("type = 'payment'").select(day.alias("batch_day")).distinct().where(F.datediff("batch_day", F.lit("1970-01-01").cast("date")) % 40 == 0)
    return se.assign_debits_to_batch(li.where("type != 'payment'").select("entity_id", day.alias("due_day")), days).select("entity_id", "batch_day")


@query("m3_settlement_headers", "SELECT settlement_id, net AS net_amount_paise, sfee AS fee_paise, stax AS tax_paise FROM h")
def _(s, d):
    return se.settlement_headers(L.bare_lines(s, d))


@query("m4_debit_cap", "SELECT greatest(gross // 2, 10000) AS cap_paise FROM (SELECT CAST(sum(amount) AS BIGINT) AS gross, row_number() OVER (ORDER BY sum(amount), settled) AS n, count(*) OVER () AS total FROM ln WHERE type = 'payment' GROUP BY settled) WHERE n = (total + 1) // 2")
def _(s, d):
    return se.debit_cap(se.expected_payment_lines(_payments(s, d)))


@query("m5_settlement_report", "SELECT entity_id, settlement_id, net AS settlement_net_amount_paise, sfee AS settlement_fee_paise, stax AS settlement_tax_paise FROM bare JOIN h USING (settlement_id)")
def _(s, d):
    bare = L.bare_lines(s, d)
    return se.settlement_report(bare, se.settlement_headers(bare)).select("entity_id", "settlement_id", "settlement_net_amount_paise", "settlement_fee_paise", "settlement_tax_paise")


@query("m6_bank_statement", "SELECT 'txn' || utr AS bank_txn_id, strftime(settled, '%Y-%m-%d') AS value_date, net AS credit_paise, CAST(25000000 + sum(net) OVER (ORDER BY settled, utr ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_balance_paise, strftime(settled, '%d/%m/%Y') AS value_date_text FROM g WHERE status = 'processed'")
def _(s, d):
    h = L.headers(L.bare_lines(s, d)).select("settlement_id", F.col("settlement_utr").alias("utr"), F.col("settlement_status").alias("status"), F.to_date("settled_at").alias("day"), F.col("net").alias("net_amount_paise"))
    return se.bank_statement(h).select("bank_txn_id", "value_date", "credit_paise", "running_balance_paise", "value_date_text")
