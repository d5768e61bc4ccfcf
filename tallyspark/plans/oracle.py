"""SQL restatements of the ledger views and stage results, for an engine that isn't Spark."""

from __future__ import annotations

#: Common table expressions, each using those before it. Timestamps are rendered as text at the end of a query.
BASE = r"""
base AS (
  SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderdate AS created,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN 'paid' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'cancelled' END AS status
  FROM orders
), o AS (
  SELECT 'order_' || key AS order_id, amount, created, status FROM base
  UNION ALL SELECT 'order_dup_' || key, amount, created + INTERVAL 45 SECOND, status FROM base WHERE status = 'paid' AND key % 97 = 0
), item AS (
  SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth,
    l_returnflag AS flag, CAST(round(l_extendedprice * 100) AS BIGINT) AS paise, CAST(l_shipdate AS DATE) AS ship
  FROM lineitem
), l0 AS (
  SELECT b.key, b.amount, b.created, i.paise, i.ship,
    CASE WHEN nth = 1 AND (status = 'paid' OR b.key % 29 = 0) THEN 'payment'
         WHEN nth = 2 AND flag = 'R' AND (status = 'paid' OR b.key % 29 = 0) THEN 'refund'
         WHEN nth = 3 AND flag = 'A' AND b.key % 11 = 0 THEN 'adjustment' END AS type,
    CASE b.key % 4 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' WHEN 2 THEN 'netbanking' ELSE 'wallet' END AS m,
    CASE b.key % 4 WHEN 0 THEN 0 WHEN 1 THEN 200 WHEN 2 THEN 180 ELSE 220 END AS bp
  FROM item i JOIN base b ON b.key = i.key WHERE nth <= 3
), l1 AS (
  SELECT *, CASE WHEN type = 'payment' THEN CASE WHEN key % 37 = 0 THEN amount * 80 // 100 ELSE amount END ELSE paise END AS gross FROM l0 WHERE type IS NOT NULL
), l2 AS (
  SELECT *, CASE WHEN type <> 'payment' THEN 0 WHEN key % 41 = 0 THEN (gross * (bp + 40) + 5000) // 10000 ELSE (gross * bp + 5000) // 10000 END AS fee FROM l1
), l3 AS (
  SELECT *, (fee * 18 + 50) // 100 AS tax,
    CASE WHEN type = 'payment' THEN CAST(created AS DATE) + CAST(2 + CASE WHEN key % 43 = 0 THEN 3 ELSE 0 END + CASE WHEN key % 31 = 0 THEN 1 ELSE 0 END AS INTEGER) ELSE ship END AS day FROM l2
), bare AS (
  SELECT key, CASE type WHEN 'payment' THEN 'pay_' WHEN 'refund' THEN 'rfnd_' ELSE 'adj_' END || key AS entity_id, type,
    CASE WHEN type = 'payment' AND key % 101 = 0 THEN 'order_unknown_' || key WHEN type <> 'adjustment' THEN 'order_' || key END AS order_id,
    CASE WHEN type = 'payment' THEN 'pay_' || key WHEN type = 'refund' AND key % 53 = 0 THEN 'pay_prior_' || key WHEN type = 'refund' THEN 'pay_' || key END AS payment_id,
    CASE WHEN type = 'payment' THEN m END AS method, bp,
    CASE WHEN type = 'payment' THEN 0 ELSE gross END AS debit, CASE WHEN type = 'payment' THEN gross - fee - tax ELSE 0 END AS credit,
    gross AS amount, fee, tax, 'setl_' || strftime(day, '%Y%m%d') AS settlement_id, CAST(day AS TIMESTAMP) AS settled
  FROM l3
), h AS (
  SELECT settlement_id, settled, CAST(sum(credit - debit) AS BIGINT) AS net, CAST(sum(fee) AS BIGINT) AS sfee, CAST(sum(tax) AS BIGINT) AS stax, CAST(count(*) AS BIGINT) AS line_count,
    date_diff('day', DATE '1970-01-01', CAST(settled AS DATE)) AS d, '2025' || strftime(settled, '%Y%m%d') AS utr
  FROM bare GROUP BY settlement_id, settled
), g AS (
  SELECT *, CASE WHEN d % 17 = 0 THEN 'on_hold' ELSE 'processed' END AS status, net + CASE WHEN d % 59 = 0 THEN 7 ELSE 0 END AS stated FROM h
), ln AS (
  SELECT b.*, g.utr, g.status AS settlement_status, g.stated, g.sfee, g.stax FROM bare b JOIN g USING (settlement_id)
), bk0 AS (
  SELECT settled, d, 1 AS n, utr, net + CASE WHEN status <> 'on_hold' AND d % 23 = 0 THEN 3 WHEN status <> 'on_hold' AND d % 19 = 0 THEN 1 ELSE 0 END AS credit
  FROM g WHERE (status <> 'on_hold' AND d % 47 <> 0) OR (status = 'on_hold' AND d % 85 = 0)
  UNION ALL SELECT settled, d, 2, '9999' || strftime(settled, '%Y%m%d'), net + 100 FROM g WHERE d % 29 = 0
), bk AS (
  SELECT 'txn' || strftime(settled, '%Y%m%d') || lpad(CAST(n AS VARCHAR), 4, '0') AS bank_txn_id, CAST(settled AS DATE) AS value_date, utr, credit,
    CASE d % 4 WHEN 0 THEN 'RAZORPAY SETTLEMENT ' || utr WHEN 1 THEN 'NEFT CR-' || utr || '-RAZORPAY SOFTWARE PVT LTD' WHEN 2 THEN 'IMPS/' || utr || '/RAZORPAYSOFT' ELSE 'TRANSFER REF ' || utr || ' OK' END AS description,
    CASE d % 4 WHEN 0 THEN 'RAZORPAY_SETTLEMENT' WHEN 1 THEN 'NEFT_CR' WHEN 2 THEN 'IMPS' ELSE 'UNKNOWN_FORMAT' END AS format
  FROM bk0
), bal AS (
  SELECT *, CAST(25000000 + sum(credit) OVER (ORDER BY value_date, bank_txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM bk
), pl AS (
  SELECT order_id, max_by(entity_id, (settled, settlement_id, entity_id)) AS line_id, max_by(amount, (settled, settlement_id, entity_id)) AS settled_amount,
    max_by(settlement_id, (settled, settlement_id, entity_id)) AS settlement_id, max_by(method, (settled, settlement_id, entity_id)) AS method, max(settled) AS settled
  FROM ln WHERE type = 'payment' AND order_id IS NOT NULL GROUP BY order_id
), gap AS (
  SELECT *, CASE WHEN epoch(created) - epoch(lag(created) OVER w) <= 90 THEN 0 ELSE 1 END AS brk FROM o WINDOW w AS (PARTITION BY amount ORDER BY created, order_id)
), run AS (
  SELECT *, sum(brk) OVER (PARTITION BY amount ORDER BY created, order_id ROWS UNBOUNDED PRECEDING) AS r FROM gap
), dup AS (
  SELECT *, min(order_id) OVER (PARTITION BY amount, r) AS group_id FROM run QUALIFY count(*) OVER (PARTITION BY amount, r) > 1
), seen AS (
  SELECT o.order_id, o.amount, o.created, o.status, pl.line_id, pl.settled_amount, pl.settlement_id, pl.settled, pl.method, dup.group_id
  FROM o LEFT JOIN pl USING (order_id) LEFT JOIN dup USING (order_id)
), pj AS (
  SELECT ln.*, o.amount AS ordered, o.created, o.status AS order_status, o.order_id IS NOT NULL AS known FROM ln LEFT JOIN o USING (order_id) WHERE type = 'payment'
), oref AS (
  SELECT * FROM ln WHERE type = 'refund' AND payment_id NOT IN (SELECT entity_id FROM ln WHERE type = 'payment')
), tied AS (
  SELECT g.*, f.bank_txn_id, f.credit AS bank_credit, coalesce(f.n, 0) AS bank_rows FROM g
  LEFT JOIN (SELECT utr, min(bank_txn_id) AS bank_txn_id, min_by(credit, bank_txn_id) AS credit, count(*) AS n FROM bk GROUP BY utr) f USING (utr)
), rec AS (
  SELECT settlement_id, bank_txn_id, net FROM tied WHERE status <> 'on_hold' AND bank_txn_id IS NOT NULL AND abs(bank_credit - net) <= 1 AND stated = net
), ghost AS (
  SELECT * FROM bk WHERE utr NOT IN (SELECT utr FROM g)
), delta AS (
  SELECT order_id, entity_id AS line_id, date_diff('day', CAST(created AS DATE), CAST(settled AS DATE)) AS day_delta, created, settled, settlement_id, amount, method FROM pj WHERE known
), failed AS (
  SELECT settlement_id, bank_txn_id, CASE WHEN status = 'on_hold' THEN CASE WHEN bank_txn_id IS NULL THEN 'SETTLEMENT_ON_HOLD' ELSE 'UNEXPECTED_BANK_CREDIT_ON_HOLD' END WHEN bank_txn_id IS NULL THEN 'SETTLEMENT_WITHOUT_BANK_CREDIT' ELSE 'NET_MISMATCH' END AS code
  FROM tied WHERE settlement_id NOT IN (SELECT settlement_id FROM rec)
), fe AS (
  SELECT 'DUPLICATE_ORDER_PAIR:' || group_id AS finding_id, 'DUPLICATE_ORDER_PAIR' AS code, 'order' AS kind, order_id AS id, order_id <> group_id AS tail FROM seen WHERE group_id IS NOT NULL
  UNION ALL SELECT 'DUPLICATE_ORDER_PAIR:' || group_id, 'DUPLICATE_ORDER_PAIR', 'settlement_line', line_id, true FROM seen WHERE group_id IS NOT NULL AND line_id IS NOT NULL
  UNION ALL SELECT 'ORDER_WITHOUT_SETTLEMENT:' || order_id, 'ORDER_WITHOUT_SETTLEMENT', 'order', order_id, false FROM seen WHERE status = 'paid' AND line_id IS NULL
  UNION ALL SELECT 'ORDER_STATUS_CONTRADICTION:' || order_id, 'ORDER_STATUS_CONTRADICTION', unnest(['order', 'settlement_line']), unnest([order_id, line_id]), unnest([false, true]) FROM seen WHERE status <> 'paid' AND line_id IS NOT NULL AND group_id IS NULL
  UNION ALL SELECT 'ORPHAN_SETTLEMENT_LINE:' || entity_id, 'ORPHAN_SETTLEMENT_LINE', 'settlement_line', entity_id, false FROM (SELECT entity_id FROM ln WHERE type = 'adjustment' UNION ALL SELECT entity_id FROM oref UNION ALL SELECT entity_id FROM pj WHERE NOT known)
  UNION ALL SELECT 'SHORT_CAPTURE:' || entity_id, 'SHORT_CAPTURE', unnest(['order', 'settlement_line']), unnest([order_id, entity_id]), unnest([false, true]) FROM pj WHERE amount < ordered
  UNION ALL SELECT 'FEE_SLAB_MISMATCH:' || entity_id, 'FEE_SLAB_MISMATCH', unnest(['order', 'settlement_line']), unnest([order_id, entity_id]), unnest([false, true]) FROM pj WHERE known AND amount >= ordered AND (fee <> (amount * bp + 5000) // 10000 OR tax <> (((amount * bp + 5000) // 10000) * 18 + 50) // 100)
  UNION ALL SELECT code || ':' || settlement_id, code, 'settlement', settlement_id, false FROM failed
  UNION ALL SELECT code || ':' || settlement_id, code, 'bank_txn', bank_txn_id, true FROM failed WHERE bank_txn_id IS NOT NULL
  UNION ALL SELECT code || ':' || settlement_id, code, 'settlement_line', entity_id, true FROM failed JOIN ln USING (settlement_id)
  UNION ALL SELECT code || ':' || settlement_id, code, 'order', order_id, true FROM failed JOIN ln USING (settlement_id) WHERE type = 'payment' AND order_id IN (SELECT order_id FROM o)
  UNION ALL SELECT 'BANK_CREDIT_WITHOUT_SETTLEMENT:' || bank_txn_id, 'BANK_CREDIT_WITHOUT_SETTLEMENT', 'bank_txn', bank_txn_id, false FROM ghost
  UNION ALL SELECT 'SETTLEMENT_DELAY:' || line_id, 'SETTLEMENT_DELAY', unnest(['order', 'settlement_line']), unnest([order_id, line_id]), unnest([false, true]) FROM delta WHERE day_delta > 2
), owned AS (
  SELECT DISTINCT kind, id FROM fe
), matched AS (
  SELECT ln.*, rec.bank_txn_id, rec.net FROM ln JOIN rec USING (settlement_id)
  WHERE entity_id NOT IN (SELECT id FROM owned WHERE kind = 'settlement_line') AND NOT (type = 'payment' AND order_id IN (SELECT id FROM owned WHERE kind = 'order'))
), excl AS (
  SELECT order_id, status, amount FROM seen WHERE status <> 'paid' AND line_id IS NULL AND group_id IS NULL
), fkey AS (
  SELECT finding_id, code, kind || ':' || id AS k, min(CASE WHEN NOT tail THEN kind || ':' || id END) OVER (PARTITION BY finding_id) AS head FROM fe
), edge AS (
  SELECT DISTINCT head AS a, k AS b FROM fkey UNION SELECT DISTINCT k, head FROM fkey
), reach AS (
  SELECT DISTINCT k AS node, k AS c FROM fkey
  UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.node WHERE r.c < e.b
), comp AS (
  SELECT node, min(c) AS c FROM reach GROUP BY node
), cases AS (
  SELECT DISTINCT f.finding_id, f.code, 'res_' || substr(sha256(comp.c), 1, 16) AS residue_id FROM fkey f JOIN comp ON comp.node = f.head
), re AS (
  SELECT DISTINCT residue_id, kind, id FROM fe JOIN cases USING (finding_id)
), rea AS (
  SELECT re.*, coalesce(o.amount, ln.amount, bk.credit, g.net) AS amount FROM re
  LEFT JOIN o ON re.kind = 'order' AND o.order_id = re.id LEFT JOIN ln ON re.kind = 'settlement_line' AND ln.entity_id = re.id
  LEFT JOIN bk ON re.kind = 'bank_txn' AND bk.bank_txn_id = re.id LEFT JOIN g ON re.kind = 'settlement' AND g.settlement_id = re.id
), val AS (
  SELECT residue_id, CAST(CASE WHEN sum(CASE WHEN kind = 'settlement_line' THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN kind = 'settlement_line' THEN amount ELSE 0 END)
    ELSE sum(CASE WHEN kind IN ('bank_txn', 'order') THEN amount ELSE 0 END) END AS BIGINT) AS value_paise FROM rea GROUP BY residue_id
), verdict AS (
  SELECT residue_id, CASE
    WHEN bool_or(code IN ('SETTLEMENT_ON_HOLD', 'UNEXPECTED_BANK_CREDIT_ON_HOLD')) THEN 'ON_HOLD' WHEN bool_or(code = 'BANK_CREDIT_WITHOUT_SETTLEMENT') THEN 'UNEXPLAINED'
    WHEN bool_or(code = 'ORDER_STATUS_CONTRADICTION') THEN 'SILENT_UPI_FAIL' WHEN bool_or(code = 'SHORT_CAPTURE') THEN 'PARTIAL_CAPTURE' WHEN bool_or(code = 'FEE_SLAB_MISMATCH') THEN 'FEE_VARIANCE'
    WHEN bool_or(code = 'ORPHAN_SETTLEMENT_LINE') THEN CASE split_part(split_part(min(CASE WHEN code = 'ORPHAN_SETTLEMENT_LINE' THEN finding_id END), ':', 2), '_', 1) WHEN 'adj' THEN 'CHARGEBACK_DEBIT' WHEN 'rfnd' THEN 'REFUND_NETTED' ELSE 'INSUFFICIENT_EVIDENCE' END
    WHEN bool_or(code = 'DUPLICATE_ORDER_PAIR') THEN 'DUPLICATE_WEBHOOK'
    WHEN bool_or(code = 'SETTLEMENT_DELAY') THEN CASE WHEN min_by(day_delta, CASE WHEN code = 'SETTLEMENT_DELAY' THEN finding_id END) >= 4 THEN 'LATE_SETTLEMENT' ELSE 'INSUFFICIENT_EVIDENCE' END
    ELSE 'INSUFFICIENT_EVIDENCE' END AS cause,
    bool_or(code = 'ORPHAN_SETTLEMENT_LINE') AS orphan, bool_or(code = 'SETTLEMENT_DELAY') AS late, bool_or(code = 'ORDER_WITHOUT_SETTLEMENT') AS open,
    CASE WHEN bool_or(code IN ('ORPHAN_SETTLEMENT_LINE', 'SETTLEMENT_DELAY', 'ORDER_WITHOUT_SETTLEMENT')) THEN 0.3 ELSE 0.2 END AS unsure
  FROM cases LEFT JOIN delta ON cases.finding_id = 'SETTLEMENT_DELAY:' || delta.line_id GROUP BY residue_id
), amt AS (
  SELECT c.residue_id, coalesce(min_by(g.net, f.key) FILTER (WHERE c.code = 'SETTLEMENT_ON_HOLD'), min_by(g.net, f.key) FILTER (WHERE g.net IS NOT NULL)) AS held, max(bk.credit) AS ghost,
    min_by(p.ordered - p.amount, f.key) FILTER (WHERE c.code = 'SHORT_CAPTURE') AS short,
    min_by(p.fee + p.tax - (p.amount * p.bp + 5000) // 10000 - (((p.amount * p.bp + 5000) // 10000) * 18 + 50) // 100, f.key) FILTER (WHERE c.code = 'FEE_SLAB_MISMATCH') AS fee,
    min_by(l.debit, f.key) FILTER (WHERE c.code = 'ORPHAN_SETTLEMENT_LINE') AS debit
  FROM cases c JOIN (SELECT DISTINCT finding_id, split_part(finding_id, ':', 2) AS key FROM fe) f USING (finding_id)
  LEFT JOIN g ON g.settlement_id = f.key LEFT JOIN bk ON bk.bank_txn_id = f.key AND c.code = 'BANK_CREDIT_WITHOUT_SETTLEMENT' LEFT JOIN pj p ON p.entity_id = f.key LEFT JOIN ln l ON l.entity_id = f.key GROUP BY c.residue_id
), said AS (
  SELECT v.*, CAST(CASE v.cause WHEN 'ON_HOLD' THEN held WHEN 'UNEXPLAINED' THEN ghost WHEN 'PARTIAL_CAPTURE' THEN short WHEN 'FEE_VARIANCE' THEN fee WHEN 'CHARGEBACK_DEBIT' THEN debit END AS BIGINT) AS amount FROM verdict v JOIN amt USING (residue_id)
), lab AS (
  SELECT 'payment' AS record_type, entity_id AS record_id, CASE WHEN key % 37 = 0 THEN 'PARTIAL_CAPTURE' WHEN key % 41 = 0 THEN 'FEE_VARIANCE' ELSE 'LATE_SETTLEMENT' END AS true_cause
  FROM bare WHERE type = 'payment' AND key % 101 <> 0 AND (key % 37 = 0 OR key % 41 = 0 OR key % 43 = 0)
  UNION ALL SELECT 'refund', entity_id, 'REFUND_NETTED' FROM bare WHERE type = 'refund' AND key % 53 = 0
  UNION ALL SELECT 'settlement_line', entity_id, 'CHARGEBACK_DEBIT' FROM bare WHERE type = 'adjustment'
  UNION ALL SELECT 'order', 'order_dup_' || key, 'DUPLICATE_WEBHOOK' FROM base WHERE status = 'paid' AND key % 97 = 0
  UNION ALL SELECT 'order', 'order_' || key, 'SILENT_UPI_FAIL' FROM base WHERE status = 'pending' AND key % 29 = 0 AND key IN (SELECT key FROM bare WHERE type = 'payment' AND key % 101 <> 0)
  UNION ALL SELECT 'settlement', settlement_id, 'ON_HOLD' FROM g WHERE status = 'on_hold'
  UNION ALL SELECT 'bank_txn', bank_txn_id, 'UNEXPLAINED' FROM bk WHERE utr LIKE '9999%'
), mid AS (
  SELECT order_id AS id FROM matched WHERE type = 'payment' UNION SELECT entity_id FROM matched UNION SELECT settlement_id FROM rec UNION SELECT bank_txn_id FROM rec
), obs AS (
  SELECT c.residue_id, coalesce(t.true_cause, '(no defect)') AS gold, v.cause AS predicted, v.unsure, v.cause <> 'INSUFFICIENT_EVIDENCE' AS auto
  FROM (SELECT DISTINCT residue_id FROM re) c LEFT JOIN (SELECT residue_id, true_cause FROM re JOIN lab ON lab.record_id = re.id) t USING (residue_id) JOIN verdict v USING (residue_id)
), ob AS (
  SELECT *, CASE WHEN gold = '(no defect)' THEN predicted = 'INSUFFICIENT_EVIDENCE' ELSE predicted = gold END AS correct FROM obs
)
"""


def sql(select: str) -> str:
    return f"WITH RECURSIVE {BASE.strip()}\n{select}"


def at(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"
