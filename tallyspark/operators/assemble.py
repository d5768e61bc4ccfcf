"""From findings to the partition of all records into matched, residue cases and excluded.

Findings are three long tables, so that a batch that owns a million lines is a million rows and no giant array:
``findings`` (finding_id, stage, place, code, evidence), ``entities`` (finding_id, code, stage, seq, kind, id, head; seq 0 is the head, and head its key) and
``candidates`` (finding_id, stage, place, rank, kind, id, reason, evidence).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.cells import entity_key
from tallyspark.operators import delay, lines as ln, orders as od, settlements as st
from tallyspark.operators.components import star_components
from tallyspark.operators.joins import running_sum
from tallyspark.schemas import NEAR_BANK, NEAR_BATCH, NET_TOLERANCE_PAISE, ORDINAL, PARENT, TWIN_SETTLED, TWIN_UNSETTLED
from tallyspark.sources.shared import discard, stored, stored_all


_TOLD = ["entity_id", "type", "order_id", "payment_id", "method", "debit_paise", "credit_paise", "amount_paise", "fee_paise", "tax_paise", "settlement_id", "settled_at", ORDINAL]


def typed_findings(orders: DataFrame, lines: DataFrame, bank: DataFrame) -> dict[str, DataFrame]:
    """One plain table for each kind of finding, plus the batch ties and day deltas that others need."""
    # without the cells that no finding names
    plain = orders.select("order_id", "amount_paise", "created_at", "status")
    told = lines.select(*(k for k in _TOLD if k in lines.columns))
    groups, seen, joined = stored_all(st.group_settlements(lines), od.with_settling_line(plain, lines), ln.payment_lines_with_order(plain, told))
    tied = stored(st.tie_settlement_to_bank(groups, bank))
    deltas = delay.settlement_day_delta(orders, lines, joined)
    twins = od.duplicate_twins(orders, lines, seen)
    return {
        "DUPLICATE_ORDER_PAIR": od.count_duplicate_orders(twins),
        "ORDER_WITHOUT_SETTLEMENT": od.unsettled_orders(orders, lines, seen),
        "ORDER_STATUS_CONTRADICTION": od.find_status_contradictions(orders, lines, seen),
        "ORPHAN_ADJUSTMENT": ln.find_orphan_adjustments(lines),
        "ORPHAN_REFUND": ln.find_orphan_refunds(orders, lines),
        "ORPHAN_PAYMENT": ln.find_orphan_payments(orders, lines, joined),
        "SHORT_CAPTURE": ln.find_short_captures(orders, lines, joined),
        "FEE_SLAB_MISMATCH": ln.find_fee_mismatches(orders, lines, joined),
        "SETTLEMENT_ON_HOLD": st.find_on_hold(tied).withColumn("bank_rows_for_utr", F.lit(0)),
        "UNEXPECTED_BANK_CREDIT_ON_HOLD": st.find_unexpected_credit_on_hold(tied),
        "SETTLEMENT_WITHOUT_BANK_CREDIT": st.find_missing_bank_credit(tied),
        "NET_MISMATCH": st.find_net_mismatch(tied).withColumn("tolerance_paise", F.lit(NET_TOLERANCE_PAISE)),
        "BANK_CREDIT_WITHOUT_SETTLEMENT": st.find_unclaimed_bank_credits(groups, bank),
        "SETTLEMENT_DELAY": delay.find_settlement_delays(deltas),
        "_seen": seen,
        "_twins": twins,
        "_groups": groups,
        "_tied": tied,
        "_deltas": deltas,
    }


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "timestamp":
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind == "double":
        return F.regexp_replace(F.col(name).cast("string"), r"\.0$", "")
    return F.array_join(name, ",") if kind.startswith("array") else F.col(name).cast("string")


def _evidence(df: DataFrame, leave: set[str]) -> Column:
    """All columns as text by name; nulls are left out. Batch findings call their status and delays their order date by longer names."""
    rename = {"status": "settlement_status"} if "expected_net_paise" in df.columns else {"created_at": "order_created_at"} if "day_delta" in df.columns else {}
    pairs = [x for k in df.columns if k not in leave for x in (F.lit(rename.get(k, k)), _text(df, k))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


#: code, stage, what sorts a stage's findings, the id column, (kind, column) of the owned records, the head first; None where a long table has them
_SHAPES = {
    "DUPLICATE_ORDER_PAIR": (1, 0, "group_id", None),
    "ORDER_WITHOUT_SETTLEMENT": (1, 1, "order_id", [("order", "order_id")]),
    "ORDER_STATUS_CONTRADICTION": (1, 1, "order_id", [("order", "order_id"), ("settlement_line", "line_id")]),
    "ORPHAN_ADJUSTMENT": (2, 0, "line_id", [("settlement_line", "line_id")]),
    "ORPHAN_REFUND": (2, 0, "line_id", [("settlement_line", "line_id")]),
    "ORPHAN_PAYMENT": (2, 0, "line_id", [("settlement_line", "line_id")]),
    "SHORT_CAPTURE": (2, 0, "line_id", [("order", "order_id"), ("settlement_line", "line_id")]),
    "FEE_SLAB_MISMATCH": (2, 0, "line_id", [("order", "order_id"), ("settlement_line", "line_id")]),
    "SETTLEMENT_ON_HOLD": (3, 0, "settlement_id", None),
    "UNEXPECTED_BANK_CREDIT_ON_HOLD": (3, 0, "settlement_id", None),
    "SETTLEMENT_WITHOUT_BANK_CREDIT": (3, 0, "settlement_id", None),
    "NET_MISMATCH": (3, 0, "settlement_id", None),
    "BANK_CREDIT_WITHOUT_SETTLEMENT": (3, 1, "bank_txn_id", [("bank_txn", "bank_txn_id")]),
    "SETTLEMENT_DELAY": (4, 0, "line_id", [("order", "order_id"), ("settlement_line", "line_id")]),
}
_HEADS = {"group_id", "order_id", "line_id", "settlement_id", "bank_txn_id"}


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _twin_ownership(twins: DataFrame) -> DataFrame:
    """group_id, seq, kind, id: a duplicate group's orders, its least as the head, and the lines that settle them."""
    order = twins.select("group_id", F.when(F.col("order_id") == F.col("group_id"), 0).otherwise(1).alias("seq"), F.lit("order").alias("kind"), F.col("order_id").alias("id"))
    return order.unionByName(twins.where("settled").select("group_id", F.lit(1).alias("seq"), F.lit("settlement_line").alias("kind"), F.col("line_id").alias("id")))


def union_findings(typed: dict[str, DataFrame], orders: DataFrame, lines: DataFrame, bank: DataFrame) -> dict[str, DataFrame]:
    """The common findings, entities and candidates tables."""
    return {"findings": plain_findings(typed), "entities": finding_entities(typed, orders, lines), "candidates": finding_candidates(typed, lines, bank)}


def _finding_id(kind: str) -> tuple[str, Column]:
    code = "ORPHAN_SETTLEMENT_LINE" if kind.startswith("ORPHAN") else kind
    return code, F.concat(F.lit(f"{code}:"), F.col(_SHAPES[kind][2]))


def plain_findings(typed: dict[str, DataFrame]) -> DataFrame:
    """finding_id, stage, place, code, evidence."""
    findings = []
    for kind, (stage, place, key, owns) in _SHAPES.items():
        df, (code, fid) = typed[kind], _finding_id(kind)
        sort = F.concat(F.lit(f"{place}:"), F.col(key))
        leave = {"line_id", "group_id"} | ({"order_id"} if owns and len(owns) + (kind == "ORDER_WITHOUT_SETTLEMENT") > 1 else set()) | ({"settlement_id"} if stage == 3 and place == 0 else set()) | ({"bank_txn_id"} if place == 1 and stage == 3 else set())
        findings.append(df.select(fid.alias("finding_id"), F.lit(stage).alias("stage"), sort.alias("place"), F.lit(code).alias("code"), _evidence(df, leave).alias("evidence")))
    return _all(findings)


def finding_entities(typed: dict[str, DataFrame], orders: DataFrame, lines: DataFrame) -> DataFrame:
    """finding_id, code, stage, seq, kind, id, head."""
    entities = []
    # what failed batches own, in one pass over the lines; a batch fails in one way
    failed = _all([typed[k].select("settlement_id", F.lit(k).alias("code"), F.col("bank_txn_id") if "bank_txn_id" in typed[k].columns else F.lit(None).cast("string").alias("bank_txn_id")) for k, v in _SHAPES.items() if v[2] == "settlement_id"])
    owned = st.settlement_ownership(failed, lines, orders).join(failed.select("settlement_id", "code"), "settlement_id")
    entities.append(owned.select(F.concat("code", F.lit(":"), "settlement_id").alias("finding_id"), "code", F.lit(3).alias("stage"), F.when(F.col("kind") == "settlement", 0).otherwise(1).alias("seq"), "kind", "id", entity_key(F.lit("settlement"), "settlement_id").alias("head")))
    for kind, (stage, _, key, owns) in _SHAPES.items():
        df, (code, fid) = typed[kind], _finding_id(kind)
        if key == "group_id":
            own = _twin_ownership(typed["_twins"]).select(fid.alias("finding_id"), "seq", "kind", "id", entity_key(F.lit("order"), "group_id").alias("head"))
        elif owns is None:
            continue
        else:
            refs = F.array(*(F.struct(F.lit(seq).alias("seq"), F.lit(what).alias("kind"), F.col(column).alias("id")) for seq, (what, column) in enumerate(owns)))
            head = entity_key(F.lit(owns[0][0]), owns[0][1])
            own = df.select(fid.alias("finding_id"), F.explode(refs).alias("e"), head.alias("head")).select("finding_id", "e.seq", "e.kind", "e.id", "head")
        entities.append(own.select("finding_id", F.lit(code).alias("code"), F.lit(stage).alias("stage"), "seq", "kind", "id", "head"))
    return _all(entities)


def finding_candidates(typed: dict[str, DataFrame], lines: DataFrame, bank: DataFrame) -> DataFrame:
    """finding_id, stage, place, rank, kind, id, reason, evidence."""
    candidates = []

    def near(df: DataFrame, code: str, stage: int, place: int, key: str, kind: str, id_: str, reason: str, *shown: str) -> DataFrame:
        pairs = [x for k in shown for x in (F.lit(k), F.coalesce(_text(df, k), F.lit("")))]
        return df.select(F.concat(F.lit(f"{code}:"), F.col(key)).alias("finding_id"), F.lit(stage).alias("stage"), F.concat(F.lit(f"{place}:"), F.col(key)).alias("place"), "rank", F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.lit(reason).alias("reason"), F.create_map(*pairs).alias("evidence"))

    ranked = running_sum(typed["_twins"], F.lit(1), "group_id", ["order_id"], "rank")
    reason = F.when(F.col("settled"), TWIN_SETTLED).otherwise(TWIN_UNSETTLED)
    shown = F.create_map(*(x for k in ("created_at", "amount_paise", "status") for x in (F.lit(k), F.coalesce(_text(ranked, k), F.lit("")))))
    candidates.append(ranked.select(F.concat(F.lit("DUPLICATE_ORDER_PAIR:"), "group_id").alias("finding_id"), F.lit(1).alias("stage"), F.concat(F.lit("0:"), "group_id").alias("place"), F.col("rank").cast("int").alias("rank"), F.lit("order").alias("kind"), F.col("order_id").alias("id"), reason.alias("reason"), shown.alias("evidence")))
    candidates.append(near(ln.refund_parent_candidates(typed["ORPHAN_REFUND"], lines), "ORPHAN_SETTLEMENT_LINE", 2, 0, "line_id", "settlement_line", "candidate_id", PARENT, "amount_paise", "settlement_id", "settled_at", "order_id"))
    for code in ("SETTLEMENT_ON_HOLD", "SETTLEMENT_WITHOUT_BANK_CREDIT"):
        candidates.append(near(st.nearby_bank_candidates(typed[code], bank), code, 3, 0, "settlement_id", "bank_txn", "bank_txn_id", NEAR_BANK, "credit_paise", "delta_paise", "utr", "value_date"))
    ghost = typed["BANK_CREDIT_WITHOUT_SETTLEMENT"]
    candidates.append(near(st.nearby_settlement_candidates(ghost, typed["_groups"]), "BANK_CREDIT_WITHOUT_SETTLEMENT", 3, 1, "bank_txn_id", "settlement", "settlement_id", NEAR_BATCH, "expected_net_paise", "delta_paise", "utr", "settled_at"))
    return _all(candidates)


def owned_entities(entities: DataFrame) -> DataFrame:
    return entities.select("kind", "id").distinct()


def matched_lines(lines: DataFrame, owned: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Lines nobody owns, of a batch that ties to the bank, whose order (payments only) nobody owns."""
    free = lines.join(owned.where("kind = 'settlement_line'").select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    free = free.join(reconciled, "settlement_id")
    taken = owned.where("kind = 'order'").select(F.col("id").alias("taken"))
    free = free.join(taken, (F.col("type") == "payment") & (F.col("order_id") == F.col("taken")), "left_anti")
    payment = F.when(F.col("type") == "payment", F.col("entity_id")).otherwise(F.col("payment_id"))
    return free.select("order_id", payment.alias("payment_id"), F.col("entity_id").alias("line_id"), F.col("type").alias("line_type"), "settlement_id", "bank_txn_id", F.col("expected_net_paise").alias("net_paise"), "amount_paise", F.lit(True).alias("verified"))


_FNV_BASE, _FNV_PRIME, _WORD = 2166136261, 16777619, 1 << 32
#: The state that a separator turns into the hash's beginning, so that every key can be taken with a separator before it.
_BEFORE = (_FNV_BASE * pow(_FNV_PRIME, -1, _WORD) % _WORD) ^ ord("|")


def short_ids(keys: DataFrame, by: str) -> DataFrame:
    """by, short_id: the 32-bit FNV-1a hash over the distinct keys of each ``by``, sorted and joined by bars; no key list is gathered.

    Range partitions keep the order. How a stretch of text changes the hash depends on the 256 values of its low byte
    alone: (h + 256 k) goes to f(h) + 256 k times the prime to the stretch's length. So of a case that goes on from an earlier
    partition a task gives that function, and only functions, one for each partition, meet in a case's row.
    """
    rows = stored(keys.select(F.col(by).alias("by"), "key").where("key is not null").distinct())
    rows = rows.repartitionByRange("by", "key").sortWithinPartitions("by", "key").withColumn("part", F.spark_partition_id())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, part, opened, h, seq, first, length = [], None, 0, False, _BEFORE, 0, 0, 0
        table = np.arange(256, dtype=np.uint32)

        def piece() -> tuple:
            return (now, part, seq, first, pow(_FNV_PRIME, length, _WORD), table.astype(np.int64), None) if not opened else (now, part, seq, 0, 1, None, h)

        for batch in batches:
            for case, key, part in zip(batch["by"], batch["key"], batch["part"].tolist()):
                if case != now:
                    if now is not None:
                        out.append(piece())
                        opened, h, seq = True, _BEFORE, 0
                    now = case
                codes = [124, *map(ord, key)]
                if opened:
                    for x in codes:
                        h = (h ^ x) * _FNV_PRIME % _WORD
                    continue
                for x in codes:
                    if x > 255:  # reaches beyond the low byte: it is put in before the next stretch
                        out.append(piece())
                        table, seq, first, length, x = np.arange(256, dtype=np.uint32), seq + 1, x, 0, 0
                    table = (table ^ np.uint32(x)) * np.uint32(_FNV_PRIME)
                    length += 1
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=_PIECE)
                out = []
        if now is not None:
            out.append(piece())
        yield pd.DataFrame(out, columns=_PIECE)

    pieces = rows.mapInPandas(each, "by string, part int, seq int, first long, power long, low array<long>, h long")

    def onward(h: Column, p: Column) -> Column:
        h = h.bitwiseXOR(p["first"])
        high = F.shiftright(h, 8) * p["power"] % _WORD * 256
        return F.when(p["h"].isNotNull(), p["h"]).otherwise((high + F.get(p["low"], h.bitwiseAND(F.lit(255)).cast("int"))) % _WORD)

    whole = pieces.groupBy("by").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "first", "power", "low", "h"))).alias("pieces"))
    number = F.aggregate("pieces", F.lit(_BEFORE).cast("bigint"), onward)
    return whole.select(F.col("by").alias(by), F.concat(F.lit("res_"), F.lower(F.lpad(F.hex(number), 8, "0"))).alias("short_id"))


_PIECE = ["by", "part", "seq", "first", "power", "low", "h"]


def members(entities: DataFrame) -> DataFrame:
    """head, key: the records of each finding beside the key of its first one."""
    return entities.select("head", entity_key("kind", "id").alias("key"))


def cases_and_records(entities: DataFrame, ids: str = "sha") -> tuple[DataFrame, DataFrame]:
    """Stored (finding_id, residue_id) and (residue_id, kind, id): findings that share a record are one case, and a record is in one case only.

    A case is named by a hash of its least record key, or with ids="fnv" by the short hash of all of its keys;
    it is an error if two of those collide.
    """
    ends, home = star_components(members(entities))
    if ids == "sha":
        named = home.select("head", F.concat(F.lit("res_"), F.substring(F.sha2("component", 256), 1, 16)).alias("residue_id"))
    else:
        keys = stored(short_ids(ends.join(home, "head").select("component", "key"), "component").withColumnRenamed("short_id", "residue_id"))
        twice = keys.groupBy("residue_id").agg(F.count("*").alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError("two cases have the same short id; use ids='sha'")
        named = home.join(keys, "component").select("head", "residue_id")
    heads = entities.where("seq = 0").groupBy("finding_id").agg(F.min("head").alias("head"))
    kind = F.substring_index("key", ":", 1)
    records = ends.join(named, "head").select("residue_id", kind.alias("kind"), F.expr("if(contains(key, ':'), substr(key, instr(key, ':') + 1), null)").alias("id"))
    out = [stored(heads.join(named, "head").select("finding_id", "residue_id")), stored(records)]
    discard(ends, home)
    return tuple(out)


def case_of_finding(entities: DataFrame, ids: str = "sha") -> DataFrame:
    """finding_id, residue_id: findings that share a record are one case."""
    return cases_and_records(entities, ids)[0]


def record_amounts(records: DataFrame, orders: DataFrame, lines: DataFrame, bank: DataFrame, groups: DataFrame) -> DataFrame:
    """The cases' records with their amount_paise, null where no input has them."""
    one = lambda df, kind, key, amount: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(amount).alias("amount_paise"))
    known = _all([one(orders, "order", "order_id", "amount_paise"), one(lines, "settlement_line", "entity_id", "amount_paise"), one(bank, "bank_txn", "bank_txn_id", "credit_paise"), one(groups, "settlement", "settlement_id", "expected_net_paise")])
    return records.join(known, ["kind", "id"], "left").select("residue_id", "kind", "id", "amount_paise")


def residue_entities(records: DataFrame, orders: DataFrame, lines: DataFrame, bank: DataFrame, groups: DataFrame, strict: bool = False) -> DataFrame:
    """residue_id, kind, id, amount_paise, normalized and raw (both JSON): a case's records, each from (residue_id, kind, id).

    A record that no input has is an error if strict; else its values are null, and partition_audit reports it.
    """
    def shape(df: DataFrame, kind: str, key: str, amount: str) -> DataFrame:
        # the cells are written out behind the join, so that it moves no text
        plain = [k for k in df.columns if k not in ("raw", "errors")]
        own, cells = records.where(F.col("kind") == kind).select("residue_id", "kind", F.col("id").alias("_id")), df.withColumn("_known", F.lit(True))
        found = own.join(cells, own["_id"] == cells[key], "left")
        normalized = F.when(F.col("_known"), F.to_json(F.struct(*plain)))
        raw = F.when(F.col("_known"), F.to_json("raw")) if "raw" in df.columns else F.lit(None).cast("string")
        return found.select(own["residue_id"], own["kind"], F.col("_id").alias("id"), F.col(amount).alias("amount_paise"), normalized.alias("normalized"), raw.alias("raw"))

    shapes = [(orders, "order", "order_id", "amount_paise"), (lines, "settlement_line", "entity_id", "amount_paise"), (bank, "bank_txn", "bank_txn_id", "credit_paise"), (groups, "settlement", "settlement_id", "expected_net_paise")]
    none = [F.lit(None).cast(kind).alias(k) for k, kind in (("amount_paise", "bigint"), ("normalized", "string"), ("raw", "string"))]
    others = records.where(~F.col("kind").isin([x[1] for x in shapes])).select("residue_id", "kind", "id", *none)
    found = _all([*(shape(*x) for x in shapes), others])
    if not strict:
        return found
    sure = F.when(F.col("normalized").isNull(), F.raise_error(F.concat(F.lit("residue references unknown "), "kind", F.lit(" "), "id")).cast("string")).otherwise(F.col("normalized"))
    return found.select("residue_id", "kind", "id", "amount_paise", sure.alias("normalized"), "raw")


def residue_evidence(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """residue_id, evidence: the first finding's value keeps its key, later ones are put under CODE.key, the last of a code wins."""
    rows = findings.join(cases, "finding_id").select("residue_id", "stage", "place", "code", F.explode("evidence").alias("key", "value"))
    # by aggregates, so that a case of a million findings is no hot task; a code's last value counts unless it is the key's first
    at = F.struct("stage", "place", "code")
    by_code = rows.groupBy("residue_id", "key", "code").agg(F.min(at).alias("first"), F.min_by("value", at).alias("first_value"), F.max(at).alias("last"), F.max_by("value", at).alias("last_value"))
    whole = Window.partitionBy("residue_id", "key")  # a row for each code
    by_code = by_code.withColumn("_first", F.min("first").over(whole))
    kept = F.array(
        F.when(F.col("first") == F.col("_first"), F.struct("key", F.col("first_value").alias("value"))),
        F.when(F.col("last") > F.col("_first"), F.struct(F.concat_ws(".", "code", "key").alias("key"), F.col("last_value").alias("value"))),
    )
    last = by_code.select("residue_id", F.explode(F.array_compact(kept)).alias("e")).select("residue_id", "e.*")
    return last.groupBy("residue_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("evidence"))


def residue_candidates(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """residue_id, kind, id, reason, each once, with the place of its first mention and what was shown there (evidence)."""
    rows = candidates.join(cases, "finding_id")
    at = F.struct("stage", "place", "rank")
    return rows.groupBy("residue_id", "kind", "id", "reason").agg(F.min(at).alias("first"), F.min_by("evidence", at).alias("evidence"))


def residue_findings(findings: DataFrame, records: DataFrame, cases: DataFrame) -> DataFrame:
    """residue_id, finding_types (sorted codes), n_findings, n_entities."""
    codes = findings.join(cases, "finding_id").groupBy("residue_id").agg(F.array_sort(F.collect_set("code")).alias("finding_types"), F.count("*").alias("n_findings"))
    sizes = records.groupBy("residue_id").agg(F.count("id").alias("n_entities"))
    return codes.join(sizes, "residue_id")


def residue_value(residue_entities: DataFrame) -> DataFrame:
    """residue_id, value_paise: gross of the case's lines, or of its bank rows and orders where it has no line."""
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("amount_paise")).otherwise(0))
    sums = residue_entities.groupBy("residue_id").agg(of("settlement_line").alias("a"), of("bank_txn", "order").alias("b"), F.count_if(F.col("kind") == "settlement_line").alias("n"))
    return sums.select("residue_id", F.when(F.col("n") > 0, F.col("a")).otherwise(F.col("b")).alias("value_paise"))


def finding_type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").alias("findings"))


def match_metrics(orders: DataFrame, lines: DataFrame, bank: DataFrame, groups: DataFrame, matched: DataFrame, values: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: totals, matched, residue and excluded counts and values, match rates (1 where there is nothing)."""
    kind = lambda k: F.count_if(F.col("type") == k)
    row = orders.agg(F.count("*").alias("total_orders"))
    for part in (
        lines.agg(kind("payment").alias("total_payments"), kind("refund").alias("total_refunds"), kind("adjustment").alias("total_adjustments")),
        groups.agg(F.count("*").alias("total_settlements")),
        bank.agg(F.count("*").alias("total_bank_rows")),
        matched.agg(F.count("*").alias("auto_matched_count"), F.coalesce(F.sum("amount_paise"), F.lit(0)).alias("auto_matched_value_paise")),
        values.agg(F.count("*").alias("residue_count"), F.coalesce(F.sum("value_paise"), F.lit(0)).alias("residue_value_paise")),
        excluded.agg(F.count("*").alias("excluded_count")),
    ):
        row = row.crossJoin(part)  # one row each
    rate = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.round(F.col(a) / (F.col(a) + F.col(b)), 4))
    return row.select("*", rate("auto_matched_count", "residue_count").alias("match_rate_by_count"), rate("auto_matched_value_paise", "residue_value_paise").alias("match_rate_by_value"))


def partition_audit(orders: DataFrame, lines: DataFrame, bank: DataFrame, matched: DataFrame, reconciled: DataFrame, residue_entities: DataFrame, excluded: DataFrame, strict: bool = False) -> DataFrame:
    """kind, id, problem: records that aren't in exactly one of matched, residue and excluded. Empty when all is well."""
    ref = lambda df, kind, key, bucket: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(bucket).alias("bucket"))
    universe = _all([ref(orders, "order", "order_id", "input"), ref(lines, "settlement_line", "entity_id", "input"), ref(lines, "settlement", "settlement_id", "input"), ref(bank, "bank_txn", "bank_txn_id", "input")])
    placed = _all(
        [
            ref(matched.where("line_type = 'payment' and order_id is not null"), "order", "order_id", "matched"),
            ref(matched, "settlement_line", "line_id", "matched"),
            ref(reconciled, "settlement", "settlement_id", "matched"),
            ref(reconciled, "bank_txn", "bank_txn_id", "matched"),
            ref(excluded, "order", "order_id", "excluded"),
            residue_entities.select("kind", "id", F.lit("residue").alias("bucket")),
        ]
    )
    owners = residue_entities.groupBy("kind", "id").agg(F.count_distinct("residue_id").alias("owners"))
    has = lambda b: F.max((F.col("bucket") == b).cast("int")).alias(b)
    seen = universe.unionByName(placed).groupBy("kind", "id").agg(has("input"), has("matched"), has("residue"), has("excluded")).join(owners, ["kind", "id"], "left")
    n = F.col("matched") + F.col("residue") + F.col("excluded")
    problem = F.when(F.col("input") == 0, "not in the input").when(n == 0, "unaccounted for").when(n > 1, "in more than one of matched, residue, excluded").when(F.col("owners") > 1, "in two cases")
    out = seen.select("kind", "id", problem.alias("problem")).where("problem is not null")
    if strict:
        first = out.take(1)
        if first:
            raise ValueError(f"{first[0].kind} {first[0].id}: {first[0].problem}")
    return out
