"""The whole reconciliation: three typed tables in, the partition and its metrics out."""

from __future__ import annotations

from collections import UserDict
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import assemble as a
from tallyspark.operators import delay, orders as od, settlements as st
from tallyspark.sources.shared import stored, stored_all, tidy


class Tables(UserDict):
    """Tables by name. What is given as a function is made when it is first asked for, so that a caller of one table doesn't pay for the disk of all."""

    def __init__(self, spark: SparkSession, tables: dict):
        super().__init__(tables)
        self.spark = spark

    def __getitem__(self, name: str) -> DataFrame:
        made = super().__getitem__(name)
        if not isinstance(made, DataFrame):
            with tidy(self.spark):
                made = self.data[name] = made()
        return made


def reconcile(orders: DataFrame, lines: DataFrame, bank: DataFrame, ids: str = "sha", strict: bool = False) -> Tables:
    """matched, residue, residue_entities, residue_candidates, excluded, reconciled, findings, histogram, metrics, audit,
    duplicate_twins, the orders of the groups that evidence names as duplicate_group, case_records, residue_entities without the
    records' text, and members, what components are of.

    The inputs are read many times: each is written to the shared folder once.
    """
    spark = orders.sparkSession
    with tidy(spark):
        orders, lines, bank = stored_all(orders, lines, bank)
        typed = a.typed_findings(orders, lines, bank)
        good, links = stored_all(st.reconciled(typed["_tied"]), a.finding_entities(typed, orders, lines))
    groups, excluded = typed["_groups"], od.excluded_orders(orders, lines, typed["_seen"])

    @cache
    def cases_and_records() -> tuple[DataFrame, DataFrame]:
        cases, records = a.cases_and_records(links, ids)
        return cases, stored(a.record_amounts(records, orders, lines, bank, groups))

    cases, records = lambda: cases_and_records()[0], lambda: cases_and_records()[1]
    findings = cache(lambda: stored(a.plain_findings(typed)))
    values = cache(lambda: stored(a.residue_value(records())))
    matched = lambda: stored(a.matched_lines(lines, records(), good))
    tables = Tables(
        spark,
        {
            "matched": matched,
            "residue": lambda: a.residue_findings(findings(), records(), cases()).join(a.residue_evidence(findings(), cases()), "residue_id").join(values(), "residue_id"),
            "residue_entities": lambda: a.residue_entities(records(), orders, lines, bank, groups, strict),
            "residue_candidates": lambda: a.residue_candidates(a.finding_candidates(typed, lines, bank), cases()),
            "case_records": records,
            "members": a.members(links),
            "excluded": excluded,
            "reconciled": good,
            "findings": lambda: findings().join(cases(), "finding_id"),
            "finding_entities": lambda: links.drop("head").join(cases(), "finding_id"),
            "duplicate_twins": typed["_twins"],
            "histogram": delay.day_delta_histogram(typed["_deltas"]),
            "metrics": lambda: a.match_metrics(orders, lines, bank, groups, tables["matched"], values(), excluded),
            "audit": lambda: a.partition_audit(orders, lines, bank, tables["matched"], good, records(), excluded, strict),
            "counts": lambda: a.finding_type_counts(findings()).orderBy(F.col("code")),
        },
    )
    tables.details = lambda own: a.residue_entities(own, orders, lines, bank, groups, strict)
    if strict:
        tables["residue_entities"] = stored(tables["residue_entities"])
        tables["audit"]
    return tables


def unreconciled_batches(lines: DataFrame, bank: DataFrame) -> DataFrame:
    """Which settlement batches don't tie to the bank, and why: settlement_id, utr, reason, expected_net_paise, bank_credit_paise, line_count."""
    tied = st.tie_settlement_to_bank(st.group_settlements(lines), bank).withColumn("reason", st.failing_reason())
    return tied.where("reason is not null").select("settlement_id", "utr", "reason", "expected_net_paise", "bank_credit_paise", "line_count")
