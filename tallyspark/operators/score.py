"""Scoring matcher and classifier against labels. Not imported by either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.cells import normalize_id
from tallyspark.schemas import CAUSES, INSUFFICIENT, NO_DEFECT


def _truth(labels: DataFrame) -> DataFrame:
    return labels.select(normalize_id("record_id").alias("id"), "true_cause")


def _matched_ids(result: dict[str, DataFrame]) -> DataFrame:
    m, r = result["matched"], result["reconciled"]
    out = m.where("line_type = 'payment' and order_id is not null").select(F.col("order_id").alias("id"))
    for df, key in ((m, "line_id"), (r, "settlement_id"), (r, "bank_txn_id")):
        out = out.unionByName(df.select(F.col(key).alias("id")))
    return out.distinct()


def _owned(result: dict[str, DataFrame]) -> DataFrame:
    """The cases' records, without their text where the result has them so."""
    return result["case_records" if "case_records" in result else "residue_entities"]


def label_outcome(labels: DataFrame, result: dict[str, DataFrame]) -> DataFrame:
    """record_id, true_cause, outcome: captured, falsely_matched, excluded or unaccounted, the first that holds."""
    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    seen = _truth(labels).join(mark(_owned(result), "a"), "id", "left").join(mark(_matched_ids(result), "b"), "id", "left").join(mark(result["excluded"].select(F.col("order_id").alias("id")), "c"), "id", "left")
    outcome = F.when(F.col("a"), "captured").when(F.col("b"), "falsely_matched").when(F.col("c"), "excluded").otherwise("unaccounted")
    return seen.select(F.col("id").alias("record_id"), "true_cause", outcome.alias("outcome"))


def capture_by_cause(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("true_cause").agg(F.count("*").alias("labelled"), F.count_if(F.col("outcome") == "captured").alias("captured")).orderBy(F.desc("labelled"), "true_cause")


def clean_match_rate(labels: DataFrame, result: dict[str, DataFrame]) -> DataFrame:
    """One row: unlabelled records matched, pulled into cases (matched wins), and the rate."""
    ids = _matched_ids(result).withColumn("m", F.lit(1)).unionByName(_owned(result).select("id", F.lit(0).alias("m")))
    clean = ids.join(_truth(labels).select("id"), "id", "left_anti").groupBy("id").agg(F.max("m").alias("m"))
    row = clean.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("clean_matched"), F.coalesce(F.sum(1 - F.col("m")), F.lit(0)).alias("clean_residue"))
    total = F.col("clean_matched") + F.col("clean_residue")
    return row.select("*", F.when(total > 0, F.round(F.col("clean_matched") / total, 4)).alias("rate"))


def _labelled(entities: DataFrame, labels: DataFrame) -> DataFrame:
    return entities.join(_truth(labels), "id", "left")


def residue_precision(labels: DataFrame, result: dict[str, DataFrame]) -> DataFrame:
    """One row: cases, those with a labelled record, their share."""
    cases = _labelled(_owned(result), labels).groupBy("residue_id").agg(F.max(F.col("true_cause").isNotNull().cast("int")).alias("d"))
    return cases.agg(F.count("*").alias("entries"), F.coalesce(F.sum("d"), F.lit(0)).alias("with_defect")).select("*", F.when(F.col("entries") > 0, F.round(F.col("with_defect") / F.col("entries"), 4)).alias("precision"))


def finding_cause_crosstab(labels: DataFrame, result: dict[str, DataFrame]) -> DataFrame:
    """code, a column for each cause, noise: findings by the distinct causes of their records, noise where there is none."""
    owned = _labelled(result["finding_entities"], labels).select("finding_id", "code", "true_cause").distinct()
    # a finding with a labelled record counts for its causes only
    best = owned.groupBy("finding_id", "code").agg(F.collect_set("true_cause").alias("causes"))
    rows = best.select("code", F.explode(F.when(F.size("causes") == 0, F.array(F.lit("noise"))).otherwise(F.col("causes"))).alias("cause"))
    return rows.groupBy("code").pivot("cause", [*CAUSES, "noise"]).count().na.fill(0)


def findings_never_fired(findings: DataFrame, codes: list[str]) -> DataFrame:
    every = findings.sparkSession.createDataFrame([(x,) for x in codes], "code string")
    return every.join(findings.select("code").distinct(), "code", "left_anti")


def observations(residue_entities: DataFrame, labels: DataFrame, records: DataFrame) -> DataFrame:
    """residue_id, gold, predicted, confidence, auto_approved, correct: one row for each labelled record of a classified case, or one without defect."""
    truth = residue_entities.join(_truth(labels), "id").select("residue_id", F.col("true_cause").alias("gold"))
    cases = residue_entities.select("residue_id").distinct()
    c = F.col("classification")
    said = records.select("residue_id", c["predicted_cause"].alias("predicted"), c["confidence"].alias("confidence"), (~c["requires_human_review"]).alias("auto_approved"))
    both = cases.join(truth, "residue_id", "left").join(said, "residue_id").withColumn("gold", F.coalesce("gold", F.lit(NO_DEFECT)))
    right = F.when(F.col("gold") == NO_DEFECT, F.col("predicted") == INSUFFICIENT).otherwise(F.col("predicted") == F.col("gold"))
    return both.select("residue_id", "gold", "predicted", "confidence", "auto_approved", right.alias("correct"))


def accuracy_headline(obs: DataFrame, labels: DataFrame, residue: DataFrame) -> DataFrame:
    """One row: correct, total labels, ceiling (cases with a defect), cases with several, cases not classified."""
    real = obs.where(F.col("gold") != NO_DEFECT)
    row = real.agg(F.count_if("correct").alias("correct"), F.count_distinct("residue_id").alias("ceiling"))
    several = real.groupBy("residue_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("multi_defect_entries"))
    missing = residue.select("residue_id").join(obs.select("residue_id"), "residue_id", "left_anti").agg(F.count("*").alias("unclassified_entries"))
    return row.crossJoin(labels.agg(F.count("*").alias("total"))).crossJoin(several).crossJoin(missing)  # one row each


def auto_approval_exposure(residue_entities: DataFrame, labels: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: approved cases and value, wrong ones and their value; the wrong cases)."""
    truth = residue_entities.join(_truth(labels), "id", "left").groupBy("residue_id").agg(F.array_sort(F.collect_set("true_cause")).alias("causes"))
    c = F.col("classification")
    auto = records.where(~c["requires_human_review"]).select("residue_id", c["predicted_cause"].alias("predicted"), c["confidence"].alias("confidence"), F.coalesce(c["proposed_adjusting_entry"]["amount_paise"], F.lit(0)).alias("amount_paise"), c["proposed_adjusting_entry"]["action"].alias("action"))
    both = auto.join(truth, "residue_id")
    wrong = F.when(F.size("causes") == 0, F.col("predicted") != INSUFFICIENT).otherwise(~F.array_contains("causes", F.col("predicted")))
    both = both.withColumn("wrong", wrong)
    money = lambda only: F.coalesce(F.sum(F.when(only, F.col("amount_paise"))), F.lit(0))
    summary = both.agg(F.count("*").alias("auto_approved"), money(F.lit(True)).alias("exposure_paise"), F.count_if("wrong").alias("wrong"), money(F.col("wrong")).alias("wrong_exposure_paise"))
    return summary, both.where("wrong").drop("wrong")


def gate_split(obs: DataFrame) -> DataFrame:
    """bucket, entries, defects, correct, accuracy, over labelled defects."""
    real = obs.where(F.col("gold") != NO_DEFECT).withColumn("bucket", F.when(F.col("auto_approved"), "auto").otherwise("review"))
    rows = real.groupBy("bucket").agg(F.count_distinct("residue_id").alias("entries"), F.count("*").alias("defects"), F.count_if("correct").alias("correct"))
    return rows.select("*", F.round(F.col("correct") / F.col("defects"), 4).alias("accuracy"))


def precision_recall_f1(obs: DataFrame) -> DataFrame:
    """class, actual, predicted, correct, precision, recall, f1; null where a denominator is 0."""
    classes = F.array(*map(F.lit, [*CAUSES, INSUFFICIENT]))
    facts = obs.select(F.explode(F.array(F.struct(F.col("gold").alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p"), F.lit(0).alias("t")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p"), (F.col("gold") == F.col("predicted")).cast("int").alias("t")))).alias("x")).select("x.*")
    none = obs.sparkSession.range(1).select(F.explode(classes).alias("class"), F.lit(0).alias("a"), F.lit(0).alias("p"), F.lit(0).alias("t"))
    sums = facts.where(F.array_contains(classes, F.col("class"))).unionByName(none).groupBy("class").agg(F.sum("a").alias("actual"), F.sum("p").alias("predicted"), F.sum("t").alias("correct"))
    p, r = F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")), F.when(F.col("actual") > 0, F.col("correct") / F.col("actual"))
    sums = sums.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return sums.select("class", "actual", "predicted", "correct", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def noise_breakdown(obs: DataFrame) -> DataFrame:
    """predicted, entries, review, mean_confidence of the cases without a defect."""
    return obs.where(F.col("gold") == NO_DEFECT).groupBy("predicted").agg(F.count("*").alias("entries"), F.count_if(~F.col("auto_approved")).alias("review"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def confusion_matrix(obs: DataFrame) -> DataFrame:
    """gold, a column for each prediction, total."""
    names = [*CAUSES, INSUFFICIENT]
    table = obs.groupBy("gold").pivot("predicted", names).count().na.fill(0)
    return table.withColumn("total", sum((F.col(n) for n in names), F.lit(0)))
