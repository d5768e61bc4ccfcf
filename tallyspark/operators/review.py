"""The review queue and its decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.schemas import CAUSES, INSUFFICIENT

ACTIONS = ["approve", "reject", "reclassify"]


def review_queue(residue: DataFrame, records: DataFrame) -> DataFrame:
    """Cases with their classification; unclassified ones need review. Review first, then by proposed value."""
    c = F.col("classification")
    said = records.select("residue_id", c["predicted_cause"].alias("predicted_cause"), c["confidence"].alias("confidence"), c["proposed_adjusting_entry"]["action"].alias("proposed_action"), c["proposed_adjusting_entry"]["amount_paise"].alias("proposed_amount_paise"), c["requires_human_review"].alias("_review"), F.col("gate_forced_review"))
    both = residue.join(said, "residue_id", "left")
    bucket = F.when(F.coalesce("_review", F.lit(True)), "review").otherwise("auto")
    both = both.withColumn("bucket", bucket).withColumn("gate_forced_review", F.coalesce("gate_forced_review", F.lit(False))).drop("_review")
    return both.orderBy(F.desc("bucket"), F.desc(F.coalesce("proposed_amount_paise", F.lit(0))), "residue_id")


def review_summary(queue: DataFrame, audit: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: cases and proposed value in each bucket, decided cases, value of all cases."""
    value = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.coalesce("proposed_amount_paise", F.lit(0)))), F.lit(0))
    row = queue.agg(F.count_if(F.col("bucket") == "review").alias("review_count"), F.count_if(F.col("bucket") == "auto").alias("auto_count"), value("review").alias("review_value_paise"), value("auto").alias("auto_value_paise"))
    row = row.crossJoin(audit.agg(F.count_distinct("residue_id").alias("decided_count")))  # one row each
    return row.crossJoin(metrics.select("residue_count", "residue_value_paise", "match_rate_by_count"))


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit rows, rejects with reason and status). What the case said is taken from the queue, not from the decision.

    decisions: residue_id, action, final_cause, reviewer_note, timestamp.
    """
    cases = queue.select(F.col("residue_id").alias("_case"), "predicted_cause", "confidence", "gate_forced_review")
    both = decisions.join(cases, F.col("residue_id") == F.col("_case"), "left")
    known_action = F.coalesce(F.col("action").isin(ACTIONS), F.lit(False))
    reason = (
        F.when(F.coalesce("residue_id", F.lit("")) == "", "residue_id is required")
        .when(~known_action, "unknown action")
        .when(F.col("_case").isNull(), "unknown residue_id")
        .when((F.col("action") == "reclassify") & ~F.coalesce(F.col("final_cause").isin([*CAUSES, INSUFFICIENT]), F.lit(False)), "unknown final_cause")
    )
    both = both.withColumn("reason", reason)
    rejects = both.where("reason is not null").select("residue_id", "action", "reason", F.when(F.col("reason") == "unknown residue_id", 404).otherwise(400).alias("status"))
    original = F.coalesce("predicted_cause", F.lit("UNCLASSIFIED"))
    final = F.when(F.col("action") == "reject", "REJECTED").when(F.col("action") == "reclassify", F.col("final_cause")).otherwise(original)
    audit = both.where("reason is null").select("timestamp", "residue_id", "action", original.alias("original_prediction"), final.alias("final_cause"), F.nullif(F.trim(F.coalesce("reviewer_note", F.lit(""))), F.lit("")).alias("reviewer_note"), F.coalesce("confidence", F.lit(0.0)).alias("original_confidence"), F.col("gate_forced_review").alias("gate_forced"))
    return audit, rejects


def latest_decision(audit: DataFrame) -> DataFrame:
    return audit.groupBy("residue_id").agg(F.max_by(F.struct("action", "final_cause", "timestamp"), F.struct("timestamp", "action", "final_cause")).alias("d")).select("residue_id", "d.*")


def filter_bucket(queue: DataFrame, bucket: str) -> DataFrame:
    return queue if bucket == "all" else queue.where(F.col("bucket") == bucket)
