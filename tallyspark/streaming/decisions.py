"""The append-only decision log followed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.schemas import AUDIT


def follow_audit_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines of the log as a streaming table. Torn lines have no residue_id and are left out."""
    return spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", files_per_batch).json(path).where("residue_id is not null")


def latest_decisions(log: DataFrame) -> DataFrame:
    """residue_id, action, final_cause, timestamp of the last decision so far. State is one row for each decided case."""
    last = F.max_by(F.struct("action", "final_cause", "timestamp"), F.struct("timestamp", "action", "final_cause"))
    return log.groupBy("residue_id").agg(last.alias("d")).select("residue_id", "d.*")


def publish_latest_decisions(log: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changed cases of every batch below table_path, one folder a batch, and ends when the log is read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")  # a batch that is done again replaces itself

    return latest_decisions(log).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
