from pyspark.sql import functions as F

from tallyspark.schemas import AUDIT
from tallyspark.sources import files
from tallyspark.streaming import decisions as ds


def test_latest_decisions_over_a_growing_log(spark, tmp_path):
    log, out, check = (str(tmp_path / k) for k in ("log", "out", "check"))
    row = lambda case, cause, at: (at, case, "reclassify", "ON_HOLD", cause, None, 0.9, False)
    for batch in ([row("r1", "A", "1"), row("r2", "B", "1")], [row("r1", "C", "2")]):
        files.append_jsonl(spark.createDataFrame(batch, AUDIT), log)
        ds.publish_latest_decisions(ds.follow_audit_log(spark, log), out, check).awaitTermination(60)
    last = spark.read.parquet(out).groupBy("residue_id").agg(F.max_by("final_cause", "batch").alias("cause"))
    assert {r.residue_id: r.cause for r in last.collect()} == {"r1": "C", "r2": "B"}
