"""An append-only log of JSON lines in which the last record of a key holds, with the order of appends kept and compaction by bucket.

Every append claims the next commit number by making a file of that name, which only one writer can, and stamps it on its lines
together with their place in the append. Lines stand in folders by a hash of the key, so compaction rewrites only buckets in which
something is superseded or torn. A reader needs no lock: what a broken-off compaction leaves twice has the same stamps and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMPS = T.StructType([T.StructField("commit", T.LongType()), T.StructField("ordinal", T.LongType())])


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def claim(spark: SparkSession, path: str) -> int:
    """The next commit number, nobody else's. Its file stays, also where the append then fails: numbers only have to rise."""
    jvm = spark.sparkContext._jvm
    fs, folder = _folder(spark, f"{path}/_commits")
    fs.mkdirs(folder)
    number = 1 + max([int(s.getPath().getName()) for s in fs.listStatus(folder)], default=0)
    while True:
        try:
            fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{number:012d}"), False).close()
            return number
        except Exception as e:  # another writer was first
            if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{number:012d}")):
                raise e
            number += 1


def append(df: DataFrame, path: str, key: str, buckets: int = 64) -> int:
    """Adds df's rows as one commit and gives its number. Rows of a null key can't be superseded and aren't taken."""
    spark = df.sparkSession
    number = claim(spark, path)
    rows = df.where(F.col(key).isNotNull()).withColumn("commit", F.lit(number).cast("long")).withColumn("ordinal", F.monotonically_increasing_id())
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("append").partitionBy("bucket").json(path, ignoreNullFields=False)
    return number


def _lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    whole = T.StructType([*schema.fields, *STAMPS.fields])
    lines = spark.read.text(path)
    if "bucket" not in lines.columns:  # no commit yet
        lines = lines.withColumn("bucket", F.lit(None).cast("int"))
    lines = lines.where(F.trim("value") != "").select("bucket", "value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("row", F.from_json("value", whole, {"mode": "PERMISSIVE"}))
    return parsed.withColumn("good", F.coalesce(F.col(f"row.{key}").isNotNull() & F.col("row.commit").isNotNull() & F.get_json_object("value", f"$.{key}").isNotNull(), F.lit(False)))


def read(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with commit and ordinal, torn lines)."""
    lines = _lines(spark, path, schema, key)
    return lines.where("good").select("row.*"), lines.where("not good").select(F.col("value").alias("line"))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last record of each key, by commit and place; combined before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct("commit", "ordinal")).alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str) -> list[int]:
    """Rewrites the buckets that hold superseded or torn lines to one record a key, and gives their numbers. New files come first, old ones go after.

    What reaches the driver is a row for each bucket and the names of the old files in those rewritten.
    """
    lines = _lines(spark, path, schema, key)
    keys = lines.where("good").groupBy("bucket", F.col(f"row.{key}").alias("_key")).agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max("n").alias("most"))
    torn = lines.groupBy("bucket").agg(F.count_if(~F.col("good")).alias("torn"))
    touched = [r.bucket for r in torn.join(keys, "bucket", "left").where("torn > 0 or most > 1").select("bucket").collect()]
    if not touched:
        return []
    own = lines.where(F.col("bucket").isin(touched))
    old = [r.file for r in own.select("file").distinct().collect()]
    kept = latest(own.where("good").select("bucket", "row.*"), key)
    kept.repartition("bucket").write.mode("append").partitionBy("bucket").json(path, ignoreNullFields=False)
    fs, _ = _folder(spark, path)
    for name in old:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name), False)
    return sorted(touched)
