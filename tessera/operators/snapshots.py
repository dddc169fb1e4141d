"""Tables of files in buckets, of which a new snapshot rewrites only those that its files lie in.

A snapshot is a list of folders, one a bucket of paths. Replacing some files writes the buckets that hold them to new folders
and appends one list that names these and the old folders of all other buckets. Lists are only ever added, each as one
file that appears at once, and readers take the one of the greatest version: they see whole snapshots, and always one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64

_LIST = "version long, bucket int, folder string"


def bucket_of(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def newest(spark: SparkSession, root: str) -> dict[int, str]:
    """Folders of the newest snapshot by bucket; at most BUCKETS rows reach the driver."""
    if not _exists(spark, f"{root}/lists"):
        return {}
    lists = spark.read.schema(_LIST).parquet(f"{root}/lists")
    last = lists.agg(F.max("version")).first()[0]
    return {r.bucket: r.folder for r in lists.where((F.col("version") == F.lit(last)) & F.col("folder").isNotNull()).collect()}


def version(spark: SparkSession, root: str) -> int:
    """Number of the newest snapshot, 0 if there is none."""
    if not _exists(spark, f"{root}/lists"):
        return 0
    return spark.read.schema(_LIST).parquet(f"{root}/lists").agg(F.max("version")).first()[0]


def read(spark: SparkSession, root: str, schema) -> DataFrame:
    """The newest snapshot; an empty table of the schema if there is none."""
    folders = sorted(newest(spark, root).values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace(rows: DataFrame, files: DataFrame, root: str, buckets: int = BUCKETS, key: str = "path") -> int:
    """The next snapshot: of some files (path) what was goes, and rows (path, ..) come in. Returns its version.

    Rows of other files than those named are left out. Only the touched buckets are read and written.
    """
    spark = rows.sparkSession
    at, next_ = newest(spark, root), version(spark, root) + 1
    named = files.select(F.col(key)).distinct()
    touched = [r.b for r in named.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect()]  # at most `buckets`
    new = rows.join(named, key, "left_semi").select(*rows.columns)
    old = [at[b] for b in touched if b in at]
    if old:
        kept = spark.read.schema(rows.schema).parquet(*old).join(named, key, "left_anti").select(*rows.columns)
        new = kept.unionByName(new)
    folder = f"{root}/data/v{next_}"
    new.withColumn("_bucket", bucket_of(F.col(key), buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    held = {b for b in touched if _exists(spark, f"{folder}/_bucket={b}")}  # a bucket may be empty now
    now = {b: f for b, f in at.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in held}
    listed = [(next_, b, f) for b, f in sorted(now.items())] or [(next_, -1, None)]  # nothing is left: a list without folders
    spark.createDataFrame(listed, _LIST).coalesce(1).write.mode("append").parquet(f"{root}/lists")
    return next_
