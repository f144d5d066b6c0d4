"""Session settings this engine expects, and the shared folder for stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
_LOCAL: dict[str, str] = {}


def apply_conf(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by spark.checkpoint.dir; a local one only for local masters."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        return None
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="postern-")
    return _LOCAL[context.applicationId]


def python_partitions(spark: SparkSession) -> int:
    """Partition count for CPU-bound Python steps; explicit, so that tiny inputs are not merged into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def stored_by(df: DataFrame, *keys: str) -> DataFrame:
    """Written into the shared folder, split by ``keys`` into as many buckets as shuffles have partitions: joins on them shuffle only their other side."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    label, buckets = f"postern_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", f"{folder}/{label}").option("compression", "zstd").saveAsTable(label)
    return spark.table(label)
