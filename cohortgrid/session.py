"""Session settings and the shared scratch location."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan in this package relies on. They never fix a
# partition count: AQE coalesces and splits from the cluster's own setting.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortgrid")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Column call-site capture costs several driver round trips per expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return apply_runtime_conf(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables.

    It sits under ``spark.checkpoint.dir`` (storage every executor sees), or under the
    warehouse, which is shared too, where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``by``: a folder for each value of that column.

    Cuts the lineage before iterative training: a lost executor re-reads the
    table instead of replaying the feature joins.
    """
    path = shared_dir(df.sparkSession, purpose)
    if by is None:
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in {f.rsplit("/", 1)[0] if "=" in f.rsplit("/", 1)[1] else f for f in folders}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
