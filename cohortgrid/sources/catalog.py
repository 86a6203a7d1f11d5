"""Table sources and sinks: a catalog of lazily read tables, CSV, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import MIN_PAYLOAD_BYTES
from ..functions.taxonomy import upsert_dimension

# Requested name -> stored name.
ALIASES = {"steps": "step", "calories": "calorie"}


class Catalog:
    """Tables by name, read lazily from a folder of parquet files, JDBC or given frames."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None,
                 jdbc: dict[str, str] | None = None, ranges: dict[str, tuple[str, int, int, int]] | None = None):
        """``ranges``: for each JDBC table the integer column, bounds and number of its parallel reads."""
        self.spark, self.root, self.jdbc, self.ranges = spark, root, jdbc, dict(ranges or {})
        self.tables = dict(tables or {})

    def table(self, name: str) -> DataFrame:
        name = ALIASES.get(name, name) if name not in self.tables else name
        if name not in self.tables:
            self.tables[name] = self._read(name)
        return self.tables[name]

    def _read(self, name: str) -> DataFrame:
        if self.jdbc:
            if name not in self.ranges:
                raise KeyError(f"give the range of {name!r}, or it is read through one connection")
            return self.partitioned(name, *self.ranges[name])
        if self.root is None:
            raise KeyError(f"no table {name!r} in the catalog")
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def partitioned(self, name: str, column: str, lower: int, upper: int, parts: int) -> DataFrame:
        """A JDBC table read in parallel ranges of an integer column."""
        options = {"partitionColumn": column, "lowerBound": lower, "upperBound": upper, "numPartitions": parts}
        return self.spark.read.format("jdbc").options(**(self.jdbc or {}), dbtable=name, **options).load()

    def extract(self, names: list[str]) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in names}


def exclude_test_users(df: DataFrame, participants: DataFrame, pattern: str = "%-test%", name: str = "participant_id") -> DataFrame:
    """Drop rows of users whose study id matches; rows without a user stay.

    No broadcast hint: the id list grows with the cohort, so AQE decides
    from its measured size.
    """
    if "app_user_id" not in df.columns:
        return df
    matched = participants.where(F.col(name).like(pattern)).select("app_user_id").distinct()
    return df.join(matched, "app_user_id", "left_anti")


def payload_scan(df: DataFrame, payload: str = "payload", limit: int | None = None) -> DataFrame:
    """Records with a payload above the minimum size; ``limit`` takes the first by id."""
    rows = df.where(F.col(payload).isNotNull() & (F.octet_length(payload) > MIN_PAYLOAD_BYTES))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType, with_file: bool = False) -> DataFrame:
    """Typed CSV scan over one or more folders; missing ones are skipped."""
    found = [p for p in paths if _exists(spark, p)]
    reader = spark.read.schema(schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if not found:
        return spark.createDataFrame([], schema)
    df = reader.csv(found)
    return df.withColumn("file", F.input_file_name()) if with_file else df


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def refresh_dimension(spark: SparkSession, path: str, names: DataFrame, previous: str | None = None) -> DataFrame:
    """Write the category dimension extended by the names it lacks; returns the written table.

    ``previous`` is the last written version; the new version goes to ``path``.
    """
    empty = spark.createDataFrame([], "app_name string, app_category string")
    known = spark.read.parquet(previous) if previous else empty
    write_parquet(upsert_dimension(known, names), path)
    return spark.read.parquet(path)
