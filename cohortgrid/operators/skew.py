"""Order-dependent operators that never gather one group in one task.

Row numbers, nearest-value lookups and medians are computed in two levels: a
chunk of each group is ordered locally, and a summary with one row per
(group, chunk) carries the offset or the neighbour value across chunks. Only
the summary is ordered per group, and its size is the number of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


QUANTILE_CHUNKS = 256
HOT_MIN_ROWS = 1_000_000
SKETCH = 10_000
MARGIN = 3
WHOLE_GROUP = 20_000


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Keys with more than ``min_rows`` rows. The bar is fixed, so no group ordered in one task grows with
    the data; the list does, so it is joined without a broadcast hint."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > F.lit(min_rows)).drop("_n")


def hot_row_number(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], name: str = "rn",
                   size_name: str = "n", min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """1-based position and group size per ``keys``; only hot groups are chunked.

    ``chunk`` must rise with ``order``. Ordinary groups take one window; the
    rows of a hot group are spread over its chunks, whose offsets are counted
    separately. Keys must not be NULL.
    """
    hot = hot_keys(df, keys, min_rows).withColumn("_hot", F.lit(True))
    rows = df.join(hot, keys, "left").withColumn("_chunk", F.when(F.col("_hot"), chunk.cast("string")).otherwise(""))
    offsets = _chunk_offsets(rows.where("_hot"), keys)
    # Placed by group and chunk even when the input is already placed by a
    # part of the keys, which would keep a hot group in one task.
    placed = rows.join(offsets, [*keys, "_chunk"], "left").repartition(*keys, "_chunk")
    group = Window.partitionBy(*keys, "_chunk")
    return placed.withColumns(
        {
            name: F.row_number().over(group.orderBy(*order)) + F.coalesce("_offset", F.lit(0)),
            size_name: F.coalesce("_group_size", F.count(F.lit(1)).over(group)),
        }
    ).drop("_hot", "_chunk", "_offset", "_group_size")


def _chunk_offsets(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each chunk and rows of the whole group."""
    sizes = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    by_group = Window.partitionBy(*keys)
    before = by_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(by_group).alias("_group_size"),
    )


def chunked_row_number(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn",
                       size_name: str | None = None) -> DataFrame:
    """1-based position per ``keys`` of a frame that carries ``_chunk``.

    ``_chunk`` must rise with ``order``. Keys must not be NULL. ``size_name``
    adds the group's row count.
    """
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    out = df.join(_chunk_offsets(df, keys), [*keys, "_chunk"]).withColumn(
        name, (F.row_number().over(local) + F.col("_offset")).cast("long")
    )
    if size_name:
        out = out.withColumn(size_name, F.col("_group_size"))
    return out.drop("_chunk", "_offset", "_group_size")


def with_quantile_chunk(df: DataFrame, column: str, descending: bool = False, chunks: int = QUANTILE_CHUNKS) -> DataFrame:
    """Add ``_chunk``, rising (or falling) with ``column``, with similar row counts per chunk.

    The edges come from a distributed sketch of the column. Equal values never
    straddle chunks.
    """
    cuts = [i / chunks for i in range(1, chunks)]
    edges = df.agg(F.percentile_approx(column, cuts, 10_000)).scalar()
    # The coalesce keeps the chunk non-nullable, so a join on it adds no null
    # test that Catalyst would push below an aggregation and run per input row.
    below = F.coalesce(F.size(F.filter(F.col("_edges"), lambda e: e < F.col(column))), F.lit(0))
    return df.withColumn("_edges", edges).withColumn("_chunk", -below if descending else below).drop("_edges")


def chunked_cumulative(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums per ``keys`` over a frame that carries ``_chunk``.

    ``sums`` maps a summed column to the output name.
    """
    def whole(c: str, total: Column) -> Column:
        # Wider decimals would lose digits when they are added.
        kind = df.schema[c].dataType
        return total.cast(kind) if isinstance(kind, T.DecimalType) else total

    parts = df.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *keys, "_chunk",
        *[whole(c, F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0))).alias(f"_before_{c}") for c in sums],
    )
    local = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = df.join(carried, [*keys, "_chunk"])
    for c, alias in sums.items():
        out = out.withColumn(alias, whole(c, F.sum(c).over(local)) + F.col(f"_before_{c}"))
    return out.drop("_chunk", *[f"_before_{c}" for c in sums])


def exact_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` and the exact median of each column, for all groups and columns in two aggregations.

    The first gives every (group, column) its count and a bracket around its middle from a sketch. The sketch is off
    by at most one rank in ``SKETCH``, so ``MARGIN`` ranks in ``SKETCH`` on either side hold the middle; groups of at
    most ``WHOLE_GROUP`` rows take all their values. The second counts what is below the bracket in one number and
    the values inside one by one, about a thousandth of a large group. No buffer holds a group's values. Keys must
    not be NULL; missing values don't count, and a group without values has no row.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]))
    values = df.select(*keys, cells.alias("_cell")).select(*keys, "_cell._c", "_cell._v").where(F.col("_v").isNotNull())
    group, half = [*keys, "_c"], MARGIN / SKETCH
    ends = F.percentile_approx("_v", [0.5 - half, 0.5 + half], SKETCH)
    brackets = values.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), ends.alias("_e"))
    wide = F.col("_n") <= WHOLE_GROUP
    brackets = brackets.select(*group, "_n", F.when(wide, F.lit(float("-inf"))).otherwise(F.col("_e")[0]).alias("_lo"),
                               F.when(wide, F.lit(float("nan"))).otherwise(F.col("_e")[1]).alias("_hi"))  # NaN is above all
    inside = values.join(brackets, group).where(F.col("_v") <= F.col("_hi"))
    counted = inside.groupBy(*group, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*group).orderBy(F.col("_at").asc_nulls_first()))
    middle = counted.withColumn("_upto", upto).groupBy(*group).agg(
        F.min(F.when(F.col("_upto") >= F.expr("(_n + 1) div 2"), F.col("_at"))).alias("_low"),
        F.min(F.when(F.col("_upto") >= F.expr("_n div 2 + 1"), F.col("_at"))).alias("_high"))
    median = (F.col("_low") + F.col("_high")) / F.lit(2.0)
    return middle.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == c, median)).alias(c) for c in columns])


def exact_median(df: DataFrame, column: str) -> float | None:
    """Exact median of one column; None without values."""
    row = exact_medians(df.select(column), [], [column]).first()
    return row[0] if row else None
