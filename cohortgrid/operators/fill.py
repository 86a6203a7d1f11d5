"""Missing-value filling and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import exact_medians, with_quantile_chunk

FILL_ALIASES = {"linear": "interpolate", "ffill": "ffill_bfill", "bfill": "ffill_bfill", "fill": "ffill_bfill"}
FILL_METHODS = ("interpolate", "ffill_bfill", "zero")


def fill_gaps(df: DataFrame, columns: list[str], method: str | None, keys: list[str], order: str,
              flag: bool = False) -> DataFrame:
    """Fill NULLs of ``columns`` along ``order`` within ``keys``.

    ``df`` is a time grid (one row per key and bucket), so a key's rows are
    bounded by the length of the study, whatever the raw event volume.
    ``flag`` adds ``<column>_is_filled``.
    """
    if not method:
        return df
    method = FILL_ALIASES.get(method, method)
    if method not in FILL_METHODS:
        raise ValueError(f"unknown fill method {method!r}; use one of {FILL_METHODS} or None")
    out = df
    if flag:
        out = out.withColumns({f"{c}_is_filled": F.col(c).isNull() for c in columns})
    if method == "zero":
        return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order))))
    # Nearest known (position, value) on each side; reverse order keeps both frames growing.
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).alias("v"))) for c in columns}
    out = out.withColumns({f"_prev_{c}": F.last(known[c], ignorenulls=True).over(ahead) for c in columns})
    out = out.withColumns({f"_next_{c}": F.last(known[c], ignorenulls=True).over(back) for c in columns})
    filled = _linear if method == "interpolate" else _nearest_before
    out = out.withColumns({c: filled(c) for c in columns})
    return out.drop("_pos", *[f"_prev_{c}" for c in columns], *[f"_next_{c}" for c in columns])


def _nearest_before(c: str) -> Column:
    return F.coalesce(F.col(c), F.col(f"_prev_{c}.v"), F.col(f"_next_{c}.v"))


def _linear(c: str) -> Column:
    """Straight line by row position; the ends take the nearest value."""
    p0, v0 = F.col(f"_prev_{c}.p"), F.col(f"_prev_{c}.v")
    p1, v1 = F.col(f"_next_{c}.p"), F.col(f"_next_{c}.v")
    between = v0 + (v1 - v0) * (F.col("_pos") - p0) / (p1 - p0)
    return F.when(F.col(c).isNotNull(), F.col(c)).when(
        v0.isNotNull() & v1.isNotNull(), between
    ).otherwise(F.coalesce(v0, v1))


def carry_values(df: DataFrame, columns: list[str], keys: list[str], order: str, forward: bool = True) -> DataFrame:
    """Missing values take the nearest known one before them (after them, if not ``forward``) within ``keys``.

    A key's rows are cut into chunks along ``order``: days of a timestamp, else ranges of similar counts. Each chunk
    is ordered by itself; a summary with each chunk's last known values, one row for each (key, chunk), carries them
    to the chunks after it. So a key with very many rows is spread over its chunks. Keys must not be NULL.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        rows = df.withColumn("_chunk", F.coalesce(F.to_date(order), F.lit("0001-01-01").cast("date")))
    elif isinstance(kind, T.DateType):
        rows = df.withColumn("_chunk", F.coalesce(F.trunc(order, "month"), F.lit("0001-01-01").cast("date")))
    else:
        rows = with_quantile_chunk(df, order)
    place = F.coalesce(F.struct(F.col(order)), F.struct(F.lit(None).cast(kind).alias(order)))
    pick = F.max_by if forward else F.min_by
    known = [pick(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_last_{c}") for c in columns]
    per_chunk = rows.groupBy(*keys, "_chunk").agg(*known)
    along = F.col("_chunk") if forward else F.col("_chunk").desc()
    before = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*keys, "_chunk", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carried_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.col(order) if forward else F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, [*keys, "_chunk"]).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carried_{c}")) for c in columns})
    return out.select(*df.columns)


def fit_imputer(df: DataFrame, columns: list[str], strategy: str) -> dict[str, float]:
    """Fill values learnt from ``df``; empty for strategies that learn nothing."""
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        values = {c: row[c] for c in columns}
    elif strategy == "median":
        row = exact_medians(df, [], columns).first()
        values = {c: row[c] if row else None for c in columns}
    elif strategy == "zero":
        values = {c: 0.0 for c in columns}
    else:
        values = {}
    return {c: v for c, v in values.items() if v is not None}


def impute(df: DataFrame, columns: list[str], strategy: str, keys: list[str] | None = None,
           order: str | None = None, fitted: dict[str, float] | None = None) -> DataFrame:
    """Apply a missing-value strategy: zero, mean, median, ffill, bfill, interpolate or drop."""
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy in ("zero", "mean", "median"):
        values = fit_imputer(df, columns, strategy) if fitted is None else fitted
        return df.fillna(values, subset=list(values)) if values else df
    if not (keys and order):
        raise ValueError(f"strategy {strategy!r} needs keys and an order column")
    if strategy == "interpolate":
        return fill_gaps(df, columns, "interpolate", keys, order)
    if strategy in ("ffill", "bfill"):
        return carry_values(df, columns, keys, order, forward=strategy == "ffill")
    raise ValueError(f"unknown strategy {strategy!r}")
