"""Interval totals from prefix sums: the ``prefix`` method of the window features.

Pairing every reference with the rows of its window costs (references) x
(rows per window). Here every total is a difference of running sums read at
the window ends, so the work is linear in rows and references, however many
rows one user holds. Minutes are decimals, so differences are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import US_PER_HOUR, add_hours, epoch_us, hour_floor
from .skew import chunked_cumulative

# Exact type of minutes and their sums.
EXACT = "decimal(24,12)"


@dataclass(frozen=True)
class Interval:
    """``name`` covers ages ``newest .. oldest`` hours before the reference; the
    newest end is closed, the oldest end closed only when ``closed``."""

    name: int
    newest: int
    oldest: int
    closed: bool

    @property
    def length(self) -> int:
        return self.oldest - self.newest

    @property
    def top(self) -> tuple[int, bool]:
        """Prefix up to and including the newest end."""
        return (self.newest, True)

    @property
    def base(self) -> tuple[int, bool]:
        """Prefix to subtract: a closed oldest end stays in the interval."""
        return (self.oldest, not self.closed)


def running_at(rows: DataFrame, probes: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums of ``rows`` (``keys, t, sums``) up to each probe (``keys, t, inclusive, probe``).

    Running sums are taken in hour chunks with carried totals, so a key's rows
    are spread over tasks.
    """
    left = rows.select(*keys, "t", *sums, F.lit(1).alias("_kind"))
    kind = F.when(F.col("inclusive"), 2).otherwise(0)
    right = probes.select(*keys, "t", kind.alias("_kind"), "probe")
    both = left.unionByName(right, allowMissingColumns=True).na.fill(0, sums).withColumn("_chunk", hour_floor(F.col("t")))
    out = chunked_cumulative(both, keys, [F.col("t"), F.col("_kind")], {c: f"run_{c}" for c in sums})
    return out.where(F.col("probe").isNotNull()).select(*keys, "probe", *[F.col(f"run_{c}").alias(c) for c in sums])


def _probes(refs: DataFrame, id_cols: list[str], points: list[tuple[int, bool]]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(age).alias("age"), F.lit(inclusive).alias("inclusive"))
        for k, (age, inclusive) in enumerate(points)
    ])
    exploded = refs.withColumn("_p", F.explode(cells))
    probe = F.struct(*id_cols, F.col("_p.k").alias("k"))
    return exploded.select("app_user_id", add_hours(F.col("ref_ts"), -F.col("_p.age")).alias("t"),
                           F.col("_p.inclusive").alias("inclusive"), probe.alias("probe"))


def _points(intervals: list[Interval]) -> list[tuple[int, bool]]:
    return sorted({i.top for i in intervals} | {i.base for i in intervals})


def category_amounts(sessions: DataFrame, refs: DataFrame, id_cols: list[str], intervals: list[Interval]) -> DataFrame:
    """``m<name>`` minutes and ``n<name>`` rows per (reference, category)."""
    points = _points(intervals)
    # NULL is a category of its own here; encode it, since keys are joined.
    coded = F.coalesce(F.concat(F.lit("="), F.col("app_category")), F.lit(""))
    rows = sessions.select("app_user_id", coded.alias("_cat"), F.col("last_time_used").alias("t"),
                           F.coalesce(F.col("total_time_minutes").cast(EXACT), F.lit(0).cast(EXACT)).alias("m"), F.lit(1).alias("n"))
    own = rows.select("app_user_id", "_cat").distinct()
    found = running_at(rows, _probes(refs, id_cols, points).join(own, "app_user_id"), ["app_user_id", "_cat"], ["m", "n"])
    at = found.groupBy(*[F.col(f"probe.{c}").alias(c) for c in id_cols], "_cat").agg(
        *[F.expr(f"max(CASE WHEN probe.k = {k} THEN {c} END) AS {c}_{k}") for k in range(len(points)) for c in ("m", "n")]
    )
    diffs = [
        F.expr(f"{c}_{points.index(i.top)} - {c}_{points.index(i.base)} AS {c}{i.name}") for i in intervals for c in ("m", "n")
    ]
    name = F.when(F.col("_cat") != "", F.substring("_cat", 2, 1_000_000))
    return at.select(*id_cols, name.alias("app_category"), *diffs)


def _next_uses(sessions: DataFrame) -> DataFrame:
    """Distinct uses ``app_user_id, app_name, t`` with the time of the app's next use.

    The next use is looked up inside each day; a day's last use takes the
    first use of the next active day.
    """
    uses = sessions.where(F.col("app_name").isNotNull()).select(
        "app_user_id", "app_name", F.col("last_time_used").alias("t"), F.to_date("last_time_used").alias("_day")
    ).distinct()
    days = uses.groupBy("app_user_id", "app_name", "_day").agg(F.min("t").alias("_first"))
    following = Window.partitionBy("app_user_id", "app_name").orderBy("_day")
    days = days.select("app_user_id", "app_name", "_day", F.lead("_first").over(following).alias("_later"))
    in_day = Window.partitionBy("app_user_id", "app_name", "_day").orderBy("t")
    keys = ["app_user_id", "app_name", "_day"]
    return uses.join(days, keys).withColumn("next", F.coalesce(F.lead("t").over(in_day), F.col("_later")))


def distinct_apps(sessions: DataFrame, refs: DataFrame, id_cols: list[str], intervals: list[Interval]) -> DataFrame:
    """``a<name>`` distinct apps per reference.

    An app seen before the reference is missing from an interval of length L
    exactly when a gap between two of its uses covers the interval. Such a
    gap is longer than L, and a gap longer than L that has ended by the newest
    end also began before the oldest end. So the covering gaps number (long
    gaps begun before the interval) - (long gaps ended by its newest end):
    two prefix counts.
    """
    points, lengths = _points(intervals), sorted({i.length for i in intervals})
    uses = _next_uses(sessions)
    gap = (epoch_us(F.col("next")) - epoch_us(F.col("t"))) / F.lit(float(US_PER_HOUR))
    is_long = {n: F.coalesce(gap > n, F.lit(True)).cast("long") for n in lengths}
    begins = uses.select("app_user_id", "t", F.lit(1).cast("long").alias("d"), *[c.alias(f"a{n}") for n, c in is_long.items()])
    ends = uses.where(F.col("next").isNotNull()).select(
        "app_user_id", F.col("next").alias("t"), F.lit(-1).cast("long").alias("d"), *[c.alias(f"b{n}") for n, c in is_long.items()]
    )
    sums = ["d", *[f"{s}{n}" for s in "ab" for n in lengths]]
    changes = begins.unionByName(ends, allowMissingColumns=True)
    found = running_at(changes, _probes(refs, id_cols, points), ["app_user_id"], sums)
    at = found.groupBy(*[F.col(f"probe.{c}").alias(c) for c in id_cols]).agg(
        *[F.expr(f"max(CASE WHEN probe.k = {k} THEN {c} END) AS {c}_{k}") for k in range(len(points)) for c in sums]
    )
    counts = []
    for i in intervals:
        top, base = points.index(i.top), points.index(i.base)
        counts.append(F.expr(f"int(d_{top} - (a{i.length}_{base} - b{i.length}_{top})) AS a{i.name}"))
    return at.select(*id_cols, *counts)


def interval_lists(sessions: DataFrame, refs: DataFrame, id_cols: list[str], intervals: list[Interval]) -> DataFrame:
    """Per reference: ``_cats`` (category amounts per interval) and the ``a<name>`` app counts."""
    amounts = [f"{c}{i.name}" for i in intervals for c in ("m", "n")]
    cats = category_amounts(sessions, refs, id_cols, intervals).groupBy(*id_cols).agg(
        F.collect_list(F.struct("app_category", *amounts)).alias("_cats")
    )
    apps = distinct_apps(sessions, refs, id_cols, intervals)
    return cats.join(apps, id_cols, "left").na.fill(0, [f"a{i.name}" for i in intervals])
