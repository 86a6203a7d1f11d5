"""Interval joins between survey (or submission) times and preceding behaviour.

Every join here is an equi-join on (user, day) or (user, hour) with a
residual range test: a row belongs to exactly one bucket and a reference is
replicated to the few buckets its window touches, so a pair meets once and no
user is held by one task. Behaviour is summed to the hour before the join;
raw rows are read only in hours that a window edge cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import US_PER_HOUR, add_hours, at_reference_hour, epoch_us, hour_ceil, hour_floor
from .prefix import EXACT, Interval, interval_lists

# Window sets in hours.
CATEGORY_WINDOWS = [1, 3, 6, 12, 24, 48, 72, 168]
TRAINING_WINDOWS = [3, 6, 9, 12]
REFERENCE_HOUR = 9


def hours_between(start: Column, end: Column) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(float(US_PER_HOUR))


def reference_times(surveys: DataFrame, standardized: bool, reference_hour: int = REFERENCE_HOUR) -> DataFrame:
    """Add ``ref_ts``: the survey time, or its day at a fixed hour."""
    ref = at_reference_hour(F.col("survey_ts"), reference_hour) if standardized else F.col("survey_ts")
    return surveys.withColumn("ref_ts", ref)


def _by_day(refs: DataFrame, hours: int) -> DataFrame:
    """Replicate references to the days of ``[ref_ts - hours, ref_ts]``."""
    days = F.sequence(F.to_date(add_hours(F.col("ref_ts"), -hours)), F.to_date("ref_ts"))
    return refs.withColumn("_day", F.explode(days))


def reach_days(hours: int, reference_hour: int = REFERENCE_HOUR) -> int:
    """Days before its own that the window of a standardized reference touches."""
    return -((reference_hour - hours) // 24)


def survey_days(surveys: DataFrame) -> DataFrame:
    """``app_user_id, days``: each user's days with a survey, an array bounded by the length of the study."""
    day = F.to_date("survey_ts")
    return surveys.where(F.col("app_user_id").isNotNull()).groupBy("app_user_id").agg(F.collect_set(day).alias("days"))


def near_usage(surveys: DataFrame, hourly: DataFrame, hours: int, reference_hour: int = REFERENCE_HOUR) -> DataFrame:
    """Surveys that can have a grid row in the ``hours`` before their standardized reference: those whose window touches a
    day on which their user has one. The others have no slots, whatever they answer."""
    days = F.sequence(F.to_date("datetime"), F.date_add(F.to_date("datetime"), reach_days(hours, reference_hour)))
    near = hourly.select("app_user_id", F.explode(days).alias("_day")).distinct()
    return surveys.withColumn("_day", F.to_date("survey_ts")).join(near, ["app_user_id", "_day"], "left_semi").drop("_day")


# ---------------------------------------------------------------- hour slots


def slot_of(hours_before: Column, mode: str = "rounded") -> Column:
    """Hour slot: half-even rounding, or the elapsed hour (``ceil - 1``)."""
    if mode == "rounded":
        return F.bround(hours_before).cast("int")
    if mode == "elapsed":
        return (F.ceil(hours_before) - 1).cast("int")
    raise ValueError(f"unknown slot mode {mode!r}")


def slot_rows(hourly: DataFrame, refs: DataFrame, value: str, hours: int, mode: str = "rounded") -> DataFrame:
    """Grid rows of ``[ref_ts - hours, ref_ts)`` per reference:
    ``survey_response_id, hours_before, hour_slot, value``."""
    grid = hourly.select("app_user_id", F.to_date("datetime").alias("_day"), "datetime", F.col(value).alias("value"))
    keys = refs.select("survey_response_id", "app_user_id", "ref_ts")
    pairs = _by_day(keys, hours).join(grid, ["app_user_id", "_day"]).where(
        (F.col("datetime") >= add_hours(F.col("ref_ts"), -hours)) & (F.col("datetime") < F.col("ref_ts"))
    )
    before = hours_between(F.col("datetime"), F.col("ref_ts"))
    return pairs.select("survey_response_id", before.alias("hours_before"), slot_of(before, mode).alias("hour_slot"), "value")


def _slot_columns(hours: int, fill: str | None, window: str | None = None) -> list[Column]:
    """``hour_0 ..``: a slot with rows sums them (missing values count 0); an
    empty slot is 0 under ``zero``, else NULL."""
    out = []
    for i in range(hours):
        total = f"coalesce(sum(CASE WHEN hour_slot = {i} THEN value END), 0.0D)"
        if fill != "zero":
            total = f"CASE WHEN count_if(hour_slot = {i}) > 0 THEN {total} END"
        if window is not None:
            total = f"CASE WHEN {window} > {i} THEN {total} END"
        out.append(F.expr(f"{total} AS hour_{i}"))
    return out


def lookback_slots(hourly: DataFrame, surveys: DataFrame, value: str, hours: int, standardized: bool = False,
                   reference_hour: int = REFERENCE_HOUR, mode: str = "rounded", fill: str | None = "zero",
                   keep: list[str] | None = None) -> DataFrame:
    """``hour_0 .. hour_{hours-1}`` per survey with at least one row in its window."""
    refs = reference_times(surveys, standardized, reference_hour)
    rows = slot_rows(hourly, refs, value, hours, mode)
    wide = rows.groupBy("survey_response_id").agg(*_slot_columns(hours, fill))
    return refs.select("survey_response_id", "app_user_id", "ref_ts", *(keep or [])).join(wide, "survey_response_id")


def multiwindow_slots(hourly: DataFrame, surveys: DataFrame, value: str, windows: list[int] | None = None,
                      standardized: bool = True, reference_hour: int = REFERENCE_HOUR, mode: str = "rounded",
                      fill: str | None = "zero", keep: list[str] | None = None) -> DataFrame:
    """One training row per (survey, window) that holds data, from one join at
    the longest window. Slots at or beyond the window are NULL."""
    windows = windows or TRAINING_WINDOWS
    refs = reference_times(surveys, standardized, reference_hour)
    rows = slot_rows(hourly, refs, value, max(windows), mode)
    inside = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: F.col("hours_before") <= w)
    rows = rows.withColumn("window_hours", F.explode(inside))
    cols = _slot_columns(max(windows), fill, "window_hours")
    wide = rows.groupBy("survey_response_id", "window_hours").agg(*cols)
    return refs.select("survey_response_id", "app_user_id", "ref_ts", *(keep or [])).join(wide, "survey_response_id")


def sequences(wide: DataFrame, hours: int, name: str = "sequence") -> DataFrame:
    """Slots as one array, oldest hour first, NULL as 0."""
    cells = [F.coalesce(F.col(f"hour_{i}"), F.lit(0.0)).cast("double") for i in reversed(range(hours))]
    return wide.withColumn(name, F.array(*cells))


# -------------------------------------------------------- category sessions


def exact_minutes() -> Column:
    """Minutes as decimals, so that sums do not depend on their order and equal totals are equal."""
    return F.col("total_time_minutes").cast(EXACT)


def usage_cells(sessions: DataFrame, bucket: Column) -> DataFrame:
    """Minutes per (user, bucket, category, app)."""
    return (
        sessions.where(F.col("app_user_id").isNotNull() & F.col("last_time_used").isNotNull())
        .groupBy("app_user_id", bucket.alias("bucket"), "app_category", "app_name")
        .agg(F.coalesce(F.sum(exact_minutes()), F.lit(0)).cast(EXACT).alias("minutes"))
    )


def aligned_usage(sessions: DataFrame, refs: DataFrame, hours: int) -> DataFrame:
    """Usage before references that sit on whole hours.

    Cells are half-open hours ``(h-1, h]``, so ``hour_age`` (0 for the hour
    ending at the reference) is exact without raw rows.
    """
    cells = usage_cells(sessions, hour_ceil(F.col("last_time_used"))).withColumn("_day", F.to_date("bucket"))
    pairs = _by_day(refs, hours).join(cells, ["app_user_id", "_day"])
    age = F.expr("cast((unix_micros(cast(ref_ts as timestamp)) - unix_micros(cast(bucket as timestamp))) div 3600000000L as int)")
    pairs = pairs.withColumn("hour_age", age).where(F.col("hour_age").between(0, hours - 1))
    return pairs.drop("_day", "bucket")


def edge_usage(sessions: DataFrame, refs: DataFrame, hours: int, edges: list[int]) -> DataFrame:
    """Usage in ``[ref_ts - hours, ref_ts]`` for references at any instant.

    Adds ``hours_before``: exact for the hours holding a window edge (read
    from raw rows), and a value strictly between the two neighbouring edges
    for all other hours (read from hourly sums). ``edges`` are the ages, in
    hours, at which windows begin or end.
    """
    edges = sorted({0, *edges})
    ref_hour = hour_floor(F.col("ref_ts"))
    cut_ages = F.array(*[F.lit(e) for e in edges])
    # Whole hours: hourly sums, met by day.
    cells = usage_cells(sessions, hour_floor(F.col("last_time_used"))).withColumn("_day", F.to_date("bucket"))
    whole = _by_day(refs, hours).join(cells, ["app_user_id", "_day"])
    age = hours_between(F.col("bucket"), ref_hour).cast("int")
    whole = whole.withColumn("_age", age).where(F.col("_age").between(1, hours - 1) & ~F.array_contains(cut_ages, F.col("_age")))
    whole = whole.withColumn("hours_before", F.col("_age").cast("double")).drop("_age", "_day", "bucket")
    # Hours cut by an edge: raw rows, met by hour.
    raw = sessions.where(F.col("app_user_id").isNotNull()).select(
        "app_user_id", hour_floor(F.col("last_time_used")).alias("_hour"), "last_time_used",
        "app_category", "app_name", exact_minutes().alias("minutes"),
    )
    cut = refs.withColumn("_age", F.explode(cut_ages)).withColumn("_hour", add_hours(ref_hour, -F.col("_age")))
    cut = cut.join(raw, ["app_user_id", "_hour"]).withColumn(
        "hours_before", hours_between(F.col("last_time_used"), F.col("ref_ts"))
    )
    cut = cut.where(F.col("hours_before").between(0, hours)).drop("_age", "_hour", "last_time_used")
    return whole.unionByName(cut)


def _with_empty(pairs: DataFrame, refs: DataFrame, piece: Column, name: str) -> DataFrame:
    """Add a blank row per reference so that references without usage survive the grouping."""
    blank = refs.withColumns(
        {
            name: piece,
            "app_category": F.lit(None).cast("string"),
            "app_name": F.lit(None).cast("string"),
            "minutes": F.lit(None).cast(EXACT),
            "_real": F.lit(0),
        }
    )
    return pairs.withColumn("_real", F.lit(1)).unionByName(blank)


def _per_category(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Minutes and app set per (keys, category); sets are bounded by the app vocabulary."""
    return pairs.groupBy(*keys, "app_category").agg(
        F.coalesce(F.sum("minutes").cast("double"), F.lit(0.0)).alias("minutes"),
        F.collect_set("app_name").alias("apps"),
        F.max("_real").alias("_real"),
    )


def _top() -> Column:
    """Largest category by minutes (ties by name), missing categories ignored."""
    entry = F.struct((-F.round("minutes", 6)).alias("neg"), F.col("app_category").alias("category"), F.col("minutes").alias("minutes"))
    return F.min(F.when(F.col("app_category").isNotNull(), entry))


def _app_count() -> Column:
    return F.size(F.array_distinct(F.flatten(F.collect_list("apps"))))


def subwindow_rows(sessions: DataFrame, refs: DataFrame, lookback: int, size: int, aligned: bool,
                   method: str = "pairs") -> DataFrame:
    """Long sub-window features, one row per (survey, piece) with usage, plus one row with
    ``piece`` NULL for every survey in the ``pairs`` method.

    ``method`` is the caller's choice and never follows from the data: ``pairs`` joins references
    with the usage of their window, ``prefix`` reads running sums, linear in rows and references
    however dense a user is. Both sum decimals and give the same values.
    """
    _check_method(method)
    pieces = lookback // size
    keys = refs.select("survey_response_id", "app_user_id", "ref_ts")
    group = ["survey_response_id", "piece"]
    if aligned:
        pairs = aligned_usage(sessions, keys, pieces * size).withColumn("piece", F.floor(F.col("hour_age") / size).cast("int"))
        pairs = _with_empty(pairs.drop("hour_age"), keys, F.lit(None).cast("int"), "piece")
        return _per_category(pairs, group).groupBy(*group).agg(_top().alias("_top"), _app_count().alias("num_apps"))
    if method == "prefix":
        spans = [Interval(i, size * i, size * (i + 1), closed=False) for i in range(pieces)]
        lists = interval_lists(sessions, keys, ["survey_response_id"], spans)
        cells = [f"struct({i} AS piece, array_min({_entries(i)}) AS _top, a{i} AS num_apps)" for i in range(pieces)]
        filled = lists.select("survey_response_id", F.expr(f"inline(array({', '.join(cells)}))"))
        return keys.select("survey_response_id").join(filled, "survey_response_id", "left")
    pairs = edge_usage(sessions, keys, pieces * size, [size * i for i in range(pieces + 1)])
    pairs = pairs.withColumn("piece", F.floor(F.col("hours_before") / size).cast("int")).drop("hours_before")
    pairs = _with_empty(pairs.where(F.col("piece") < pieces), keys, F.lit(None).cast("int"), "piece")
    return _per_category(pairs, group).groupBy(*group).agg(_top().alias("_top"), _app_count().alias("num_apps"))


def _check_method(method: str) -> None:
    if method not in ("pairs", "prefix"):
        raise ValueError(f"unknown method {method!r}; use pairs or prefix")


def _entries(name: int) -> str:
    """SQL: the used categories of an interval as (negated rounded minutes, name, minutes)."""
    return f"""transform(
        filter(_cats, c -> c.n{name} > 0 AND c.app_category IS NOT NULL),
        c -> struct(-round(c.m{name}, 6) AS neg, c.app_category AS category, cast(c.m{name} AS DOUBLE) AS minutes))"""


def subwindow_features(sessions: DataFrame, surveys: DataFrame, lookback: int = 12, size: int = 3,
                       standardized: bool = True, reference_hour: int = REFERENCE_HOUR,
                       keep: list[str] | None = None, method: str = "pairs") -> DataFrame:
    """Top category, its minutes and distinct apps for each piece of the
    lookback; piece ``i`` covers ``(t-(i+1)s, t-i*s]``. Every survey is kept."""
    refs = reference_times(surveys, standardized, reference_hour)
    rows = subwindow_rows(sessions, refs, lookback, size, standardized, method)
    cols = []
    for i in range(lookback // size):
        cols += [
            F.expr(f"max(CASE WHEN piece = {i} THEN _top.category END) AS most_used_category_sw{i}"),
            F.expr(f"coalesce(max(CASE WHEN piece = {i} THEN _top.minutes END), 0.0D) AS most_used_category_time_sw{i}"),
            F.expr(f"coalesce(max(CASE WHEN piece = {i} THEN num_apps END), 0) AS num_apps_sw{i}"),
        ]
    wide = rows.groupBy("survey_response_id").agg(*cols)
    return refs.select("survey_response_id", "app_user_id", "ref_ts", *(keep or [])).join(wide, "survey_response_id")


def normalized_entropy(shares: Column) -> Column:
    """Entropy of an array of amounts over ``ln(n)``; 0 for one or no amount, or a zero total."""
    total = F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x)
    plogp = F.aggregate(
        shares, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, (x / total) * F.ln(x / total)).otherwise(0.0)
    )
    return F.when((F.size(shares) > 1) & (total > 0), -plogp / F.ln(F.size(shares).cast("double")) + 0.0).otherwise(0.0)


def _prefix_profile(sessions: DataFrame, refs: DataFrame, windows: list[int]) -> DataFrame:
    keys = refs.columns
    lists = interval_lists(sessions, refs, keys, [Interval(w, 0, w, closed=True) for w in windows])
    empty = F.expr("cast(array() AS " + lists.schema["_cats"].dataType.simpleString() + ")")
    lists = refs.join(lists, keys, "left").withColumn("_cats", F.coalesce("_cats", empty)).na.fill(0, [f"a{w}" for w in windows])
    names = [f"a{w}" for w in windows]
    return _window_profiles(lists, windows, f"CASE window_hours {' '.join(f'WHEN {w} THEN a{w}' for w in windows)} END").drop(*names)


def _pair_profile(sessions: DataFrame, refs: DataFrame, windows: list[int]) -> DataFrame:
    keys = refs.columns
    pairs = edge_usage(sessions, refs, windows[-1], windows)
    ring = F.lit(None).cast("int")
    for w in reversed(windows):
        ring = F.when(F.col("hours_before") <= w, w).otherwise(ring)
    pairs = _with_empty(pairs.withColumn("ring", ring).drop("hours_before"), refs, F.lit(windows[0]), "ring")
    # Place each event's pairs together once; both groupings below start with
    # the event and reuse that placement. The lists are bounded by the
    # category and app vocabularies.
    cats = pairs.repartition(*keys).groupBy(*keys, "app_category").agg(
        *[F.expr(f"cast(coalesce(sum(CASE WHEN ring <= {w} THEN minutes END), 0) AS {EXACT}) AS m{w}") for w in windows],
        *[F.expr(f"count_if(ring <= {w} AND _real = 1) AS n{w}") for w in windows],
        F.collect_set(F.when(F.col("app_name").isNotNull(), F.struct("app_name", "ring"))).alias("apps"),
    )
    amounts = [f"{kind}{w}" for w in windows for kind in ("m", "n")]
    per_event = cats.groupBy(*keys).agg(
        F.collect_list(F.struct("app_category", *amounts)).alias("_cats"), F.flatten(F.collect_list("apps")).alias("_apps")
    )
    used_apps = "size(array_distinct(transform(filter(_apps, a -> a.ring <= window_hours), a -> a.app_name)))"
    return _window_profiles(per_event, windows, used_apps).drop("_apps")


def category_windows(sessions: DataFrame, events: DataFrame, windows: list[int] | None = None,
                     method: str = "pairs") -> DataFrame:
    """Category profile of ``[t-W, t]`` for each submission event and window.
    ``method`` as in ``subwindow_rows``.

    ``events`` holds ``screentime_id, app_user_id, ref_ts``. Long form: one
    row per (event, window), also when the window is empty.
    """
    windows = sorted(windows or CATEGORY_WINDOWS)
    keys = ["screentime_id", "app_user_id", "ref_ts"]
    _check_method(method)
    refs = events.select(*keys).distinct()
    profile = _prefix_profile(sessions, refs, windows) if method == "prefix" else _pair_profile(sessions, refs, windows)
    top = F.get(F.col("_r"), F.lit(0))
    top_time = F.coalesce(top["minutes"], F.lit(0.0))
    out = {
        "most_used_category": top["category"],
        "most_used_category_time": top_time,
        "num_categories_used": F.size("_r"),
        "category_diversity": normalized_entropy(F.transform("_r", lambda e: e["minutes"])),
        "most_used_category_proportion": F.when(
            F.col("data_available") == 1,
            F.when(F.col("total_screentime") > 0, top_time / F.col("total_screentime")).otherwise(0.0),
        ),
    }
    for i in range(3):
        out[f"category_rank_{i + 1}"] = F.get(F.col("_r"), F.lit(i))["category"]
        out[f"category_rank_{i + 1}_time"] = F.get(F.col("_r"), F.lit(i))["minutes"]
    return profile.withColumns(out).drop("_r")


def _window_profiles(lists: DataFrame, windows: list[int], apps: str) -> DataFrame:
    """A row for each event and window: totals, distinct apps and ranked categories. The window is a column, so that a
    query pays only for the figures that it reads."""
    pick = lambda kind: f"CASE window_hours {' '.join(f'WHEN {w} THEN c.{kind}{w}' for w in windows)} END"
    rows = lists.withColumn("window_hours", F.explode(F.array(*[F.lit(w) for w in windows])))
    rows = rows.withColumn("_at", F.expr(f"transform(_cats, c -> struct(c.app_category AS category, {pick('m')} AS m, {pick('n')} AS n))"))
    return rows.withColumns({
        "total_screentime": F.expr(f"cast(aggregate(_at, cast(0 AS {EXACT}), (total, c) -> cast(total + c.m AS {EXACT})) AS DOUBLE)"),
        "num_apps_used": F.expr(apps),
        "data_available": F.expr("int(exists(_at, c -> c.n > 0))"),
        "_r": F.expr("""array_sort(transform(filter(_at, c -> c.n > 0 AND c.category IS NOT NULL),
            c -> struct(-round(c.m, 6) AS neg, c.category AS category, cast(c.m AS DOUBLE) AS minutes)))"""),
    }).drop("_at", "_cats")


# -------------------------------------------------------------------- sweep


def sweep_pairs(spark, max_lookback: int) -> DataFrame:
    """Every (lookback, sub-window) with the sub-window dividing the lookback."""
    lookbacks = spark.range(1, max_lookback + 1).select(F.col("id").cast("int").alias("lookback_hours"))
    sizes = lookbacks.withColumn("subwindow_hours", F.explode(F.sequence(F.lit(1), F.col("lookback_hours"))))
    return sizes.where(F.col("lookback_hours") % F.col("subwindow_hours") == 0)


def sweep_pieces(sessions: DataFrame, surveys: DataFrame, max_lookback: int = 30, reference_hour: int = REFERENCE_HOUR) -> DataFrame:
    """``(survey_response_id, subwindow_hours, piece, _top, num_apps)`` for every sub-window size up to the longest
    lookback, pieces with usage only. A piece depends on the size and its index, so it serves all lookbacks.

    Usage holds one row for each (survey, hour, category, app). A survey's rows are bounded by the lookback and the
    vocabularies; they are shuffled once, as one list, and all sizes are read from it."""
    refs = reference_times(surveys, True, reference_hour).select("survey_response_id", "app_user_id", "ref_ts")
    usage = aligned_usage(sessions, refs, max_lookback)
    lists = usage.groupBy("survey_response_id").agg(F.collect_list(F.struct("hour_age", "app_category", "app_name", "minutes")).alias("u"))
    minutes = "cast(aggregate(filter(own, e -> e.app_category = c), cast(0 AS decimal(34,12)), (t, e) -> cast(t + e.minutes AS decimal(34,12))) AS double)"
    piece = f"""transform(array(filter(u, e -> e.hour_age div s = p)), own -> struct(s AS subwindow_hours, p AS piece,
        array_min(transform(array_distinct(transform(filter(own, e -> e.app_category IS NOT NULL), e -> e.app_category)),
            c -> transform(array({minutes}), m -> struct(-round(m, 6) AS neg, c AS category, m AS minutes))[0])) AS _top,
        size(array_distinct(transform(filter(own, e -> e.app_name IS NOT NULL), e -> e.app_name))) AS num_apps))[0]"""
    used = f"array_distinct(transform(filter(u, e -> (e.hour_age div s + 1) * s <= {max_lookback}), e -> cast(e.hour_age div s AS int)))"
    return lists.select("survey_response_id", F.expr(f"inline(flatten(transform(sequence(1, {max_lookback}), s -> transform({used}, p -> {piece}))))"))


def sweep_features(sessions: DataFrame, surveys: DataFrame, max_lookback: int = 30,
                   reference_hour: int = REFERENCE_HOUR) -> DataFrame:
    """Sub-window features of every sweep pair from one join at the longest lookback.

    A piece is computed once per size and then repeated for the lookbacks it divides. Long form, pieces with
    usage only.
    """
    per_size = sweep_pieces(sessions, surveys, max_lookback, reference_hour)
    multiples = F.sequence((F.col("piece") + 1) * F.col("subwindow_hours"), F.lit(max_lookback), F.col("subwindow_hours"))
    return per_size.withColumn("lookback_hours", F.explode(multiples)).select(
        "survey_response_id", "lookback_hours", "subwindow_hours", "piece",
        F.col("_top.category").alias("most_used_category"),
        F.coalesce(F.col("_top.minutes"), F.lit(0.0)).alias("most_used_category_time"),
        "num_apps",
    )


def sweep_vectors(sessions: DataFrame, surveys: DataFrame, levels: list[str], max_lookback: int = 30,
                  reference_hour: int = REFERENCE_HOUR) -> DataFrame:
    """``(survey_response_id, subwindow_hours, x)`` for every survey and size: piece by piece its minutes, its apps
    and one 0/1 number for each level but the first; zeros where there was no usage. The features of a pair are the
    first ``lookback / size`` pieces."""
    pieces = sweep_pieces(sessions, surveys, max_lookback, reference_hour)
    cells = [F.coalesce(F.col("_top.minutes"), F.lit(0.0)), F.col("num_apps").cast("double"),
             *[F.coalesce((F.col("_top.category") == v).cast("double"), F.lit(0.0)) for v in levels[1:]]]
    filled = pieces.groupBy("survey_response_id", "subwindow_hours").agg(
        F.map_from_entries(F.collect_list(F.struct("piece", F.array(*cells)))).alias("held"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(max_lookback)))
    every = surveys.select("survey_response_id").withColumn("subwindow_hours", sizes).join(filled, ["survey_response_id", "subwindow_hours"], "left")
    blank = F.array_repeat(F.lit(0.0), len(cells))
    numbers = F.expr(f"sequence(0, {max_lookback} div subwindow_hours - 1)")
    return every.select("survey_response_id", "subwindow_hours",
                        F.flatten(F.transform(numbers, lambda i: F.coalesce(F.col("held")[i], blank))).alias("x"))


def sweep_few(sessions: DataFrame, surveys: DataFrame, levels: list[str], max_lookback: int = 30, reference_hour: int = REFERENCE_HOUR) -> DataFrame:
    """``sweep_vectors`` by the numbers that are not 0: ``at`` has their places, ascending, ``x`` the numbers. A survey
    without usage in a size's pieces has no row."""
    pieces = sweep_pieces(sessions, surveys, max_lookback, reference_hour)
    start, level = F.col("piece") * (len(levels) + 1), F.array_position(F.array(*[F.lit(v) for v in levels[1:]]), F.col("_top.category")).cast("int")
    cells = F.array(F.struct(start.alias("at"), F.coalesce(F.col("_top.minutes"), F.lit(0.0)).alias("v")),
                    F.struct((start + 1).alias("at"), F.col("num_apps").cast("double").alias("v")),
                    F.struct((start + 1 + F.coalesce(level, F.lit(0))).alias("at"), (level > 0).cast("double").alias("v")))
    held = F.array_sort(F.flatten(F.collect_list(F.filter(cells, lambda c: c["v"] != 0))))
    rows = pieces.groupBy("survey_response_id", "subwindow_hours").agg(held.alias("_held"))
    return rows.select("survey_response_id", "subwindow_hours", F.col("_held.at").alias("at"), F.col("_held.v").alias("x"))


def sweep_coverage(sessions: DataFrame, surveys: DataFrame, max_lookback: int = 30,
                   reference_hour: int = REFERENCE_HOUR) -> DataFrame:
    """The sweep grid with, per pair, its piece count, the surveys with usage and the pieces filled."""
    spark = sessions.sparkSession
    pieces = sweep_pieces(sessions, surveys, max_lookback, reference_hour)
    # A survey has data in a pair if its first piece lies in the lookback: no survey is counted twice.
    held = pieces.groupBy("survey_response_id", "subwindow_hours").agg(F.collect_list("piece").alias("_held"))
    cells = held.select("subwindow_hours", F.array_min("_held").alias("_first"), F.explode("_held").alias("piece"))
    cells = cells.groupBy("subwindow_hours", "piece").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("piece") == F.col("_first")).alias("firsts"))
    multiples = F.sequence((F.col("piece") + 1) * F.col("subwindow_hours"), F.lit(max_lookback), F.col("subwindow_hours"))
    filled = cells.withColumn("lookback_hours", F.explode(multiples)).groupBy("lookback_hours", "subwindow_hours").agg(
        F.sum("firsts").alias("surveys_with_data"), F.sum("n").alias("pieces_filled")
    )
    grid = sweep_pairs(spark, max_lookback).withColumn(
        "n_subwindows", F.expr("cast(lookback_hours div subwindow_hours as int)")
    )
    return grid.join(filled, ["lookback_hours", "subwindow_hours"], "left").na.fill(0, ["surveys_with_data", "pieces_filled"])
