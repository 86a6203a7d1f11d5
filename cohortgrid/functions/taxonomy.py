"""App-name to category rules and the category dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Package names with a hand-set category.
EXACT_APPS = {
    "com.ss.android.ugc.trill": "SOCIAL",
    "com.mobile.legends": "GAMES",
    "app.revanced.android.youtube": "VIDEO_PLAYERS",
    "com.rubenmayayo.reddit": "SOCIAL",
}

# First matching keyword group decides; order matters.
KEYWORD_CATEGORIES = [
    ("COMMUNICATION", ["dialer", "contacts", "messaging", "incallui", "telecom", "phone"]),
    ("PHOTOGRAPHY", ["camera", "gallery", "photo", "screenshot", "photopicker", "markup"]),
    ("VIDEO_PLAYERS", ["videoplayer", "video", "smartmirroring"]),
    ("MUSIC_AND_AUDIO", ["soundrecorder", "dolby", "music"]),
    ("WEATHER", ["weather"]),
    ("MAPS_AND_NAVIGATION", ["compass", "navigation", "location"]),
    ("PRODUCTIVITY", ["calculator", "clock", "deskclock", "notes", "reminder", "calendar"]),
    ("HEALTH_AND_FITNESS", ["health", "fitness", "wellbeing"]),
    ("FINANCE", ["wallet", "mwallet", "finance"]),
    ("PERSONALIZATION", ["launcher", "theme", "wallpaper", "aod", "dressroom"]),
]

# Vendor package prefixes that mark system tools.
SYSTEM_PREFIXES = ["com.android", "com.google.android", "com.samsung", "com.miui",
                   "com.oplus", "com.vivo", "com.motorola", "com.xiaomi"]


def rule_category(app_name: Column, study_app: str | None = None) -> Column:
    """Category by rule. ``study_app`` is a keyword naming the study's own app,
    which ranks before every keyword group and counts as health and fitness."""
    lowered = F.lower(app_name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, category in EXACT_APPS.items():
        out = out.when(app_name == name, category)
    groups = [("HEALTH_AND_FITNESS", [study_app.lower()])] if study_app else []
    for category, words in groups + KEYWORD_CATEGORIES:
        out = out.when(lowered.rlike("|".join(words)), category)
    prefixes = "|".join(p.replace(".", r"\.") for p in SYSTEM_PREFIXES)
    return out.when(lowered.rlike(f"^({prefixes})"), "TOOLS").otherwise("UNKNOWN")


def collapse_games(category: Column) -> Column:
    return F.when(category.startswith("GAME_"), "GAMES").otherwise(category)


def resolve_categories(names: DataFrame, dimension: DataFrame | None = None,
                       study_app: str | None = None) -> DataFrame:
    """``app_name -> app_category`` for distinct names: dimension hit, else rules."""
    if dimension is None:
        found = names.withColumn("_hit", F.lit(None).cast("string"))
    else:
        found = names.join(
            dimension.select("app_name", F.col("app_category").alias("_hit")), "app_name", "left"
        )
    chosen = F.coalesce(F.col("_hit"), rule_category(F.col("app_name"), study_app))
    return found.select("app_name", collapse_games(chosen).alias("app_category"))


def categorize_apps(df: DataFrame, dimension: DataFrame | None = None,
                    study_app: str | None = None) -> DataFrame:
    """Add ``app_category``. The rules run once per distinct name.

    The name table joins back without a broadcast hint: AQE broadcasts it
    when its measured size is small and splits a hot name otherwise.
    """
    names = df.select("app_name").where(F.col("app_name").isNotNull()).distinct()
    return df.join(resolve_categories(names, dimension, study_app), "app_name", "left")


def upsert_dimension(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """The dimension plus rule categories for names it lacks."""
    fresh = names.select("app_name").where(F.col("app_name").isNotNull()).distinct()
    fresh = fresh.join(dimension.select("app_name"), "app_name", "left_anti")
    return dimension.select("app_name", "app_category").unionByName(resolve_categories(fresh))
