"""Helpers shared by the operators: settings, scratch tables, words, numpy hashing, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than these six ASCII blanks. ``bytes.split()`` splits on the same six.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts may be long: few rows per Arrow batch keep a Python worker's memory small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tuned(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on, and let Python workers find this package where it is not installed."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder in the storage that driver and executors share: ``spark.checkpoint.dir``, or the
    warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows depends on files, not on executors, and the shuffle files of the write are freed at its end.
    """
    spark = df.sparkSession
    path = scratch(spark, purpose)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def words(text: Column | str) -> Column:
    """Array of a text's words; empty for a null text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unit(*of: Column | str) -> Column:
    """A reproducible number in (0, 1): 52 bits of MD5, so that other engines can form it too."""
    digits = F.substring(F.md5(F.concat_ws("|", *of)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


# ---------------------------------------------------------------- numpy inside tasks

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 17
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i up to n."""
    held = _POWERS.get(int(base))
    if held is None or len(held[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        both = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        held = _POWERS[int(base)] = (both[0], both[1])
    return held


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts with their numbers in lists of about ``CHUNK`` bytes; longer texts are cut at blanks."""
    held, numbers, size = [], [], 0
    for k, text in enumerate(texts):
        while text:
            cut = len(text)
            if cut > 2 * CHUNK:
                cut = max(text.rfind(bytes([b]), CHUNK, 2 * CHUNK) for b in BLANKS.encode())
                cut = cut if cut > 0 else len(text)
            held.append(text[:cut])
            numbers.append(k)
            size += cut
            text = text[cut:]
            if size >= CHUNK:
                yield held, numbers
                held, numbers, size = [], [], 0
    if held:
        yield held, numbers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, one after another, and each word's text number.

    Texts are taken in chunks, so that working memory does not follow their length."""
    found, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for held, numbers in _pieces(texts):
        sizes = np.fromiter((len(t) + 1 for t in held), np.int64, len(held))
        a = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        inside = np.concatenate(([False], ~_BLANK[a]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[0::2], turns[1::2]
        up, down = _powers(_P, len(a))
        sums = np.empty(len(a) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
        found.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        owners.append(np.array(numbers)[np.searchsorted(np.cumsum(sizes), starts, side="right")])
    return np.concatenate(found), np.concatenate(owners)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` consecutive words."""
    out = [np.empty(0, np.uint64)]
    for at in range(0, len(hashes) - n + 1, CHUNK):
        part = hashes[at: at + CHUNK + n - 1]
        up, down = _powers(_Q, len(part))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)))
        out.append(mixed((sums[n:] - sums[:-n]) * down[: len(part) - n + 1]))
    return np.concatenate(out)


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every end of ``links (a, b)``; root: the smallest id that is reachable.

    Alternates the large-star and small-star steps of Kiveris et al. Each step is a grouped minimum and a
    join, both on shuffled rows, and is written to shared storage; hubs are pre-aggregated by the minimum
    and split by AQE in the join. Nulls and loops link nothing.
    """
    edges = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .distinct(), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = stored(small, "links")
        same = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, after)]
        dropped(edges)
        dropped(large)
        edges = after
        if same[0] == same[1]:
            roots = edges.select(F.col("v").alias("id")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                roots.select("id", F.col("id").alias("root")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB text where SQL can express it."""

    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
