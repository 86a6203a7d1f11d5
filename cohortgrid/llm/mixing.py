"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected copies are its source's target over its
source's size (times a relative weight, if one is given): the whole part is certain, the rest is its inclusion
probability p. Documents are ranked by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and
the lowest ranks get one more copy until the source's words are as near its target as they come.

Ranks are not found by sorting a source: the rank statistic is cut into buckets of about ``BUCKET`` documents,
bucket totals are summed in order (one row per bucket), and rows are ordered within their bucket only.

Edge cases: a null source is a source of its own, the last; a null or empty text has size 0 and takes no words;
the random number depends on the seed and the id alone, so reruns agree, repeated rows share it and ties go by
id, then size. An empty table gives an empty result. Columns that bear a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, query, stored, table, unit

BUCKET = 2000
MAX_COPIES = 3
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
RESULTS = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share all words. A source stops at
    ``max_copies`` times its size. The level at which the excess is reshared until none is above is found by
    taking sources in order of cap over weight: a source is capped if its fair share of what the sources
    before it left is above its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    out = sizes.withColumns({"weight": weight, "cap": max_copies * F.col("source_size")})
    out = out.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    out = out.withColumn("level", level).withColumn("capped", F.col("cap") < F.col("weight") * F.col("level"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return out.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * final).alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, weight: Column | None = None, max_copies: int = MAX_COPIES,
        seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted).

    ``weight``: a positive column that raises or lowers a document's expected copies within its source.
    """
    rows = docs.drop(*RESULTS).withColumns({
        "size": n_words(text), "_w": F.lit(1.0) if weight is None else weight.cast("double"), "_u": unit(F.lit(seed), F.col(doc_id))})
    per = rows.groupBy(F.col(source).alias("source")).agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_n"), F.sum(F.col("_w") * F.col("size")).alias("_ws"))
    per = stored(per, "mix-sources")
    goal = targets(per.select("source", "source_size"), weights, max_copies)
    per = per.alias("p").join(goal.alias("g"), F.expr("p.source <=> g.source")).select(
        F.col("p.source").alias("_source"), "p._n", "p._ws", "g.source_size", "g.target")
    # Expected copies, the certain part of them, and the odds of the rest.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    expected = F.least(F.lit(float(max_copies)), ratio * F.col("_w") / F.when(
        F.col("_ws") > 0, F.col("_ws") / F.col("source_size")).otherwise(F.lit(1.0)))
    usual = ratio - F.floor(ratio)
    rows = rows.join(per, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_e", expected)
    rows = rows.withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole"))
    odds, some = F.col("_p") / (1 - F.col("_p")), F.col("_p") > 0
    rows = rows.withColumn("_q", F.when(some, F.col("_u") / (1 - F.col("_u")) / odds))
    # A place in (0, 1) that rises with the rank and is even when weights are: the bucket comes from it. Documents
    # without a rank, as all of a capped source, are spread by their random number; they take no words from it.
    scaled = F.col("_q") * F.when(usual > 0, usual / (1 - usual)).otherwise(F.lit(1.0))
    rows = rows.withColumn("_bucket", F.floor(F.coalesce(scaled / (1 + scaled), F.col("_u")) * F.ceil(F.col("_n") / BUCKET)))
    light = rows.select(F.col(source).alias("_source"), "_bucket", "size", "_p", "_whole", "target")
    sums = stored(light.groupBy("_source", "_bucket").agg(
        F.sum(F.when(some, F.col("size")).otherwise(F.lit(0))).alias("_words"),
        F.sum(F.col("_whole") * F.col("size")).alias("_certain"), F.first("target").alias("target")), "mix-buckets")
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_source").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"),
        (F.col("target") - F.sum("_certain").over(Window.partitionBy("_source"))).alias("_rest"))
    rows = rows.join(offsets, F.col(source).eqNullSafe(F.col("_s")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    within = Window.partitionBy("_s", "_b").orderBy("_q", doc_id, "size")
    upto = F.sum(F.when(some, F.col("size"))).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The last document taken is the one whose middle still lies below the rest.
    middle = F.col("_ahead") + upto - F.col("size") / 2
    copies = F.col("_whole") + F.when(some & (middle <= F.col("_rest")), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("int"))
    return rows.select(*[c for c in docs.columns if c not in RESULTS], "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that the mix takes. Documents without words have no copy."""
    return mixed.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  (('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight,
             {MAX_COPIES} * source_size AS cap, (SELECT sum(source_size) FROM s)::BIGINT AS total FROM s),
o AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap < weight * level THEN cap::DOUBLE
             ELSE weight * (SELECT max(level) FROM o WHERE NOT cap < weight * level) END AS target FROM o),
e AS (SELECT d.*, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle,
             target - whole * source_size AS rest FROM e),
c AS (SELECT *, whole + CASE WHEN ratio > whole AND middle <= rest THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM c"""


@query("op5_mix_sources", ORACLE)
def op5_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
