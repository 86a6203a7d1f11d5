"""SimHash near-duplicates by tiled exact comparison.

Every distinct fingerprint falls into a cell by the population counts of its four 16-bit parts. The bits by
which two fingerprints differ are at least the sum of the differences of these counts, so cells further apart
than the radius are skipped; within a cell fingerprints are cut into tiles of about ``TILE``. Tile pairs meet
by an equi-join on the cell, with the neighbouring cells of a tile listed by rule, and are compared in numpy
by exclusive-or and bit counts. A tile pair reports a spanning forest of its links, never all pairs of a
group, and components are found over distinct fingerprints. The comparison is exact at any size; what remains
quadratic is the part of pairs that the counts can't tell apart (about a twentieth).

Edge cases: a null text or one without words has fingerprint 0 and is linked like any other; equal texts share
a fingerprint, so copies cost nothing; null ids are kept, with a component found from their fingerprint; very
long texts are hashed in slices; an empty table gives an empty result. ``fingerprints`` keeps id and text key
only, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, query, stored, table

SHINGLE = 3
RADIUS = 3
TILE = 2048
SLICE = 1 << 15
PARTS = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; each is the majority of that bit over the XXH64 of the text's word shingles, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(parts) - shingle + 1)
    starts, ends = (ends - sizes)[:n].tolist(), ends[len(parts) - n:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        hashes = [xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts[at: at + SLICE], ends[at: at + SLICE])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Positions of links (a, b) that connect all that the links connect: each round, every part not yet
    joined keeps one link to another part."""
    part, kept = np.arange(n), []
    at = np.arange(len(a))
    while True:
        pa_, pb = part[a[at]], part[b[at]]
        at = at[pa_ != pb]
        if not len(at):
            return np.unique(np.concatenate(kept)) if kept else at
        high, low = np.maximum(part[a[at]], part[b[at]]), np.minimum(part[a[at]], part[b[at]])
        order = np.lexsort((low, high))
        first = order[np.unique(high[order], return_index=True)[1]]
        kept.append(at[first])
        up = np.arange(n)
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        part = up[part]


def linked(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a forest of the links between two tiles (or within one)."""
    rows, cols = [], []
    for at in range(0, len(x), 256):
        near = np.bitwise_count(x[at: at + 256, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(near)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if len(i) > 2 * len(y):
            keep = _forest(i, len(x) + j, len(x) + len(y)) if not same else _forest(i + at, j, len(y))
            i, j = i[keep], j[keep]
        rows.append(i + at)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    keep = _forest(i, j if same else len(x) + j, len(x) + len(y))
    return x[i[keep]], y[j[keep]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: links between the distinct longs ``fp`` of ``prints`` that differ in 1 to ``radius`` bits and
    connect all that do."""
    spark = prints.sparkSession
    counts = [F.bit_count(F.shiftright("fp", 16 * i).bitwiseAND(0xFFFF)).cast("int") for i in range(PARTS)]
    rows = prints.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    cell = [f"c{i}" for i in range(PARTS)]
    sizes = rows.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).alias("n"))  # at most 17**4 cells
    rows = rows.join(sizes, cell).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n")))
    # A tile is a sorted list of at most a few thousand longs.
    tiles = stored(rows.groupBy(*cell, "tile").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles")
    steps = [d for d in np.ndindex(*[2 * radius + 1] * PARTS) if sum(abs(x - radius) for x in d) <= radius]
    steps = [tuple(int(x) - radius for x in d) for d in steps]
    steps = [d for d in steps if d >= (0,) * PARTS]  # each pair of cells once
    near = F.array(*[F.struct(*[(F.col(f"c{i}") + s).alias(f"d{i}") for i, s in enumerate(d)]) for d in steps])
    left = tiles.select(*cell, F.col("tile").alias("t"), F.col("fps").alias("x"), F.explode(near).alias("d"))
    left = left.select(*[F.col(f"d.d{i}").alias(f"d{i}") for i in range(PARTS)], "t", "x",
                       F.struct(*cell).alias("own")).where(" AND ".join(f"d{i} BETWEEN 0 AND 16" for i in range(PARTS)))
    right = tiles.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(cell)], F.col("tile").alias("u"), F.col("fps").alias("y"))
    same_cell = F.expr("own = struct(d0 AS c0, d1 AS c1, d2 AS c2, d3 AS c3)")
    pairs = left.join(right, [f"d{i}" for i in range(PARTS)]).where(~same_cell | (F.col("t") <= F.col("u"))).select(
        "x", "y", (same_cell & (F.col("t") == F.col("u"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            xs, ys = (c.values.to_numpy().view(np.uint64) for c in (x, y))
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            ends = [linked(xs[xo[k]: xo[k + 1]], ys[yo[k]: yo[k + 1]], radius, same)
                    for k, same in enumerate(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([e[i] for e in ends]).view(np.int64) if ends else [], pa.int64()) for i in (0, 1)],
                ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row; component_id: the smallest id that is reachable."""
    prints = stored(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    classed = distinct.join(roots, distinct.fp == roots.id, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classed.join(whole, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
