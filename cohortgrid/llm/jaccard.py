"""Near-duplicates by Jaccard similarity of word shingles: fingerprints propose groups, shingle sets decide.

Nodes are distinct texts. Proposals come from SimHash (``simhash.links`` over fingerprints of the same shingles), and,
since its three bits reach only part of the texts at similarity 0.8, from MinHash bands: each node has ``BANDS`` keys of ``ROWS`` minima each of its shingles' hashes; texts that
share a key are a bucket. At similarity 0.8 a pair shares no bucket with a chance of (1 - 0.8**4)**32, about
5e-8. A pair that is proposed is decided by its whole shingle sets, so no pair below the bar is linked.

No pair is ever a row. Every member of a bucket is linked to the bucket's smallest node, which gives, with the links
of fingerprints, candidate components; near-duplicates can only lie within one. A component's nodes go to classes by their number of shingles,
each class 1.25 times the one before, and big classes to tiles of about ``TILE`` nodes by hash. At similarity 0.8 a
pair's classes are equal or neighbours, so a tile meets the tiles of its class and the next only. Inside a task a
pair of tiles is compared whole and exactly: the shingles that both sides hold are the columns of two 0/1 matrices,
whose product counts what each pair shares. A spanning forest of the links goes out, at most one row for each node
of a pair of tiles, so rows grow with nodes times tiles, never with pairs. Small comparisons share a task.

Edge cases: texts of fewer words than a shingle have one shingle, their words; null and empty texts are alike;
letters are compared without ASCII case; equal texts are one node, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, dropped, mixed, stored, window_hashes, word_hashes

SHINGLE = 5
LEAST = (4, 5)  # similarity of 0.8 as a fraction
BANDS, ROWS = 32, 4
SLICE = 1 << 13
TILE = 2048
COLUMNS = 4096


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's word shingles."""
    words, _ = word_hashes([(text or "").encode().lower()])
    return np.unique(window_hashes(words, max(1, min(shingle, len(words)))))


SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: a hash of its minima and its number."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE):
        # The upper halves of odd multiples, after a shift that mixes them, are in random order.
        x = hashes[at: at + SLICE]
        for k, seed in enumerate(SEEDS):
            y = (x ^ seed) * seed
            low[k] = min(low[k], (y ^ (y >> np.uint64(32))).min())
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys ^ low[k::ROWS])
    return keys


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``a`` has in common with each of ``b``; arrays hold distinct values."""
    out = np.zeros((len(a), len(b)), np.float32)
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    sides = []
    for arrays in (a, b):
        row = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        flat = np.concatenate(arrays)
        at = np.searchsorted(both, flat)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == flat[ok]
        order = np.argsort(at[ok], kind="stable")
        sides.append((row[ok][order], at[ok][order]))
    for first in range(0, len(both), COLUMNS):
        grids = []
        for (row, at), n in zip(sides, out.shape):
            p, q = np.searchsorted(at, (first, first + COLUMNS))
            grid = np.zeros((n, min(COLUMNS, len(both) - first)), np.float32)
            grid[row[p:q], at[p:q] - first] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def forest(near: np.ndarray, one: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links ``near[i, j]``; ``one``: rows and columns are the same nodes."""
    rows, columns = near.shape
    seen_rows, seen_columns, links = np.zeros(rows, bool), np.zeros(columns, bool), []
    for start in range(rows):
        if seen_rows[start]:
            continue
        seen_rows[start] = True
        if one:
            seen_columns[start] = True
        stack = [(0, start)]
        while stack:
            side, i = stack.pop()
            if side == 0:
                new = np.flatnonzero(near[i] & ~seen_columns).tolist()
                links += [(i, j) for j in new]
                seen_columns[new] = True
                if one:
                    seen_rows[new] = True
                stack += [(0 if one else 1, j) for j in new]
            else:
                new = np.flatnonzero(near[:, i] & ~seen_rows).tolist()
                links += [(j, i) for j in new]
                seen_rows[new] = True
                stack += [(0, j) for j in new]
    return links


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(rows: pa.Table) -> pa.Table:
    """A spanning forest of the links of every comparison in a bundle."""
    up, down = LEAST
    keys = list(zip(*(rows.column(c).to_pylist() for c in ("root", "low", "high", "p", "q"))))
    nodes, side, lists = rows.column("node").to_pylist(), rows.column("side").to_pylist(), rows.column("shingles")
    groups: dict[tuple, tuple[list[int], list[int]]] = {}
    for k, key in enumerate(keys):
        groups.setdefault(key, ([], []))[side[k]].append(k)
    found = []
    for left, right in groups.values():
        one = not right
        if one and len(left) < 2 or not left:
            continue
        a, b = ([lists[k].values.to_numpy() for k in some] for some in (left, right or left))
        sizes = [np.array([len(x) for x in y]) for y in (a, b)]
        near = (up + down) * shared(a, b).astype(np.int64) >= up * (sizes[0][:, None] + sizes[1])
        found += [(nodes[left[i]], nodes[(right or left)[j]]) for i, j in forest(near, one)]
    return pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=LINK)


def _by_fingerprint(texts: DataFrame, shingle: int) -> DataFrame:
    """Candidate links of ``(node, text)``: SimHash fingerprints of the same shingles that differ in few bits."""
    prints = stored(simhash.fingerprints(texts, "text", "node", shingle).select(F.col("doc_id").alias("node"), "fp").distinct(), "fingerprints")
    hubs = stored(prints.groupBy("fp").agg(F.min("node").alias("hub")), "fingerprint-hubs")
    same = prints.join(hubs, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    ends = [hubs.select(F.col("fp").alias(f"f{x}"), F.col("hub").alias(x)) for x in "ab"]
    near = simhash.links(hubs.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return same.unionByName(near.join(ends[0], "fa").join(ends[1], "fb").select("a", "b"))


def near_texts(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """``(node, root)`` for the nodes, ``xxhash64`` of texts, that are linked with another."""
    texts = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("node"), F.coalesce(text, F.lit("")).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
            keys = [bands(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                                             ["node", "n", "buckets"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    keys = stored(texts.mapInArrow(sketch, "node long, n long, buckets array<long>"), "sketches")
    members = keys.select("node", F.explode("buckets").alias("bucket"))
    # Copies of a text have equal buckets, so a bucket's smallest and largest node tell if it has two.
    smallest = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    stars = members.join(smallest.select("bucket", "hub"), "bucket").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = stored(stars.unionByName(_by_fingerprint(texts, shingle)).distinct(), "stars")
    roots = components(stars)
    sizes = keys.groupBy("node").agg(F.max("n").alias("n"))
    step = F.when(F.col("n") > 0, F.floor(F.log("n") / F.log(F.lit(LEAST[1] / LEAST[0])))).otherwise(F.lit(-2)).cast("int")
    nodes = stored(roots.withColumnRenamed("id", "node").join(sizes, "node").select("node", "root", step.alias("step")), "candidates")
    dropped(stars)
    tiles = nodes.groupBy("root", "step").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    around = {0: "own", 1: "next", -1: "before"}
    for move, name in around.items():
        nodes = nodes.join(tiles.select("root", (F.col("step") - move).alias("step"), F.col("tiles").alias(name)), ["root", "step"], "left")

    def numbers(n: str) -> Column:
        return F.expr(f"IF({n} IS NULL, array(), sequence(0, {n} - 1))")

    place = nodes.withColumn("h", F.pmod(F.hash("node"), F.col("own"))).withColumn("meets", F.concat(
        F.transform(numbers("own"), lambda t: F.struct(F.col("step").alias("low"), F.col("step").alias("high"), F.least("h", t).alias("p"),
                                                       F.greatest("h", t).alias("q"), F.when(F.col("h") <= t, 0).otherwise(1).alias("side"))),
        F.transform(numbers("next"), lambda t: F.struct(F.col("step").alias("low"), (F.col("step") + 1).alias("high"), F.col("h").alias("p"),
                                                        t.alias("q"), F.lit(0).alias("side"))),
        F.transform(numbers("before"), lambda t: F.struct((F.col("step") - 1).alias("low"), F.col("step").alias("high"), t.alias("p"),
                                                          F.col("h").alias("q"), F.lit(1).alias("side")))))
    place = stored(place.select("node", "root", F.explode("meets").alias("m")).select("node", "root", "m.*"), "meetings")
    bundles = max(1, -(-place.count() // tile))
    sets = texts.join(place.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(whole, "node long, shingles array<long>")
    meeting = place.withColumn("bundle", F.pmod(F.xxhash64("root", "low", "high", "p", "q"), F.lit(bundles))).join(sets, "node")
    links = stored(meeting.groupBy("bundle").applyInArrow(_compare, "a long, b long"), "links")
    dropped(place)
    dropped(keys)
    return stored(components(links), "roots").withColumnRenamed("id", "node")
