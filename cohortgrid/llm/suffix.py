"""Suffix-array dedup of byte strings: shard Burrows-Wheeler transforms, merged by interleave refinement.

A byte goes if some ``window`` consecutive bytes that cover it also start elsewhere in the corpus.

**Spans.** Equal windows have equal content, so they also share the smallest hash of their ``ANCHOR``-byte strings,
their anchor. The windows of a document fall into runs with one anchor, and a run's bytes are a span; all windows
that could be equal lie in spans of one anchor. Spans of equal content are one row with a count: copies, however
many, are one span, whose windows repeat. What is left open are anchors that spans of different content share, or
that a span has twice.

**Merge.** Open spans are dealt into groups of about ``GROUP`` bytes by their anchor; an anchor of more than half a
group is split by content over as many groups as its bytes fill. A group's spans are put into shards of ``SHARD``
bytes. Each shard is sorted by its suffixes, which gives its Burrows-Wheeler transform. The merge reads the
transforms only: their sorted symbols are the first column, and the stable order of the symbols is the step to the
next position. The interleave starts as blocks of rows that share a first symbol and is refined by doubling:
rows that agree on h symbols agree on 2h if the rows h steps on agree too. Rows of a shard are in order already, so
a shard's rows come in runs, and only one key for each run is sorted: no suffix is sorted again. A row's block at h
tells if it has h symbols in common with its neighbours; at ``window`` symbols, blocks of two or more rows are the
repeated intervals. Where an anchor is split, each group sends one hash of 128 bits for each of its blocks, packed by
buckets of hashes, and blocks that several groups have, repeat too.

Long documents are read in pieces of ``PIECE`` bytes. Spans are named by (anchor, 128-bit hash of their content).

Edge cases: a null text is empty; texts shorter than a window keep all; strings that overlap count; rows that share
an id or a text are documents of their own; ids may be null; an empty table gives an empty result; other columns stay,
except those with the names of the results, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, _powers, dropped, mixed, query, stored, table

WINDOW = 400
ANCHOR = 100
LONGEST = 1024
PIECE = 1 << 20
GROUP = 1 << 20
SHARD = 1 << 18
GROUPS_PER_TASK = 4
BUCKET = 1 << 19
RESULTS = ("n_bytes", "n_removed", "n_spans", "removed", "kept")

# ---------------------------------------------------------------- spans


def gram_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` bytes."""
    up, down = _powers(_P, len(a))
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(a) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values, from running minima of blocks of ``n``."""
    size = len(x) - n + 1
    rows = -(-len(x) // n)
    grid = np.full(rows * n, np.iinfo(x.dtype).max, x.dtype)
    grid[: len(x)] = x
    grid = grid.reshape(rows, n)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:size], ahead[n - 1: n - 1 + size])


def spans(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """``(text number, start, windows, anchor, anchor is in it more than once)`` of the spans of some texts, in order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    a = np.frombuffer(b"".join(texts), np.uint8)
    if len(a) < window:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, bool))
    grams, width = gram_hashes(a, anchor), window - anchor + 1
    least = sliding_min(grams, width)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= ends[of])
    of, least = of[at], least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - first) % LONGEST == 0
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(at)))
    of, first, least = of[starts], at[starts], least[starts]
    many = [np.count_nonzero(grams[p: p + m + width - 1] == x) > 1 for p, m, x in zip(first.tolist(), n.tolist(), least)]
    return of, first - (ends - sizes)[of], n, least, np.array(many, bool)


SPAN = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()),
                  ("c1", pa.int64()), ("c2", pa.int64()), ("many", pa.bool_())])
SPAN_SQL = "k1 long, k2 long, start long, n int, anchor long, c1 long, c2 long, many boolean"


def digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _numbers(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, or overlapping pieces of long ones, in lists of about ``PIECE`` bytes, with their text's number and start."""
    numbers, starts, held, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), PIECE):
            part = text[at: at + PIECE + window - 1]
            numbers.append(k)
            starts.append(at)
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield numbers, starts, held
                numbers, starts, held, size = [], [], [], 0
    if held:
        yield numbers, starts, held


def _spans(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for numbers, starts, texts in _pieces(batch.column(2).cast(pa.binary()).to_pylist(), window):
                of, start, n, least, many = spans(texts, window, anchor)
                if not len(of):
                    continue
                names = _numbers([digest(texts[t][s: s + m + window - 1]) for t, s, m in zip(of.tolist(), start.tolist(), n.tolist())])
                doc = np.array(numbers)[of]
                columns = (k1[doc], k2[doc], start + np.array(starts)[of], n.astype(np.int32), least.view(np.int64), names[:, 0], names[:, 1], many)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SPAN)], schema=SPAN)

    return run


# ---------------------------------------------------------------- shards and their merge


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. Symbol 0 ends a string; equal suffixes are in the strings' order."""
    n = len(symbols)
    left = np.flatnonzero(symbols == 0)
    left = left[np.searchsorted(left, np.arange(n))] - np.arange(n)  # symbols before the end
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(7):
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = symbols[k:]
        key = key * 512 + np.where(open_, ahead, 0)
        open_ &= ahead != 0
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    new |= left[order] < 7  # a string that ended is told from its equals by its place
    rank, h = np.empty(n, np.int64), 7
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        key = rank[at] * n + rank[at + h]
        turn = np.argsort(key, kind="stable")
        order[tied], key = at[turn], key[turn]
        first = np.ones(len(tied), bool)
        first[1:] = key[1:] != key[:-1]
        new[tied] = first
        rank[order[tied]] = np.maximum.accumulate(np.where(first, tied, 0))
        h *= 2


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard's strings (bytes plus one; 0 ends a string), and its rows' positions
    in the strings, each with its end."""
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[np.cumsum([len(s) + 1 for s in strings]) - 1] = 0
    order = suffix_order(symbols)
    return symbols[order - 1], order  # before the first string, as before the others, comes an end


def interleave(transforms: list[np.ndarray], length: int) -> np.ndarray:
    """For the rows of all transforms, one after another: the number of their block, those that share their first
    ``length`` symbols, in the order of these."""
    base = np.cumsum([0, *map(len, transforms)])
    step = np.concatenate([np.argsort(t, kind="stable") + b for t, b in zip(transforms, base)])
    block = np.concatenate([np.sort(t) for t in transforms]).astype(np.int64)
    step = np.where(block == 0, np.arange(len(step)), step)  # nothing follows an end
    starts = np.zeros(len(step), bool)
    starts[base[:-1]] = True

    def refined(jump: np.ndarray) -> np.ndarray:
        key = block * (int(block.max()) + 1) + block[jump]
        new = starts.copy()
        new[1:] |= key[1:] != key[:-1]
        _, number = np.unique(key[new], return_inverse=True)
        return number[np.cumsum(new) - 1]

    h, rest, jump, steps = 1, length, None, step
    while 2 * h <= length:
        block = refined(steps)
        steps, h = steps[steps], 2 * h
    rest, power, steps = length - h, 1, step
    while power <= rest:
        if rest & power:
            jump = steps if jump is None else steps[jump]
        steps, power = steps[steps], 2 * power
    return block if jump is None else refined(jump)


def repeats(contents: list[bytes], weights: np.ndarray, window: int, shard: int = SHARD) -> tuple[np.ndarray, ...]:
    """``(content, offset, block, count)`` for every window of some spans' contents; ``count``: the windows of its
    block, by the weight of their content."""
    lists, held, size = [], [], 0
    for k, c in enumerate(contents):
        held.append(k)
        size += len(c)
        if size >= shard:
            lists.append(held)
            held, size = [], 0
    if held:
        lists.append(held)
    made, of, offset = [], [], []
    for numbers in lists:
        bwt, order = transform([contents[k] for k in numbers])
        sizes = np.array([len(contents[k]) + 1 for k in numbers])
        firsts = np.cumsum(sizes) - sizes
        string = np.searchsorted(firsts, order, side="right") - 1
        made.append(bwt)
        of.append(np.array(numbers)[string])
        offset.append(order - firsts[string])
    block, of, offset = interleave(made, window), np.concatenate(of), np.concatenate(offset)
    whole = offset + window <= np.array([len(c) for c in contents])[of]
    block, of, offset = block[whole], of[whole], offset[whole]
    return of, offset, block, np.bincount(block, weights[of])[block].astype(np.int64)


RANGES = pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])
RANGES_SQL = "anchor long, c1 long, c2 long, lo array<int>, hi array<int>"
FOUND = pa.schema([*RANGES, ("bucket", pa.int64()), ("hashes", pa.binary()), ("sure", pa.binary()), ("of", pa.binary()), ("at", pa.binary()),
                   ("names", pa.binary())])
FOUND_SQL = RANGES_SQL + ", bucket long, hashes binary, sure binary, of binary, at binary, names binary"


def _ranges(of: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
    """Contents with their runs of offsets: number, starts, ends."""
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    lows, highs, of = at[starts], at[np.append(starts[1:], len(at)) - 1] + 1, of[starts]
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
        yield int(of[a]), lows[a:b].tolist(), highs[a:b].tolist()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _group(window: int, buckets: int):
    """A group's contents with the ranges of their repeated windows. The blocks of split anchors go out packed, one
    row for each bucket of hashes: hash, whether the block repeats already, and else its content and offset."""

    def run(rows: pa.Table) -> pa.Table:
        names = list(zip(*(rows.column(c).to_pylist() for c in ("anchor", "c1", "c2"))))
        first = {name: k for k, name in reversed(list(enumerate(names)))}  # rows that share id and text give a span twice
        keep = sorted(first.values())
        names = [names[k] for k in keep]
        held, weights, split = (rows.column(c).take(pa.array(keep)) for c in ("content", "weight", "split"))
        contents, split = held.to_pylist(), np.array(split.to_pylist(), bool)
        of, offset, block, count = repeats(contents, np.array(weights.to_pylist(), np.int64), window)
        sure = count >= 2
        out = [(*names[k], lows, highs, *[None] * 6) for k, lows, highs in _ranges(of[sure], offset[sure])] if sure.any() else []
        wide = np.flatnonzero(split[of])
        _, one = np.unique(block[wide], return_index=True)
        one = wide[one]
        if len(one):
            hashes = _numbers([digest(contents[c][at: at + window]) for c, at in zip(of[one].tolist(), offset[one].tolist())])
            bucket = hashes[:, 0] % buckets
            order = np.argsort(bucket, kind="stable")
            one, hashes, bucket = one[order], hashes[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(one)]):
                used, number = np.unique(of[one[a:b]], return_inverse=True)
                known = np.array([names[k] for k in used.tolist()], "<i8")
                out.append((*[None] * 5, int(bucket[a]), hashes[a:b].tobytes(), sure[one[a:b]].tobytes(), number.astype("<u4").tobytes(),
                            offset[one[a:b]].astype("<u4").tobytes(), known.tobytes()))
        return _table(out, FOUND)

    return run


def _bucket(rows: pa.Table) -> pa.Table:
    """Blocks that several groups have: the ranges of the contents for which this is news."""
    rows = rows.to_pylist()
    names = [np.frombuffer(r["names"], "<i8").reshape(-1, 3) for r in rows]
    base = np.cumsum([0, *map(len, names)])
    hashes = np.concatenate([np.frombuffer(r["hashes"], "<i8").reshape(-1, 2) for r in rows])
    sure = np.concatenate([np.frombuffer(r["sure"], bool) for r in rows])
    of = np.concatenate([np.frombuffer(r["of"], "<u4").astype(np.int64) + b for r, b in zip(rows, base)])
    at = np.concatenate([np.frombuffer(r["at"], "<u4").astype(np.int64) for r in rows])
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]).all(axis=1)
    again = np.empty(len(order), bool)
    again[order] = same | np.append(same[1:], False)
    new = again & ~sure
    names = np.concatenate(names)
    return _table([(*names[k].tolist(), lows, highs) for k, lows, highs in _ranges(of[new], at[new])] if new.any() else [], RANGES)


# ---------------------------------------------------------------- Spark

NAME = ["anchor", "c1", "c2"]


def _contents(window: int):
    """The bytes of a document's open spans."""
    schema = pa.schema([(c, pa.int64()) for c in NAME] + [("weight", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(wanted), 4096):
                    some = wanted[at: at + 4096]
                    columns = [[w[c] for w in some] for c in (*NAME, "weight")]
                    columns.append([text[w["start"]: w["start"] + w["n"] + window - 1] for w in some])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """``(k1, k2, ranges)`` for the documents ``(k1, k2, text)`` that hold repeated windows: the ranges of their
    starts."""
    spark = docs.sparkSession
    found = stored(docs.mapInArrow(_spans(window, anchor), SPAN_SQL), "spans")
    contents = stored(found.groupBy(*NAME).agg(F.count("*").alias("weight"), F.max("many").alias("many"), F.min(F.struct("k1", "k2", "start", "n")).alias("one")), "contents")
    per_anchor = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("many").alias("many"), F.sum(F.col("one.n") + (window - 1)).alias("size"),
                                                F.sum("one.n").alias("windows"))
    per_anchor = stored(per_anchor.where("kinds > 1 OR many"), "anchors")
    total = per_anchor.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // group), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 16))
    wanted = contents.join(per_anchor.select("anchor"), "anchor").groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2")).agg(
        F.collect_list(F.struct(*NAME, "weight", "one.start", "one.n")).alias("wanted"))
    texts = docs.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "wanted")
    open_ = stored(texts.mapInArrow(_contents(window), "anchor long, c1 long, c2 long, weight long, content binary"), "open")
    # An anchor's parts, and which group each goes to.
    parts = F.ceil(F.col("size") / (group // 2))
    salted = open_.join(per_anchor.select("anchor", parts.alias("parts")), "anchor").withColumn("split", F.col("parts") > 1)
    salted = salted.withColumn("g", F.pmod(F.xxhash64("anchor", F.pmod("c1", "parts")), F.lit(groups))).drop("parts")
    hot = per_anchor.where(F.col("size") > group // 2).agg(F.sum("windows")).first()[0] or 0
    # Sorting takes far longer than its bytes suggest: few groups a task.
    tasks = salted.repartition(-(-groups // GROUPS_PER_TASK), "g").groupBy("g")
    merged = stored(tasks.applyInArrow(_group(window, max(1, hot // BUCKET)), FOUND_SQL), "merged")
    dropped(open_)
    early = merged.where("lo IS NOT NULL").select(*NAME, "lo", "hi")
    late = merged.where("hashes IS NOT NULL").drop(*NAME, "lo", "hi").groupBy("bucket").applyInArrow(_bucket, RANGES_SQL)
    again = early.unionByName(late).select(*NAME, F.arrays_zip("lo", "hi").alias("ranges"))
    once = again.join(contents.where("weight = 1").select(*NAME, "one"), NAME).select("one.k1", "one.k2", "one.start", "ranges")
    copies = found.join(contents.where("weight > 1").select(*NAME), NAME).select(
        "k1", "k2", "start", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("ranges"))
    ranges = once.unionByName(copies).select("k1", "k2", F.explode(F.transform("ranges", lambda r: F.struct(
        (F.col("start") + r["lo"]).alias("lo"), (F.col("start") + r["hi"]).alias("hi")))).alias("r"))
    return stored(ranges.groupBy("k1", "k2").agg(F.collect_list("r").alias("ranges")), "ranges")


def removed(ranges: list, size: int, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows with these starts cover."""
    if not ranges:
        return []
    edges = np.array([(r["lo"], r["hi"]) for r in ranges], np.int64)
    edges = edges[np.argsort(edges[:, 0])]
    lows, highs = edges[:, 0], np.maximum.accumulate(edges[:, 1]) + window - 1
    new = np.ones(len(lows), bool)
    new[1:] = lows[1:] > highs[:-1]
    starts = np.flatnonzero(new)
    return list(zip(lows[starts].tolist(), highs[np.append(starts[1:], len(lows)) - 1].tolist()))


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW,
                 anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``removed`` (runs as ``lo``, ``hi``) and ``kept`` (the
    remaining bytes; a run may end inside a character) in place of the text."""
    keep = [c for c in docs.columns if c != text and c not in RESULTS]
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("k2")]
    rows = docs.where(F.octet_length(text) >= window).select(*key, F.col(text).alias("text"))
    ranges = repeated_ranges(rows, window, anchor, group).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("ranges").alias("_ranges"))
    whole = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"), *[k.alias(f"_of{i}") for i, k in enumerate(key)])
    whole = whole.join(ranges, (F.col("_of0") == F.col("_k1")) & (F.col("_of1") == F.col("_k2")), "left").select(*keep, "_text", "_ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, kept = [], [], [], []
            for t, r in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_ranges").to_pylist()):
                out = removed(r, len(t), window)
                n.append(len(t))
                gone.append(sum(hi - lo for lo, hi in out))
                runs.append([{"lo": lo, "hi": hi} for lo, hi in out])
                kept.append(b"".join(t[a:b] for (_, a), (b, _) in zip([(0, 0), *out], [*out, (len(t), 0)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(map(len, runs), pa.int64()),
                                                   pa.array(runs, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                [*keep, *RESULTS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema if f.name in keep]
    return whole.mapInArrow(cut, ", ".join([*fields, "n_bytes long, n_removed long, n_spans long, removed array<struct<lo:long,hi:long>>, kept binary"]))


@query("op13_suffix_dedup")
def op13_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
