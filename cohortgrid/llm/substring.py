"""Substring dedup by level-wise doubling.

Level 0 hashes every window of ``window`` words; windows that also start in another document survive. Level
k + 1 extends survivors alone to twice the length: a window of 2L words is a candidate where windows of L words
survived at its start and L words further on, and its hash comes from theirs. Levels go on until no candidate
survives. What is removed follows from level 0; the later levels tell how long a repeat is.

Rows that are shuffled hold packed numpy columns, not single windows. Documents are taken in blocks. A block
sends each distinct hash once, to the bucket that the hash falls in, with the smallest id among the block's
documents that have it; further windows of the block with that hash stay in the block's own row. So a bucket
gets a passage once per block, however many documents hold it. The bucket answers the block, and the block
settles its own windows. Level 0 goes over the texts in ``ROUNDS`` rounds, each for the windows whose hashes
have one remainder, so that only a part of all windows is on disk at a time. Hashes have 64 bits: a window is
wrongly matched with a chance of (windows in the corpus) / 2**64.

Edge cases: null or empty texts and texts below a window keep all; rows with a null id keep all and match
nothing; equal rows and rows that share an id don't repeat each other; the memory that one block needs follows
the longest text; an empty table gives an empty result; other columns pass through, and one that bears the
name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mixed, query, stored, table, window_hashes, word_hashes

WINDOW = 13
BLOCK_WORDS = 500_000
BUCKET = 500_000
ROUNDS = 3
RESULTS = ("n_words", "n_removed", "kept_text", "longest_repeat")

MESSAGE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("h", pa.binary()), ("at", pa.binary()),
                     ("more", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("h", pa.binary()), ("at", pa.binary()), ("more", pa.binary()),
                    ("ids", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())])
STATE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n", pa.int64()),
                   ("hit", pa.bool_()), ("spans", pa.binary()), ("at", pa.binary()), ("h", pa.binary())])
SQL = {s: ", ".join(f"{f.name} {dict(int64='long', binary='binary', bool='boolean')[str(f.type)]}" for f in s)
       for s in (MESSAGE, ANSWER, STATE)}


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: the upper bytes of small or sorted numbers then compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(b: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


@dataclass
class Block:
    """Windows of some documents. ``at`` counts words from the block's start."""

    ids: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    h: list[np.ndarray] = field(default_factory=list)
    at: list[np.ndarray] = field(default_factory=list)
    words: int = 0

    def add(self, ids: np.ndarray, keys: np.ndarray, sizes: np.ndarray, h: np.ndarray, at: np.ndarray) -> None:
        for held, new in zip((self.ids, self.keys, self.sizes, self.h, self.at), (ids, keys, sizes, h, at + self.words)):
            held.append(new)
        self.words += int(sizes.sum())

    def messages(self, block: int, buckets: int) -> Iterator[tuple]:
        ids, keys, sizes, h, at = (np.concatenate(x) for x in (self.ids, self.keys, self.sizes, self.h, self.at))
        ends = np.cumsum(sizes)
        doc = ids[np.searchsorted(ends, at, side="right")]
        order = np.lexsort((at, doc, h))
        h, at, doc = h[order], at[order], doc[order]
        first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        last = np.append(starts[1:], len(h)) - 1 if len(h) else starts
        more = doc[last] != doc[starts]  # another document of the block has it too
        # The block's own row: what the sender must remember. It gets a bucket of its own.
        yield (buckets + block, block, h[~first].tobytes(), at[~first].astype("<u4").tobytes(), b"",
               ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), keys.astype("<i8").tobytes())
        h, at, doc = h[starts], at[starts], doc[starts]
        bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((at, bucket))
        h, at, doc, more, bucket = h[order], at[order], doc[order], more[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(h)).tolist()):
            used, which = np.unique(doc[a:b], return_inverse=True)
            width = "<u2" if len(used) < 1 << 16 else "<u4"
            yield (int(bucket[a]), block, _planes(h[a:b]), _planes(np.diff(at[a:b], prepend=0).astype("<u4")),
                   np.packbits(more[a:b]).tobytes(), _planes(used.astype("<i8")), _planes(which.astype(width)), b"")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _send(read: Callable, buckets: int, part: int = 0, parts: int = 1):
    """Blocks of what ``read`` makes of each batch, as messages: those with hashes of one remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, keys, sizes, h, at = read(batch)
            if parts > 1:
                own = np.flatnonzero(h % np.uint64(parts) == np.uint64(part))
                h, at = h[own], at[own]
            block.add(ids, keys, sizes, h, at)
            if block.words >= BLOCK_WORDS:
                yield _batch(list(block.messages(number, buckets)), MESSAGE)
                block, number = Block(), number + 1
        if block.ids:
            yield _batch(list(block.messages(number, buckets)), MESSAGE)

    return run


def _from_texts(window: int):
    def read(batch: pa.RecordBatch):
        ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
        words, doc = word_hashes([t.encode() for t in batch.column(2).to_pylist()])
        sizes = np.bincount(doc, minlength=len(ids))
        h = window_hashes(words, window)
        at = np.flatnonzero(doc[: len(h)] == doc[window - 1: window - 1 + len(h)])
        return ids, keys, sizes, h[at], at

    return read


def _from_state(length: int):
    """Survivors of ``length`` words that a survivor follows ``length`` words on, as one twice as long."""

    def read(batch: pa.RecordBatch):
        ids, keys, sizes = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "key", "n_words"))
        hs, ats, start = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for parts, size in zip(batch.column("parts").to_pylist(), sizes.tolist()):
            at = np.concatenate([np.frombuffer(p["at"], "<u4") for p in parts]).astype(np.int64)
            at, first = np.unique(at, return_index=True)
            h = np.concatenate([np.frombuffer(p["h"], "<u8") for p in parts])[first]
            there = np.searchsorted(at, at + length)
            ok = np.flatnonzero((there < len(at)) & (at[np.minimum(there, len(at) - 1)] == at + length))
            hs.append(mixed(h[ok] * np.uint64(0xD6E8FEB86659FD93) + mixed(h[there[ok]])))
            ats.append(at[ok] + start)
            start += size
        return ids, keys, sizes, np.concatenate(hs), np.concatenate(ats)

    return read


def _bucket(buckets: int):
    """Answer every block that sent a hash which more than one document has."""

    def of(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        if rows and rows[0]["bucket"] >= buckets:  # a block's own row goes back as it came
            return pa.Table.from_batches([_batch([tuple(r[f.name] for f in ANSWER) for r in rows], ANSWER)])
        h = [_numbers(r["h"], "<u8") for r in rows]
        sizes = [len(x) for x in h]
        ids = [_numbers(r["ids"], "<i8") for r in rows]
        doc = [i[_numbers(r["sizes"], "<u2" if len(i) < 1 << 16 else "<u4")] for i, r in zip(ids, rows)]
        more = [np.unpackbits(np.frombuffer(r["more"], np.uint8), count=n).astype(bool) for r, n in zip(rows, sizes)]
        h, doc, more = (np.concatenate(x) for x in (h, doc, more))
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
        low, high = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
        repeated = (low != high) | np.maximum.reduceat(more[order], starts)
        runs = np.diff(np.append(starts, len(h)))
        alive, least = np.zeros(len(h), bool), np.empty(len(h), np.int64)
        alive[order], least[order] = np.repeat(repeated, runs), np.repeat(low, runs)
        out, a = [], 0
        for r, n in zip(rows, sizes):
            keep = np.flatnonzero(alive[a: a + n]) + a
            if len(keep):
                at = np.cumsum(_numbers(r["at"], "<u4"), dtype=np.int64)[keep - a]
                cut = np.packbits(doc[keep] > least[keep]).tobytes()  # another document is smaller: remove it
                out.append((r["block"], _planes(h[keep]), _planes(np.diff(at, prepend=0).astype("<u4")), cut, b"", b"", b""))
            a += n
        return pa.Table.from_batches([_batch(out, ANSWER)])

    return of


def _settle(length: int, spans: bool):
    """From a block's own row and the answers to it: its documents with surviving windows."""

    def of(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        own = [r for r in rows if r["ids"]]
        answers = [r for r in rows if not r["ids"]]
        if not own or not answers:
            return pa.Table.from_batches([], STATE)
        ids, sizes, keys = (np.frombuffer(own[0][c], k) for c, k in (("ids", "<i8"), ("sizes", "<u4"), ("keys", "<i8")))
        h = np.concatenate([_numbers(r["h"], "<u8") for r in answers])
        at = [np.cumsum(_numbers(r["at"], "<u4"), dtype=np.int64) for r in answers]
        cut = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(x)) for r, x in zip(answers, at)]).astype(bool)
        at = np.concatenate(at)
        ends = np.cumsum(sizes.astype(np.int64))
        doc_of = lambda at: np.searchsorted(ends, at, side="right")
        # The block's further windows of a hash: in the first one's document they share its fate, elsewhere
        # the first one's document is the smaller.
        eh, eat = np.frombuffer(own[0]["h"], "<u8"), np.frombuffer(own[0]["at"], "<u4").astype(np.int64)
        order = np.argsort(h)
        h, at, cut = h[order], at[order], cut[order]
        there = np.minimum(np.searchsorted(h, eh), len(h) - 1)
        ok = h[there] == eh
        there, eh, eat = there[ok], eh[ok], eat[ok]
        ecut = cut[there] | (ids[doc_of(eat)] > ids[doc_of(at[there])])
        h, at, cut = np.concatenate((h, eh)), np.concatenate((at, eat)), np.concatenate((cut, ecut))
        order = np.argsort(at)
        h, at, cut = h[order], at[order], cut[order]
        doc = doc_of(at)
        begin = ends - sizes
        firsts = np.flatnonzero(np.diff(doc, prepend=-1))
        out = []
        for a, b in zip(firsts.tolist(), np.append(firsts[1:], len(doc)).tolist()):
            d = int(doc[a])
            p = at[a:b] - begin[d]
            gone = p[cut[a:b]]
            covered = b""
            if spans and len(gone):
                new = np.concatenate(([True], gone[1:] > gone[:-1] + length))
                last = np.append(np.flatnonzero(new)[1:], len(gone)) - 1
                covered = np.stack((gone[new], gone[last] + length), axis=1).astype("<i4").tobytes()
            out.append((int(ids[d]), int(keys[d]), int(sizes[d]), b - a, bool(len(gone)), covered,
                        p.astype("<u4").tobytes(), h[a:b].tobytes()))
        return pa.Table.from_batches([_batch(out, STATE)])

    return of


def _level(rows: DataFrame, read: Callable, n: int, length: int, spans: bool, part: int = 0, parts: int = 1) -> DataFrame:
    """One level, or one round of it, as a written table; ``n``: about how many windows it has."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-n // BUCKET), min(partitions, n // 50_000))
    sent = rows.mapInArrow(_send(read, buckets, part, parts), SQL[MESSAGE])
    answered = sent.groupBy("bucket").applyInArrow(_bucket(buckets), SQL[ANSWER])
    return stored(answered.groupBy("block").applyInArrow(_settle(length, spans), SQL[STATE]), f"repeats-{length}")


def repeats(rows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """For ``(doc_id, key, text)``: spans of words to remove, ``(doc_id, key, spans)``, and ``(doc_id, key,
    longest)``, the length of the longest level at which a window also starts in a smaller document."""
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    states = [_level(rows, _from_texts(window), chars // 6 // ROUNDS, window, True, k, ROUNDS) for k in range(ROUNDS)]
    state = reduce(DataFrame.unionByName, states)
    spans = stored(state.where("hit").groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans")), "spans")
    found, length = [spans.select("doc_id", "key", F.lit(window).alias("longest"))], window
    while n := state.agg(F.sum("n")).first()[0]:
        # The rounds' windows of a document together again. Written, since blocks are named by the order in which rows
        # arrive: a task that runs again has to read the same rows in the same order.
        whole = stored(state.groupBy("doc_id", "key", "n_words").agg(F.collect_list(F.struct("at", "h")).alias("parts")), "repeats-whole")
        length *= 2
        state = _level(whole, _from_state(length // 2), n, length, False)
        for old in [*states, whole]:
            dropped(old)
        states = [state]
        found.append(stored(state.where("hit").select("doc_id", "key", F.lit(length).alias("longest")), "longest"))
    longest = reduce(DataFrame.unionByName, found).groupBy("doc_id", "key").agg(F.max("longest").alias("longest"))
    return spans, longest


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_text`` (kept words, one space between) and
    ``longest_repeat`` (words; 0 if nothing is repeated) in place of the text."""
    keep = [c for c in docs.columns if c != text and c not in RESULTS]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    spans, longest = repeats(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), window)
    plan = spans.join(longest, ["doc_id", "key"]).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans", "longest")
    whole = docs.select(*keep, F.col(text).alias("_text"))
    whole = whole.join(plan, (F.col(doc_id).cast("long") == F.col("_id")) & (F.xxhash64("_text") == F.col("_key")), "left")
    whole = whole.select(*keep, "_text", F.col("spans").alias("_spans"), F.coalesce("longest", F.lit(0)).alias("longest_repeat"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for t, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
                words = (t or "").encode().split()
                n.append(len(words))
                if spans:
                    edges = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
                    depth = np.bincount(edges[:, 0], minlength=n[-1] + 1) - np.bincount(edges[:, 1], minlength=n[-1] + 1)
                    words = [w for w, d in zip(words, np.cumsum(depth).tolist()) if not d]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                                   pa.array(kept, pa.string()), batch.column("longest_repeat")],
                [*keep, "n_words", "n_removed", "kept_text", "longest_repeat"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema if f.name in keep]
    return whole.mapInArrow(cut, ", ".join([*fields, "n_words long, n_removed long, kept_text string, longest_repeat int"]))


@query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "longest_repeat")
