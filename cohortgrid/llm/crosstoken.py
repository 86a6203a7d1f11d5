"""Cross-tokenizer alignment by an associative fragment monoid.

A text, with one blank before it, is tokenized twice: byte-level BPE (A) and sentence pieces (B). Where tokens of
both end at the same byte, the tokens are cut into groups; two tokens are linked if they share a group.

**Fragments.** The tokens that end in a byte range form a fragment: an open prefix (up to the range's first common
end), closed groups, and an open suffix (after its last common end); a range without a common end is all prefix.
Two neighbours compose: the left suffix and the right prefix close one group, and everything else stays. This is
associative, with the empty fragment as its unit, so ranges can be cut anywhere and composed in any bracketing.
Documents of more than ``RANGE`` bytes are cut into ranges of that many bytes, which Spark deals out; a range's
task tokenizes from the last blank before it to the first behind it, where neither tokenizer joins what a blank
parts, and keeps the tokens that end in it. Then rounds of ``FAN`` neighbours each compose a document's fragments;
only open ends travel, closed groups stay as written. A run without blanks that is longer than a range is one range.

**Counts.** Shorter documents are one fragment each, in blocks of ``BLOCK`` bytes of text. A block sends each of its
id pairs once, with the number of its documents that hold it, and gets back one row for each; a pair that every
document holds is one row for each block. The pairs' table is never broadcast by hint.

Token ids of the parts of a text between blanks are remembered in each worker, for ``UNITS`` parts at most.

Edge cases: null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens, zeros
and an empty string; rows that share an id or a text are documents of their own; ids may be null; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, stored, table
from .packing import Store

RANGE = 1 << 16
FAN = 16
RANGES_PER_TASK = 8
BLOCK = 4 << 20
UNITS = 400_000
SLICE = 1 << 20
WIDE = 256
JOINED = 256
# A blank between two other characters than white space: both tokenizers begin a token with it, and none crosses it.
PARTED = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable bytes stand for themselves, the others for
    characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, paths: tuple[str, str]):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(paths[0])
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=paths[1])
        alphabet = byte_alphabet()
        vocabulary = self._a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [(self._b.id_to_piece(i), self._b.is_byte(i)) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.n_b = len(pieces)
        if len(self.a_bytes) * self.n_b >= 1 << 32:
            raise ValueError("a pair of ids has to fit in 32 bits")
        # Every id with each of the marks that may follow it.
        ids = range(max(len(self.a_bytes), self.n_b))
        self.marked = np.array([f"{i}{mark}" for i in ids for mark in ",|;\n"], object)
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a blank and each unit."""
        encode = getattr(self._a, "encode_batch_fast", self._a.encode_batch)
        a = [e.ids for e in encode([" " + u for u in units], add_special_tokens=False)]
        return a, self._b.encode(units, num_threads=1)

    def exact(self, unit: str, a: list[int], b: list[int]) -> bool:
        whole = b" " + unit.encode()
        return b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _TOKENIZERS:
        _TOKENIZERS[paths] = Tokenizers(paths)
    return _TOKENIZERS[paths]


# ---------------------------------------------------------------- groups and fragments


def written(a: list[int], b: list[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


def linked(a: list[int], b: list[int], n_b: int) -> dict[int, int]:
    """How often a group links each pair of ids, by the pair's code."""
    of_b = Counter(b)
    return {i * n_b + j: m * n for i, m in Counter(a).items() for j, n in of_b.items()}


def groups(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Iterator[tuple[list[int], list[int], int]]:
    """The tokens up to each common end, and that end; -1 for tokens after the last."""
    common = sorted(set(a_ends) & set(b_ends))
    i = j = 0
    for end in common:
        p, q = i, j
        while i < len(a) and a_ends[i] <= end:
            i += 1
        while j < len(b) and b_ends[j] <= end:
            j += 1
        yield a[p:i], b[q:j], end
    if i < len(a) or j < len(b):
        yield a[i:], b[j:], -1


class Fragment:
    """Open prefix and suffix; ``cut``: has a common end; ``first``: the number of the range that has the first one.
    The closed groups are in ``closed``, as ``(position, a, b)`` in any order; positions order a document's groups."""

    __slots__ = ("closed", "cut", "first", "pa", "pb", "sa", "sb")

    def __init__(self, pa_=(), pb=(), sa=(), sb=(), cut=False, first=-1, closed=()):
        self.pa, self.pb, self.sa, self.sb = list(pa_), list(pb), list(sa), list(sb)
        self.cut, self.first, self.closed = cut, first, list(closed)

    def then(self, right: Fragment) -> Fragment:
        """The fragment of this one's range and the next."""
        if not self.cut:
            return Fragment(self.pa + right.pa, self.pb + right.pb, right.sa, right.sb, right.cut, right.first, self.closed + right.closed)
        if not right.cut:
            return Fragment(self.pa, self.pb, self.sa + right.pa, self.sb + right.pb, True, self.first, self.closed + right.closed)
        seam = (2 * right.first, self.sa + right.pa, self.sb + right.pb)
        return Fragment(self.pa, self.pb, right.sa, right.sb, True, self.first, [*self.closed, seam, *right.closed])

    def whole(self) -> list[tuple[int, list[int], list[int]]]:
        """All groups of a document that this fragment covers: its start and end are common ends too."""
        if not self.cut:
            return [*self.closed, (0, self.pa, self.pb)] if self.pa or self.pb else self.closed
        tail = [(1 << 62, self.sa, self.sb)] if self.sa or self.sb else []
        return [(2 * self.first, self.pa, self.pb), *self.closed, *tail]


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int], number: int) -> Fragment:
    """Of one range's tokens: the closed groups are all at the position of the range."""
    out = Fragment()
    for ga, gb, end in groups(a, a_ends, b, b_ends):
        if not out.cut:
            out.pa, out.pb = ga, gb
            out.cut, out.first = (True, number) if end >= 0 else (False, -1)
        elif end >= 0:
            out.closed.append((2 * number + 1, ga, gb))
        else:
            out.sa, out.sb = ga, gb
    return out


# ---------------------------------------------------------------- short documents


class Memory:
    """Counts, links and written groups of units."""

    def __init__(self, paths: tuple[str, str], units: int = UNITS):
        self.t, self.limit = tokenizers(paths), units
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.codes, self.times = Store(), Store()
        self.text: list[str] = []
        self.table = np.zeros((1 << 12, 5), np.int64)  # A tokens, B tokens, groups, links, exact

    def learn(self, units: list[str]) -> None:
        """Units are encoded many at a time, as they would stand in a text: nothing crosses the blanks between them.
        Those with white space at an end, of a text that isn't given back byte by byte, or with groups of very many
        links, go one by one."""
        single = [u for u in units if u[0].isspace() or u[-1].isspace()]
        inner = [u for u in units if not (u[0].isspace() or u[-1].isspace())]
        joined = [inner[at: at + JOINED] for at in range(0, len(inner), JOINED)]
        texts = [" ".join(some) for some in joined]
        many, a, b = [], [], []
        for some, text, x, y in zip(joined, texts, *self.t.encode(texts)):
            if self.t.exact(text, x, y):
                many += some
                a += x
                b += y
            else:
                single += some
        if many:
            single += self._learn_many(many, np.array(a, np.int64), np.array(b, np.int64))
        if single:
            for unit, x, y in zip(single, *self.t.encode(single)):
                self._learn_one(unit, x, y)

    def _add(self, units: list[str], texts: list[str], counts: np.ndarray, codes: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.text)
        self.known.update(zip(units, range(first, first + len(units))))
        self.text += texts
        while len(self.table) < len(self.text):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[first: len(self.text)] = counts
        self.codes.add(codes.astype(np.uint32), sizes)
        self.times.add(times.astype(np.uint32), sizes)

    def _learn_one(self, unit: str, a: list[int], b: list[int]) -> None:
        t, pairs, found, links = self.t, {}, [], 0
        exact = t.exact(unit, a, b)
        if exact:
            found = list(groups(a, list(accumulate(t.a_size[a].tolist())), b, list(accumulate(t.b_size[b].tolist()))))
            for p, q, _ in found:
                links += len(p) * len(q)
                for code, n in linked(p, q, t.n_b).items():
                    pairs[code] = pairs.get(code, 0) + n
        counts = np.array([[len(a), len(b), len(found), links, 1] if exact else [0] * 5])
        self._add([unit], [";".join([written(p, q) for p, q, _ in found])], counts, np.array(list(pairs), np.int64),
                  np.array(list(pairs.values()), np.int64), np.array([len(pairs)]))

    def _learn_many(self, units: list[str], a: np.ndarray, b: np.ndarray) -> list[str]:
        """Units whose ids are ``a`` and ``b``, one after another; returns those that are left to do."""
        t = self.t
        ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units)))
        a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not np.isin(ends, common, assume_unique=True).all():
            return units
        of_a, of_b, unit = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends), np.searchsorted(ends, common)
        n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        links = n_a * n_b
        n = len(units)
        wide = np.bincount(unit, links > WIDE, n) > 0
        counts = np.stack([np.bincount(unit, w, n) for w in (n_a, n_b, np.ones(len(common)), links, np.zeros(len(common)))], axis=1).astype(np.int64)
        counts[:, 4] = 1
        # Each A token with all B tokens of its group.
        use = np.flatnonzero(~wide[unit[of_a]])
        group, many = of_a[use], n_b[of_a[use]]
        upto = np.cumsum(many)
        place = np.repeat((np.cumsum(n_b) - n_b)[group] - upto + many, many) + np.arange(int(many.sum()))
        codes = np.repeat(a[use], many) * t.n_b + b[place]
        # The written groups: A before B, and after each id what comes before the next.
        key = np.concatenate((2 * of_a, 2 * of_b + 1))
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate((a, b))[order]
        last = np.append(key[1:] != key[:-1], True)
        closes = np.append(unit[1:] != unit[:-1], True)[key >> 1]
        mark = np.where(~last, 0, np.where(key % 2 == 0, 1, np.where(closes, 3, 2)))
        texts = "".join(t.marked[ids * 4 + mark].tolist()).split("\n")[:-1]
        keep = np.flatnonzero(~wide)
        sizes = counts[keep, 3]
        self._add([units[i] for i in keep], [texts[i] for i in keep], counts[keep], codes, np.ones(len(codes), np.int64), sizes)
        return [units[i] for i in np.flatnonzero(wide)]

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For some texts: a row of A tokens, B tokens, groups and links each, their groups' hashes, and all texts'
        links as text number, code and times, in that order."""
        if len(self.text) > self.limit:
            self.clear()
        split = [PARTED.split(t) if t else [] for t in texts]
        if new := {u for s in split for u in s} - self.known.keys():
            self.learn(list(new))
        which = [list(map(self.known.__getitem__, s)) for s in split]
        sizes = np.fromiter(map(len, which), np.int64, len(which))
        flat = np.fromiter((i for w in which for i in w), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        rows = np.stack([np.bincount(doc, self.table[flat, c], len(texts)) for c in range(5)], axis=1).astype(np.int64) if len(flat) else np.zeros((len(texts), 5), np.int64)
        good = (rows[:, 4] == sizes) & (sizes > 0)
        rows[~good] = 0
        kept = good[doc]
        flat, doc = flat[kept], doc[kept]
        hashes = [hashlib.sha256(";".join([self.text[i] for i in w]).encode()).hexdigest() if ok else "" for w, ok in zip(which, good.tolist())]
        codes, n = self.codes.get(flat)
        times, _ = self.times.get(flat)
        keys = (np.repeat(doc, n).astype(np.uint64) << np.uint64(32)) | codes
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        total = np.add.reduceat(times[order].astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
        return rows[:, :4], hashes, (keys[starts] >> np.uint64(32)).astype(np.int64), keys[starts].astype(np.uint32), total


STATE = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("times", pa.binary()),
                   ("codes", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
STATE_SQL = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, "
             "times binary, codes array<long>, docs array<long>")


def _sliced(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE`` characters."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _read(paths: tuple[str, str], block_bytes: int):
    """Documents with their links, and at each block's end a row with its pairs and how many documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, block, size = Memory(paths), TaskContext.get().partitionId() << 32, 0
        seen: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            codes, docs = np.unique(np.concatenate(seen), return_counts=True)
            row = [block, None, None, None, None, None, None, None, None, codes.tolist(), docs.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, STATE)], schema=STATE)

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _sliced(texts):
                rows, hashes, doc, codes, times = memory.documents(texts[a:b])
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                links = [codes[p:q].astype("<u4").tobytes() for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                # Nearly all are 1: only others are kept, as place and number.
                often = [_others(times[p:q]) for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), batch.column(0).slice(a, n), *[pa.array(rows[:, c], pa.int64()) for c in range(4)],
                     pa.array(hashes), pa.array(links, pa.binary()), pa.array(often, pa.binary()),
                     pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=STATE)
                seen.append(codes)
                size += sum(map(len, texts[a:b]))
                if size >= block_bytes:
                    yield close()
                    seen, size, block = [], 0, block + 1
        if seen:
            yield close()

    return run


def _others(times: np.ndarray) -> bytes:
    at = np.flatnonzero(times != 1)
    return np.stack((at, times[at]), axis=1).astype("<i8").tobytes()


def _times(n: int, others: bytes) -> np.ndarray:
    out, rest = np.ones(n, np.int64), np.frombuffer(others, "<i8").reshape(-1, 2)
    out[rest[:, 0]] = rest[:, 1]
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                    ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
RESULT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the counts of its pairs."""
    codes = pairs.column("code").to_numpy()
    order = np.argsort(codes)
    codes, count, best = codes[order], pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy()[order]
    n_best, count_sum = [], []
    for links, others in zip(docs.column("links").to_pylist(), docs.column("times").to_pylist()):
        links = np.frombuffer(links, "<u4").astype(np.int64)
        times, at = _times(len(links), others), np.searchsorted(codes, links)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    held = {c: docs.column(c) for c in RESULT.names if c in docs.column_names}
    held |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.Table.from_arrays([held[c] for c in RESULT.names], schema=RESULT)


# ---------------------------------------------------------------- long documents

PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
                   ("at", pa.int64()), ("text", pa.string())])
PIECE_SQL = "row long, doc_id long, k long, lo long, hi long, at long, text string"
OPEN = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("first", pa.int64()), ("pa", pa.list_(pa.int32())), ("pb", pa.list_(pa.int32())),
                  ("sa", pa.list_(pa.int32())), ("sb", pa.list_(pa.int32())), ("pos", pa.int64()), ("groups", pa.string()),
                  ("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("n_a", pa.int64()), ("n_b", pa.int64()),
                  ("n_groups", pa.int64()), ("n_links", pa.int64()), ("ok", pa.bool_())])
OPEN_SQL = ("row long, k long, first long, pa array<int>, pb array<int>, sa array<int>, sb array<int>, pos long, groups string, "
            "codes array<long>, times array<long>, n_a long, n_b long, n_groups long, n_links long, ok boolean")


def ranges(text: str, width: int) -> Iterator[tuple[int, int, int, str]]:
    """``(lo, hi, at, part)``: byte ranges of a blank and the text, and the text's units that reach into each, which
    start at byte ``at``. No range starts inside a unit longer than ``width``."""
    units = PARTED.split(text)
    sizes = np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units))
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    edges = np.arange(width, total, width)
    unit = np.searchsorted(starts, edges, side="right") - 1
    edges = edges[(sizes[unit] <= width) | (starts[unit] == edges)]
    edges = [0, *edges.tolist(), total]
    for lo, hi in zip(edges[:-1], edges[1:]):
        i, j = int(np.searchsorted(starts, lo, side="right")) - 1, int(np.searchsorted(starts, hi, side="left"))
        yield lo, hi, int(starts[i]), " ".join(units[i:j])


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = [(row, doc_id, k, *r) for k, r in enumerate(ranges(text, width))]
                row += 1
                for a in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[a: a + 64]], f.type) for i, f in enumerate(PIECE)], schema=PIECE)

    return run


def _opened(row: int, k: int, f: Fragment) -> dict:
    return {"row": row, "k": k, "first": f.first, "pa": f.pa, "pb": f.pb, "sa": f.sa, "sb": f.sb}


def _closed(row: int, pos: int, found: list[tuple[list[int], list[int]]], n_b: int) -> dict:
    """A row for consecutive closed groups."""
    pairs: Counter[int] = Counter()
    for a, b in found:
        pairs.update(linked(a, b, n_b))
    return {"row": row, "pos": pos, "groups": ";".join([written(a, b) for a, b in found]), "codes": list(pairs), "times": list(pairs.values()),
            "n_groups": len(found), "n_links": sum(len(a) * len(b) for a, b in found), "ok": True}


def _opens(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in OPEN], schema=OPEN)


def _fragments(paths: tuple[str, str]):
    """One row for each range: its open ends, and its closed groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(paths)
        for batch in batches:
            for r in batch.to_pylist():
                units = PARTED.split(r["text"])
                a, b = t.encode(units)
                ok = all(map(t.exact, units, a, b))
                f, n_a, n_b = Fragment(), 0, 0
                if ok:
                    sides = []
                    for ids, size in ((a, t.a_size), (b, t.b_size)):
                        ids = np.concatenate([np.array(x, np.int64) for x in ids])
                        ends = r["at"] + np.cumsum(size[ids])
                        own = (ends > r["lo"]) & (ends <= r["hi"])
                        sides += [ids[own].tolist(), ends[own].tolist()]
                    f = fragment(*sides, r["k"])
                    n_a, n_b = len(sides[0]), len(sides[2])
                row = _closed(r["row"], 2 * r["k"] + 1, [(x, y) for _, x, y in f.closed], t.n_b)
                yield _opens([_opened(r["row"], r["k"], f) | row | {"n_a": n_a, "n_b": n_b, "ok": ok}])

    return run


def _fold(n_b: int):
    """Neighbouring fragments composed: one row with the open ends, one for each seam."""

    def run(rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r["k"])
        whole = Fragment()
        for r in rows:
            whole = whole.then(Fragment(r["pa"], r["pb"], r["sa"], r["sb"], r["first"] >= 0, r["first"]))
        out = [_opened(rows[0]["row"], rows[0]["k"] // FAN, whole)]
        out += [_closed(rows[0]["row"], pos, [(a, b)], n_b) for pos, a, b in whole.closed]
        return pa.Table.from_batches([_opens(out)])

    return run


def _ended(n_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = Fragment(r["pa"], r["pb"], r["sa"], r["sb"], r["first"] >= 0, r["first"])
                yield _opens([_closed(r["row"], pos, [(a, b)], n_b) for pos, a, b in f.whole()])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each document's groups, from its rows in order."""
    row, h, empty = None, None, True
    for batch in batches:
        out: list[tuple[int, str]] = []
        for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if r != row:
                if row is not None:
                    out.append((row, h.hexdigest()))
                row, h, empty = r, hashlib.sha256(), True
            if text:
                h.update((text if empty else ";" + text).encode())
                empty = False
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["row", "groups_sha256"])
    if row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([h.hexdigest()])], ["row", "groups_sha256"])


def long_documents(docs: DataFrame, paths: tuple[str, str], width: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """``(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256)`` and ``(row, code, times)`` for documents
    ``(doc_id, text)``, cut into ranges of ``width`` bytes."""
    n_b = tokenizers(paths).n_b
    pieces = stored(docs.mapInArrow(_cut(width), PIECE_SQL), "ranges")
    # Tokenizing takes far longer than its bytes suggest: a few ranges a task, whatever their size.
    tasks = -(-pieces.count() // RANGES_PER_TASK)
    found = stored(pieces.repartition(max(1, tasks), "row", "k").mapInArrow(_fragments(paths), OPEN_SQL), "fragments")
    opened = ["row", "k", "first", "pa", "pb", "sa", "sb"]
    closed = ["row", "pos", "groups", "codes", "times", "n_a", "n_b", "n_groups", "n_links", "ok"]
    parts, level, n = found.select(*closed), found.select(*opened), (found.agg(F.max("k")).first()[0] or 0) + 1
    while n > 1:
        folded = level.groupBy("row", F.floor(F.col("k") / FAN).alias("g")).applyInArrow(_fold(n_b), OPEN_SQL)
        folded = stored(folded, "fragments")
        parts = parts.unionByName(folded.where("pos IS NOT NULL").select(*closed))
        level, n = folded.where("k IS NOT NULL").select(*opened), -(-n // FAN)
    parts = stored(parts.unionByName(level.mapInArrow(_ended(n_b), OPEN_SQL).select(*closed)), "groups")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    stats = parts.groupBy("row").agg(*sums, F.min("ok").alias("ok"))
    texts = parts.repartition("row").sortWithinPartitions("row", "pos").select("row", "groups").mapInArrow(_hashed, "row long, groups_sha256 string")
    names = pieces.where("k = 0").select("row", "doc_id")
    rows = names.join(stats, "row").join(texts, "row")
    rows = stored(rows.select("row", "doc_id", "ok", *[F.when(F.col("ok"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
                              F.when(F.col("ok"), F.col("groups_sha256")).otherwise(F.lit("")).alias("groups_sha256")), "long-documents")
    links = parts.select("row", F.explode(F.arrays_zip("codes", "times")).alias("l")).groupBy("row", F.col("l.codes").alias("code"))
    links = links.agg(F.sum("l.times").cast("long").alias("times")).join(rows.where("ok").select("row"), "row", "left_semi")
    return rows.drop("ok"), stored(links, "long-links")


# ---------------------------------------------------------------- all documents


def pair_counts(pairs: DataFrame, n_b: int) -> DataFrame:
    """``(code, n, best)`` from ``(code, docs)``: documents that hold the pair, and whether no pair of its A id is in
    more."""
    counts = pairs.groupBy("code").agg(F.sum("docs").cast("long").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("code") / n_b))  # at most one row for each B id
    return counts.select("code", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", paths: tuple[str, str] | None = None,
          width: int = RANGE, block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents like ``RESULT``, and all linked pairs as ``(a_id, b_id, n, best)``."""
    paths = paths or tokenizer_paths()
    n_b = tokenizers(paths).n_b
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > width, F.lit(False))
    state = stored(rows.where(~is_long).mapInArrow(_read(paths, block_bytes), STATE_SQL), "alignments")
    long_rows, long_links = long_documents(rows.where(is_long), paths, width)
    of_block = state.where("codes IS NOT NULL").select("block", F.explode(F.arrays_zip("codes", "docs")).alias("p"))
    held = of_block.select(F.col("p.codes").alias("code"), F.col("p.docs").alias("docs"))
    pairs = stored(pair_counts(held.unionByName(long_links.select("code", F.lit(1).cast("long").alias("docs"))), n_b), "pairs")
    answers = of_block.select(F.col("block").alias("of"), F.col("p.codes").alias("code")).join(pairs, "code")
    short = state.where("codes IS NULL").drop("codes", "docs").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_scored, RESULT_SQL)
    scores = long_links.join(pairs, "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    long_ = long_rows.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *filled, "groups_sha256")
    of_pair = pairs.select(F.floor(F.col("code") / n_b).cast("int").alias("a_id"), (F.col("code") % n_b).cast("int").alias("b_id"), "n", "best")
    return short.unionByName(long_), of_pair


@query("op12_align")
def op12_align(spark, sf_dir):
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
