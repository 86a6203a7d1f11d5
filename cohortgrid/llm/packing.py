"""Best-fit packing of token sequences, refined by best-two-fit.

Texts are tokenized in whole, an end id is added, and only documents longer than a sequence are cut. Pieces
are dealt at random into groups of about ``GROUP`` pieces, and each group is packed on its own, largest piece
first: a sequence is filled greedily with the largest piece that fits; then its smallest piece is replaced by
two unpacked pieces that fill the widened gap more tightly, as long as there are such. A group can leave one
sequence partly empty, so the cost of dealing is below one sequence in ``GROUP`` pieces.

Words are tokenized once per worker: the tokenizer splits at white space and nothing crosses it, so a text's
ids are its words' ids in order. A memory of words is emptied when it holds ``WORDS`` of them.

Edge cases: a null or empty text is one piece that holds the end id alone; repeated rows are packed each on
their own; ids may be null; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, stored, table

CAPACITY = 4096
END_ID = 1
GROUP = 20_000
WORDS = 500_000


class Store:
    """Growing list of id sequences, kept in three arrays."""

    def __init__(self):
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> range:
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while len(self.start) < self.count + len(sizes):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        first = self.count
        self.flat[self.used: self.used + len(flat)] = flat
        self.start[first: first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[first: first + len(sizes)] = sizes
        self.used, self.count = self.used + len(flat), first + len(sizes)
        return range(first, self.count)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences one after another, and their sizes."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(total)], sizes


# Letters that lower-casing and normalization treat one by one; marks that form a token run of their own.
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
JOINED = 512


class Words:
    """Token ids of texts, by way of bounded memories of words and of their parts.

    A plain word is its letters in lower case and the marks after them, which the tokenizer splits anyway; other
    words are taken whole. New parts are encoded many at a time, with blanks between: each ends in the one token
    that closes it."""

    def __init__(self, path: str, words: int = WORDS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)  # without offsets
        self.closes = np.zeros(tokenizer.get_vocab_size(), bool)
        self.closes[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.words = words
        self.known: dict[bytes, int] = {}
        self.parts: dict[bytes, int] = {b"": 0}
        self.word_ids, self.part_ids = Store(), Store()
        self.part_ids.add(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encode_batch(texts, add_special_tokens=False)]

    def _add(self, parts: list[bytes], found: list[list[int]], sizes: np.ndarray | None = None) -> None:
        if sizes is None:
            sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.parts.update(zip(parts, self.part_ids.add(flat, sizes)))

    def _encode_plain(self, parts: list[bytes]) -> None:
        for at in range(0, len(parts), JOINED):
            some = parts[at: at + JOINED]
            ids = self._encode([b" ".join(some).decode()])[0]
            sizes = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
            if len(sizes) == len(some):
                self._add(some, [ids], sizes)
            else:
                self._add(some, self._encode([p.decode() for p in some]))

    def learn(self, new: list[bytes]) -> None:
        pairs: list[bytes] = []
        plain, whole = set(), set()
        for w in new:
            stem = w.rstrip(MARKS)
            if stem.isalpha():
                mark, stem = w[len(stem):], stem.lower()
            elif stem and LATIN.fullmatch(s := stem.decode()):
                mark, stem = w[len(stem):], s.lower().encode()
            else:
                pairs += (w, b"")
                if w not in self.parts:
                    whole.add(w)
                continue
            pairs += (stem, mark)
            if stem not in self.parts:
                plain.add(stem)
            if mark not in self.parts:
                plain.add(mark)
        self._encode_plain(list(plain))
        if whole:
            self._add(list(whole), self._encode([w.decode() for w in whole]))
        flat, sizes = self.part_ids.get(np.fromiter(map(self.parts.__getitem__, pairs), np.int64, len(pairs)))
        self.known.update(zip(new, self.word_ids.add(flat, sizes.reshape(-1, 2).sum(axis=1))))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.parts) > self.words or len(self.known) > self.words:
            self.known, self.word_ids = {}, Store()
        if len(self.parts) > self.words:
            self.parts, self.part_ids = {b"": 0}, Store()
            self.part_ids.add(np.empty(0, np.uint32), np.zeros(1, np.int64))
        split = [text.encode().split() for text in texts]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self.learn(list({words[k] for k in missing}))
            at[missing] = [self.known[words[k]] for k in missing]
        start = 0
        for parts in split:
            yield self.word_ids.get(at[start: start + len(parts)])[0]
            start += len(parts)


_WORDS: dict[str, Words] = {}


def pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids cut at ``capacity``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(path) or _WORDS.setdefault(path, Words(path))
        for batch in batches:
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, found in zip(batch.column(0).to_pylist(), words.encode(texts)):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start: start + capacity]
                    out.append((key, k, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in out], schema.field(i).type) for i in range(5)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of lengths, each at most ``capacity``; the lengths lie in 1..capacity."""
    left = np.bincount(lengths, minlength=capacity + 1).tolist()
    there = sum(1 << n for n in range(1, capacity + 1) if left[n])  # bit n: a piece of length n is unpacked

    def largest(most: int) -> int:
        return max(0, (there & ((1 << (most + 1)) - 1)).bit_length() - 1) if most > 0 else 0

    def take(n: int) -> None:
        nonlocal there
        left[n] -= 1
        if not left[n]:
            there ^= 1 << n

    def give(n: int) -> None:
        nonlocal there
        left[n] += 1
        there |= 1 << n

    def two(gap: int, least: int) -> tuple[int, int]:
        """The two unpacked lengths with the largest sum up to ``gap``, if it is above ``least``."""
        best = (0, 0)
        a = largest(gap - 1)
        while a and 2 * a > least:
            b = largest(min(a, gap - a))
            if b == a and left[a] < 2:
                b = largest(a - 1)
            if b and a + b > least:
                best, least = (a, b), a + b
                if least == gap:
                    break
            a = largest(a - 1)
        return best

    out = []
    while there:
        bin_, gap = [], capacity
        while n := largest(gap):
            take(n)
            bin_.append(n)
            gap -= n
        while gap:
            small = min(bin_)
            a, b = two(gap + small, small)
            if not a:
                break
            bin_.remove(small)
            give(small)
            take(a)
            take(b)
            bin_ += [a, b]
            gap += small - a - b
        out.append(bin_)
    return out


def _packed(capacity: int):
    def of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ignore_index=True)
        lengths = group["length"].to_numpy()
        bins = best_two_fit(lengths, capacity)
        flat = np.fromiter(chain.from_iterable(bins), np.int64, len(lengths))
        sizes = np.fromiter(map(len, bins), np.int64, len(bins))
        seq = np.repeat(np.arange(len(bins)), sizes)
        ends = np.cumsum(flat)
        offset = ends - flat - np.repeat((ends - flat)[np.cumsum(sizes) - sizes], sizes)
        at = np.argsort(flat, kind="stable")  # the places by length, as the pieces are
        group["sequence_id"] = (int(key[0]) << 32) + seq[at]
        group["offset"] = offset[at]
        return group.drop(columns=["_group"])

    return of


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    made = stored(pieces(docs, path, text, doc_id, capacity, end_id), "pieces")
    groups = max(1, round(made.count() / GROUP))
    return made.withColumn("_group", F.floor(F.rand(11) * groups)).groupBy("_group").applyInPandas(
        _packed(capacity),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_pack")
def op9_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
