"""Suffix-array dedup against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cohortgrid.llm import suffix


def brute(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k: k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if count[t[k: k + window]] > 1:
                gone[k: k + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, **how):
    rows = suffix.suffix_dedup(docs, **how).collect()
    for r in rows:
        assert sum(x.hi - x.lo for x in r.removed) == r.n_removed and all(a.hi < b.lo for a, b in zip(r.removed, r.removed[1:]))
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé \n", k=rng.randint(30, 120))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 60))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), passages[0] if rng.random() < 0.5 else rng.choice(passages))  # one is in half of all
        rows.append((i, "".join(parts)))
    rows += [(200 + k, rows[3][1]) for k in range(30)] + [(3, rows[3][1]), (3, "other"), (None, rows[5][1]), (None, rows[5][1]), (None, None)]
    rows += [(300, "ab" * 90), (301, "x" * 70), (302, ""), (303, "z" * 24), (304, "short"), (305, "q\0" * 30 + "é" * 40)]
    return rows


@pytest.mark.parametrize("window,anchor,group", [(24, 8, 1 << 20), (24, 8, 2000), (25, 20, 700), (32, 4, 4000)])
def test_against_all_windows(documents, monkeypatch, window, anchor, group):
    monkeypatch.setattr(suffix, "PIECE", 500)
    monkeypatch.setattr(suffix, "LONGEST", 40)
    monkeypatch.setattr(suffix, "SHARD", 600)
    monkeypatch.setattr(suffix, "BUCKET", 300)
    rows = corpus(window)
    docs = documents(*rows).withColumnRenamed("n_chars", "n_spans").repartition(5)
    assert got(docs, window=window, anchor=anchor, group=group) == brute(rows, window)


def test_production_window(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == brute(rows, suffix.WINDOW)
    assert got(documents()) == []
    assert got(documents((1, None), (2, "a" * 399), (3, "b" * 400), (4, "c" * 401))) == brute([(1, None), (2, "a" * 399), (3, "b" * 400), (4, "c" * 401)], 400)


def test_transform_and_merge():
    """Rows in suffix order, the strings back from the transform alone, and blocks as those of sorted prefixes."""
    rng = random.Random(1)
    for length in (1, 2, 5, 8, 13):
        shards = [[bytes(rng.choices(b"ab\0\xff", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 9))] for _ in range(4)]
        made = [suffix.transform(s) for s in shards]
        prefixes = []
        for strings, (bwt, order) in zip(shards, made):
            rows = [(s[k:], n) for n, s in enumerate(strings) for k in range(len(s) + 1)]
            place = {p: r for p, r in enumerate(rows)}
            assert [place[p] for p in order] == sorted(rows, key=lambda r: (r[0], r[1]))
            prefixes += [place[p][0][:length] + b"$" * (len(place[p][0]) < length) for p in order]
            step = np.argsort(bwt, kind="stable")
            back, at = [], {int(p): r for r, p in enumerate(order)}
            for n, s in enumerate(strings):
                row, out = at[sum(len(x) + 1 for x in strings[:n])], b""
                while (symbol := np.sort(bwt)[row]) > 0:
                    out, row = out + bytes([symbol - 1]), step[row]
                back.append(out)
            assert back == strings
        block = suffix.interleave([m[0] for m in made], length)
        whole = [k for k, p in enumerate(prefixes) if len(p) == length and not p.endswith(b"$")]
        assert {(prefixes[a] == prefixes[b]) == (block[a] == block[b]) for a in whole for b in whole} == {True}
        assert all(block[a] < block[b] for a in whole for b in whole if prefixes[a] < prefixes[b])


def test_spans_cover_all_windows_once():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abc", k=n)) for n in (0, 10, 200, 24, 23, 500)]
    of, start, n, anchor, many = suffix.spans(texts, 24, 8)
    seen = sorted((int(o), int(s) + k) for o, s, m in zip(of, start, n) for k in range(m))
    assert seen == [(o, k) for o, t in enumerate(texts) for k in range(len(t) - 23)]
    least = {}
    for o, s, m, x in zip(of, start, n, anchor):
        for k in range(m):
            window = texts[o][s + k: s + k + 24]
            assert least.setdefault(window, x) == x
