"""The prefix trie against plain Python, over parts small enough that most nodes lie in several."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortgrid.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    """Rows (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) by the query's definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, tid(role, text), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: h[c]] + ts[h[c]:] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(cs) if len(own[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(not kids[q] for q in under),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tid(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def got(nodes):
    return sorted((tuple(r) for r in nodes.drop("turn_id").collect()), key=str)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(trie, "PART_BYTES", 900)
    monkeypatch.setattr(trie, "ID_BLOCK", 8)


def forest(seed, n, hot):
    """Conversations of few distinct turns, so that prefixes are shared; ``hot``: the share with one first turn."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(1000), n):
        first = [("system", "hot")] if rng.random() < hot else []
        turns = first + [(rng.choice("ua"), "t" * rng.randint(0, 3)) for _ in range(rng.randint(0 if first else 1, 6))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.4), (3, 0.9)])
def test_trie_over_many_parts(spark, small_parts, seed, hot):
    rows = forest(seed, 150, hot)
    for rebuild in (False, True):
        own = trie.ordered_turns(spark.createDataFrame(rows, TURNS))
        conversations = trie.rebuilt(spark.createDataFrame(rows, TURNS)) if rebuild else own
        assert got(trie.prefix_trie(conversations)) == brute(rows, rebuild)


def test_edges(spark, small_parts):
    long = [(700, k, "u", f"turn {k}") for k in range(400)]
    rows = [
        (None, 0, "u", "no id"), (5, None, None, None), (5, 0, "u", None), (5, 0, "u", None), (5, 0, "a", "tie"), (6, 3, "", ""),
        (7, 0, "u", "ü" * 3000), (8, 0, "1:u", "x"), (9, 0, "1", ":ux"), *long, *[(800, k, "u", f"turn {k}") for k in range(399)],
        *[(c, 0, "u", "copy") for c in range(900, 960)], *[(c, 1, "a", "copy") for c in range(900, 960)],
    ]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], TURNS + ", depth string")
    assert got(trie.prefix_trie(trie.ordered_turns(turns))) == brute(rows, False)
    assert got(trie.prefix_trie(trie.rebuilt(turns))) == brute(rows)
    nodes = trie.with_texts(trie.prefix_trie(trie.ordered_turns(turns)), turns)
    assert nodes.where("depth = 1 AND conv_id = 7").first()["text"] == "ü" * 3000
    assert nodes.where("depth = 0").first()["text"] is None
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.rebuilt(empty)).count() == 0


def test_a_conversation_without_turns_ends_at_the_root(spark):
    rows = [(c, 0, "u", "x") for c in range(1, 30)]
    out = got(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, TURNS))))
    assert out == brute(rows)
    assert any(r[1] == 0 and r[7] != trie.NO_IDS for r in out)


def test_layouts_grow_and_keep_order():
    rng = random.Random(4)
    for size in (4, 5, 16, 17, 48, 49, 256):
        keys = [bytes([b]) + bytes(15) for b in rng.sample(range(256), size)]
        root = trie.tree(keys)
        assert root.places == next(p for p in (4, 16, 48, 256) if size <= p)
        assert [keys[n.value] for n in root.children()] == sorted(keys)
        assert all(root.find(k[0]).prefix == k[1:] for k in keys)


def test_a_hot_first_turn_is_spread(spark, monkeypatch):
    """Parts hold keys, so those of one first turn lie in several."""
    monkeypatch.setattr(trie, "PART_BYTES", 2000)
    rows = [(c, k, "u", "hot" if k == 0 else f"{c}") for c in range(400) for k in range(2)]
    conversations = trie.ordered_turns(spark.createDataFrame(rows, TURNS))
    nodes = trie.prefix_trie(conversations)
    assert got(nodes) == brute(rows, False)
    assert nodes.where(F.col("depth") == 1).first()["n_convs"] == 400
