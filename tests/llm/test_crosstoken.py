"""Cross-tokenizer alignment against a token-by-token computation of whole texts."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from cohortgrid.llm import crosstoken as ct


@pytest.fixture(scope="module")
def both():
    return ct.tokenizers(ct.tokenizer_paths())


def tokens(both, text):
    """Whole-text ids and ends of both sides, or None."""
    if not text:
        return None
    a, b = both._a.encode(" " + text, add_special_tokens=False).ids, both._b.encode(text)
    whole = (" " + text).encode()
    if b"".join(both.a_bytes[i] for i in a) != whole or b"".join(both.b_bytes[i] for i in b) != whole:
        return None
    return a, list(accumulate(len(both.a_bytes[i]) for i in a)), b, list(accumulate(len(both.b_bytes[i]) for i in b))


def brute(both, rows):
    per_doc = []
    for doc_id, text in rows:
        found = tokens(both, text)
        gs, links = [], Counter()
        if found:
            a, ea, b, eb = found
            i = j = 0
            for end in sorted(set(ea) & set(eb)):
                p, q = i, j
                while i < len(a) and ea[i] <= end:
                    i += 1
                while j < len(b) and eb[j] <= end:
                    j += 1
                gs.append((a[p:i], b[q:j]))
                links.update((x, y) for x in a[p:i] for y in b[q:j])
        per_doc.append((doc_id, found, gs, links))
    count = Counter(pair for *_, links in per_doc for pair in links)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc_id, found, gs, links in per_doc:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((doc_id, len(found[0]) if found else 0, len(found[2]) if found else 0, len(gs), sum(links.values()),
                    sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return sorted(out, key=str)


def got(docs, **how):
    return sorted((tuple(r) for r in ct.align(docs, **how)[0].collect()), key=str)


TEXTS = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "  a  b   c ", "tab\tand\nlines\r\n\n end ", "don't we'll 123,456.78 «ünïcode» ﬁ",
    "▁ under ▁score", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x41> <pad>", "日本語のテキスト と 漢字", "🙂🙃 emoji👩‍👩‍👧‍👦 x", "nul\x00 byte",
    "a　b c  d", "x\x1c y\x1f z", "aaaa" * 300, "word " * 500, "é é", "İ İ ß ẞ", "a" * 5000 + " b " + "日" * 2000,
]


def test_edges_and_sharing(documents, both):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(5, "a"), (5, "another a"), (None, "no id"), (None, "no id"), (99, TEXTS[10])]
    want = brute(both, rows)
    docs = documents(*rows).withColumnRenamed("n_chars", "n_links")
    assert got(docs) == want
    assert got(docs, width=64) == want  # nearly all texts in ranges
    assert got(docs.repartition(5), width=1000, block_bytes=100) == want
    assert got(documents()) == []
    pairs = {(r.a_id, r.b_id): r.n for r in ct.align(docs)[1].collect()}
    assert len(pairs) > 100 and max(pairs.values()) >= 4


def test_given_table(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == brute(both, rows)
    assert got(docs, width=700) == brute(both, rows)


def test_fragments_compose_from_any_cut_in_any_bracketing(both):
    rng = random.Random(3)
    for text in ["don't stop 日本語 ünïcode 12345 " * 6, "hyperparameterization of unbelievablenesses", "a" * 90, "".join(rng.choices("abé日 \n", k=300))]:
        a, ea, b, eb = tokens(both, text)
        whole = [(x, y) for x, y, _ in ct.groups(a, ea, b, eb)]
        for _ in range(20):
            cuts = sorted(rng.sample(range(1, ea[-1]), min(7, ea[-1] - 1)))
            parts = []
            for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, ea[-1]])):
                side = [([i for i, e in zip(ids, ends) if lo < e <= hi], [e for e in ends if lo < e <= hi]) for ids, ends in ((a, ea), (b, eb))]
                parts.append(ct.fragment(*side[0], *side[1], k))
            while len(parts) > 1:
                k = rng.randrange(len(parts) - 1)
                parts[k: k + 2] = [parts[k].then(parts[k + 1])]
            found = sorted(parts[0].whole(), key=lambda g: g[0])
            assert [(x, y) for _, x, y in found] == whole


def test_open_ends_are_not_empty(both):
    """Ranges cut through groups, so that fragments carry tokens across."""
    text = "unbelievablenesses " * 40
    parts = list(ct.ranges(text, 50))
    assert len(parts) == -(-(len(text) + 1) // 50) and parts[0][2] == 0
    carried = 0
    for k, (lo, hi, at, part) in enumerate(parts):
        a, ea, b, eb = tokens(both, part)
        keep = [[(i, e + at) for i, e in zip(*s) if lo < e + at <= hi] for s in ((a, ea), (b, eb))]
        f = ct.fragment([i for i, _ in keep[0]], [e for _, e in keep[0]], [i for i, _ in keep[1]], [e for _, e in keep[1]], k)
        carried += len(f.sa) + len(f.sb)
    assert carried > 0


def test_no_range_starts_in_a_run_longer_than_a_range():
    text = "x" * 1000 + " " + "ab " * 100
    parts = list(ct.ranges(text, 64))
    assert parts[0][:2] == (0, 1024) and all(hi - lo <= 64 for lo, hi, *_ in parts[1:])
