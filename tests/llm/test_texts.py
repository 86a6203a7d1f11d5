"""Operators on texts against plain Python, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortgrid.llm import common, lines, mixing, packing, quality, resample, sharding, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def mixed_rows(say):
    a, b, long = say(1, 60), say(2, 45), say(3, 3000)
    return [
        (1, a), (2, b), (3, f"{say(4, 9)} {a} {say(5, 9)}"), (4, a), (5, None), (6, ""), (7, " \n\t "), (8, long),
        (9, f"{long} {say(6, 20)}"), (10, "the the the the the the"), (11, "ünï\x1fcode word " + b), (12, say(7, 12)),
        (13, say(7, 13)), (14, say(7, 13)), (None, a), (None, None), (4, a), (4, b), (15, "### $$ " + say(8, 60)),
        (16, "\n".join([say(9, 12)] * 3 + [say(10, 12)])), (17, "\n".join([say(9, 12), "Of.", "Of."])), (18, "Of."),
    ]


def collect(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_word_hashes_split_on_six_blanks():
    texts = ["a b\x0bc", "", "a b", "x" * 5000 + " a", "  a  "]
    h, doc = common.word_hashes([t.encode() for t in texts])
    words = [(w, i) for i, t in enumerate(texts) for w in WORD.findall(t)]
    assert doc.tolist() == [i for _, i in words]
    assert len({int(x) for x in h}) == len({w for w, _ in words})
    assert h[0] == h[-1]
    assert len(set(common.window_hashes(h, 2).tolist())) == len({(a[0], b[0]) for a, b in zip(words, words[1:])})


def substring_brute(rows, window):
    first, out = {}, []
    for i, t in rows:
        if i is not None and t is not None:
            w = t.encode().split()
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if i is not None and t is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(documents, mixed_rows):
    docs = documents(*mixed_rows).withColumn("n_words", F.lit("clash"))
    out = substring.substring_dedup(docs).withColumn("sha", F.sha2("kept_text", 256))
    assert collect(out, "doc_id", "n_words", "n_removed", "sha") == substring_brute(mixed_rows, 13)
    longest = {r["doc_id"]: r["longest_repeat"] for r in out.collect()}
    assert longest[9] == 13 * 2**7 and longest[1] == 0 and longest[14] == 13
    assert substring.substring_dedup(documents()).count() == 0


def test_substring_dedup_in_small_blocks(documents, say, monkeypatch):
    """The same with many blocks and buckets, and passages that most documents hold."""
    random.seed(5)
    rows = []
    for i in range(120):
        parts = [say(100 + i, random.randint(0, 40)), say(1, 30), say(200 + i, 5), say(random.randint(2, 6), 20)]
        rows.append((i, " ".join(random.sample(parts, random.randint(1, 4)))))
    monkeypatch.setattr(substring, "BUCKET", 700)
    out = substring.substring_dedup(documents(*rows).repartition(7)).withColumn("sha", F.sha2("kept_text", 256))
    assert collect(out, "doc_id", "n_words", "n_removed", "sha") == substring_brute(rows, 13)


def near(a, b):
    """Within one inserted, deleted or replaced word."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


def lines_brute(rows, least):
    every = []
    for i, t in rows:
        if i is not None and t is not None:
            every += [((i, k), tuple(w)) for k, line in enumerate(t.split("\n")) if (w := WORD.findall(line))]
    first = {}
    for at, w in every:
        first[w] = min(first.get(w, at), at)
    close = {w for w, at in first.items() if len(w) >= least and any(
        o < at and v != w and len(v) >= least and near(v, w) for v, o in first.items())}
    out = []
    for i, t in rows:
        held, exact, by_near, kept = 0, 0, 0, []
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(WORD.findall(line))
            held += bool(w)
            if w and i is not None and first[w] < (i, k):
                exact += 1
            elif w and i is not None and w in close:
                by_near += 1
            else:
                kept.append(line)
        out.append((i, held, exact, by_near, None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_variant_hashes(spark):
    """Equal exactly where the words that are left are equal."""
    rng = random.Random(8)
    lines_ = [rng.choices("abc", k=n) for n in (1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 30) for _ in range(8)]
    df = spark.createDataFrame([(x,) for x in lines_], "w array<string>")
    whole = F.expr(lines._xor("transform(w, (x, i) -> xxhash64(x, i))"))
    found = {}
    for r in df.select("w", whole.alias("h"), lines._variant_hashes("w").alias("v")).collect():
        assert len(r.v) == len(r.w)
        for words, h in [(r.w, r.h)] + [(r.w[:i] + r.w[i + 1:], h) for i, h in enumerate(r.v)]:
            found.setdefault(tuple(words), set()).add(h)
    assert all(len(h) == 1 for h in found.values()) and len({h for hs in found.values() for h in hs}) == len(found)


def test_very_long_lines(documents, say):
    """Two lines of 20,000 words, one word apart: a text without line feeds is a line."""
    long = say(7, 20_000).split()
    other = [*long[:9000], "new", *long[9001:]]
    out = lines.line_dedup(documents((1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[5:])))).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_near"]) for r in out} == {1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 0, 0)}


def test_line_dedup(documents, mixed_rows, say):
    base = say(20, 10).split()
    variants = [base, base[:4] + ["new"] + base[5:], base[:7] + base[8:], base + ["more"], ["x"] + base, base[:2] + ["p", "q"] + base[4:]]
    rows = mixed_rows + [(30 + k, " ".join(v) + f"\nown {k} {say(40 + k, 9)}\n\n") for k, v in enumerate(variants)]
    rows = [r for r in rows if not (r[0] == 4 and r[1] != rows[0][1])]  # one text for each id
    rows += [(50 + k, f"{say(21, 8)} number {k}") for k in range(40)] + [(90, say(22, 400)), (91, say(22, 399) + " end")]
    out = lines.line_dedup(documents(*rows).withColumn("n_near", F.lit(1.5)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_exact", "n_near"]
    assert collect(out, "doc_id", "n_lines", "n_exact", "n_near", "text") == lines_brute(rows, lines.MIN_WORDS)
    assert lines.line_dedup(documents()).count() == 0


def test_line_dedup_leaves_one_small_table(documents, tmp_path, monkeypatch):
    """Texts are shuffled last: only the numbers of removed lines are on the disk beside them, not the tables before."""
    long = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{long}\n\x0b\x0c\nshort line"), (2, f" \t{long}  x\r\nshort\tline\n\n"), (2, f" \t{long}  x\r\nshort\tline\n\n"), (3, "\x0b"), (4, None)]
    monkeypatch.setattr("cohortgrid.llm.common.scratch", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    out = lines.line_dedup(documents(*rows))
    got = sorted((r.doc_id, r.text or "", r.n_lines, r.n_exact, r.n_near) for r in out.collect())
    left = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if any(p.glob("*.parquet"))]
    assert left == ["lines-removed"]
    assert got == [(1, rows[0][1], 2, 0, 0), (2, "\n", 2, 1, 1), (2, "\n", 2, 1, 1), (3, "\x0b", 0, 0, 0), (4, "", 0, 0, 0)]


def test_line_dedup_is_native(documents, mixed_rows):
    plan = lines.line_dedup(documents(*mixed_rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def repeat_words(w):
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k:k + 3]), []).append(k)
    return len({k + s for at in seen.values() if len(at) > 1 for k in at for s in range(3)})


def test_quality_measures(documents, mixed_rows, say):
    rows = [*mixed_rows, (40, "a b c d a b c x a b c"), (41, "a b c a b c"), (42, "a a a"), (43, "a a a a"), (44, say(1, 5000) + " " + say(1, 5000))]
    out = quality.judge(documents(*rows).withColumn("kept", F.lit("clash")))
    want = []
    for i, t in rows:
        t = t or ""
        w, held = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        rep = repeat_words(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), rep,
                     len(w) < 50 or 100 * rep > 50 * len(w)))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collect(out, *cols) == sorted(want, key=str)
    assert all(not (r["base_failed"] and r["kept"]) for r in out.collect())
    assert quality.judge(documents()).count() == 0


def test_quality_rules_table(spark, documents):
    good = "the quick brown fox and a dog of the town went to see it with that cat for " * 1
    text = " ".join(f"{w}{k}" if k % 3 else w for k in range(5) for w in good.split())
    cases = {1: text, 2: text.replace("e", "#"), 3: text.upper(), 4: " ".join("qz" * 3 + str(k) for k in range(80)),
             5: " ".join(str(k * 37) for k in range(80))}
    out = {r["doc_id"]: r for r in quality.judge(documents(*cases.items())).collect()}
    assert out[1]["kept"] and not any(out[k]["kept"] for k in (2, 3, 4, 5))
    assert "shout_word_ratio" in out[3]["failed"] and "stop_word_ratio" in out[4]["failed"] and "letter_word_ratio" in out[5]["failed"]
    other = quality.judge(documents((4, cases[4])).withColumn("lang", F.lit("fi"))).first()
    assert other["kept"]  # the stop-word rule holds for listed languages only
    plan = quality.judge(documents((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(ids, prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(documents, mixed_rows, say):
    rows = [*mixed_rows, (50, say(30, 400)), (51, say(30, 400) + " x"), (52, "y " + say(30, 400)), (53, "One TWO"), (54, "one two"), (55, "É a"), (56, "é a")]
    prints = [brute_print(t) for _, t in rows]
    comps = classes_of([i for i, _ in rows], prints)
    want = sorted(((i, format(p, "016x"), c) for (i, _), p, c in zip(rows, prints, comps)), key=str)
    assert collect(simhash.near_duplicates(documents(*rows)), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(documents()).count() == 0


def test_simhash_links_of_close_fingerprints(spark, monkeypatch):
    """Many fingerprints within a few bits, over several tiles: components equal those of all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    prints = set(map(int, base)) | {0, -1}
    for b in base[:4]:
        x = int(b)
        for _ in range(70):
            x ^= 1 << int(rng.integers(0, 62))
            prints.add(x)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "TILE", 8)
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    roots = {r["id"]: r["root"] for r in common.components(links).collect()}
    want = classes_of(prints, [p & (2**64 - 1) for p in prints])
    assert [roots.get(p, p) for p in prints] == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    roots = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {k: 100 for k in range(100, 161)} | {k: 1000 for k in range(1000, 1300)} | {7: 7, 8: 7}


def test_targets_fill_to_the_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 5, None: 100}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2)))
    left, free, want = float(sum(sizes.values())), set(sizes), {}
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not full:
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    want |= {s: weight[s] * level for s in free}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(documents, say, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    rows = [(k, say(k, 5 + k % 40), ["a", "b", "c", "d", None][k % 5]) for k in range(600)] + [(900, None, "a"), (901, "", "e"), (None, "x y", "a"), (5, say(5, 10), "a")]
    out = mixing.mix(documents(*rows).withColumn("taken", F.lit("clash")))
    got = out.collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in got)
    for s in ("a", "b", "c", "d", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 25
    again = mixing.mix(documents(*rows).repartition(5))
    assert collect(again, "doc_id", "taken") == collect(out, "doc_id", "taken")
    assert mixing.repeated(out, ["doc_id"]).count() == sum(r["copies"] for r in got if r["size"])
    heavy = mixing.mix(documents(*rows), weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).where("source = 'a'").collect()
    even = [r["copies"] for r in heavy if r["doc_id"] is not None and r["doc_id"] % 2 == 0]
    odd = [r["copies"] for r in heavy if r["doc_id"] is not None and r["doc_id"] % 2]
    assert sum(even) / len(even) > sum(odd) / len(odd)
    assert mixing.mix(documents()).count() == 0


def test_mix_spreads_capped_sources(documents, say, monkeypatch):
    # Source a stops at three times its size, so none of its documents has a rank; still no bucket holds them all.
    monkeypatch.setattr(mixing, "BUCKET", 20)
    held = {}

    def keep(df, purpose, stored=mixing.stored):
        held[purpose] = stored(df, purpose)
        return held[purpose]

    monkeypatch.setattr(mixing, "stored", keep)
    rows = [(k, say(k, 10), "a") for k in range(200)] + [(1000 + k, say(k, 100), "b") for k in range(300)]
    got = mixing.mix(documents(*rows)).collect()
    assert all(r["copies"] == 3 for r in got if r["source"] == "a")
    sums = held["mix-buckets"].where("_source = 'a'").collect()
    assert len(sums) == 10 and sum(r["_words"] for r in sums) == 0


def test_shard(documents, say):
    rows = [(k, say(k, 20 + k * 7 % 300)) for k in range(800)] + [(1000 + k, say(1, 50)) for k in range(400)] + [(None, None), (3000, ""), (5, say(5, 55))]
    got = sharding.shard(documents(*rows).withColumn("shard", F.lit("clash")).drop("lang")).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(24)]
    count = [sum(1 for r in got if r["shard"] == s) for s in range(24)]
    assert max(load) <= 1.1 * min(load) and max(count) <= 1.3 * min(count)
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    assert sharding.shard(documents()).count() == 0


def test_shard_keeps_groups_whole(documents, say):
    """Equal texts are together unless there are more of them than a whole shard holds."""
    rows = [(k, say(k, 30 + k % 90)) for k in range(3000)]
    rows += [(10_000 + 100 * g + k, say(5000 + g, 20 + 3 * g)) for g in range(40) for k in range(2 + 3 * (g % 8))]
    rows += [(20_000 + k, "hot") for k in range(1500)]
    where = {}
    got = sharding.shard(documents(*rows)).collect()
    shard_of = {r["doc_id"]: r["shard"] for r in got}
    for i, t in rows:
        where.setdefault(t, set()).add(shard_of[i])
    assert {t for t, s in where.items() if len(s) > 1} == {"hot"}
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(24)]
    assert max(load) <= 1.03 * min(load)


def test_place_takes_the_highest_dot_product():
    rng = random.Random(6)
    units = [[rng.random() * 10, rng.random() * 3, rng.randint(1, 4)] for _ in range(60)]
    residual = [[sum(u[m] for u in units) / 5 for m in range(3)] for _ in range(5)]
    got = sharding.place(np.array(units), np.array(residual))
    scale = [sum(r[m] for r in residual) for m in range(3)]
    left = [[r[m] / scale[m] for m in range(3)] for r in residual]
    rel = [[u[m] / scale[m] for m in range(3)] for u in units]
    for i in sorted(range(60), key=lambda i: -max(rel[i])):
        open_ = [sum(max(s[m], 0) * rel[i][m] for m in range(3)) for s in left]
        assert open_[got[i]] >= max(open_) - 1e-12
        left[got[i]] = [a - b for a, b in zip(left[got[i]], rel[i])]


def test_best_two_fit():
    random.seed(2)
    for cap in (10, 97, 4096):
        lengths = np.array([random.randint(1, cap) if random.random() < 0.5 else random.randint(1, max(1, cap // 5)) for _ in range(900)])
        bins = packing.best_two_fit(lengths, cap)
        assert sorted(x for b in bins for x in b) == sorted(lengths.tolist())
        assert all(sum(b) <= cap for b in bins) and len(bins) <= lengths.sum() / cap * 1.03 + 2
    assert packing.best_two_fit(np.array([6, 5, 5, 4]), 10) in ([[6, 4], [5, 5]], [[5, 5], [6, 4]])
    assert packing.best_two_fit(np.array([7, 2, 4, 6]), 10) == [[6, 4], [7, 2]] or len(packing.best_two_fit(np.array([7, 2, 4, 6]), 10)) == 2
    assert packing.best_two_fit(np.array([], dtype=np.int64), 10) == []


def test_pack(documents, mixed_rows, say, monkeypatch):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    rows = [*mixed_rows, (60, say(60, 4000)), (61, "a<|endoftext|>b don't CAFÉ é̀ xͅ 日本語"), (61, "a")]
    got = packing.pack(documents(*rows), path).collect()
    whole = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(documents(), path).count() == 0


def test_resample(documents, spark, say):
    random.seed(7)
    good, junk = [f"good{k}" for k in range(300)], [f"junk{k}" for k in range(300)]
    text = lambda pool: " ".join(random.choice(pool) for _ in range(60))
    rows = [(k, text(good if k % 3 else junk)) for k in range(600)] + [(700, None), (701, ""), (None, text(good)), (1, text(good))]
    docs = documents(*rows)
    labels = spark.createDataFrame([(k,) for k in range(0, 200) if k % 3], "doc_id long")
    out = resample.gumbel_top_k(resample.weigh(docs, resample.fit(docs, labels)), 0.66)
    got = out.collect()
    assert sum(r["kept"] for r in got) == round(0.66 * len(rows)) and len(got) == len(rows)
    held_out = [r for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 600]
    assert sum(r["kept"] == bool(r["doc_id"] % 3) for r in held_out) / len(held_out) > 0.97
    kept = [r["score"] for r in got if r["kept"]]
    assert min(kept) >= max(r["score"] for r in got if not r["kept"])
    assert resample.gumbel_top_k(resample.weigh(documents(), resample.fit(documents(), labels)), 0.5).count() == 0
    assert set(resample.fit(docs, labels.where("doc_id < 0"))) == {0.0}


def test_resample_weights(documents, spark, say):
    """Log weights from plain counts of each text's grams."""
    rows = [(k, say(k % 4, 5 + k) + (" Good" if k % 3 else " bad")) for k in range(30)] + [(40, None), (41, ""), (None, say(1, 9))]
    good = {k for k in range(30) if k % 3}
    grams = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        each = [resample.ngrams([x])[0][0] for x in w] + [resample.ngrams([f"{x} {y}"])[0][2] for x, y in zip(w, w[1:])]
        grams.setdefault(i, []).extend(each)
    raw, target = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    for i, each in grams.items():
        for g in each:
            raw[g] += 1
            target[g] += i in good
    ratio = np.log((target + 1) / (target.sum() + resample.BUCKETS)) - np.log((raw + 1) / (raw.sum() + resample.BUCKETS))
    model = resample.fit(documents(*rows), spark.createDataFrame([(k,) for k in good], "doc_id long"))
    got = {r["doc_id"]: (r["n_grams"], r["log_weight"]) for r in resample.weigh(documents(*rows), model).collect()}
    assert got == {i: (len(each), pytest.approx(sum(ratio[g] for g in each))) for i, each in grams.items()}


@pytest.mark.parametrize("k", [0, 1, 7, 250, 500, 999, 1000])
def test_first_rows_orders_no_large_group(spark, k):
    rows = [(float(i % 3 if i % 2 else i), i % 5, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b long, c long").cache()
    got = df.where(resample.first_rows(df, k, ["a", "b", "c"], most=20)).collect()
    assert sorted(tuple(r) for r in got) == sorted(rows)[:k]


def test_resample_ties(spark):
    weighed = spark.createDataFrame([(None, 1, 0.5)] * 30 + [(7, 1, 0.5)] * 40 + [(8, 1, 0.25)], "doc_id long, n_grams long, log_weight double")
    out = resample.gumbel_top_k(weighed, 0.5).collect()
    assert sum(r["kept"] for r in out) == round(0.5 * 71) and len(out) == 71
    assert min(r["score"] for r in out if r["kept"]) >= max(r["score"] for r in out if not r["kept"])
