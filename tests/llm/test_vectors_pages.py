"""Search and extraction against plain Python; the queries and the pipeline on the smallest table."""

import html
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortgrid.llm import queries, template, topk
from cohortgrid.llm.common import tuned

SF = "/root/testdata/sf0.001"


def brute_top(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted({(i, tuple(v)) for i, v in ok})
    out = []
    for q, v in {(i, v) for i, v in ok if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    tuned(spark)
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(400)]
    rows += [(400 + k, rows[0][1]) for k in range(60)]  # copies of a query
    rows += [(500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (None, rows[3][1])]
    rows += [(700, [1.0, 2.0]), (701, [1.0, -2.0]), (750, []), (0, rows[0][1]), (800, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{x}}</style><script>var a="</p>";</script></head>
<body class="post with-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li>About</ul></nav><div class="ad">Buy {n}</div>
<{tag}><h1>Head&amp;line {n}</h1><div class="share-bar">Share</div><p><b>One {n}<br>two<p>T<i>hre</i>e &lt;b&gt; &#233;
  four<form><input value="x>y">Mail</form><ul><li>five<li>six</ul><aside>Side</aside><section class="comments"><p>Nice!</p></section></{tag}>
<div id="cookie-notice">Cookies</div><!-- x > y --><footer>&copy; all</footer>"""


@pytest.mark.parametrize("tag", ["article", "main"])
def test_extract_main_text(tag):
    pages = [PAGE.format(n=n, tag=tag) for n in range(5)]
    assert template.extract(pages) == [f"Head&line {n} One {n} two Three <b> é four five six" for n in range(5)]
    assert template.extract(pages[:1]) == template.extract(pages)[:1]


def test_extract_without_article_drops_what_pages_share():
    page = "<body><div class=top>Welcome to the site</div><div class=body><p>Text {n} of the page.</p><p>More {n}.</p></div><div>All rights</div></body>"
    assert template.extract([page.format(n=n) for n in range(6)]) == [f"Text {n} of the page. More {n}." for n in range(6)]


def test_extract_odd_pages():
    odd = [None, "", "plain text", "<p>unclosed <b>bold", "<script>never closed", "</div></p>x", "<a href='>'>y</a>", "<" * 5000]
    assert template.extract(odd)[:4] == ["", "", "plain text", "unclosed bold"]
    assert template.extract(["<article>" + "<div>" * 3000 + "deep" + "</article>"]) == ["deep"]


@pytest.mark.parametrize("inner", [
    "<figure><img src=x><figcaption>kept text</figcaption></figure>", "<math><mi>kept</mi> <mi>text</mi></math>", "<noscript>kept text</noscript>",
    "<fieldset>kept text</fieldset>", "<p><button>kept</button> text</p>", "<xmp>kept text</xmp>", "<dialog>kept text</dialog>",
    "<h2 id='search-methods'>kept text</h2>", "<p class=related>kept text</p>", "<p id=comment-on-form>kept text</p>", "<header><h1>kept text</h1></header>"])
def test_article_text_that_no_rule_names_stays(inner):
    assert template.extract([f"<article><p>Before.</p>{inner}<p>After.</p></article>"]) == ["Before. kept text After."]


@pytest.mark.parametrize("inner", [
    "<nav>gone</nav>", "<aside>gone</aside>", "<footer>gone</footer>", "<form>gone</form>", "<menu>gone</menu>", "<script>gone</script>", "<style>gone</style>",
    "<div class=advert>gone</div>", "<section id=comments><p>gone</p></section>", "<div role=navigation>gone</div>", "<div class='cookie notice'>gone</div>",
    "<select><option>gone</select>", "<textarea>gone</textarea>"])
def test_what_the_contract_names_goes_from_the_article(inner):
    assert template.extract([f"<article><p>Before.</p>{inner}<p>After.</p></article>"]) == ["Before. After."]


def test_template_classes_nest():
    pages = [template.read("<div><ul>" + "<li><a>x</a></li>" * n + "</ul></div>") for n in (2, 3, 4)]
    found = template.classes(pages)
    assert (1, 1, 1) in found and (2, 3, 4) in found and len(found[(2, 3, 4)]) == 4
    assert len(template.template(pages)) == 8


SITE = """<html><body><div class=strip>{strip}</div><article><h2>Teaser {n}</h2></article><div class=story><p>Story {n} a.</p>
<p>Story {n} b.</p></div><div class=legal>All rights</div></body></html>"""
BARE = "<html><body><div class=strip>{strip}</div><div class=story><p>Bare {n} a.</p><p>Bare {n} b.</p></div><div class=legal>All rights</div></body></html>"


def test_template_decides(monkeypatch):
    # The strip takes turns among few texts, so it repeats; what varies stays, beside an article too.
    strips = ["Up", "Down"]
    pages = [SITE.format(n=n, strip=strips[n % 2]) for n in range(8)]
    want = [f"Teaser {n} Story {n} a. Story {n} b." for n in range(8)]
    assert template.extract(pages) == want
    bare = [BARE.format(n=n, strip=strips[n % 2]) for n in range(8)]
    assert template.extract(bare) == [f"Bare {n} a. Bare {n} b." for n in range(8)]
    # Copies of a page are one page of the template: they don't make its own text a repeated one.
    assert template.extract([*bare, *[bare[0]] * 20])[:8] == template.extract(bare)
    monkeypatch.setattr(template, "template", lambda pages: set())
    assert template.extract(pages) != want and template.extract(bare)[0].startswith("Up")


def test_template_is_of_the_whole_host(spark):
    # One page with an article among 600 without: at any number of partitions the others lose what they share.
    tuned(spark)
    rows = [(n, f"http://h/{n}", BARE.format(n=n, strip="Welcome")) for n in range(600)]
    rows += [(600, "http://h/a", SITE.format(n=600, strip="Welcome")), (601, "http://other/", BARE.format(n=601, strip="Welcome"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        got = {r["page_id"]: r["text"] for r in template.main_text(pages.repartition(parts)).collect()}
        assert all(got[n] == f"Bare {n} a. Bare {n} b." for n in range(600))
        assert got[600] == "Teaser 600 Story 600 a. Story 600 b."
        assert got[601] == "Welcome Bare 601 a. Bare 601 b. All rights"
    assert [got[n] for n in range(601)] == template.extract([r[2] for r in rows[:601]])


def test_main_text_of_table(spark):
    got = {r["page_id"]: r for r in template.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        text = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>|</?(?:p|h1)>", " ", body))).split())
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)
    rows = [(1, None, None), (None, "http://a/x", "<p>a"), (1, "http://a/x", "<p>a")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((str(r["page_id"]), r["text"]) for r in template.main_text(odd).collect()) == [("1", ""), ("1", "a"), ("None", "a")]
    assert template.main_text(odd.limit(0)).count() == 0


def test_oracles_at_the_smallest_scale(spark):
    from oracle_check import compare, connect

    con = connect(SF)
    for name, text in queries.ORACLES.items():
        assert compare(con, queries.QUERIES[name](spark, SF), text) is None, name


def test_pipeline_stages(spark, documents, say):
    import corpus_pipeline as pipeline
    from cohortgrid.llm import common
    from test_texts import brute_print, classes_of, lines_brute

    stop = "the of and to in is that for"
    rows = [(k, "\n".join(f"{stop} {say(k * 10 + j, 30)}" for j in range(3)), f"s{k % 3}") for k in range(60)]
    rows += [(100, rows[0][1], "s0"), (101, rows[1][1] + " tail", "s1"), (102, "junk " * 80, "s1"), (103, None, "s1"), (104, "short", None)]
    docs, kept = documents(*rows), rows
    out = common.stored(pipeline.STAGES[0][1](spark, docs, SF), "p")
    kept = [r for r in rows if r[0] not in (102, 103, 104)]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in kept)
    out = common.stored(pipeline.STAGES[1][1](spark, out, SF), "p")
    kept = [(i, t) for i, _, _, _, t in lines_brute([r[:2] for r in kept], 8) if t.split()]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == sorted((i, t, len(t)) for i, t in kept)
    out = common.stored(pipeline.STAGES[2][1](spark, out, SF), "p")
    comps = classes_of([i for i, _ in kept], [brute_print(t) for _, t in kept])
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(comps))
    before = out
    out = common.stored(pipeline.STAGES[3][1](spark, out, SF), "p")
    assert out.columns == before.columns == pipeline.COLUMNS and out.count() > 0
    last = pipeline.STAGES[4][1](spark, out, SF)
    assert last.agg(F.sum("length")).first()[0] >= out.count()
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_pipeline_near_dedup(spark, documents, say):
    import corpus_pipeline as pipeline
    from cohortgrid.llm import jaccard

    def changed(seed, n, *at):
        w = say(seed, n).split()
        for k in at:
            w[k] = "other"
        return " ".join(w)

    def jac(a, b):
        a, b = ({tuple(t.lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    # 20 pairs above the bar and 20 just below it.
    rows = [(k, say(k + 1, 200)) for k in range(40)]
    rows += [(100 + k, changed(k + 1, 200, 20, 60, 100, 140) if k < 20 else changed(k + 1, 200, 20, 60, 100, 140, 180)) for k in range(40)]
    # A chain: the first and the last are alike only by what lies between.
    rows += [(300 + k, changed(77, 200, *range(10, 10 + 40 * k, 40))) for k in range(5)]
    assert all((jac(rows[k][1], rows[40 + k][1]) >= 0.8) == (k < 20) for k in range(40)) and jac(rows[80][1], rows[83][1]) >= 0.8
    want = {*range(40), *range(120, 140), 300}
    assert {r["doc_id"] for r in pipeline.near_dedup(spark, documents(*rows), SF).collect()} == want
    same = jaccard.bands(jaccard.shingles(rows[0][1])) == jaccard.bands(jaccard.shingles(rows[40][1]))
    assert same.any() and not same.all()


@pytest.mark.parametrize("tile", [2048, 7])
def test_near_texts_against_all_pairs(documents, say, tile):
    """Random texts of shared passages, in whole comparisons and in many tiles; also texts of no or few words."""
    from cohortgrid.llm import jaccard
    from test_texts import WORD

    rng = random.Random(9)
    passages = [say(500 + k, 120).split() for k in range(4)]
    texts = ["", " ", "\n", "one", "One", "one two", "a b c d e f", "A b c d e F"]
    for _ in range(110):
        words = list(rng.choice(passages)) + say(rng.randint(600, 640), rng.choice([0, 20, 40, 80])).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                up[root(i)] = root(j)
    classes = {}
    for i in range(len(texts)):
        classes.setdefault(root(i), set()).add(texts[i])
    docs = documents(*enumerate(texts))
    roots = jaccard.near_texts(docs, tile=tile)
    got = {}
    for r in docs.selectExpr("text", "xxhash64(text) AS node").join(roots, "node").collect():
        got.setdefault(r.root, set()).add(r.text)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_near_texts_makes_no_pair_rows(documents, say, monkeypatch):
    """Texts that share a passage without being near-duplicates: rows grow with the texts."""
    from cohortgrid.llm import jaccard

    made = []
    for n in (100, 200, 400):
        rows, before = [(k, say(1, 150) + " " + say(1000 + k, 60)) for k in range(n)], jaccard.stored
        count = 0

        def counted(df, purpose):
            nonlocal count
            out = before(df, purpose)
            if purpose != "sketches":
                count += out.count()
            return out

        monkeypatch.setattr(jaccard, "stored", counted)
        assert jaccard.near_texts(documents(*rows)).count() == 0
        monkeypatch.setattr(jaccard, "stored", before)
        made.append(count)
    assert made[2] < 5 * made[0] and made[2] < 40 * 400


def test_pipeline_near_dedup_of_shared_ids(spark, documents, say):
    import corpus_pipeline as pipeline

    rows = [(1, say(1, 60)), (2, say(2, 60)), (2, say(1, 60) + " x"), (2, say(3, 60)), (None, say(1, 60))]
    got = sorted(((str(r["doc_id"]), r["text"]) for r in pipeline.near_dedup(spark, documents(*rows), SF).collect()))
    assert got == sorted([("1", say(1, 60)), ("2", say(2, 60)), ("2", say(3, 60)), ("None", say(1, 60))])
