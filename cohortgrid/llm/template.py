"""HTML extraction by template deduction over the pages of a host.

Every tag and close tag of a page is a token whose role is its name, its class, id and role words, and the path
of open elements above it. Tokens with the same occurrence vector (how often they occur on each distinct page
of the host) form an equivalence class. A class is valid if its tokens come in one order, round after round, on
every page; the valid classes that occur once on every page are the template's outer frame, and valid classes
of two tokens or more that are on most pages and lie below the frame are nested in it. What is left between
template tokens are the slots' contents.

The template decides slot by slot: a slot whose texts repeat on the host (half of them or fewer are distinct)
goes, one whose texts vary stays. Further evidence, page by page: text in an article (or, without one, in the
main element) stays even if it repeats, beside it only slots stay that are on most pages and vary; text below
a menu, header, footer, sidebar, notice, advert, form, comment list or the like, by its name or its class, id
and role words, goes. Hosts of one or two distinct pages have no template, so only the evidence counts.

Occurrence vectors are gathered over the whole host: a role's vector is held as the exclusive-or of hashes of
(page, count), so it is summed before the shuffle and no task holds a host. Pages are then joined with their
host's decisions by host; AQE broadcasts the small side or splits a host with many pages.

Edge cases: a null html gives an empty text; a null url is a host of its own; null or repeated ids stay as
they are; equal pages of a host count once in its template; unclosed, misnested and unknown elements are read
as browsers do in the usual cases; an empty table gives an empty result; only the three columns are read, so
others can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import dropped, query, stored, table

LEAST_PAGES = 3

# Elements of HTML by what they do to text, and words that mark what isn't main text.
RAW = "script style textarea template iframe svg select option title".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms mtext "
                   "q s samp small span strike strong sub sup time tt u var wbr img".split())
NOISE_TAGS = frozenset("head nav header footer aside form menu dialog figure object canvas audio video fieldset noscript button math xmp".split())
# Inside the article only menus, footers, sidebars, notices, adverts, forms and reader comments go, and only boxes are
# read for words that mark these: headings, paragraphs and the like are the article's own, whatever they are called.
NOISE_IN_ARTICLE = frozenset("nav footer aside form menu".split())
BOXES = frozenset("div section aside nav ul ol dl table details center".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner "
                        "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies "
                        "consent notice notices alert popup modal newsletter subscribe signup login comment comments reply replies "
                        "respond disqus share sharing social related recommended widget toolbar pagination pager search form "
                        "complementary contentinfo".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z0-9]+")


@dataclass
class Element:
    name: str
    role: int
    noise: bool
    main: str  # "article", "main" or ""


@dataclass
class Page:
    """Tokens ``(role, place in runs)``, runs ``(text, element, starts a block)`` and the role above each role."""

    tokens: list[tuple[int, int]] = field(default_factory=list)
    runs: list[tuple[str, Element, bool]] = field(default_factory=list)
    above: dict[int, int] = field(default_factory=dict)


def _hash(*of) -> int:
    """64 bits, signed."""
    return xxh64_intdigest("\x00".join(map(str, of))) - (1 << 63)


def _element(name: str, attrs: str, above: Element) -> Element:
    words: list[str] = []
    noise = above.noise or name in (NOISE_IN_ARTICLE if above.main else NOISE_TAGS)
    if attrs:
        for key, *values in ATTRIBUTE.findall(attrs):
            found = PART.findall("".join(values).lower())
            words += found
            # An article's own classes name its kind ("article form-post"); body's name the page.
            if above.main and name not in ("article", "main"):
                if name in BOXES or key.lower() == "role":
                    noise = noise or not (NOISE_ROLES if key.lower() == "role" else NOISE_WORDS).isdisjoint(found)
            elif name not in ("html", "body", "article", "main"):
                noise = noise or not (NOISE_ROLES if key.lower() == "role" else NOISE_WORDS).isdisjoint(found)
            elif name == "article":
                noise = noise or not {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo"}.isdisjoint(found)
    main = "article" if name == "article" or above.main == "article" else "main" if name == "main" or "main" in above.main else ""
    return Element(name, _hash(above.role, name, *words), noise, main)


ROOT = Element("", 0, False, "")


def read(html: str) -> Page:
    """A page's tokens and text runs. Elements that HTML closes by itself are closed where the next begins."""
    page, stack, at, fresh = Page(), [ROOT], 0, True

    def token(role: int, above: int) -> None:
        page.tokens.append((role, len(page.runs)))
        page.above[role] = above

    def text(a: int, b: int) -> None:
        nonlocal fresh
        if b > a:
            page.runs.append((html[a:b], stack[-1], fresh))
            fresh = False

    for m in MARKUP.finditer(html):
        text(at, m.start())
        at = m.end()
        if m["raw"]:
            token(_hash(stack[-1].role, m["raw"].lower()), stack[-1].role)
            fresh = fresh or m["raw"].lower() == "title"
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        inline = name in INLINE
        fresh = fresh or not inline
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    token(_hash(stack[k].role, "/"), stack[k].role)
                    del stack[k:]
                    break
            continue
        if name in VOID:
            token(_hash(stack[-1].role, name), stack[-1].role)
            continue
        if not inline:
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                      "th": ("td", "th"), "body": ("head",)}.get(name, ()) + (("p",) if name != "body" else ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closes:
                    del stack[k:]
                elif stack[k].name not in INLINE and stack[k].name != "p":
                    break
        one = _element(name, m["attrs"], stack[-1])
        token(one.role, stack[-1].role)
        if not m["attrs"].endswith("/") or not inline:
            stack.append(one)
    text(at, len(html))
    return page


def rounds(roles: list[int], classed: dict[int, int]) -> dict[int, int | None]:
    """For each class on a page, a hash of its tokens' order, or None if rounds differ in it. ``classed``: the
    class of each role; ``roles``: the page's tokens."""
    sizes, seen = Counter(classed.values()), {}
    for role in roles:
        if role in classed:
            seen.setdefault(classed[role], []).append(role)
    out = {}
    for one, found in seen.items():
        n = sizes[one]
        order = found[:n]
        good = len(set(order)) == n and found == order * (len(found) // n)
        out[one] = _hash(*order) if good else None
    return out


def classes(pages: list[Page]) -> dict[tuple[int, ...], list[int]]:
    """Valid equivalence classes of roles by occurrence vector."""
    counts = [Counter(role for role, _ in p.tokens) for p in pages]
    vectors = {role: tuple(c[role] for c in counts) for role in {r for c in counts for r in c}}
    numbers = {v: k for k, v in enumerate(set(vectors.values()))}
    classed = {role: numbers[v] for role, v in vectors.items()}
    orders: dict[int, set] = {}
    for p in pages:
        for one, order in rounds([r for r, _ in p.tokens], classed).items():
            orders.setdefault(one, set()).add(order)
    out: dict[tuple[int, ...], list[int]] = {}
    for role, v in vectors.items():
        if len(orders[numbers[v]]) == 1 and None not in orders[numbers[v]]:
            out.setdefault(v, []).append(role)
    return out


def nest(roles: list[tuple[int, int, int, bool]]) -> set[int]:
    """The template from ``(role, role above, class, once on every page)`` of the roles in valid classes on most
    pages, and of those of invalid ones with class None: the frame and what is nested below it."""
    frame = {role for role, _, one, once in roles if once and one is not None}
    above, sizes = {r[0]: r[1] for r in roles}, Counter(r[2] for r in roles)
    below: dict[int, bool] = {}
    for start in above:
        way, at = [], start
        while at in above and at not in below:
            way.append(at)
            at = above[at]
        inside = below.get(at, False) or at in frame
        for role in reversed(way):
            below[role] = inside
            inside = inside or role in frame
    return frame | {role for role, _, one, _ in roles if one is not None and sizes[one] > 1 and below[role]}


def template(pages: list[Page]) -> set[int]:
    """Roles of the template: the frame that every page has once, and the valid classes nested in it."""
    above = {role: up for p in pages for role, up in p.above.items()}
    valid = {role: (k, set(v) == {1}) for k, (v, roles) in enumerate(classes(pages).items()) for role in roles}
    seen = Counter(role for p in pages for role in p.above)
    return nest([(r, above[r], *valid.get(r, (None, False))) for r, n in seen.items() if 2 * n > len(pages)])


def slots(tokens: list[tuple[int, int]], n: int, frame: set[int]) -> list[tuple[int | None, int, int]]:
    """The stretches of the ``n`` runs between template tokens, with the template token that each follows."""
    out, at, last = [], 0, None
    for role, place in tokens:
        if role in frame:
            if place > at:
                out.append((last, at, place))
                at = place
            last = role
    if n > at:
        out.append((last, at, n))
    return out


def marks(page: Page) -> list[int]:
    """A hash for each run; 0 for blank runs and those that aren't main text by their elements."""
    return [0 if e.noise or not text.strip() else _hash(*text.split()) for text, e, _ in page.runs]


def contents(tokens: list[tuple[int, int]], runs: list[int], frame: set[int]) -> list[tuple[int, int, int]]:
    """``(template token, hash of the slot's text, 1 if it is the token's first on the page else 0)`` of a page's
    slots that have a text."""
    out, seen = [], set()
    for after, a, b in slots(tokens, len(runs), frame):
        texts = [m for m in runs[a:b] if m]
        if after is not None and texts:
            out.append((after, _hash(*texts), int(after not in seen)))
            seen.add(after)
    return out


def judged(seen: int, texts: int, on: int, pages: int) -> bool | None:
    """True: a slot seen so often, with so many distinct texts on so many pages, varies; False: it repeats; None: neither is shown."""
    if seen >= LEAST_PAGES and 2 * texts <= seen:
        return False
    return True if 2 * on > pages and 2 * texts > seen else None


def _text(runs: list[tuple[str, Element, bool]]) -> str:
    parts = []
    for text, _, fresh in runs:
        if fresh:
            parts.append(" ")
        parts.append(entities.unescape(text))
    return " ".join("".join(parts).split())


def choose(page: Page, frame: set[int], decided: dict[int, bool]) -> str:
    """A page's main text by its host's template and ``decided``, which has True for slots that vary and False
    for those that repeat."""
    kinds = {e.main for _, e, _ in page.runs if not e.noise}
    kind = "article" if "article" in kinds else "main" if "main" in kinds else ""
    # Runs keep their block starts: a run that follows a skipped one starts a block.
    kept, skipped = [], True
    for after, a, b in slots(page.tokens, len(page.runs), frame):
        varies = decided.get(after)
        for text, e, fresh in page.runs[a:b]:
            stays = e.main == kind or varies if kind else varies is not False
            if e.noise or not stays:
                skipped = skipped or fresh
                continue
            kept.append((text, e, fresh or skipped))
            skipped = False
    return _text(kept)


def extract(htmls: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    pages = [read(h or "") for h in htmls]
    distinct = list({h or "": p for h, p in zip(htmls, pages)}.values())
    frame: set[int] = set()
    decided: dict[int, bool] = {}
    if len(distinct) >= LEAST_PAGES:
        frame = template(distinct)
        found: dict[int, list[tuple[int, int]]] = {}
        for p in distinct:
            for after, text, first in contents(p.tokens, marks(p), frame):
                found.setdefault(after, []).append((text, first))
        for after, seen in found.items():
            one = judged(len(seen), len({t for t, _ in seen}), sum(k for _, k in seen), len(distinct))
            if one is not None:
                decided[after] = one
    return [choose(p, frame, decided) for p in pages]


def decisions(rows: DataFrame) -> DataFrame:
    """``(_host, frame, slots, varies)`` for each host with a template, from ``(_host, html)``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [read(h or "") for h in batch.column(2).to_pylist()]
            counts = [Counter(role for role, _ in p.tokens) for p in pages]
            held = [[r for r, _ in p.tokens] for p in pages], [[k for _, k in p.tokens] for p in pages], [marks(p) for p in pages]
            kinds = [list(c) for c in counts], [list(c.values()) for c in counts], [[p.above[r] for r in c] for p, c in zip(pages, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *[pa.array(x, pa.list_(t)) for x, t in zip((*held, *kinds), (pa.int64(), pa.int32(), pa.int64()) * 2)]],
                ["_host", "_h", "tokens", "places", "runs", "roles", "times", "above"])

    parsed = rows.select("_host", F.xxhash64(F.coalesce("html", F.lit(""))).alias("_h"), "html").mapInArrow(
        parse, "_host string, _h long, tokens array<long>, places array<int>, runs array<long>, roles array<long>, times array<int>, above array<long>")
    # Equal pages count once, and hosts of fewer than LEAST_PAGES have no template.
    pages = stored(parsed.dropDuplicates(["_host", "_h"]), "page-tokens")
    hosts = stored(pages.groupBy("_host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES), "hosts")
    each = pages.select("_host", "_h", F.explode(F.arrays_zip("roles", "times", "above")).alias("r")).select("_host", "_h", "r.*")
    vectors = each.groupBy("_host", F.col("roles").alias("role")).agg(
        F.min("above").alias("above"), F.bit_xor(F.xxhash64("_h", "times")).alias("vector"), F.count("*").alias("n"),
        F.max("times").alias("most"))
    # At most twice as many roles as a page has tokens are on most pages of a host.
    common = vectors.join(hosts, "_host").where("2 * n > pages").withColumn("once", F.expr("most = 1 AND n = pages"))
    classed = stored(common.groupBy("_host").agg(F.collect_list(F.struct("role", "above", "vector", "once")).alias("common")), "common-roles")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, tokens, common in zip(*[c.to_pylist() for c in batch.columns]):
                out += [(host, *x) for x in rounds(tokens, {c["role"]: c["vector"] for c in common}).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                             ["_host", "vector", "ordered"])

    orders = pages.join(classed, "_host").select("_host", "tokens", "common").mapInArrow(order, "_host string, vector long, ordered long")
    valid = orders.groupBy("_host", "vector").agg(
        F.min("ordered").alias("a"), F.max("ordered").alias("b"), F.count_if(F.col("ordered").isNull()).alias("bad"))
    valid = valid.where("bad = 0 AND a = b").groupBy("_host").agg(F.collect_list("vector").alias("valid"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for common, valid in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                good = set(valid or ())
                out.append(sorted(nest([(c["role"], c["above"], c["vector"] if c["vector"] in good else None, c["once"]) for c in common])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["_host", "frame"])

    templates = stored(classed.join(valid, "_host", "left").select("_host", "common", "valid").mapInArrow(
        frames, "_host string, frame array<long>"), "templates")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, tokens, places, runs, frame in zip(*[c.to_pylist() for c in batch.columns]):
                out += [(host, *x) for x in contents(list(zip(tokens, places)), runs, set(frame))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32()))],
                ["_host", "slot", "content", "first"])

    cuts = pages.join(templates, "_host").select("_host", "tokens", "places", "runs", "frame").mapInArrow(
        cut, "_host string, slot long, content long, first int")
    # Summed by (slot, text) first, so that a slot of a large host spreads.
    texts = cuts.groupBy("_host", "slot", "content").agg(F.count("*").alias("seen"), F.sum("first").alias("on"))
    told = texts.groupBy("_host", "slot").agg(F.sum("seen").alias("seen"), F.count("*").alias("texts"), F.sum("on").alias("on"))
    told = told.join(hosts, "_host")
    varies = F.expr(f"CASE WHEN seen >= {LEAST_PAGES} AND 2 * texts <= seen THEN false WHEN 2 * on > pages AND 2 * texts > seen THEN true END")
    told = told.withColumn("varies", varies).where("varies IS NOT NULL").groupBy("_host").agg(
        F.collect_list(F.struct("slot", "varies")).alias("s"))
    out = stored(templates.join(told, "_host", "left").select("_host", "frame", "s.slot", "s.varies"), "decisions")
    dropped(pages)
    return out


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("_host", F.coalesce(F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#:]*)", 1), F.lit("")))
    whole = rows.join(decisions(rows.select("_host", "html")), "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [choose(read(h or ""), set(frame or ()), dict(zip(slot or (), varies or ())))
                     for h, frame, slot, varies in zip(*[c.to_pylist() for c in batch.columns[2:]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return whole.select("page_id", "url", "html", "frame", "slot", "varies").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


@query("op10_extract")
def op10_extract(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
