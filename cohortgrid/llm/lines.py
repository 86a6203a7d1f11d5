"""Line dedup with a deletion-neighbourhood join.

Native: DataFrame functions only. Lines are the parts of a text between line feeds, compared as sequences of
words. A line goes if an equal line comes earlier, or an earlier line is within one word's edit (a word
inserted, deleted or replaced) and both have ``MIN_WORDS`` words or more. Earlier: smaller id, then smaller
line number. Lines are judged on the input, not on what is left; lines without words stay.

Equal lines are first reduced to one row each. Every line then emits its variants, the line itself and the
line with each one word deleted, as hashed keys (``_variant_hashes``). Lines that share a variant made by deleting at the same place
are all within one replacement of each other, so the earliest of them stands for all; a line that equals a
variant of another is one insertion away. Each match is therefore a grouped minimum and a join back, never
all pairs of a group, and is verified on the words. Of two lines one edit apart, the words before or the words
after the middle are equal; lines whose halves no other line shares can have no match and emit nothing.

Edge cases: a null text stays null; rows with a null id pass unchanged and match nothing; rows that share an
id don't remove each other's first lines when their texts are equal, since they are the same lines; a text
that loses all lines becomes empty; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, dropped, query, stored, table

MIN_WORDS = 8
RESULTS = ("n_lines", "n_exact", "n_near")
HELD = r"[^\x20\x09-\x0D][^\n]*"  # a line with a word, from its first word on


def _line(text: Column) -> Column:
    """A line's words joined by one space; empty for a line without words."""
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(BLANKS))


def _halves(w: Column, n: Column, least: int) -> Column:
    """Hashes that a line shares with every line one edit away: for pairs whose shorter line has m words, the
    first m // 2 words and the last m - m // 2. A line can be the shorter or the longer of a pair."""

    def of(m: Column, side: str) -> Column:
        h = F.floor(m / 2).cast("int")
        part = F.slice(w, 1, h) if side == "first" else F.slice(w, n - (m - h) + 1, m - h)
        return F.when(m >= least, F.xxhash64(F.lit(side), m, part))

    return F.array(*[of(m, side) for m in (n, n - 1) for side in ("first", "last")])


def _without(line: str, n: str, i: str) -> Column:
    """The line (words joined by one space, n of them) without its word i, counted from 0."""
    return F.expr(f"trim(concat_ws(' ', substring_index({line}, ' ', {i}), substring_index({line}, ' ', {i} + 1 - {n})))")


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _xor(values: str) -> str:
    return f"aggregate({values}, 0L, (q, v) -> q ^ v)"


def _variant_hashes(w: str) -> Column:
    """Hashes of a line's words with each one left out.

    A sequence's hash is the exclusive or of the hashes of its words with their places, so a variant's is that of the
    words before, with their places, and of the words after, each one place ahead. The first part is an exclusive or
    of a prefix; prefixes are formed from blocks of about the root of the line's length, so a line of n words takes
    n times its root, not n times n, steps."""
    own, moved = "transform({w}, (x, i) -> xxhash64(x, i) ^ xxhash64(x, i - 1))", "transform({w}, (x, i) -> xxhash64(x, i - 1))"
    each = f"transform(z.b, (x, i) -> ah[i div z.s] ^ {_xor('slice(z.c, int(i div z.s) * z.s + 1, i % z.s)')} ^ x ^ t)"
    ahead = f"transform(sequence(0, size(bl) - 1), k -> {_xor('slice(bl, 1, k)')})"
    blocks = f"transform(sequence(0, int((size(z.c) - 1) div z.s)), k -> {_xor('slice(z.c, k * z.s + 1, z.s)')})"
    first = f"named_struct('c', {own.format(w=w)}, 'b', {moved.format(w=w)}, 's', int(ceil(sqrt(size({w})))))"
    return F.expr(_let(first, "z", _let(_xor("z.b"), "t", _let(blocks, "bl", _let(ahead, "ah", each)))))


def removed_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, key, exact, near)``: numbers of the lines to remove from the text with that hash.

    ``rows``: ``(doc_id, key, text)``, none null. Tables are deleted when their last reader is done, so that texts, which
    are shuffled last, don't meet all of them on the disk."""
    at = F.struct("doc_id", "line", "key")
    split = rows.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line", "_l")).where(
        F.btrim("_l", F.lit(BLANKS)) != "").select("doc_id", "key", "line", _line(F.col("_l")).alias("_t")).select(
        "doc_id", "key", "line", "_t", F.split("_t", " ").alias("_w"))
    n = F.size("_w")
    full = stored(split.select(
        "doc_id", "key", "line", F.unhex(F.md5("_t")).alias("id"), n.alias("n"),
        F.when(n >= min_words, _halves(F.col("_w"), n, min_words)).alias("halves")), "lines")
    distinct = stored(full.select("id", "n", *[F.col("halves")[i].alias(f"h{i}") for i in range(4)], at.alias("at")).groupBy(
        "id", "n", "h0", "h1", "h2", "h3").agg(F.min("at").alias("at"), F.count("*").alias("c")), "lines-distinct")
    every = stored(full.select("doc_id", "key", "line", "id"), "lines-places")
    dropped(full)

    # Lines that share a half with another line.
    halves = distinct.where(F.col("n") >= min_words).select(
        "id", F.explode(F.array("h0", "h1", "h2", "h3")).alias("half")).where("half IS NOT NULL")
    shared = stored(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half"), "lines-halves")
    some = stored(halves.join(shared, "half").select("id").distinct(), "lines-some")
    dropped(shared)
    wanted = distinct.join(some, "id").select("id", "n", "at.*").groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("line", "id", "n")).alias("want"))
    wanted = stored(wanted, "lines-wanted")
    repeated = stored(distinct.where("c > 1").select("id", "at"), "lines-repeated")
    for done in (some, distinct):
        dropped(done)
    # Rows that share an id and a text give their lines once.
    found = stored(rows.select("doc_id", "key", "text").join(wanted, ["doc_id", "key"]).select(
        "doc_id", "key", F.split("text", "\n").alias("_t"), F.explode("want").alias("e")).select(
        F.struct("doc_id", "e.line", "key").alias("at"), "e.id", "e.n",
        _line(F.get("_t", F.col("e.line"))).alias("text")).dropDuplicates(["id"]), "lines-found")
    dropped(wanted)

    # Variants as hashed keys; slot: the deleted word, -1 for the line itself.
    split = found.select("at", "id", F.split("text", " ").alias("_v"))
    whole_ = F.expr(_xor("transform(_v, (x, i) -> xxhash64(x, i))"))
    variants = split.select("at", "id", F.posexplode(F.concat(F.array(whole_), _variant_hashes("_v"))).alias("slot", "variant"))
    variants = stored(variants.select("at", "id", (F.col("slot") - 1).alias("slot"), "variant"), "lines-variants")
    best = variants.groupBy("variant", "slot").agg(F.min(F.struct("at", "id", "slot")).alias("best"), F.count("*").alias("c"))
    best = stored(best, "lines-best")
    whole, cut = F.col("slot") < 0, F.col("slot") >= 0  # the line itself, or without a word
    # A variant has a row for each slot here, so at most as many as a line has words.
    per = best.groupBy("variant").agg(
        F.min(F.when(whole, F.col("best"))).alias("whole"), F.min(F.when(cut, F.col("best"))).alias("cut"),
        F.max("c").alias("most"), F.count("*").alias("slots")).where("most > 1 OR (whole IS NOT NULL AND cut IS NOT NULL)")
    per = stored(per.select("variant", "whole", "cut"), "lines-per")
    offers = best.join(per, "variant").select(
        "variant", "slot", F.when(whole, F.array("cut")).otherwise(F.array("best", "whole")).alias("offers"))
    offers = stored(offers, "lines-offers")
    for done in (best, per):
        dropped(done)
    matches = variants.join(offers, ["variant", "slot"]).select(
        "at", "id", "slot", F.explode("offers").alias("o")).where("o.at < at AND o.id <> id")
    matches = stored(matches.groupBy("id", F.col("o.id").alias("other")).agg(
        F.min(F.struct(F.col("slot").alias("a"), F.col("o.slot").alias("b"))).alias("slots")), "lines-matches")
    for done in (variants, offers):
        dropped(done)
    text = found.select("id", "n", "text")
    proof = lambda t, n, s: F.when(F.col(s) < 0, F.col(t)).otherwise(_without(t, n, s))
    near = matches.join(text, "id").join(
        text.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("text").alias("old")), "other").where(
        proof("text", "n", "slots.a") == proof("old", "m", "slots.b")).select("id").distinct()
    # Lines that can go: those of repeated texts, and those near an earlier one.
    near = near.join(found.select("id", "at"), "id").select("id", "at", F.lit(True).alias("near"))
    marks = near.unionByName(repeated.withColumn("near", F.lit(False))).groupBy("id").agg(
        F.min("at").alias("first"), F.max("near").alias("near"))
    marks = stored(marks, "lines-marks")
    for done in (matches, found, repeated):
        dropped(done)
    judged = every.join(marks, "id").select("doc_id", "key", "line", (F.col("first") < at).alias("exact"), "near")
    gone = stored(judged.where("exact OR near").groupBy("doc_id", "key").agg(
        F.collect_set(F.when(F.col("exact"), F.col("line"))).alias("exact"),
        F.collect_set(F.when(~F.col("exact"), F.col("line"))).alias("near")), "lines-removed")
    for done in (every, marks):
        dropped(done)
    return gone


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the kept lines as its text, ``n_lines`` (with a word, before), ``n_exact`` and ``n_near``
    (removed as equal to, or one edit from, an earlier line)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    gone = removed_lines(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), min_words).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("exact").alias("_exact"), F.col("near").alias("_near"))
    out = docs.drop(*RESULTS).join(
        gone, (F.col(doc_id).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left")
    all_ = F.split(text, "\n")
    gone = F.concat("_exact", "_near")
    kept = F.array_join(F.filter(all_, lambda x, i: ~F.array_contains(gone, i)), "\n")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    held = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(HELD)).cast("long")
    out = out.select(*[c for c in docs.columns if c not in (text, *RESULTS)],
                     F.when(F.col("_key").isNull(), F.col(text)).otherwise(kept).alias(text), held.alias("n_lines"),
                     F.when(F.col("_key").isNull(), 0).otherwise(count("_exact")).cast("long").alias("n_exact"),
                     F.when(F.col("_key").isNull(), 0).otherwise(count("_near")).cast("long").alias("n_near"))
    return out.select(*[c for c in docs.columns if c not in RESULTS], *RESULTS)


LINES = f"""
l AS (SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(s[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT doc_id, line, array_to_string(w, ' ') AS t, len(w) AS n, w FROM l WHERE len(w) > 0),
e AS (SELECT t, any_value(n) AS n, any_value(w) AS w, min((doc_id, line)) AS first FROM k GROUP BY t),
v AS (SELECT t, first, n, i - 1 AS slot, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e WHERE n >= {MIN_WORDS})),
p AS (SELECT a.t FROM v a JOIN v b ON a.v = b.v AND a.slot = b.slot AND b.first < a.first
      UNION SELECT v.t FROM v JOIN e ON v.v = e.t AND e.n >= {MIN_WORDS} AND e.first < v.first
      UNION SELECT e.t FROM v JOIN e ON v.v = e.t AND e.n >= {MIN_WORDS} AND v.first < e.first),
j AS (SELECT k.doc_id, k.line, e.first < (k.doc_id, k.line) AS exact, p.t IS NOT NULL AS near
      FROM k JOIN e USING (t) LEFT JOIN p USING (t)),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near,
             list(line) FILTER (exact OR near) AS gone FROM j GROUP BY doc_id)"""
ORACLE = f"""
WITH {LINES},
s AS (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents)
SELECT s.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near,
       md5(array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: NOT coalesce(list_contains(gone, i - 1), false)), lambda i: s[i]), chr(10))) AS kept_md5
FROM s LEFT JOIN c USING (doc_id)"""


@query("op2_line_dedup", ORACLE)
def op2_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.md5("text").alias("kept_md5"))
