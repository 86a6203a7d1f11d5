"""Quality rules: a table of thresholds compiled into one projection.

Native: DataFrame functions only. Each text is measured inside its own row, so there is no shuffle.
A null or empty text has no words, zero for every measure, and fails the base rule. Repeated rows are judged
alike, rows with a null id or language too. Other columns pass through; one that bears the name of a measure
or verdict is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, table, words

# Function words of the languages that the corpus names.
STOP_WORDS = {
    "en": "the of and to in is that for it as with was on are this be at by from or an not",
    "de": "der die das und ist ein nicht mit sich für zu den von dem des im eine auf als auch in",
    "fr": "la le les et des en un une du que pour dans est pas qui sur au avec de ce",
    "es": "el la los las de que y en un una por con para no se su al lo como del es",
}
SYMBOLS = "[#*$%&|<>]"
LETTER = r"\p{L}"
LOWER, SHOUT = "[a-z]", "[A-Z]{2}"


@dataclass(frozen=True)
class Rule:
    """A text fails when ``measure`` is below ``low`` or above ``high``. ``langs``: the languages that the
    rule holds for (all, if empty)."""

    measure: str
    low: float | None = None
    high: float | None = None
    langs: tuple[str, ...] = ()

    def fails(self) -> Column:
        m, out = F.col(self.measure), F.lit(False)
        if self.low is not None:
            out = out | (m < F.lit(self.low))
        if self.high is not None:
            out = out | (m > F.lit(self.high))
        return out & F.coalesce(F.col("lang").isin(*self.langs), F.lit(False)) if self.langs else out


# Length, symbol, stop-word and line rules, beside the base rule.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.01, langs=tuple(STOP_WORDS)),
    Rule("letter_word_ratio", low=0.4),
    Rule("shout_word_ratio", high=0.5),
    Rule("dup_line_ratio", high=0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words of the array ``w`` inside a 3-word window that occurs at least twice.

    Window hashes carry their position in the low bits and are sorted as longs, so equal windows are
    neighbours; neighbours are compared word for word. In order of position, a repeated window then adds the
    words that the one before it did not cover.
    """
    n = F.size(w)
    mask = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long") - 1

    def same(a: Column, b: Column, mask: Column) -> Column:
        i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
        equal = a.bitwiseOR(mask) == b.bitwiseOR(mask)
        for k in range(3):
            equal = equal & (F.get(w, i + k) == F.get(w, j + k))
        return F.coalesce(equal, F.lit(False))

    def hits(mask: Column) -> Column:
        packed = F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask))
            .bitwiseOR(i.cast("long"))))
        return _let(packed, lambda s: F.sort_array(F.array_distinct(F.flatten(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda k: same(F.get(s, k), F.get(s, k + 1), mask)),
            lambda k: F.array(F.get(s, k).bitwiseAND(mask), F.get(s, k + 1).bitwiseAND(mask)))))))

    covered = F.aggregate(
        _let(mask, hits), F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("total")),
        lambda s, i: F.struct(i.alias("last"), (s["total"] + F.least(F.lit(3).cast("long"), i - s["last"])).alias("total")),
        lambda s: s["total"])
    return F.when(n >= 4, covered).otherwise(F.lit(0).cast("long"))


def with_measures(docs: DataFrame, text: str = "text", stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """``docs`` with counts and ratios of each text: one projection for the arrays, one for what they give."""
    stops = sorted({w for held in stop_words.values() for w in held.split()})
    has_word = F.lit(r"[^\x20\x09-\x0D]")

    def of(w: Column, lines: Column, text: Column) -> Column:
        n = F.size(w).cast("long")
        share = lambda part, of: F.when(of > 0, part / of).otherwise(F.lit(0.0))
        chars = F.char_length(F.array_join(w, "")).cast("long")
        symbols = F.regexp_count(text, F.lit(SYMBOLS)).cast("long")
        dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"), share(chars, n).alias("mean_word_chars"),
            share(symbols, n).alias("symbols_per_word"),
            share(F.size(F.filter(w, lambda x: F.lower(x).isin(*stops))), n).alias("stop_word_ratio"),
            share(F.size(F.filter(w, lambda x: F.rlike(x, F.lit(LETTER)))), n).alias("letter_word_ratio"),
            share(F.size(F.filter(w, lambda x: ~F.rlike(x, F.lit(LOWER)) & F.rlike(x, F.lit(SHOUT)))), n).alias("shout_word_ratio"),
            share(dup, F.size(lines)).alias("dup_line_ratio"))

    whole = F.coalesce(F.col(text), F.lit(""))
    measured = _let(words(whole), lambda w: _let(
        F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, has_word)), lambda lines: of(w, lines, whole)))
    out = docs.withColumn("_m", measured)
    names = [f.name for f in out.schema["_m"].dataType.fields]
    return out.select(*[c for c in docs.columns if c not in names], *[F.col("_m")[x].alias(x) for x in names])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 50,
          max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``failed`` (names of the failed rules, comma-joined) and
    ``kept``. ``lang`` may be absent; rules that hold for some languages then never apply."""
    had_lang = "lang" in docs.columns
    out = with_measures(docs if had_lang else docs.withColumn("lang", F.lit(None).cast("string")), text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    failed = F.concat_ws(",", *[F.when(r.fails(), F.lit(r.measure)) for r in rules])
    out = out.withColumns({"base_failed": base, "failed": failed})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))
    return out if had_lang else out.drop("lang")


def _oracle(rules: tuple[Rule, ...] = RULES) -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for held in STOP_WORDS.values() for w in held.split()}))
    tests = []
    for r in rules:
        either = [f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)
        held = f" AND coalesce(lang IN ({', '.join(repr(x) for x in r.langs)}), false)" if r.langs else ""
        tests.append(f"CASE WHEN ({' OR '.join(either)}){held} THEN '{r.measure}' END")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 4),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT k, count(DISTINCT i + s) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) v(s) WHERE c > 1 GROUP BY k),
m AS (SELECT k, doc_id, lang, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops,
             len(list_filter(w, lambda x: regexp_matches(x, '{LETTER}'))) AS letters,
             len(list_filter(w, lambda x: NOT regexp_matches(x, '{LOWER}') AND regexp_matches(x, '{SHOUT}'))) AS shouts FROM w),
s AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
             CASE WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_word_ratio,
             CASE WHEN n_words > 0 THEN letters / n_words ELSE 0 END AS letter_word_ratio,
             CASE WHEN n_words > 0 THEN shouts / n_words ELSE 0 END AS shout_word_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio
      FROM m LEFT JOIN r USING (k)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             concat_ws(',', {', '.join(tests)}) AS failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed = '' AS kept, failed FROM v"""


ORACLE = _oracle()


@query("op3_quality_rules", ORACLE)
def op3_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")
