"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import query, read, words_of

#: frequent function words of English, German, French and Spanish (fixed values)
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "a", "for", "on", "was", "it",
    "der", "die", "das", "und", "zu", "den", "ist", "von", "mit", "nicht", "ein", "eine", "sich", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "est", "pour", "que", "dans", "sur", "pas", "par",
    "el", "los", "las", "y", "en", "del", "se", "por", "con", "para", "no", "su", "al", "lo", "como",
]

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low <= value <= high``; ``value`` is an SQL expression over the measures, an open end is None."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.expr(self.value)
        found = F.lit(True)
        if self.low is not None:
            found = found & (value >= F.lit(self.low))
        if self.high is not None:
            found = found & (value <= F.lit(self.high))
        return found


#: base rules first; ratios are products so that no row divides by zero
RULES = (
    Rule("enough_words", "n_words", low=10),
    Rule("repeated_windows", "100 * n_repeat_words - 20 * n_words", high=0),
    Rule("short_words", "word_chars - 2 * n_words", low=0),
    Rule("long_words", "word_chars - 16 * n_words", high=0),
    Rule("symbols", "10 * n_symbols - n_words", high=0),
    Rule("stop_words", "100 * n_stop_words - greatest(n_words - 40, 0)", low=0),
    Rule("repeated_lines", "100 * n_dup_lines - 50 * n_lines", high=0),
)
BASE = ("enough_words", "repeated_windows")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules use (see ``apply_rules``); other columns pass through.

    Repeated windows: a window is WINDOW words. Equal windows are found by a 64-bit hash of their words, sorted with
    their positions, so time grows as n log n and memory as n in the length of one text.
    """
    hashes = ", ".join(f"__ws[i + {k}]" for k in range(WINDOW))
    return (
        docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("__ws", words_of(F.col("__text")))
        .withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("__h", F.expr(
            f"CASE WHEN size(__ws) >= {WINDOW} THEN transform(sequence(0, size(__ws) - {WINDOW}), "
            f"i -> xxhash64({hashes})) ELSE CAST(array() AS array<bigint>) END"))
        .withColumn("__s", F.expr(
            "CASE WHEN size(array_distinct(__h)) < size(__h) THEN "
            "sort_array(transform(__h, (x, i) -> struct(x AS h, i AS i))) ELSE NULL END"))
        .withColumn("__pos", F.expr(
            "CASE WHEN __s IS NOT NULL THEN sort_array(transform(filter(sequence(0, size(__s) - 1), k -> "
            "(k > 0 AND get(__s, k - 1).h = __s[k].h) OR (k + 1 < size(__s) AND get(__s, k + 1).h = __s[k].h)), "
            "k -> __s[k].i)) ELSE NULL END"))
        .withColumns({
            "n_words": F.size("__ws").cast("long"),
            "word_chars": F.length(F.array_join("__ws", "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("__ws", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_repeat_words": F.expr(
                f"CASE WHEN __pos IS NOT NULL THEN aggregate(__pos, struct(-{WINDOW} AS p, 0L AS n), "
                f"(s, p) -> struct(p AS p, s.n + least({WINDOW}, p - s.p) AS n), s -> s.n) ELSE 0L END"),
        })
        .drop("__text", "__ws", "__lines", "__h", "__s", "__pos"))


def apply_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES,
                base: Sequence[str] = BASE) -> DataFrame:
    """Measure every text and add the verdict of the rules: ``base_failed``, ``kept``, ``failed`` (names of broken
    rules). All columns of ``docs`` pass through; columns of it named like a result are replaced.

    Null, empty and blank texts have no words and fail ``enough_words``. A row is judged alone, so ties and repeated
    rows get equal verdicts, and an empty table gives an empty result. No user function runs anywhere.
    """
    judged = _judged(docs, text, rules, base)
    results = [c for c in judged.columns if c not in ("__row", "__body")]
    # of columns named like a result the result stays
    passed = [F.col("__row").getField(c).alias(c) for c in docs.columns if c not in results]
    return judged.select(*passed, *results)


def _judged(docs: DataFrame, text: str, rules: Sequence[Rule], base: Sequence[str]) -> DataFrame:
    """``__row`` (the whole row), ``__body`` (its text) and the results: no name of ``docs`` can clash with a helper's."""
    found = measures(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__body")), "__body")
    broken = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return found.withColumns({
        "failed": broken,
        "base_failed": ~(F.lit(True) if not base else _all([r.holds() for r in rules if r.name in base])),
        "kept": _all([r.holds() for r in rules]),
    })


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their columns only, whatever these are called. An empty table gives
    an empty one.

    The row number, which no row fails, keeps the optimiser from moving the filter below the measures, where it would
    repeat every expression as often as later ones use it.
    """
    judged = _judged(docs, text, rules, BASE)
    kept = judged.withColumn("__at", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("__at") >= 0))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def _all(conditions: Sequence[Column]) -> Column:
    found = F.lit(True)
    for condition in conditions:
        found = found & condition
    return found


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, [x FOR x IN regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    len([x FOR x IN ws IF lower(x) IN ({_STOP_SQL})])::BIGINT AS n_stop_words FROM w),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o
    || ' ' || lead(x, 4) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL),
k AS (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9)) AS n FROM h WHERE c > 1),
r AS (SELECT doc_id, sum(n)::BIGINT AS n FROM k GROUP BY doc_id),
f AS (SELECT m.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 16 * n_words AND 10 * n_symbols <= n_words
    AND 100 * n_stop_words >= greatest(n_words - 40, 0) AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM b"""


@query("op3_quality_rules", SQL)
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return apply_rules(read(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
