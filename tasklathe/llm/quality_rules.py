"""Quality rules: a threshold table compiled into one Spark projection.

Every rule bounds a ratio of two counted columns (or a count over 1), for texts
of a least number of words.  The counts are built-in Spark expressions over the
whole text; ``compiled`` turns the table into one verdict expression.  No user
functions, no shuffle: each row is judged by itself.

Repetition is counted over windows of eight words.  Every word is hashed once, a
window by its words' hashes.  A text whose window hashes
are all distinct (most are) is done at once; otherwise the hashes are sorted with
their positions, equal neighbours give the repeated windows, and one pass over
those positions adds up the words they cover.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
# White space that separates words, and symbol characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in a is it for on as was by at this from an are "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine "
    "le la les de des et en un une que du pour qui dans est au il "
    "el los las y del se por con una su lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high`` for texts of ``least_words`` words or more."""

    name: str
    top: str
    bottom: str | None
    low: float | None
    high: float | None
    least_words: int = 0

    def passes(self) -> Column:
        value = F.col(self.top) / F.greatest(F.col(self.bottom), F.lit(1)) if self.bottom else F.col(self.top)
        held = F.lit(True)
        if self.low is not None:
            held = held & (value >= self.low)
        if self.high is not None:
            held = held & (value <= self.high)
        return held | (F.col("n_words") < self.least_words)


    def sql(self) -> str:
        value = f"{self.top}::DOUBLE / greatest({self.bottom}, 1)" if self.bottom else self.top
        bounds = [f"{value} >= {self.low}::DOUBLE"] * (self.low is not None) + [f"{value} <= {self.high}::DOUBLE"] * (self.high is not None)
        return f"(({' AND '.join(bounds)}) OR n_words < {self.least_words})"


RULES = (
    Rule("words", "n_words", None, 20, 200_000),
    Rule("mean word length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols to words", "n_symbols", "n_words", None, 0.1),
    Rule("words with a letter", "n_alpha_words", "n_words", 0.7, None),
    Rule("stop words to words", "n_stop_words", "n_words", 0.01, None, 50),
    Rule("duplicate lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("words like the one before", "n_adjacent_words", "n_words", None, 0.3),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("lines that break off", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One verdict over the counted columns: true where every rule passes."""
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.passes()
    return verdict


#: What ``count_columns`` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_alpha_words", "n_adjacent_words", "n_bullet_lines", "n_ellipsis_lines")


def count_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (long).  Null texts read as empty; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in COUNTS]
    t, w, m, h, s = (F.col(f"__{x}") for x in ("text", "words", "marks", "hashes", "sorted"))
    out = docs.select(*[docs[c] for c in kept], F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    out = out.withColumns({"__words": F.array_remove(F.split(t, SPACE + "+", -1), ""), "__lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))})
    out = out.withColumn("n_words", F.size(w).cast("long"))
    out = out.withColumn("__marks", F.transform(w, lambda x: F.xxhash64(x)))
    windows = F.transform(F.slice(m, 1, F.size(m) - WINDOW + 1), lambda x, i: F.xxhash64(x, *[F.get(m, i + k) for k in range(1, WINDOW)]))
    out = out.withColumn("__hashes", F.when(F.size(w) > WINDOW, windows).otherwise(F.expr("cast(array() as array<bigint>)")))
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), placed).otherwise(F.expr("cast(array() as array<struct<h:bigint,p:int>>)")))
    same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    out = out.withColumn("__twice", F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"])))
    cover = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).alias("n"))
    covered = F.aggregate("__twice", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda acc: acc["n"])
    lines, long = F.col("__lines"), lambda c: c.cast("long")
    return out.select(
        *[out[c] for c in kept],
        "n_words",
        long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(F.regexp_count(t, F.lit(SYMBOL))).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(F.filter(w, lambda x: x.isin(STOP_WORDS)))).alias("n_stop_words"),
        long(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}")))).alias("n_alpha_words"),
        long(F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))).alias("n_adjacent_words"),
        long(F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•·]")))).alias("n_bullet_lines"),
        long(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$")))).alias("n_ellipsis_lines"),
    )



def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``.

    base_failed marks texts of fewer than 20 words and texts of which repeated
    eight-word windows cover more than 30 %.  kept is false for those, else the
    rule table's verdict.  Null and empty texts fail.  Texts are judged whole,
    with a few arrays of their words in memory.  A value at a threshold passes.
    Stop words are told by their lower-case form as it is written, so "The" is
    none.  Rows are judged alone, so repeats don't matter; columns named like the
    counts, ``base_failed`` or ``kept`` are replaced; an empty table stays empty.
    """
    counted = count_columns(docs, text_col).drop("base_failed", "kept")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)
), c AS (
  SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, i + unnest(range(8)) AS spot FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1)) GROUP BY doc_id
), n AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], x))) AS n_stop_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_adjacent_words, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•·]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN c USING (doc_id)
), f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {" AND ".join(r.sql() for r in RULES)}) AS kept FROM f
"""
