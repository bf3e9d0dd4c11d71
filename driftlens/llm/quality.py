"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import SPACE, fresh, word_array

#: Function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was with as on be at by this from or an are not have but his her they "
    "le la les de des du et un une est que qui dans pour sur par au aux en il elle ne pas se avec "
    "der die das und ist den von zu mit sich auf für nicht ein eine dem im auch als an bei nach "
    "el los las y por con para es una su al lo como más del no"
).split()

#: As written in running text, at the start of a sentence and in capitals.
SPELLINGS = sorted({s for w in STOP_WORDS for s in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """Keep a document only where least <= ratio(metric, per) <= most; None leaves a side open."""

    name: str
    metric: str
    per: str | None
    least: float | None = None
    most: float | None = None


#: The production table.
RULES = (
    Rule("enough_words", "n_words", None, least=20),
    Rule("mean_word_length", "word_chars", "n_words", least=2.5, most=12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.1),
    Rule("bangs_per_word", "n_bangs", "n_words", most=0.25),
    Rule("stop_words_per_word", "n_stop_words", "n_words", least=0.03),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.35),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=0.3),
)


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The conjunction of the rules over the metric columns, without division by zero."""

    def one(rule: Rule) -> Column:
        value, base = F.col(rule.metric).cast("double"), F.col(rule.per).cast("double") if rule.per else F.lit(1.0)
        sides = [value >= F.lit(float(rule.least)) * base] if rule.least is not None else []
        sides += [value <= F.lit(float(rule.most)) * base] if rule.most is not None else []
        return reduce(and_, sides, F.lit(True))

    return reduce(and_, map(one, rules), F.lit(True))


def with_metrics(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """docs plus one long column for each metric, all from built-in functions.

    n_words, word_chars, n_symbols, n_bangs, n_stop_words; n_lines (lines with a
    word) and n_dup_lines (those equal to an earlier line); n_repeat_words, the
    words in windows of `window` words that occur twice or more in the text. A
    null text counts as one without words. Windows are compared by 64-bit hash
    within one text only. Existing columns of these names are replaced.
    """
    # Names that docs does not have, for the arrays that lambdas look into: as columns each is made once a row.
    t, w, h, s, p, lines = (fresh(docs, n) for n in ("body", "words", "windows", "sorted_windows", "repeats", "lines"))
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(w, word_array(F.col(t)))
    # get() finds a word in constant time, where slice() would copy the whole array each time
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))
    df = df.withColumn(h, F.when(F.size(w) > window, hashed))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    twice = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"]))
    # The outer transform keeps the sorted array from being made anew for each of its elements.
    df = df.withColumn(p, F.when(F.col(s).isNotNull(), F.sort_array(F.transform(F.filter(twice, lambda x: x.isNotNull()), lambda x: x))))
    repeated = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b
    )
    df = df.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0))
    metrics = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_bangs": F.regexp_count(t, F.lit("!")),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*SPELLINGS))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(repeated, F.lit(0)),
    }
    # As the output of a generator the metrics are never evaluated anew inside a filter that is pushed down.
    row = F.struct(*(v.cast("long").alias(k) for k, v in metrics.items()))
    own = [c for c in docs.columns if c.lower() not in metrics]
    return df.select(*own, F.inline(F.array(row)))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs plus the metrics, base_failed and kept.

    base_failed: under 20 words, or over 30 % of the words lie in repeated
    windows. kept: not base_failed and every rule of the table holds. Empty
    tables give empty tables; nulls and empty texts fail the base rule; rows
    that occur twice are judged twice, alike. Own columns that are called as a
    metric, base_failed or kept, whatever the case, are replaced.
    """
    df = with_metrics(docs.drop(*(c for c in docs.columns if c.lower() in ("base_failed", "kept"))), text)
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))
