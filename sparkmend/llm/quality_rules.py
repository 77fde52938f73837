"""Quality rules: a threshold table compiled into one Spark projection.

The table names a metric and the closed range it must lie in. ``with_metrics`` computes all
metrics of a row with built-in expressions (no user functions), ``apply_rules`` turns the
table into one projection of verdicts. There is no shuffle: every row is judged on its own,
so a hot source or a group of copies cannot skew it.

Cases: NULL and empty texts have no words, so they fail the base rules; a ratio over zero
words or lines is 0; repeated rows and repeated ids are judged row by row; an empty table
gives an empty result; columns that clash with a metric name are replaced by the metric.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmend.llm.common import WORD_BREAKS, word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or",
    "that", "the", "this", "to", "was", "with",
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "ist", "mit", "nicht",
    "sich", "und", "von", "zu",
    "au", "avec", "dans", "de", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour",
    "que", "qui", "sur", "un", "une",
    "al", "como", "con", "del", "el", "las", "lo", "los", "no", "por", "se", "su", "una", "y",
]


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; None leaves that side open. NULL metrics count as failed."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_word_ratio", 0.05, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.50),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.90),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.30),
)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda variable, not a repeated expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(hashes: Column, step: int) -> Column:
    """Hashes of runs twice as long: run i joined with run i + step (empty if there is no such pair)."""
    pairs = F.size(hashes) - step
    return F.when(pairs <= 0, F.slice(hashes, 1, 0)).otherwise(
        F.zip_with(F.slice(hashes, 1, F.greatest(pairs, F.lit(0))),
                   F.slice(hashes, step + 1, F.greatest(pairs, F.lit(0))),
                   lambda a, b: F.xxhash64(a, b)))


def _covered(words: Column, hashes: Column) -> Column:
    """Words covered by windows that occur at least twice.

    The (hash, position) pairs are sorted; a window counts when a neighbour has the same hash
    and the same words. The covered positions are added up as a union of intervals.
    """
    def same(pairs, x, k):
        other = F.get(pairs, k)
        return F.coalesce((other["h"] == x["h"])
                          & (F.slice(words, other["i"], WINDOW) == F.slice(words, x["i"], WINDOW)), F.lit(False))

    def union(pairs):
        starts = F.array_sort(F.transform(
            F.filter(pairs, lambda x, k: same(pairs, x, k - 1) | same(pairs, x, k + 1)), lambda x: x["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"),
                                  (i + WINDOW).alias("end")),
            lambda s: s["n"])

    return _bind(F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), (k + 1).alias("i")))), union)


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts (``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_lines``, ``n_stop_words``) and the ratios the rules look at.

    ``n_repeat_words`` counts the words in 8-word windows found twice or more, the first included:
    windows are hashed by doubling (2, 4, 8 words), and only rows with equal hashes go on to the
    sorted comparison. Columns named ``__q_*`` are used on the way and dropped.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1),
                     lambda x: F.length(F.translate(x, WORD_BREAKS, "")) > 0)
    staged = (docs
              .withColumns({"__q_words": word_array(F.col(text)), "__q_lines": lines})
              .withColumn("__q_1", F.transform("__q_words", lambda w: F.xxhash64(w)))
              .withColumn("__q_2", _joined(F.col("__q_1"), 1))
              .withColumn("__q_4", _joined(F.col("__q_2"), 2))
              .withColumn("__q_8", _joined(F.col("__q_4"), 4)))
    counted = staged.withColumns({
        "n_words": F.size("__q_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_lines": F.size("__q_lines").cast("long"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter(word_array(F.lower(F.col(text))), lambda w: w.isin(STOP_WORDS))).cast("long"),
        "n_bullet_lines": F.size(F.filter("__q_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter("__q_lines", lambda x: F.endswith(F.rtrim(x), F.lit("..."))
                                            | F.endswith(F.rtrim(x), F.lit("…")))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("__q_8")) == F.size("__q_8"), F.lit(0))
                           .otherwise(_covered(F.col("__q_words"), F.col("__q_8"))).cast("long"),
    }).drop("__q_words", "__q_lines", "__q_1", "__q_2", "__q_4", "__q_8")

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counted.withColumns({
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
    })


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES, *, min_words: int = MIN_WORDS,
                max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Compile the rules into one projection: ``base_failed``, ``failed_rules`` (names, comma-joined), ``kept``."""
    def broken(r: Rule) -> Column:
        c = F.col(r.metric)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (c < r.low)
        if r.high is not None:
            bad = bad | (c > r.high)
        return F.coalesce(bad, F.lit(True))

    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    failed = F.concat_ws(",", *[F.when(broken(r), F.lit(r.name)) for r in rules])
    return measured.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics and verdicts of every row of ``docs`` (all its columns kept)."""
    return apply_rules(with_metrics(docs, text), rules)
