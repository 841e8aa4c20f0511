"""Quality rules: a threshold table compiled into one projection.

:data:`RULES` lists (name, measure, smallest, largest).  :func:`apply_rules`
turns the table into one Spark projection over the text: length, symbol,
stop-word and line ratios, evaluated inside the JVM without user functions
and without a shuffle.

Stop words are listed for four languages (:data:`STOP_WORDS_OF`).  The rule
on them judges documents labelled with one of these, by the words of all four
(texts mix languages); where no list exists, the other rules alone decide.
Without a language column every row counts as of a listed language.

Defined results for odd input: a null or blank text has no words, all its
counts are 0 and it fails; a text whose language is null or blank has no list
of stop words; repeated rows are judged one by one; an empty
table gives an empty result.  Every other column passes through, unless it
has the name of an output column, which then replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.words import BLANK_RUN, words

# --- fixed values: base rule and symbols --------------------------------------
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# --- fixed values: frequent function words of the corpus languages -----------
STOP_WORDS_OF = {
    "en": "a an and are as at be by for from have he in is it not of on or that the they this to was with",
    "de": "das dem der des die ein eine für im ist mit nicht sich und von zu den auf",
    "fr": "au dans de est et la le les par pas pour que qui sur un une du en",
    "es": "al con como el las los para por se su una y del",
}
STOP_WORDS = " ".join(STOP_WORDS_OF.values()).split()
#: Three-letter codes of the listed languages.
LONG_CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es"}


@dataclass(frozen=True)
class Rule:
    """``smallest <= measure <= largest`` (None: no bound on that side);
    ``listed``: only for languages with a list of stop words."""
    name: str
    measure: str
    smallest: float | None = None
    largest: float | None = None
    listed: bool = False


RULES = (
    Rule("length", "n_words", smallest=MIN_WORDS),
    Rule("mean_word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", largest=0.05),
    Rule("exclamations", "exclamations_per_word", largest=0.3),
    Rule("capitals", "capital_ratio", largest=0.3),
    Rule("stop_words", "stop_word_ratio", smallest=0.05, listed=True),
    Rule("duplicate_lines", "duplicate_line_ratio", largest=0.4),
)

OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _windows(hashes: Column) -> Column:
    """Hashes of the 3-word windows, in text order (under 3 words: none)."""
    def three(h: Column) -> Column:
        two = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(two, F.slice(h, 3, F.size(h)), lambda a, b: F.xxhash64(a, b)),
                       1, F.size(h) - 2)
    return F.when(F.size(hashes) < 3, F.array().cast("array<bigint>")).otherwise(_bind(hashes, three))


def _repeated_positions(windows: Column) -> Column:
    """Sorted start positions of the windows that occur twice or more."""
    def flagged(ordered: Column) -> Column:
        same_next = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)),
                               lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
        return _bind(same_next, lambda s: F.zip_with(
            ordered, F.zip_with(s, F.concat(F.array(F.lit(False)), s), lambda a, b: a | F.coalesce(b, F.lit(False))),
            # the shifted flags are one longer than the windows: the last has no window
            lambda o, f: F.when(f & o["i"].isNotNull(), o["i"])))
    ordered = F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.sort_array(F.array_compact(_bind(ordered, flagged)))


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, first included."""
    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(
            _bind(_repeated_positions(w), covered))
    return _bind(_windows(hashes), count)


def _listed(docs: DataFrame, lang_col: str) -> Column:
    """Whether a row's language (a code like ``en``, ``en-GB`` or ``eng``) has a list of stop words."""
    if lang_col not in docs.columns:
        return F.lit(True)
    code = F.regexp_extract(F.lower(F.col(f"`{lang_col}`").cast("string")), "^\\s*([a-z]+)(?:[-_.@\\s]|$)", 1)
    return F.coalesce(code.isin(*STOP_WORDS_OF, *LONG_CODES), F.lit(False))


def measures(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each row of ``docs`` as struct ``_row`` and a struct ``_m`` with all
    counts and ratios of its text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{text_col}`").alias("_text"), _listed(docs, lang_col).alias("_listed"))
    split = rows.withColumn("_w", words(F.col("_text")))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    counts = split.select(
        "*",
        F.size("_w").cast("bigint").alias("_n"),
        F.length(F.regexp_replace(text, BLANK_RUN, "")).cast("bigint").alias("_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint").alias("_symbols"),
        (F.length(text) - F.length(_without(text, "!"))).cast("bigint").alias("_bangs"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).cast("bigint").alias("_capitals"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"),
                                        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
        .alias("_lines"),
        repeat_words(F.transform("_w", lambda w: F.xxhash64(w))).alias("_repeat"),
        F.aggregate("_w", F.lit(0).cast("bigint"), lambda acc, w: acc + F.when(
            F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))).isin(*sorted(set(STOP_WORDS))), 1).otherwise(0)).alias("_stops"))
    n, chars = F.greatest("_n", F.lit(1)), F.greatest("_chars", F.lit(1))
    m = F.struct(
        F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"),
        F.col("_lines.dup").alias("n_dup_lines"), F.col("_repeat").alias("n_repeat_words"),
        (F.col("_chars") / n).alias("mean_word_length"), (F.col("_symbols") / chars).alias("symbol_ratio"),
        (F.col("_bangs") / n).alias("exclamations_per_word"), (F.col("_capitals") / chars).alias("capital_ratio"),
        (F.col("_stops") / n).alias("stop_word_ratio"), F.col("_listed").alias("listed"),
        (F.col("_lines.dup") / F.greatest(F.col("_lines.n"), F.lit(1))).alias("duplicate_line_ratio"))
    return counts.select("_row", m.alias("_m"))


def _fails(rule: Rule) -> Column:
    value, fails = F.col(f"_m.{rule.measure}"), F.lit(False)
    if rule.smallest is not None:
        fails = fails | (value < F.lit(rule.smallest))
    if rule.largest is not None:
        fails = fails | (value > F.lit(rule.largest))
    return fails & F.col("_m.listed") if rule.listed else fails


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``failed_rules`` for every row.

    ``base_failed``: under 50 words, or more than half of the words in
    repeated 3-word windows.  ``kept``: the base holds and no rule fails.
    """
    m = measures(docs, text_col, lang_col)
    base = (F.col("_m.n_words") < MIN_WORDS) | (
        100 * F.col("_m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_m.n_words"))
    failed = F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]))
    judged = m.select("_row", "_m", base.alias("base_failed"), failed.alias("failed_rules"))
    carried = [F.col(f"_row.`{c}`") for c in docs.columns if c not in OUTPUT]
    return judged.select(
        *carried, *[F.col(f"_m.{c}").alias(c) for c in OUTPUT[:5]], "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
              lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept_row"),
                      F.col(f"`{text_col}`").alias("_kept_text"),
                      *[F.col(f"`{c}`").alias("_kept_lang") for c in docs.columns if c == lang_col])
    # a verdict that counts as non-deterministic is not moved below its own
    # projection, where the filter would compute every measure again
    verdict = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return apply_rules(row, rules, "_kept_text", "_kept_lang").select(
        "_kept_row", verdict.alias("_verdict")).filter("_verdict").select("_kept_row.*")
