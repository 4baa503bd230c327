"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import let
from quarry.llm._spark import Renamed, word_array

STOP_WORDS = tuple(
    w
    for s in (
        "the of and to in is that for with was as on are by this be it at from or an a",  # English
        "le la les de des du et un une en est que pour dans sur par au qui",  # French
        "der die das und in zu den von mit ist des auf im ein eine nicht sich dem",  # German
        "el los las del y que en un una por con para se no al lo es su",  # Spanish
    )
    for w in s.split()
)


#: The languages whose words are in STOP_WORDS.
STOP_LANGUAGES = ("en", "fr", "de", "es")


@dataclass(frozen=True)
class Rule:
    """A bound on a ratio of two measures: rejected if numerator < low * denominator or > high * denominator.

    A rule for some languages leaves texts alone whose language is known to be another one.
    """

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None
    languages: tuple[str, ...] | None = None

    def broken(self, measures: Column, language: Column) -> Column:
        """True where the ratio lies outside; a zero denominator breaks no rule. Products, so nothing is divided."""
        n, d = measures[self.numerator], measures[self.denominator]
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (n < self.low * d)
        if self.high is not None:
            bad = bad | (n > self.high * d)
        if self.languages is not None:
            bad = bad & F.coalesce(language.isin(*self.languages), F.lit(True))
        return bad & (d > 0)


#: The table. Lengths first, then symbols, stop words and lines. Values follow published web-corpus filters.
RULES: tuple[Rule, ...] = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, languages=STOP_LANGUAGES),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def measures(text: Column) -> Column:
    """A struct of the measures of a whole text, all long.

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words,
    n_stop_words. Null or blank texts have 0 everywhere (symbols of a text always lie in words).

    A 3-word window's position is sorted next to its equals as (hash, position) structs, so texts of
    any length cost n log n; covered words are the gaps between flagged positions, 3 at most each.
    Words, lines and windows are bound once each, wherever the optimizer moves the expression.
    """
    t = F.coalesce(text, F.lit(""))
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})

    def windows(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return F.when(F.size(w) < 4, None).otherwise(F.sort_array(made))

    def repeated(s: Column) -> Column:
        hash_at = lambda k: F.get(s, k)["h"]
        return F.sort_array(F.transform(F.filter(s, lambda x, k: x["h"].eqNullSafe(hash_at(k - 1)) | x["h"].eqNullSafe(hash_at(k + 1))), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x))
        return F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))

    def of(w: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.char_length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": let(let(windows(w), repeated), covered),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stop))),
        }
        return F.struct(*[found[n].cast("long").alias(n) for n in MEASURES])

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(word_array(text), lambda w: let(lines, lambda x: of(w, x)))


def base_failed(measures: Column) -> Column:
    return (measures["n_words"] < 50) | (100 * measures["n_repeat_words"] > 50 * measures["n_words"])


def verdict(text: Column, language: Column, rules: Sequence[Rule] = RULES) -> Column:
    """A struct of measures, base_failed, broken_rules (names) and kept."""

    def judged(m: Column) -> Column:
        names = F.filter(F.array(*[F.when(r.broken(m, language), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        kept = ~base_failed(m) & (F.size(names) == 0)
        return F.struct(m.alias("measures"), base_failed(m).alias("base_failed"), names.alias("broken_rules"), kept.alias("kept"))

    return let(measures(text), judged)


def quality_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, lang: str = "lang") -> DataFrame:
    """Adds the measures, base_failed, broken_rules (names) and kept to every row; no row is dropped.

    Base: fewer than 50 words, or over half of the words in repeated 3-word windows. kept is false for
    those and for any broken rule. The stop-word rule knows English, French, German and Spanish; rows whose
    ``lang`` names another language pass it, rows of a null one, or of a table without the column, don't. Null
    and empty texts fail the base; very long ones are judged whole; repeated rows are judged alike; an empty
    table gives an empty one. Columns named like an added one are replaced, all others pass unchanged.
    """
    own = Renamed(docs)
    language = F.col(own.name(lang)) if own.has(lang) else F.lit(None).cast("string")
    judged = own.df.withColumn("_v", verdict(F.col(own.name(text)), language, rules))
    added = {n: F.col("_v")["measures"][n] for n in MEASURES} | {n: F.col("_v")[n] for n in ("base_failed", "broken_rules", "kept")}
    return judged.select(*own.restored(tuple(added)), *[c.alias(n) for n, c in added.items()])
