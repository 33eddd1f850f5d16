"""Language checks: a detector by frequent words, and the review rule over any detector's scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.text import let, tokenize

#: Frequent words by language; fixed values.
FREQUENT = {
    "ca": ("els", "les", "dels", "amb", "és", "més", "són", "pel", "aquest", "aquesta", "però", "una"),
    "de": ("der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "des", "ein", "für"),
    "en": ("the", "of", "and", "to", "is", "that", "was", "for", "it", "with", "be", "this"),
    "es": ("el", "los", "las", "del", "por", "con", "para", "una", "su", "al", "lo", "como"),
    "fr": ("le", "les", "des", "et", "dans", "un", "du", "est", "pour", "qui", "par", "plus"),
}


def frequent_word_scores(c: Column) -> Column:
    """Structs (score, lang) by falling score: the share of a text's words that are frequent in a language."""

    def share(words: Column, own: tuple[str, ...]) -> Column:
        return F.try_divide(F.size(F.filter(words, lambda w: w.isin(*own))).cast("double"), F.size(words))

    def score(words: Column) -> Column:
        rows = [F.struct(share(words, own).alias("score"), F.lit(lang).alias("lang")) for lang, own in FREQUENT.items()]
        return F.reverse(F.array_sort(F.array(*rows)))

    return let(tokenize(c), score)


def language_review(scores: Column, expected: Column, least_margin: float = 0.15) -> tuple[Column, Column, Column]:
    """The detected language, the margin to the runner-up, and whether to review it: another language, or a small margin."""
    detected, margin = scores[0]["lang"], F.coalesce(scores[0]["score"] - F.coalesce(scores[1]["score"], F.lit(0.0)), F.lit(0.0))
    return detected, margin, ~detected.eqNullSafe(expected) | (margin < least_margin)
