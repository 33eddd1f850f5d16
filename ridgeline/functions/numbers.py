"""Numbers in English, Spanish and Catalan spelling, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.text import let, text_or_empty

NUMBER = r"[-−]?\d[\d.,]*"


def number_tokens(c: Column) -> Column:
    """Numbers as they are written in a text, without stops and commas at their ends."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(NUMBER), F.lit(0))
    return F.filter(F.transform(found, clean_number), lambda t: t.rlike(r"\d"))


def clean_number(token: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(text_or_empty(token), F.lit("−"), F.lit("-"))), "^[.,]+|[.,]+$", "")


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def number_variants(token: Column) -> Column:
    """The values that a token may stand for, in order.

    With both marks the later one is the decimal mark; a mark that repeats separates thousands; a single mark is a decimal
    mark, and may separate thousands too where three digits follow and at most three stand before it.
    """

    def values(clean: Column) -> Column:
        sign = F.when(clean.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
        spelled = let(F.regexp_replace(clean, "^-", ""), _spellings)
        return F.transform(spelled, lambda s: F.abs(s.try_cast("double")) * sign)

    return F.array_sort(F.array_distinct(F.filter(let(clean_number(token), values), lambda v: v.isNotNull())))


def _spellings(body: Column) -> Column:
    dots, commas = _count(body, "."), _count(body, ",")
    no_dots, no_commas = (F.replace(body, F.lit(mark), F.lit("")) for mark in ".,")
    comma_last = body.rlike(r",[^.]*$")
    left, right = (F.regexp_extract(body, r"^([^.,]*)[.,](.*)$", k) for k in (1, 2))
    either = F.array(F.concat(left, F.lit("."), right), F.when((F.length(right) == 3) & (F.length(left) <= 3), F.concat(left, right)))
    return (
        F.when(~body.rlike(r"\d"), F.array(F.lit(None).cast("string")))
        .when((dots > 0) & (commas > 0), F.array(F.when(comma_last, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas)))
        .when(dots > 1, F.array(no_dots))
        .when(commas > 1, F.array(no_commas))
        .when((dots == 1) | (commas == 1), either)
        .otherwise(F.array(body))
    )


def number_groups(c: Column) -> Column:
    """Structs (token, variants) of a text's numbers."""
    groups = F.transform(number_tokens(c), lambda t: F.struct(t.alias("token"), number_variants(t).alias("variants")))
    return F.filter(groups, lambda g: F.size(g["variants"]) > 0)


def numbers_match(expected: Column, observed: Column, relative: float = 1e-9, absolute: float = 1e-6) -> Column:
    """Some value of one array is within the tolerance of some value of the other."""
    return F.exists(
        expected, lambda e: F.exists(observed, lambda o: F.abs(e - o) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(e), F.abs(o), F.lit(1.0))))
    )


def missing_numbers(expected_text: Column, observed_text: Column) -> Column:
    """Tokens of the first text's numbers that the second text doesn't have in any spelling."""
    observed = F.flatten(F.transform(number_groups(observed_text), lambda g: g["variants"]))
    return F.transform(F.filter(number_groups(expected_text), lambda g: ~numbers_match(g["variants"], observed)), lambda g: g["token"])
