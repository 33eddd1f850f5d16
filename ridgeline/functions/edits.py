"""Cautious grammar edits: an external checker's proposals, let through by rules over columns.

A proposal is a struct of ``EDIT``. What each category may do is a table (``LIGHT``, ``DEEP``); what no deep edit may touch is an
array of intervals of the text. The gate, the choice among overlapping proposals and the splicing are array expressions; only
the places of a pattern's matches come from a Pandas UDF, as Spark gives matches but not where they are.

Defined results: a null text is empty and takes no edits; null proposals are none; proposals outside the text, without a
replacement, or with control characters in it are passed over. Of overlapping proposals the first one in the array stays.
Insertions at the place where another edit starts come before it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ridgeline.functions.text import WORD, let, strip_accents, text_or_empty

EDIT = "struct<offset:int,length:int,replacement:string,rule_id:string,category:string,message:string>"
EDITS = f"array<{EDIT}>"
LOG = "array<struct<rule_id:string,category:string,before:string,after:string,message:string>>"

# The checker's categories that change how text is set, those that change words, and its spelling rules.
LIGHT = ("CASING", "PUNCTUATION", "TYPOGRAPHY", "WHITESPACE")
DEEP = ("CONFUSED_WORDS", "GRAMMAR", "MISC", "TYPOS")
SPELLING_RULE = "MORFOLOGIK_RULE"

# Words that carry no names, by language.
FUNCTION_WORDS = {
    "en": (
        "a", "an", "the", "of", "in", "on", "at", "to", "from", "for", "with",
        "by", "about", "above", "below", "under", "over", "into", "between", "and",
        "or", "but", "is", "are", "was", "were", "be", "been", "being", "do", "does",
        "did", "has", "have", "had", "can", "could", "should", "would", "will", "shall",
        "may", "might", "must", "what", "which", "who", "whom", "whose", "where", "when",
        "why", "how", "many", "much", "long", "far", "old", "high", "tall", "deep",
        "this", "that", "these", "those", "it", "its", "there",
    ),
    "es": (
        "a", "al", "ante", "bajo", "con", "contra", "de", "del", "desde", "durante",
        "en", "entre", "hacia", "hasta", "mediante", "para", "por", "segun", "según",
        "sin", "sobre", "tras", "el", "la", "los", "las", "un", "una", "unos", "unas",
        "y", "o", "pero", "es", "son", "era", "eran", "fue", "fueron", "ser", "estar",
        "esta", "está", "estan", "están", "se", "su", "sus", "que", "qué", "cual", "cuál",
        "cuales", "cuáles", "quien", "quién", "quienes", "quiénes", "donde", "dónde",
        "cuando", "cuándo", "como", "cómo", "cuanto", "cuánto", "cuanta", "cuánta",
        "cuantos", "cuántos", "cuantas", "cuántas", "si", "sí", "no", "hay",
    ),
}

# Patterns of numbers, acronyms, words of mixed case and names of several words, and of one capitalised word.
PROTECTED = (
    r"(?<!\w)-?\d+(?:[.,]\d+)*(?!\w)",
    r"\b[A-ZÁÉÍÓÚÜÑ]{2,}(?:[-/][A-ZÁÉÍÓÚÜÑ0-9]+)*\b",
    r"\b[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+[A-Z][A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]*\b",
    r"\b(?:[A-ZÁÉÍÓÚÜÑ][\wÁÉÍÓÚÜÑáéíóúüñ'’-]+)(?:\s+(?:de|del|la|las|los|el|of|the|and|in|at|for|on|[A-ZÁÉÍÓÚÜÑ][\wÁÉÍÓÚÜÑáéíóúüñ'’-]+)){1,}\b",
)
CAPITALISED = r"\b[A-ZÁÉÍÓÚÜÑ][a-zÁÉÍÓÚÜÑáéíóúüñ'’-]{2,}\b"
NUMBER = r"-?\d+(?:[.,]\d+)*"
#: The most characters that a replacement may have, by those replaced.
MOST_ADDED, MOST_TIMES, LEAST_ROOM = 10, 4, 60
LEAST_SPELLED = 4

_PROTECTED = [re.compile(p) for p in PROTECTED]
#: A capitalised word inside a sentence: what stands before it, blanks aside, isn't a mark that ends or opens one.
_INSIDE = re.compile(rf"(?<=[^\s.!?¿¡])(?P<gap>\s*)(?P<word>{CAPITALISED})")


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def protected(texts: pd.Series) -> pd.Series:
    """The intervals of names and numbers, in order, those that meet as one."""

    def intervals(text: str) -> list[dict]:
        held = bytearray(len(text) + 2)  # one flag for each seam between characters: 1 inside an interval
        for pattern in _PROTECTED:
            for m in pattern.finditer(text):
                held[m.start() + 1 : m.end() + 1] = b"\1" * (m.end() - m.start())
        for m in _INSIDE.finditer(text):
            held[m.start("word") + 1 : m.end("word") + 1] = b"\1" * len(m["word"])
        return [{"start": m.start() - 1, "end": m.end() - 1} for m in re.finditer(rb"\x01+", held)]

    return texts.map(lambda t: intervals(t or ""))


def _clash(a: Column, b: Column) -> Column:
    """Whether two edits' ranges overlap."""
    return (a["offset"] < b["offset"] + b["length"]) & (b["offset"] < a["offset"] + a["length"])


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{WORD}]+"), F.lit(0))


def _letters(c: Column) -> Column:
    """What is left without case, accents and punctuation."""
    return F.regexp_replace(F.lower(strip_accents(c)), f"[^{WORD}]+", "")


def is_safe(edit: Column, before: Column, spans: Column, lang: str, spelling: bool = False) -> Column:
    """Whether an edit of the characters ``before`` changes neither names nor numbers nor meaning."""
    after, category = edit["replacement"], F.upper(text_or_empty(edit["category"]))
    light, deep = category.isin(*LIGHT), category.isin(*DEEP)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    brief = F.length(after) <= F.greatest(F.lit(LEAST_ROOM), MOST_TIMES * F.length(before) + MOST_ADDED)
    spells = (category == "TYPOS") | text_or_empty(edit["rule_id"]).startswith(SPELLING_RULE)
    sound = brief & (numbers(before) == numbers(after)) & (F.lit(spelling) | ~spells)
    same = _letters(before) == _letters(after)
    wordless = ~F.concat(before, after).rlike(f"[{WORD}]")
    free = ~F.exists(spans, lambda s: (edit["offset"] < s["end"]) & (s["start"] < edit["offset"] + edit["length"]))
    small = F.array(*[F.lit(w) for w in FUNCTION_WORDS["es" if lang.startswith("es") else "en"]])
    functional = F.forall(_words(F.concat_ws(" ", before, after)), lambda w: F.array_contains(small, F.lower(strip_accents(w))))
    one = lambda c: (F.size(_words(c)) == 1) & F.get(_words(c), F.lit(0)).rlike(rf"^\p{{Ll}}{{{LEAST_SPELLED},}}$")
    respelt = F.lit(spelling) & (category == "TYPOS") & one(before) & one(after)
    return sound & ((light & (same | wordless)) | (deep & (after != "") & free & (same | functional | respelt)))


def edited(text: Column, edits: Column, lang: str, spelling: bool = False) -> Column:
    """A struct (text, log) after the safe ones of an external checker's edits; the log is in the order of their places."""
    text = text_or_empty(text)

    def whole(x: Column) -> Column:
        t, spans, proposed = x["text"], x["spans"], x["edits"]
        under = lambda e: F.substring(t, e["offset"] + 1, e["length"])
        within = lambda e: (t != "") & (e["offset"] >= 0) & (e["length"] >= 0) & (e["offset"] + e["length"] <= F.length(t)) & e["replacement"].isNotNull() & ~e["replacement"].rlike(r"[\x00-\x1f]")
        safe = F.filter(proposed, lambda e: F.coalesce(within(e) & is_safe(e, under(e), spans, lang, spelling), F.lit(False)))
        none = F.expr(f"cast(array() as {EDITS})")
        chosen = F.aggregate(safe, none, lambda done, e: F.when(F.exists(done, lambda d: _clash(d, e)), done).otherwise(F.concat(done, F.array(e))))
        placed = F.array_sort(chosen, lambda a, b: F.when(a["offset"] != b["offset"], a["offset"] - b["offset"]).otherwise(F.signum(a["length"].cast("double") - b["length"]).cast("int")))

        def spliced(e: Column) -> Column:
            start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
            step = lambda s, d: F.struct(F.concat(s["out"], F.substring(t, s["at"] + 1, d["offset"] - s["at"]), d["replacement"]).alias("out"), (d["offset"] + d["length"]).alias("at"))
            text_after = F.aggregate(e, start, step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))))
            note = lambda d: F.struct(text_or_empty(d["rule_id"]).alias("rule_id"), text_or_empty(d["category"]).alias("category"), under(d).alias("before"), d["replacement"].alias("after"), text_or_empty(d["message"]).alias("message"))
            return F.struct(text_after.alias("text"), F.transform(e, note).alias("log"))

        return let(placed, spliced)

    return let(F.struct(text.alias("text"), protected(text).alias("spans"), F.coalesce(edits, F.expr(f"cast(array() as {EDITS})")).cast(EDITS).alias("edits")), whole)
