"""Text columns: normalisation, tokens, identifiers and labels. All built-in expressions but ``nfkc``, which goes to Python for texts that aren't ASCII."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRIPLE_SEP = " ||| "
BLANK = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"
_LOWER, _UPPER = "a-záéíóúüñ", "A-ZÁÉÍÓÚÜÑ"
WORD = r"\p{L}\p{N}_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, which keeps long expressions small."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_ws(c: Column) -> Column:
    """Trimmed, with runs of white space as one blank; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), BLANK, " "))


def split_camel(c: Column) -> Column:
    """A blank between a small and a capital letter, and before the last capital of a run that a small letter follows."""
    c = F.regexp_replace(c, f"([{_LOWER}])([{_UPPER}])", "$1 $2")
    return F.regexp_replace(c, f"([{_UPPER}]+)([{_UPPER}][{_LOWER}])", "$1 $2")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Unicode compatibility form, which Spark has no function for; only texts that aren't ASCII go to Python, as the others have it."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalize_triple_text(c: Column, compatibility_form: bool = True) -> Column:
    """Triples as retrieval text, in NFKC; case stays. Without ``compatibility_form`` there are built-in expressions only."""
    c = text_or_empty(c)
    for old, new in (("|||", " . "), ("||", " . "), ("|", " "), ("_", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, f"@[{WORD}]+", " ")
    c = split_camel(F.replace(c, F.lit('"'), F.lit(" ")))
    if compatibility_form:
        c = nfkc(c)
    return normalize_ws(F.regexp_replace(c, rf"[^{WORD}\s\p{{Z}}.,;:()\-/]", " "))


def normalize_text_text(c: Column, compatibility_form: bool = True) -> Column:
    """Lexicalised text in NFKC, lower case; no stemming and no stop words."""
    c = text_or_empty(c)
    if compatibility_form:
        c = nfkc(c)
    c = F.lower(F.translate(c, "_’‘“”", " ''\"\""))
    return normalize_ws(F.regexp_replace(c, rf"[^{WORD}\s\p{{Z}}.,;:()\-/]", " "))


def field_variant(raw: Column, normalized: Column, variant: str) -> Column:
    """``raw``, ``normalized`` or ``both``."""
    raw = normalize_ws(raw)
    if variant == "raw":
        return raw
    if variant == "normalized":
        return normalized
    if variant == "both":
        return normalize_ws(F.concat(raw, F.lit("\n"), normalized))
    raise ValueError(f"no such variant: {variant}")


def triples_field(c: Column, variant: str = "normalized") -> Column:
    return field_variant(c, normalize_triple_text(c), variant)


def text_field(c: Column, variant: str = "normalized") -> Column:
    return field_variant(c, normalize_text_text(c), variant)


def concat_field(triples: Column, text: Column) -> Column:
    """Both representations with their markers."""
    return normalize_ws(F.concat(F.lit("[TRIPLES]\n"), text_or_empty(triples), F.lit("\n[TEXT]\n"), text_or_empty(text)))


def spaced_words(c: Column) -> Column:
    """Lower-case words with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text_or_empty(c), "_", " ")), r"[^\p{L}\p{N}]+", " "))


def tokenize(c: Column) -> Column:
    """Lower-case words."""
    return F.array_remove(F.split(spaced_words(c), " "), "")


def qtype3(role: Column, question_type: Column) -> Column:
    """yes, no, extractive, or the question type as it stands."""
    return F.when(role == "yes_q", "yes").when(role == "no_q", "no").when(role.startswith("extractive"), "extractive").otherwise(text_or_empty(question_type))


def base_id_of(doc_id: Column, langs: list[str]) -> Column:
    """``tripleset__a__b__c__d__lang`` or ``text__...`` to ``a__b__c__d``."""
    parts = F.split(F.regexp_replace(doc_id, "^(tripleset|text)__", ""), "__")
    cut = F.when(F.element_at(parts, -1).isin(langs), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.array_join(F.slice(cut, 1, 4), "__")


def lang_of(doc_id: Column, langs: list[str]) -> Column:
    """The language at the end of an id, before an optional number; null if there is none."""
    found = F.regexp_extract(doc_id, f"__({'|'.join(langs)})(?:__\\d+)?$", 1)
    return F.when(found != "", found)


def whole_number(c: Column, default: Column | int | None = None) -> Column:
    """An integer, or the default where it is none."""
    number = c.cast("string").try_cast("double").cast("int")
    return number if default is None else F.coalesce(number, default if isinstance(default, Column) else F.lit(default))


def split_triples(c: Column) -> Column:
    """Triples of a joined field; blanks drop out."""
    c = text_or_empty(c)
    parts = F.when(c.contains(TRIPLE_SEP), F.split(c, r" \|\|\| ")).when(c.contains("|||"), F.split(c, r"\|\|\|")).otherwise(F.split(c, "\n"))
    return F.filter(F.transform(parts, normalize_ws), lambda p: p != "")


def query_id_base(row_id: Column, split: Column, category: Column, eid: Column, lex_id: Column, question_idx: Column, qtype: Column) -> Column:
    parts = [F.lit("qa"), row_id.cast("string"), split, category, eid, F.concat(F.lit("lex"), text_or_empty(lex_id)), F.concat(F.lit("q"), text_or_empty(question_idx)), qtype]
    return F.concat_ws("__", *[text_or_empty(p) for p in parts])


def normalise_triple(c: Column) -> Column:
    """Lower case and single blanks: the key that mapping compares triples by."""
    return normalize_ws(F.lower(text_or_empty(c)))


def entry_id(split: Column, category: Column, eid: Column, size: Column) -> Column:
    return F.concat_ws("__", split, category, eid, F.concat(size.cast("string"), F.lit("triples")))


def tripleset_id(base_id: Column, lang: Column) -> Column:
    return F.concat_ws("__", F.lit("tripleset"), base_id, lang)


def text_id(base_id: Column, lang: Column, lex_idx: Column | None = None) -> Column:
    parts = [F.lit("text"), base_id, lang] + ([lex_idx.cast("string")] if lex_idx is not None else [])
    return F.concat_ws("__", *parts)


#: Latin letters with marks and the letters without; fixed pairs.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def strip_accents(c: Column) -> Column:
    """Letters without marks, for the Latin letters of the corpora and for marks that stand alone."""
    return F.regexp_replace(F.translate(text_or_empty(c), ACCENTED, PLAIN), r"\p{M}+", "")


def norm_text(c: Column, keep: str = "") -> Column:
    """Plain lower-case words with ``.,/-`` and the characters in ``keep``."""
    return normalize_ws(F.regexp_replace(F.lower(strip_accents(c)), rf"[^{WORD}\s\p{{Z}}.,/\-{keep}]", " "))


def soft_match(a: Column, b: Column) -> Column:
    """One holds the other, in any case."""
    x, y = F.lower(F.trim(text_or_empty(a))), F.lower(F.trim(text_or_empty(b)))
    return x.contains(y) | y.contains(x)


def effective_answer(corrected: Column, answer: Column) -> Column:
    """The corrected answer if there is one, else the answer."""
    cleaned = F.trim(text_or_empty(corrected))
    return F.when(cleaned != "", cleaned).otherwise(F.trim(text_or_empty(answer)))


def normalize_representation(c: Column) -> Column:
    """Names of document representations brought to one spelling."""
    x = F.lower(text_or_empty(c))
    named = F.when(x.isin("triples", "triple", "tripleset", "kg"), "triples").when(x.isin("text", "texts", "lex", "lexicalisation", "lexicalization"), "text")
    for part, name in (("concat", "concat"), ("union", "hybrid_union_candidates"), ("rrf", "hybrid_rrf"), ("score", "hybrid_score"), ("cascade", "hybrid_cascade"), ("rerank", "hybrid_cascade")):
        named = named.when(x.contains(part), name)
    return named.otherwise(text_or_empty(c))


def safe_rate(amount: Column, seconds: Column) -> Column:
    """Null unless both are positive."""
    return F.when((amount > 0) & (seconds > 0), amount / seconds)


def safe_ms_per_item(seconds: Column, items: Column) -> Column:
    return F.when((items > 0) & (seconds >= 0), seconds * 1000 / items)
