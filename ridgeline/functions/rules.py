"""Guard rules for translated questions and answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.model_output import errors_of, is_no, is_yes
from ridgeline.functions.numbers import missing_numbers, number_groups
from ridgeline.functions.text import WORD, norm_text, text_or_empty

# The English stems, and words of measurement.
STEMS = "what|which|who|when|where|how"
MEASURES = "meter|metre|meters|metres|kilometer|kilometre|kilometers|kilometres|mile|miles|foot|feet|inch|inches|above sea level|sea level|runway|length|height|altitude|elevation|wide|deep|area|population|capacity"


@dataclass(frozen=True)
class Language:
    """What a rule set needs of a target language; patterns are over text without accents. Values are fixed."""

    code: str
    name: str
    who: str
    when: str
    where: str
    how_many: str
    measure: str
    how_much: str
    inverted_mark: bool
    keep: str = ""


SPANISH = Language(
    "es", "Spanish",
    who="quien|quienes|nombre|persona",
    when="cuando|fecha|ano|decada",
    where="donde|en que|ubicacion|lugar|pais|ciudad|region|estado",
    how_many="cuantos|cuantas|cuanto|cuanta|numero|cantidad",
    measure="a que altura|altura|altitud|elevacion|longitud|distancia|superficie|area|extension|capacidad|poblacion|metros|metro|kilometros|millas|pies|nivel del mar|mide|medida",
    how_much="cuanto|cuanta|cuantos|cuantas|cantidad|precio|coste|valor",
    inverted_mark=True,
)

CATALAN = Language(
    "ca", "Catalan",
    who="qui|persona|nom",
    when="quan|data|any|decada",
    where="on|en quin|en quina|lloc|ubicacio|pais|ciutat|regio|estat",
    how_many="quant|quants|quantes|nombre|numero|quantitat",
    measure="a quina altura|altura|altitud|elevacio|longitud|distancia|superficie|area|extensio|capacitat|poblacio|metres|metre|quilometres|milles|peus|nivell del mar|mesura|fa",
    how_much="quant|quanta|quants|quantes|quantitat|preu|cost|valor",
    inverted_mark=False,
    keep="'",
)


def holds_word(c: Column, words: str) -> Column:
    """Some of the words stand in the text, whole."""
    return c.rlike(f"(?<![{WORD}])(?:{words})(?![{WORD}])")


def translation_errors(question_en: Column, answer_en: Column, question: Column, answer: Column, lexicalisation: Column, language: Language = SPANISH) -> Column:
    """An array of faults of a translated question and answer; empty if none is found."""
    q, a = F.trim(text_or_empty(question)), F.trim(text_or_empty(answer))
    qn, en, an, lex, en_answer = (norm_text(c, language.keep) for c in (q, question_en, a, lexicalisation, answer_en))
    code, name = language.code, language.name
    marks = (
        [(q != "") & ~(q.startswith("¿") & q.endswith("?")), f"question_{code} must be wrapped in ¿...?"],
    ) if language.inverted_mark else (
        [(q != "") & q.startswith("¿"), f"question_{code} must not open with an inverted mark"],
        [(q != "") & ~q.startswith("¿") & ~q.endswith("?"), f"question_{code} must end in a question mark"],
    )
    measured = holds_word(en, MEASURES) & holds_word(qn, language.measure)
    numbers = F.size(number_groups(answer_en)) > 0
    missing = missing_numbers(answer_en, a)
    boolean = is_yes(answer_en) | is_no(answer_en)
    return errors_of(
        (q == "", f"empty question_{code}"),
        *[tuple(m) for m in marks],
        (F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) < 3, f"question_{code} is too short"),
        (a == "", f"empty answer_{code}"),
        (qn.rlike(rf"^[¿?]?\s*(?:{STEMS})(?![{WORD}])"), "question stem is still English"),
        (en.startswith("who ") & ~holds_word(qn, language.who), f"Who is not asked in {name}"),
        (en.startswith("when ") & ~holds_word(qn, language.when), f"When is not asked in {name}"),
        (en.startswith("where ") & ~holds_word(qn, language.where), f"Where is not asked in {name}"),
        (en.startswith("how many ") & ~(holds_word(qn, language.how_many) | measured), f"How many is not asked in {name}"),
        (en.startswith("how much ") & ~holds_word(qn, language.how_much), f"How much is not asked in {name}"),
        (is_yes(answer_en) & (an != "si"), "Yes must become Sí"),
        (is_no(answer_en) & (an != "no"), "No must stay No"),
        (F.size(missing) > 0, F.concat(F.lit(f"answer_{code} misses numbers: "), F.array_join(missing, ", "))),
        ((a != "") & ~boolean & ~numbers & ~lex.contains(an) & ~lex.contains(en_answer), f"answer_{code} is not grounded in the {name} text"),
    )
