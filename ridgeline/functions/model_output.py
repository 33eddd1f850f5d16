"""What models answer: JSON in free text, verdicts, flags and question lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.text import norm_text, text_or_empty

#: Fixed answers.
YES, NO = ("yes", "sí", "si"), ("no",)
TRUE_WORDS = ("true", "yes", "si", "valid", "ok")


def without_thinking(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?s)<think>.*?</think>", ""))


def json_text(c: Column) -> Column:
    """The text if it is a JSON object, else what lies from the first to the last brace; null if neither parses."""
    c = without_thinking(c)
    whole = F.when(c.startswith("{") & F.json_object_keys(c).isNotNull(), c)
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(whole, F.when((inner != "") & F.json_object_keys(inner).isNotNull(), inner))


def parse_json(c: Column, schema: str) -> Column:
    return F.from_json(json_text(c), schema)


def parse_ok(c: Column) -> Column:
    """The field ``ok``; failing that the field in broken JSON, then a bare true or false; else null."""
    c = without_thinking(c)
    field = F.lower(F.get_json_object(c, "$.ok"))
    truthy = F.when(field.isin("true", "1"), True).when(field.isin("false", "0", "", "null"), False)
    near = F.lower(F.regexp_extract(c, r'(?i)"ok"\s*:\s*(true|false)', 1))
    return F.coalesce(truthy, F.when(near == "true", True).when(near == "false", False), F.when(c.rlike(r"(?i)\btrue\b"), True).when(c.rlike(r"(?i)\bfalse\b"), False))


def is_yes(c: Column) -> Column:
    return norm_text(c).isin(*YES)


def is_no(c: Column) -> Column:
    return norm_text(c).isin(*NO)


def as_bool(c: Column) -> Column:
    return norm_text(c.cast("string")).isin(*TRUE_WORDS)


def compact_feedback(errors: Column, limit: int = 4) -> Column:
    """The first errors in one line; ``none`` if there are none."""
    clean = F.filter(F.transform(errors, lambda e: F.trim(text_or_empty(e))), lambda e: e != "")
    return F.when(F.size(errors) <= 0, "none").otherwise(F.array_join(F.slice(clean, 1, limit), " | "))


def yesno_check(en: Column, es: Column) -> tuple[Column, Column]:
    """Whether yes/no answers agree, and why or why not."""
    a, b = (F.lower(F.trim(text_or_empty(c))) for c in (en, es))
    a_yes, a_no, b_yes, b_no = a.isin(*YES), a.isin(*NO), b.isin(*YES), b.isin(*NO)
    quoted = lambda c: F.concat(F.lit("'"), text_or_empty(c), F.lit("'"))
    ok = (a_yes & b_yes) | (a_no & b_no)
    reason = (
        F.when(~(a_yes | a_no), F.concat(F.lit("Unexpected EN: "), quoted(en)))
        .when(~(b_yes | b_no), F.concat(F.lit("Unexpected ES: "), quoted(es)))
        .when(a_yes & b_yes, "Yes↔Sí [rule]")
        .when(a_no & b_no, "No↔No [rule]")
        .otherwise(F.concat(F.lit("Mismatch EN="), quoted(en), F.lit(" ES="), quoted(es), F.lit(" [rule]")))
    )
    return ok, reason


def errors_of(*rules: tuple[Column, Column | str]) -> Column:
    """An array of the messages whose condition holds."""
    return F.array_compact(F.array(*[F.when(when, message if isinstance(message, Column) else F.lit(message)) for when, message in rules]))


def output_errors(parsed: Column, statement: Column) -> Column:
    """Faults of a parsed question list: a struct with ``statement`` and ``questions``."""
    return errors_of(
        (parsed.isNull(), "invalid JSON"),
        (parsed.isNotNull() & ~parsed["statement"].eqNullSafe(statement), "statement mismatch"),
        (parsed.isNotNull() & (F.size(F.coalesce(parsed["questions"], F.array())) == 0), "missing questions"),
    )


#: Fixed names of question kinds as coverage reports spell them.
MISSING_KINDS = (("yes_question", "yes_q"), ("no_question", "no_q"), ("extractive_questions", "extractive"))


def missing_kinds(c: Column) -> Column:
    """Kinds of question that a coverage report misses."""
    return F.array_compact(F.array(*[F.when(text_or_empty(c).contains(said), kind) for said, kind in MISSING_KINDS]))


def wanted_questions(questions: Column, wanted: Column) -> Column:
    """Questions (structs with ``question_type`` and ``answer``) of a wanted kind: yes_q, no_q or extractive."""

    def kind(q: Column) -> Column:
        answer = F.lower(F.trim(text_or_empty(q["answer"])))
        return F.when(q["question_type"] == "extractive", "extractive").when((q["question_type"] == "yes_no") & (answer == "yes"), "yes_q").when((q["question_type"] == "yes_no") & (answer == "no"), "no_q")

    return F.filter(questions, lambda q: F.coalesce(F.array_contains(wanted, kind(q)), F.lit(False)))
