"""Question sets: coverage, votes, consensus, selection, merging, regeneration and bounded retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.model_output import compact_feedback, errors_of, missing_kinds, parse_json, wanted_questions, yesno_check
from ridgeline.functions.questions import syntactic_distance
from ridgeline.functions.stable import stable_order
from ridgeline.functions.text import effective_answer, soft_match, text_or_empty
from ridgeline.operators.retrieval import dot
from ridgeline.operators.topk import first_per_key, rank_per_key

LEX_KEY = ["category", "eid", "lex_id"]
ENTITY_KEY = ["category", "eid"]
FULL_KEY = ["split", "category", "eid", "lex_id"]


# --- coverage


def _of_kind(kind: str) -> Column:
    answer = F.lower(effective_answer(F.col("corrected_answer"), F.col("answer")))
    yes_no = F.col("question_type") == "yes_no"
    chosen = {"yes": yes_no & (answer == "yes"), "no": yes_no & (answer == "no"), "extractive": F.col("question_type") == "extractive"}[kind]
    return F.when(chosen, F.col("question"))


def coverage(qa: DataFrame, keys: list[str], least_extractive: int) -> DataFrame:
    """Distinct questions of each kind per key, and what is missing.

    Lexicalisations need one extractive question (``least_extractive`` 1), entities two.
    """
    lists = {k: F.array_sort(F.collect_set(_of_kind(k))) for k in ("yes", "no", "extractive")}
    extra = [F.countDistinct("lex_id").alias("n_lexicalisations")] if "lex_id" not in keys else []
    out = qa.groupBy(*keys).agg(*extra, *[v.alias(f"{k}_questions") for k, v in lists.items()])
    for k in lists:
        out = out.withColumn(f"n_{k}_questions", F.size(f"{k}_questions").cast("long"))
    out = out.withColumns({"has_yes": F.col("n_yes_questions") >= 1, "has_no": F.col("n_no_questions") >= 1, "has_extractive": F.col("n_extractive_questions") >= least_extractive})
    lacking = F.concat(F.lit("extractive_questions("), (2 - F.col("n_extractive_questions")).cast("string"), F.lit("_missing)"))
    missing = F.concat_ws("; ", F.when(~F.col("has_yes"), "yes_question"), F.when(~F.col("has_no"), "no_question"), F.when(~F.col("has_extractive"), lacking))
    out = out.withColumns({"is_complete": F.col("has_yes") & F.col("has_no") & F.col("has_extractive"), "missing": missing})
    return out.withColumns({f"{k}_questions": F.array_join(f"{k}_questions", " | ") for k in lists})


def lexicalisation_coverage(qa: DataFrame) -> DataFrame:
    return coverage(qa, LEX_KEY, 1)


def entity_coverage(qa: DataFrame) -> DataFrame:
    return coverage(qa, ENTITY_KEY, 2)


def missing_histogram(report: DataFrame) -> DataFrame:
    return report.where(~F.col("is_complete")).groupBy("missing").agg(F.count("*").alias("n"))


def category_completeness(report: DataFrame) -> DataFrame:
    n, whole = F.count("*"), F.sum(F.col("is_complete").cast("long"))
    return report.groupBy("category").agg(n.alias("total_entities"), whole.alias("complete_entities"), F.round(100 * whole / n, 1).alias("pct_complete"))


def complete_only(qa: DataFrame, report: DataFrame, keys: list[str] = ENTITY_KEY) -> DataFrame:
    """Questions of complete entities."""
    return qa.join(report.where("is_complete").select(*keys), keys, "left_semi")


def regeneration_tasks(report: DataFrame, qa: DataFrame, meta: tuple[str, ...] = ("split", "xml_file", "mtriple", "lex_text", "statement")) -> DataFrame:
    """One row per incomplete lexicalisation with the kinds it misses and its texts."""
    todo = report.where(~F.col("is_complete")).select(*LEX_KEY, missing_kinds(F.col("missing")).alias("missing_types")).where(F.size("missing_types") > 0)
    known = [c for c in meta if c in qa.columns]
    firsts = qa.groupBy(*LEX_KEY).agg(F.min(F.struct(*known)).alias("m")).select(*LEX_KEY, *[F.col(f"m.{c}") for c in known])
    return todo.join(firsts, LEX_KEY, "left")


def next_question_idx(qa: DataFrame, keys: list[str] = FULL_KEY) -> DataFrame:
    return qa.groupBy(*keys).agg((F.max(F.col("question_idx").cast("int")) + 1).alias("next_idx"))


# --- votes and consensus


def majority_vote(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Strict majorities over the verdicts that could be read, and the first judge's correction.

    Columns of ``verdicts``: keys, judge, answerable, correct, corrected_answer; an unreadable verdict has null flags.
    """
    read = F.col("answerable").isNotNull() | F.col("correct").isNotNull()
    n = F.sum(read.cast("long"))
    a, c = (F.sum((read & F.coalesce(x, F.lit(False))).cast("long")) for x in ("answerable", "correct"))
    given = read & (F.coalesce("corrected_answer", F.lit("")) != "")
    first = F.min_by(F.when(given, F.col("corrected_answer")), F.when(given, F.col("judge")))
    return verdicts.groupBy(*keys).agg(n.alias("judges_used"), a.alias("answerable_votes"), c.alias("correct_votes"), (a > n / 2).alias("answerable"), (c > n / 2).alias("correct"), first.alias("judge_corrected_answer"))


def judged_answers(qa: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """Yes/no answers that the judges reject get their correction."""
    fix = (F.col("question_type") == "yes_no") & ~F.col("correct") & (F.coalesce("judge_corrected_answer", F.lit("")) != "")
    out = qa.join(votes, keys)
    return out.withColumns({"final_answer": F.when(fix, F.col("judge_corrected_answer")).otherwise(F.col("answer")), "answer_corrected": F.coalesce(fix, F.lit(False))})


def boolean_consensus(answer: Column, one: Column, two: Column) -> tuple[Column, Column]:
    """The corrected answer and a flag, from two models' labels."""
    known = F.trim(text_or_empty(answer))
    agree = one == two
    wrong = agree & (F.lower(one) != F.lower(known))
    return F.when(wrong, one).otherwise(known), F.when(wrong, F.concat(F.lit("CORRECTED: "), known, F.lit(" → "), one)).when(~agree, "MODELS_DISAGREE").otherwise("")


def extractive_consensus(answer: Column, one: Column, two: Column) -> tuple[Column, Column]:
    """The suggested answer and a flag, from two models' spans."""
    known = F.trim(text_or_empty(answer))
    agree = soft_match(one, two)
    wrong = agree & ~soft_match(one, known)
    return F.when(wrong, one).otherwise(known), F.when(wrong, F.concat(F.lit("SUGGESTED: '"), known, F.lit("' → '"), one, F.lit("'"))).when(~agree, "MODELS_DISAGREE").otherwise("")


def entailment_verdict(faithfulness: Column, alignment: Column) -> Column:
    return (faithfulness == "entailment") & (alignment == "entailment")


def translation_verdict(qa: DataFrame) -> DataFrame:
    """Question judged by a model; the answer by rule for yes/no and by a model otherwise; both must hold.

    Columns read: question_type, answer, answer_es, question_judged, answer_judged.
    """
    ok, reason = yesno_check(F.col("answer"), F.col("answer_es"))
    ruled = F.col("question_type") != "extractive"
    said = lambda c: F.when(F.coalesce(c, F.lit(False)), "LLM=ok").otherwise("LLM=fail")
    answer_ok = F.when(ruled, ok).otherwise(F.coalesce("answer_judged", F.lit(False)))
    question_ok = F.coalesce("question_judged", F.lit(False))
    return qa.withColumns(
        {
            "val_question_ok": question_ok, "val_question_reason": said(F.col("question_judged")), "val_answer_method": F.when(ruled, "rule").otherwise("llm"), "val_answer_ok": answer_ok,
            "val_answer_reason": F.when(ruled, reason).otherwise(said(F.col("answer_judged"))), "val_overall_ok": question_ok & answer_ok,
        }
    )


# --- merging


def merge_questions(original: DataFrame, added: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both sets without repeats (the original row stays), placeholders dropped where there is a question, numbered anew."""
    keys = keys or [*FULL_KEY, "question_type", "question", "answer"]
    both = original.withColumn("_source", F.lit(0)).unionByName(added.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    once = first_per_key(both, keys, [F.col("_source"), F.col("question_idx").cast("int")]).drop("_source")
    return reindex(drop_placeholders(once))


def drop_placeholders(qa: DataFrame, keys: list[str] = FULL_KEY) -> DataFrame:
    """Rows with a question, and rows of keys that have none at all."""
    has = F.trim(text_or_empty(F.col("question"))) != ""
    return qa.withColumn("_any", F.max(has).over(Window.partitionBy(*keys))).where(has | ~F.col("_any")).drop("_any")


def reindex(qa: DataFrame, keys: list[str] = FULL_KEY) -> DataFrame:
    """question_idx from 0 in order of kind and question."""
    return rank_per_key(qa.drop("question_idx"), keys, [F.col("question_type"), F.col("question"), F.col("answer")], "_i").withColumn("question_idx", F.col("_i") - 1).drop("_i")


# --- selection


def pick_one(pool: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """One row per key, an original if there is one, otherwise any; the pick is by hash."""
    order = [F.col("is_original").desc(), stable_order(F.concat_ws("::", *keys, "question"), seed), F.col("question")]
    return first_per_key(pool, keys, order).withColumn("selection_source", F.when(F.col("is_original"), "original").otherwise("random"))


def combined_distance(a: Column, b: Column, a_vector: Column | None = None, b_vector: Column | None = None, weight: float = 0.7) -> Column:
    """Distance of meaning (from unit vectors) and of spelling; spelling alone without vectors."""
    spelling = syntactic_distance(a, b)
    return spelling if a_vector is None else weight * (1 - dot(a_vector, b_vector)) + (1 - weight) * spelling


def diverse_pair(pool: DataFrame, keys: list[str], distance: Callable[[Column, Column], Column] | None = None, order: list[Column] | None = None, block: int = 64) -> DataFrame:
    """``(keys, question_a, question_b, distance)``: the two questions of a key that are furthest apart; originals first.

    Keys with two or more originals use only those; a single original is paired with the furthest other question; ties go to
    the questions that come first by ``order`` (by hash). All pairs of a key are compared, as a distance can be any function:
    its questions are put into blocks, pairs of blocks are dealt to tasks, and each task keeps its furthest pair.
    """
    far = distance or (lambda a, b: combined_distance(a, b))
    n_original = F.sum(F.col("is_original").cast("int")).over(Window.partitionBy(*keys))
    used = pool.withColumn("_n", n_original).where((F.col("_n") < 2) | F.col("is_original"))
    ranked = rank_per_key(used, keys, [F.col("is_original").desc(), *(order or [stable_order(F.col("question")), F.col("question")])], "_i")
    blocks = ranked.groupBy(*keys, F.floor((F.col("_i") - 1) / block).cast("int").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", "question"))).alias("_items"), F.max("_n").alias("_n"))
    blocks = blocks.withColumn("_last", F.max("_b").over(Window.partitionBy(*keys)))
    # with one original only its block, the first, has left members
    left = blocks.where("_n <> 1 or _b = 0").select(*keys, F.col("_b").alias("_lo"), F.explode(F.sequence("_b", "_last")).alias("_hi"), F.when(F.col("_n") == 1, F.slice("_items", 1, 1)).otherwise(F.col("_items")).alias("_x"))
    right = blocks.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_lo"), F.col("_b").alias("_hi"), F.col("_items").alias("_y"))
    met = left.join(right, [*keys, "_lo", "_hi"]).select(*keys, F.explode("_x").alias("a"), "_y").select(*keys, "a", F.explode("_y").alias("b")).where("a._i < b._i")
    apart = met.withColumn("_d", far(F.col("a.question"), F.col("b.question")))
    best = apart.groupBy(*keys).agg(F.max(F.struct(F.col("_d"), (-F.col("a._i")).alias("a"), (-F.col("b._i")).alias("b"), F.col("a.question").alias("question_a"), F.col("b.question").alias("question_b"))).alias("f"))
    return best.select(*keys, "f.question_a", "f.question_b", F.round("f._d", 6).alias("distance"))


def select_four(qa: DataFrame, keys: list[str] = ENTITY_KEY, seed: int = 42, pairs: DataFrame | None = None) -> DataFrame:
    """yes_q, no_q, extractive_1 and extractive_2 for each entity that has one yes, one no and two extractive questions.

    ``pairs`` (from diverse_pair) chooses the extractive ones; without it originals go first, then by hash.
    """
    answer = F.lower(effective_answer(F.col("corrected_answer"), F.col("answer")))
    tagged = qa.withColumn("is_original", F.trim(text_or_empty(F.col("correction_flag"))) == "")
    tagged = tagged.withColumn("_kind", F.when(F.col("question_type") == "extractive", "extractive").when(answer == "yes", "yes_q").when(answer == "no", "no_q")).where("_kind is not null")
    order = [F.col("is_original").desc(), stable_order(F.concat_ws("::", *keys, "question"), seed), F.col("question")]
    ranked = rank_per_key(tagged, [*keys, "_kind"], order, "_i")
    if pairs is not None:
        chosen = pairs.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_p"), F.col(c).alias("question")) for i, c in ((1, "question_a"), (2, "question_b"))])).alias("x")).select(*keys, "x._p", "x.question")
        extractive = first_per_key(ranked.where("_kind = 'extractive'").join(chosen, [*keys, "question"]), [*keys, "_p"], order).withColumn("_i", F.col("_p")).drop("_p")
        ranked = ranked.where("_kind <> 'extractive'").unionByName(extractive)
    own = Window.partitionBy(*keys)
    has = lambda kind, n: F.max(((F.col("_kind") == kind) & (F.col("_i") == n)).cast("int")).over(own)
    need = has("yes_q", 1) + has("no_q", 1) + has("extractive", 1) + has("extractive", 2)
    picked = ranked.where((F.col("_i") == 1) | ((F.col("_kind") == "extractive") & (F.col("_i") == 2))).withColumn("_need", need).where("_need = 4")
    role = F.when(F.col("_kind") == "extractive", F.concat(F.lit("extractive_"), F.col("_i").cast("string"))).otherwise(F.col("_kind"))
    return picked.withColumns({"selected_role": role, "selection_source": F.when(F.col("is_original"), "original").otherwise("random")}).drop("_kind", "_i", "_need")


# --- texts and retries


def clamped_lexicalisation(qa: DataFrame, lexes: DataFrame, name: str = "lex_text_es") -> DataFrame:
    """Adds the text of the same number, or the last one there is."""
    at = F.least(F.coalesce(F.col("lex_id").try_cast("int"), F.lit(0)), F.size("lex") - 1)
    return qa.join(lexes.select("split", "category", "eid", "lex"), ["split", "category", "eid"], "left").withColumn(name, F.when(F.size("lex") > 0, F.get("lex", F.greatest(at, F.lit(0))))).drop("lex")


def without_lexicalisation(qa: DataFrame, entries: DataFrame, lang: str = "es") -> DataFrame:
    """Questions whose entry is in the corpus but has no text in a language."""
    lacking = entries.where(F.size(f"lex_{lang}") == 0).select("split", "category", "eid", "xml_file").distinct()
    return qa.join(lacking, ["split", "category", "eid", "xml_file"], "left_semi")


def question_rows(generated: DataFrame, meta: list[str], questions: str = "questions", errors: str = "errors") -> DataFrame:
    """One row per generated question, or one placeholder with the errors."""
    return generated.select(*meta, F.posexplode_outer(questions).alias("question_idx", "q"), F.array_join(errors, "; ").alias("generation_errors")).select(
        *meta, F.coalesce("question_idx", F.lit(0)).alias("question_idx"), F.coalesce("q.question_type", F.lit("")).alias("question_type"), F.coalesce("q.question", F.lit("")).alias("question"), F.coalesce("q.answer", F.lit("")).alias("answer"), "generation_errors"
    )


def regenerate(tasks: DataFrame, known: DataFrame, ask: Callable[[DataFrame], DataFrame], keys: list[str] = LEX_KEY) -> DataFrame:
    """Questions of the kinds that ``tasks`` miss, numbered on from those in ``known``.

    ``ask`` adds ``output``, a model's answer to each task. Questions of other kinds, and yes/no questions with the other
    answer, drop out; a task that is left with none gives one row without a number, with the reason.
    """
    asked = ask(tasks)
    parsed = asked.withColumn("_p", parse_json(F.col("output"), "questions array<struct<type:string,question:string,answer:string>>"))
    made = F.transform("_p.questions", lambda q: F.struct(q["type"].alias("question_type"), text_or_empty(q["question"]).alias("question"), F.trim(text_or_empty(q["answer"])).alias("answer")))
    judged = parsed.withColumn("_q", wanted_questions(made, F.col("missing_types")))
    none = F.concat(F.lit("no questions of the kinds wanted: "), F.array_join("missing_types", ", "))
    errors = errors_of((F.col("_p").isNull(), "invalid JSON"), (F.col("_p").isNotNull() & F.col("_p.questions").isNull(), "missing questions"), (F.size("_q") == 0, none))
    numbered = judged.withColumn("generation_errors", F.array_join(errors, "; ")).join(next_question_idx(known, keys), keys, "left")
    rows = numbered.select(*tasks.columns, "generation_errors", "next_idx", F.posexplode_outer("_q").alias("_i", "_one"))
    said = {c: text_or_empty(F.col(f"_one.{c}")).alias(c) for c in ("question_type", "question", "answer")}
    return rows.select(*tasks.columns, (F.coalesce("next_idx", F.lit(0)) + F.col("_i")).alias("question_idx"), *said.values(), "generation_errors")


def generate_with_retries(
    items: DataFrame, keys: list[str], attempt: Callable[[DataFrame, int], DataFrame], fallback: tuple[str, str], most: int = 4, keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint(),
    accept_fix_at_end: bool = True,
) -> DataFrame:
    """Generate, check, and try again what failed, at most ``most`` times.

    ``attempt(pending, number)`` gets the items and their ``feedback`` and adds question_out, answer_out, errors,
    question_fixed, answer_fixed and fix_errors (arrays of faults of the candidate and of the checker's own correction).
    A valid candidate is done; so is a faultless correction. After the last attempt the candidate stays, or the fallback
    columns. Each round works on what is still pending and is kept, so that no later round repeats it.
    """
    pending, done = items.withColumn("feedback", F.lit("none")), []
    columns = [*items.columns, "question_out", "answer_out", "validation_status", "validation_feedback", "attempts"]
    for number in range(1, most + 1):
        tried = keep(attempt(pending, number))
        no_errors = F.size("errors") == 0
        fixed = (F.coalesce("question_fixed", F.lit("")) != "") & (F.coalesce("answer_fixed", F.lit("")) != "") & (F.size(F.coalesce("fix_errors", F.array(F.lit("none")))) == 0)
        said = compact_feedback(F.col("errors"))
        suggestion = F.concat(said, F.lit(" | Suggested fix: "), F.coalesce("question_fixed", F.lit("")), F.lit(" / "), F.coalesce("answer_fixed", F.lit("")))
        feedback = F.when((F.coalesce("question_fixed", F.lit("")) != "") | (F.coalesce("answer_fixed", F.lit("")) != ""), suggestion).otherwise(said)
        last = number == most
        status = F.when(no_errors, "valid").when(fixed, "validator_fixed" if not last or not accept_fix_at_end else "validator_fixed_after_regeneration_failed")
        status = status.otherwise("invalid_after_retries") if last else status
        judged = tried.withColumns({"validation_status": status, "validation_feedback": F.when(no_errors, "").otherwise(feedback), "attempts": F.lit(number)})
        use_fix = ~no_errors & fixed
        out = lambda c, fix, back: F.when(use_fix, F.col(fix)).when(F.col("validation_status") == "invalid_after_retries", F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(back))).otherwise(F.col(c))
        ready = judged.where("validation_status is not null")
        ready = ready.withColumns({"question_out": out("question_out", "question_fixed", fallback[0]), "answer_out": out("answer_out", "answer_fixed", fallback[1])})
        done.append(ready.select(*columns))
        if last:
            break
        pending = judged.where("validation_status is null").select(*items.columns, F.col("validation_feedback").alias("feedback"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole
