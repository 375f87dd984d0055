"""Scores and descriptors of predictions: answer, support and joint scores, language strata, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mhqa.schemas import LANGUAGES

SPECIAL = ("yes", "no", "noanswer")


def bag_overlap(a: Column, b: Column) -> Column:
    """The number of tokens that two arrays share, each counted as often as both have it."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))


def ratio(part: Column, whole: Column, *, if_empty: Column) -> Column:
    return F.when(whole > 0, part / whole).when(if_empty, F.lit(1.0)).otherwise(F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def component(exact: Column, p: Column, r: Column) -> Column:
    return F.struct(exact.cast("double").alias("em"), p.cast("double").alias("p"), r.cast("double").alias("r"), harmonic(p, r).cast("double").alias("f1"))


def answer_score(predicted: Column, gold: Column, predicted_tokens: Column, gold_tokens: Column) -> Column:
    """struct(em, p, r, f1) of normalised answers; a yes, no or noanswer that isn't matched exactly scores nothing."""
    n, m, k = F.size(predicted_tokens), F.size(gold_tokens), bag_overlap(predicted_tokens, gold_tokens)
    special = (predicted.isin(*SPECIAL) | gold.isin(*SPECIAL)) & (predicted != gold)
    zero = F.lit(0.0)
    return F.when(special, component(zero, zero, zero)).otherwise(component(predicted == gold, ratio(k, n, if_empty=m == 0), ratio(k, m, if_empty=n == 0)))


def support_score(predicted: Column, gold: Column) -> Column:
    """struct(em, p, r, f1) over sets of (paragraph, sentence) pairs."""
    a, b = F.array_distinct(predicted), F.array_distinct(gold)
    n, m, k = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    return component((n == m) & (k == n), ratio(k, n, if_empty=m == 0), ratio(k, m, if_empty=n == 0))


def joint_score(answer: Column, support: Column) -> Column:
    return component(answer["em"] * support["em"], answer["p"] * support["p"], answer["r"] * support["r"])


def mismatch(language: Column, languages: Column) -> Column:
    """The share of ``languages`` other than ``language``; null for none."""
    return F.size(F.filter(languages, lambda x: x != language)) / F.nullif(F.size(languages), F.lit(0))


def entropy(languages: Column) -> Column:
    """Entropy of the languages over its maximum for so many paragraphs; 0 for one paragraph or none."""
    n = F.size(languages)
    sum_ = F.aggregate(F.array_distinct(languages), F.lit(0.0), lambda h, x: h - (F.size(F.filter(languages, lambda y: y == x)) / n) * F.ln(F.size(F.filter(languages, lambda y: y == x)) / n))
    return F.when(n <= 1, F.lit(0.0)).otherwise(sum_ / F.ln(n))


def in_range(value: Column, name: str) -> Column:
    """``value`` if it lies within 0 and 1 (a rounding error beyond is allowed) or is null, else an error; NaN is one."""
    return F.when(value.isNull() | ((value >= -1e-9) & (value <= 1 + 1e-9) & ~F.isnan(value.cast("double"))), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} beyond 0 to 1: "), value.cast("string"))).cast("double"))


def mismatch_bin(value: Column) -> Column:
    value = in_range(value, "mismatch")
    return F.when(value.isNull(), "not-applicable").when(F.abs(value) <= 1e-12, "zero").when(F.abs(value - 1) <= 1e-9, "full").otherwise("partial")


def entropy_bin(value: Column) -> Column:
    value = in_range(value, "entropy")
    return F.when(F.abs(value) <= 1e-12, "zero").when(F.abs(value - 1) <= 1e-9, "maximal").otherwise("intermediate")


def count_bin(value: Column) -> Column:
    return F.when(value <= 1, "one").when(value <= 4, "two-to-four").when(value <= 8, "five-to-eight").otherwise("nine-or-more")


def condition(gold: Column, distractors: Column, gold_languages: Column) -> Column:
    """How the languages of question, evidence and distractors relate; six labels."""
    aligned = gold == 0
    return (
        F.when(aligned & distractors.isNull(), "gold-aligned-no-distractors")
        .when(aligned & (distractors == 0), "fully-monolingual")
        .when(aligned, "multilingual-distractors-only")
        .when(gold < 1, "partial-gold-mismatch")
        .when(gold_languages == 1, "full-mismatch-single-evidence-language")
        .otherwise("full-mismatch-multilingual-evidence")
    )


def script(language: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for code, _, s in LANGUAGES for x in (code, s)]), language)


def script_relation(question_script: Column, scripts: Column) -> Column:
    kinds = F.array_distinct(scripts)
    return F.when((F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == question_script), "same-script").when(F.array_contains(kinds, question_script), "mixed-script").otherwise("different-script")


def score_from_text(text: Column) -> Column:
    """The score that a judge's text states: after the word SCORE, else the last number of one to three digits; within 0 to 100, null if there is none."""
    stated = F.nullif(F.regexp_extract(text, r"(?i)SCORE\s*[:\-]?\s*(\d{1,3})", 1), F.lit(""))
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(\d{1,3})\b"), F.lit(1)), F.lit(-1))
    number = F.coalesce(stated, last).cast("int")
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), number)))  # greatest and least skip nulls


def explanation(text: Column) -> Column:
    """A judge's text without a final line that only states the score."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?i)(?:^|\n)\s*SCORE\s*[:\-]?\s*\d{1,3}\s*$", ""))


#: Where a stored score may come from.
ORIGINS = ("visible_explicit", "visible_integer_fallback", "reasoning_explicit", "reasoning_integer_fallback")


def score_origin(score: Column, visible: Column, reasoning: Column) -> Column:
    """One of ORIGINS, null where neither text states the stored score."""
    stated = r"(?i)SCORE\s*[:\-]?\s*\d{1,3}"
    of_visible, of_reasoning = score_from_text(F.coalesce(visible, F.lit(""))), score_from_text(F.coalesce(reasoning, F.lit("")))
    return F.when(of_visible == score, F.when(visible.rlike(stated), ORIGINS[0]).otherwise(ORIGINS[1])).when(
        of_visible.isNull() & (of_reasoning == score), F.when(reasoning.rlike(stated), ORIGINS[2]).otherwise(ORIGINS[3])
    )
