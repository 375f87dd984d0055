"""Building records: expansion to all languages, audits against the sources, legacy import, release records, missing manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mhqa.functions.hashing import checksum
from mhqa.functions.text import is_blank, normalize_title
from mhqa.operators.keys import exact_join, require_empty
from mhqa.operators.validation import RECORD, checksums
from mhqa.schemas import CODES, LANGUAGES, languages

C = F.col


def view_id(identifier: Column, language: Column) -> Column:
    return F.concat(identifier, F.lit("--qa-"), language)


def expand(bases: DataFrame, translations: DataFrame, *, verify: bool = False) -> DataFrame:
    """One view of each base for each language: (every column of the base, with id, question, answer, languages and, of whole records, checksum of the view).

    With ``verify`` a base whose checksum isn't that of its content is a ContractError.
    ``translations`` has (source_id, language, question, answer) and must hold all 24 languages of each base, and of no other source.
    """
    if verify:
        require_empty(checksums(bases).where("not valid"), "base records with a wrong checksum", "id")
    incomplete = translations.groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("language").alias("d"), F.count_if(~C("language").isin(*CODES) | is_blank(C("question")) | is_blank(C("answer"))).alias("bad"))
    require_empty(incomplete.where((C("n") != len(CODES)) | (C("d") != len(CODES)) | (C("bad") > 0)), "translation sets aren't complete", "source_id", "n", "d", "bad")
    require_empty(bases.groupBy("source_id").count().where("count > 1"), "base sources repeat", "source_id")
    texts = translations.select("source_id", C("language").alias("__l"), C("question").alias("__q"), C("answer").alias("__a"))
    joined = exact_join(bases, texts, ["source_id"])
    views = joined.withColumns({"id": view_id(C("id"), C("__l")), "question": C("__q"), "answer": C("__a"), "question_language": C("__l"), "answer_language": C("__l")}).drop("__l", "__q", "__a")
    return views.withColumn("checksum", checksum(F.struct(*RECORD))) if set(RECORD) <= set(views.columns) else views


def view_ids(sources: DataFrame) -> DataFrame:
    """(source_id, ord, language, id): the ids of all views of each source, in the order of the inventory. The 24 languages are broadcast."""
    return sources.select("source_id").crossJoin(F.broadcast(languages(sources.sparkSession).select("ord", C("code").alias("language")))).withColumn("id", view_id(F.concat(F.lit("xhp-train-"), "source_id"), C("language")))


FIXED = ("source_id", "source_split", "candidates", "supporting_facts", "question_type", "difficulty")


def relation_errors(bases: DataFrame, views: DataFrame) -> DataFrame:
    """(source_id, language, problem): views that are missing, unexpected, or differ from their base in a field that must not change."""
    wanted = bases.crossJoin(F.broadcast(languages(bases.sparkSession).select(C("code").alias("language")))).select(view_id(C("id"), C("language")).alias("id"), "language", *[C(f).alias(f"b_{f}") for f in FIXED])
    joined = wanted.join(views.select("id", F.lit(True).alias("there"), *FIXED), "id", "full")
    changed = F.array_compact(F.array(*[F.when(~C(f"b_{f}").eqNullSafe(C(f)), f"changed {f}") for f in FIXED]))
    problem = F.when(C("there").isNull(), F.array(F.lit("missing"))).when(C("language").isNull(), F.array(F.lit("unexpected"))).otherwise(changed)
    return joined.select("id", "language", F.explode(problem).alias("problem"))


def missing_reason(message: Column) -> Column:
    """Why a source has no record, by the message of the ledger."""
    low = F.lower(message)
    return (
        F.when(message.isNull(), "absent_without_final_error_record")
        .when(low.contains("empty sentence"), "inherited_source_empty_sentence")
        .when(low.contains("outside") & low.contains("supporting sentence"), "inherited_source_support_index_out_of_range")
        .otherwise("logged_generation_error")
    )


def missing_manifest(sources: DataFrame, records: DataFrame, ledger: DataFrame) -> DataFrame:
    """(source_id, reason) of each source without record; ``ledger`` has (source_id, error, message), one row a source."""
    messages = ledger.select("source_id", F.coalesce("error", "message").alias("__m"))
    return sources.select("source_id").join(records.select("source_id"), "source_id", "left_anti").join(messages, "source_id", "left").select("source_id", missing_reason(C("__m")).alias("reason"))


def paragraph_index(identifier: Column) -> Column:
    """7 of 'p07'; null for other forms."""
    return F.nullif(F.regexp_extract(identifier, r"^p(\d{2})$", 1), F.lit("")).cast("int")


NAMES = {name: code for code, name, _ in LANGUAGES}


def legacy_language(cell: Column) -> Column:
    """The code of the language that a legacy cell (VARIANT) names, null if it names none."""
    return F.element_at(F.create_map(*[F.lit(x) for n, c in NAMES.items() for x in (n, c)]), F.try_variant_get(cell, "$", "string"))


def legacy_issues(rows: DataFrame) -> DataFrame:
    """``rows`` with ``issues``: sorted codes of what keeps a legacy row from becoming a record.

    ``rows`` has the raw cells as VARIANT (context, question, answer, target_language) and the source's ``source_context``
    (array<struct<title, sentences>>) and ``source_facts`` (array<struct<paragraph_id, sentence_id>>).
    """
    kind = lambda v: F.schema_of_variant(v)
    is_list = F.coalesce(kind(C("context")).startswith("ARRAY"), F.lit(False))
    cells = F.when(is_list, F.try_variant_get(C("context"), "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))
    text = lambda v: F.try_variant_get(v, "$", "string")
    is_text = lambda v: F.coalesce(kind(v) == "STRING", F.lit(False))
    name = F.create_map(*[F.lit(x) for n, c in NAMES.items() for x in (n, c)])
    when = lambda condition, code: F.when(condition, code)

    def of_cell(v: Column, i: Column) -> Column:
        part = F.try_variant_get(v, "$", "array<variant>")
        shaped = F.coalesce(kind(v).startswith("ARRAY"), F.lit(False)) & F.coalesce(F.size(part) == 3, F.lit(False))
        title, lines, language = (F.get(part, F.lit(k)) for k in range(3))
        listed = F.try_variant_get(lines, "$", "array<variant>")
        textual = F.coalesce(kind(lines).startswith("ARRAY"), F.lit(False)) & F.forall(F.coalesce(listed, F.array().cast("array<variant>")), is_text)
        sentences = F.transform(listed, text)
        return F.when(~shaped, F.array(F.lit("invalid_candidate_shape"))).otherwise(
            F.array_compact(
                F.array(
                    when(~is_text(title), "invalid_title_type"), when(is_text(title) & is_blank(text(title)), "empty_translated_title"), when(~textual, "invalid_sentences_type"), when(textual & (F.size(sentences) == 0), "empty_paragraph"),
                    when(textual & F.exists(sentences, is_blank), "empty_sentence"), when(textual & (F.size(sentences) != F.size(F.get(C("source_context"), i)["sentences"])), "sentence_cardinality_mismatch"),
                    when(~is_text(language), "invalid_language_type"), when(is_text(language) & F.element_at(name, text(language)).isNull(), "unsupported_language"),
                )
            )
        )

    lengths = F.transform(cells, lambda v: F.size(F.try_variant_get(v, "$[1]", "array<variant>")))
    counted = F.size(cells) == F.size("source_context")
    out_of_bounds = F.exists("source_facts", lambda f: F.coalesce(f["sentence_id"] >= F.get(lengths, paragraph_index(f["paragraph_id"])), F.lit(False)))
    language = F.array_compact(F.array(when(~is_text(C("target_language")), "invalid_language_type"), when(is_text(C("target_language")) & F.element_at(name, text(C("target_language"))).isNull(), "unsupported_language")))
    rest = F.array_compact(
        F.array(
            when(~is_text(C("question")), "invalid_question_type"), when(is_text(C("question")) & is_blank(text(C("question"))), "empty_question"), when(~is_text(C("answer")), "invalid_answer_type"),
            when(is_text(C("answer")) & is_blank(text(C("answer"))), "empty_answer"), when(out_of_bounds, "supporting_fact_out_of_bounds"),
        )
    )
    shape = F.when(~is_list, F.array(F.lit("invalid_context_type"))).when(~counted, F.array(F.lit("candidate_count_mismatch"))).otherwise(F.concat(F.flatten(F.transform(cells, of_cell)), rest))
    return rows.withColumn("issues", F.array_sort(F.array_distinct(F.concat(language, shape))))


def route(audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows by whether they have issues; nothing is dropped."""
    return audited.where(F.size("issues") == 0), audited.where(F.size("issues") > 0)


def duplicate_titles(instances: DataFrame) -> DataFrame:
    """(id): records of which two candidates have the same title but for case, spaces and character form."""
    titles = instances.select("id", F.explode("candidates").alias("c")).select("id", normalize_title(C("c.title")).alias("t")).where("t is not null")
    return titles.groupBy("id", "t").count().where("count > 1").select("id").distinct()


def assignment_units(assignments: DataFrame) -> DataFrame:
    """(source_id, unit_id, language, ord) of a manifest's map<source, map<unit, language>>, questions first, paragraphs by number; ContractError for gaps or unknown languages."""
    rows = assignments.select(F.explode("assignments").alias("source_id", "u")).select("source_id", F.explode("u").alias("unit_id", "language"))
    ordered = rows.withColumn("ord", F.when(C("unit_id") == "question-answer", -1).otherwise(F.nullif(F.regexp_extract("unit_id", r"^paragraph:(\d+)$", 1), F.lit("")).cast("int")))
    require_empty(ordered.where(C("ord").isNull() | ~C("language").isin(*CODES)), "malformed units", "source_id", "unit_id", "language")
    gaps = ordered.groupBy("source_id").agg(F.count("*").alias("n"), F.max("ord").alias("last"), F.countDistinct("ord").alias("d"), F.min("ord").alias("first"))
    require_empty(gaps.where("first != -1 or d != n or last != n - 2"), "units aren't contiguous", "source_id")
    return ordered

