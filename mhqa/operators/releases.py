"""Release records: generated records against their sources, public records out of historical rows, judge rows without texts.

Names of the flags are those of released data; the prefix of a release's own flags is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mhqa.functions import hashing as H
from mhqa.functions import scoring as S
from mhqa.functions.text import is_blank, normalize_title
from mhqa.operators.judging import UNITS
from mhqa.operators.records import paragraph_index
from mhqa.runtime import materialise
from mhqa.schemas import CODES, LANGUAGES

C = F.col
_NAME = {code: name for code, name, _ in LANGUAGES}


def language_name(code: Column) -> Column:
    """The English name of a language code, Unknown for others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _NAME.items() for x in pair]), code), F.lit("Unknown"))


def language_code(name: Column) -> Column:
    """The code of an English language name, und for others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for code, n in _NAME.items() for x in (n, code)]), name), F.lit("und"))


def _if(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))


def _known(code: Column) -> Column:
    return F.coalesce(code.isin(*CODES), F.lit(False))


def _list(column: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(column, F.array().cast(kind))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _paragraph_id(index: Column) -> Column:
    return F.format_string("p%02d", index.cast("int"))


def _hashed(record: DataFrame, name: str, value: Column) -> DataFrame:
    """``record``, written once, with ``value`` as ``name``: the hash of a whole record depends on other functions in Python, and one on the result of another can't always be evaluated in one projection."""
    return materialise(record).withColumn(name, value)


def status_of(structural: Column, quality: Column) -> Column:
    """quarantined with any structural flag, review_required with any flag of quality, else accepted."""
    return F.when(F.size(structural) > 0, "quarantined").when(F.size(quality) > 0, "review_required").otherwise("accepted")


def status_views(records: DataFrame) -> dict[str, DataFrame]:
    """The complete table, its records that aren't quarantined, and those accepted."""
    return {"complete": records, "usable": records.where("status != 'quarantined'"), "accepted": records.where("status = 'accepted'")}


# -- generated records -------------------------------------------------------------------------------------------------
_FIELDS = ("id", "source_id", "source_split", "question", "answer", "question_language", "answer_language", "candidates", "supporting_facts", "question_type", "difficulty", "provenance", "checksum")


def with_source(instances: DataFrame, sources: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """``instances`` with their source as the struct ``s``, null where there is none. ``keys``: the source's id, and its split where ids repeat across splits."""
    whole = F.struct(*[C(c) for c in ("source_id", "question", "answer", "question_type", "difficulty", "pos", "context", "supporting_facts")])
    return instances.select(*_FIELDS).join(sources.select(*keys, whole.alias("s")), list(keys), "left")


def _candidate_flags(own: str):  # noqa: ANN202
    def flags(c: Column, i: Column) -> Column:
        index = paragraph_index(c["id"])
        expected = F.get(_list(C("s.context"), "array<struct<paragraph_id: string, title: string, sentences: array<string>>>"), index)
        original, sentences = _list(expected["sentences"]), _list(c["sentences"])
        copied = F.exists(F.arrays_zip(sentences.alias("t"), original.alias("s")), lambda z: ~is_blank(z["s"]) & (z["t"] == z["s"]))
        return F.when(c.isNull(), F.array(F.lit(f"{own}malformed_candidate"))).otherwise(
            F.array(
                _if(expected.isNull(), f"{own}invalid_paragraph_id"),
                _if(~F.coalesce(index == i, F.lit(False)), f"{own}candidate_order_mismatch"),
                _if(_text(c["source_title"]) != _text(expected["title"]), f"{own}source_title_mismatch"),
                _if(_list(c["source_sentences"]) != original, f"{own}source_sentences_mismatch"),
                _if(F.exists(original, is_blank), "source:blank_source_sentence"),
                _if(c["sentences"].isNull(), f"{own}translation_sentences_not_list"),
                _if(F.size(sentences) != F.size(original), f"{own}sentence_count_mismatch"),
                _if(F.exists(sentences, is_blank), f"{own}blank_translation_sentence"),
                _if(~_known(c["language"]), f"{own}unknown_candidate_language"),
                _if(is_blank(c["title"]), f"{own}blank_translated_title"),
                _if((c["language"] != "en") & copied, f"quality|{own}paragraph_sentence_source_copy"),
            )
        )

    return flags


def _expected_support() -> tuple[Column, Column]:
    """(the source's facts whose title is unique, as (paragraph, sentence); whether all are)."""
    titles = F.transform(_list(C("s.context"), "array<struct<paragraph_id: string, title: string, sentences: array<string>>>"), lambda p: p["title"])
    facts = _list(C("s.supporting_facts"), "array<struct<title: string, sentence_id: int>>")
    unique = F.filter(facts, lambda f: F.size(F.filter(titles, lambda t: t == f["title"])) == 1)
    found = F.transform(unique, lambda f: F.struct(_paragraph_id(F.array_position(titles, f["title"]) - 1).alias("p"), f["sentence_id"].alias("s")))
    return found, F.size(unique) == F.size(facts)


def _length_of(fact: Column) -> Column:
    """The number of sentences of the source's paragraph that a fact names, null if there is none."""
    return F.size(F.get(_list(C("s.context"), "array<struct<paragraph_id: string, title: string, sentences: array<string>>>"), paragraph_index(fact["paragraph_id"]))["sentences"])


def generated_flags(joined: DataFrame, own: str, *, split: str | None = None) -> DataFrame:
    """``joined`` (of ``with_source``) with ``structural_flags`` and ``quality_flags``, sorted, and ``checksum_valid``.

    ``own`` is the prefix of the release's flags, as "set:". With ``split`` records of another split are flagged. A record without source has the only flag source:missing.
    """
    candidates, facts = _list(C("candidates"), joined.schema["candidates"].dataType.simpleString()), _list(C("supporting_facts"), joined.schema["supporting_facts"].dataType.simpleString())
    good = F.filter(facts, lambda f: f.isNotNull())
    expected, unique = _expected_support()
    observed = F.transform(good, lambda f: F.struct(_text(f["paragraph_id"]).alias("p"), F.coalesce(f["sentence_id"], F.lit(-1)).alias("s")))
    valid = (_text(C("checksum")) != "") & (H.checksum(F.struct(*_FIELDS)) == C("checksum"))
    out_of_range = F.exists(good, lambda f: _length_of(f).isNotNull() & ~F.coalesce(f["sentence_id"], F.lit(-1)).between(0, _length_of(f) - 1))
    flags = F.array(
        _if(F.lit(False) if split is None else ~C("source_split").eqNullSafe(split), f"{own}source_split_mismatch"),
        _if(~C("source_id").eqNullSafe(C("s.source_id")), f"{own}source_id_mismatch"),
        _if(~C("checksum_valid"), f"{own}input_checksum_mismatch"),
        _if(is_blank(C("question")), f"{own}blank_question"),
        _if(is_blank(C("answer")), f"{own}blank_answer"),
        _if(~_known(C("question_language")), f"{own}unknown_question_language"),
        _if(~_known(C("answer_language")), f"{own}unknown_answer_language"),
        _if(_text(C("question_language")) != _text(C("answer_language")), f"{own}question_answer_language_mismatch"),
        _if(C("candidates").isNull(), f"{own}candidates_not_list"),
        _if(F.size(candidates) != F.size(F.coalesce(C("s.context"), F.array())), f"{own}candidate_count_mismatch"),
        _if(~unique, "source:supporting_title_not_unique"),
        _if(C("supporting_facts").isNull(), f"{own}supporting_facts_not_list"),
        _if(F.exists(facts, lambda f: f.isNull()), f"{own}malformed_supporting_fact"),
        _if(F.exists(good, lambda f: f["sentence_id"].isNull()), f"{own}invalid_support_sentence_id"),
        _if(F.exists(good, lambda f: _length_of(f).isNull()), f"{own}invalid_support_paragraph_id"),
        _if(out_of_range, "source:support_index_out_of_range"),
        _if(observed != expected, f"{own}support_annotation_mismatch"),
        _if(F.coalesce(C("question_type"), F.lit("unknown")) != F.coalesce(C("s.question_type"), F.lit("unknown")), f"{own}question_type_mismatch"),
        _if(F.coalesce(C("difficulty"), F.lit("unknown")) != F.coalesce(C("s.difficulty"), F.lit("unknown")), f"{own}difficulty_mismatch"),
        _if(C("provenance").isNull(), f"{own}missing_provenance"),
        _if((_text(C("question_language")) != "en") & (C("question") == C("s.question")), f"quality|{own}question_source_copy"),
        _if((_text(C("answer_language")) != "en") & (C("answer") == C("s.answer")), f"quality|{own}answer_source_copy"),
        _if(_text(C("provenance.assignment_manifest_sha256")) == "", "quality|provenance:assignment_manifest_hash_missing"),
    )
    every = F.array_sort(F.array_distinct(F.array_compact(F.concat(flags, F.flatten(F.transform(candidates, _candidate_flags(own)))))))
    found = joined.withColumn("checksum_valid", F.coalesce(valid, F.lit(False))).withColumn("__f", F.when(C("s").isNull(), F.array(F.lit("source:missing"))).otherwise(every))
    quality = F.transform(F.filter("__f", lambda x: x.startswith("quality|")), lambda x: F.substring(x, 9, 200))
    return found.withColumns({"structural_flags": F.filter("__f", lambda x: ~x.startswith("quality|")), "quality_flags": quality}).drop("__f")


def flag_counts(flagged: DataFrame) -> DataFrame:
    """(flag, records) over structural and quality flags."""
    return flagged.select(F.explode(F.concat("structural_flags", "quality_flags")).alias("flag")).groupBy("flag").agg(F.count("*").alias("records"))


def generated_release(joined: DataFrame, own: str, *, split: str | None = None) -> DataFrame:
    """The 35 fields of a released generated record: its texts beside the source's, flags, status and three hashes."""
    flagged = generated_flags(joined, own, split=split)

    def candidate(c: Column, i: Column) -> Column:
        index = paragraph_index(c["id"])
        expected = F.get(C("s.context"), index)
        title, sentences = _text(expected["title"]), _list(expected["sentences"])
        return F.struct(
            F.when(_text(c["id"]) != "", c["id"]).otherwise(F.concat(F.lit("invalid-"), i.cast("string"))).alias("paragraph_id"), i.cast("smallint").alias("candidate_index"), title.alias("source_title"), sentences.alias("source_sentences"),
            _text(c["title"]).alias("title"), _list(c["sentences"]).alias("sentences"), _text(c["language"]).alias("language"), language_name(c["language"]).alias("language_name"),
            ((_text(c["source_title"]) == title) & (_list(c["source_sentences"]) == sentences)).alias("source_match"),
        )

    def fact(f: Column) -> Column:
        sentence = F.coalesce(f["sentence_id"], F.lit(-1))
        return F.struct(
            _text(f["paragraph_id"]).alias("paragraph_id"), sentence.alias("sentence_id"), _text(F.get(C("s.context"), paragraph_index(f["paragraph_id"]))["title"]).alias("source_title"),
            F.coalesce(sentence.between(0, _length_of(f) - 1), F.lit(False)).alias("in_bounds"),
        )

    # The position in a candidate's list counts malformed entries, which are left out.
    kept = F.filter(F.transform("candidates", lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].isNotNull())
    p = lambda name: _text(C(f"provenance.{name}"))
    source = F.struct(*[C(f"s.{n}").alias(n) for n in ("source_id", "question", "answer", "question_type", "difficulty", "context", "supporting_facts")])
    record = flagged.select(
        _text(C("id")).alias("id"), "source_id", "source_split", C("s.pos").cast("int").alias("source_position"), _text(C("question")).alias("question"), _text(C("answer")).alias("answer"),
        _text(C("question_language")).alias("question_language"), language_name(C("question_language")).alias("question_language_name"), _text(C("answer_language")).alias("answer_language"),
        language_name(C("answer_language")).alias("answer_language_name"), C("s.question").alias("source_question"), C("s.answer").alias("source_answer"), C("s.question_type").alias("question_type"), C("s.difficulty").alias("difficulty"),
        F.transform(kept, lambda x: candidate(x["c"], x["i"])).alias("candidates"), F.transform(F.filter("supporting_facts", lambda f: f.isNotNull()), fact).alias("supporting_facts"),
        status_of(C("structural_flags"), C("quality_flags")).alias("status"), "structural_flags", "quality_flags", F.sha2(H.canonical_json(source), 256).alias("source_record_sha256"),
        _text(C("checksum")).alias("input_record_checksum_sha256"), C("checksum_valid").alias("input_checksum_valid"), F.lit("").alias("release_record_sha256"), p("translation_model").alias("translation_model"),
        p("translation_revision").alias("translation_revision"), p("prompt_version").alias("prompt_version"), p("prompt_hash").alias("prompt_sha256"), p("assignment_version").alias("assignment_version"),
        p("assignment_manifest_sha256").alias("assignment_manifest_sha256"), F.coalesce(C("provenance.seed"), F.lit(0)).cast("long").alias("generation_seed"),
        F.when(p("decoding") == "", "{}").otherwise(p("decoding")).alias("decoding_json"), p("created_at").alias("created_at"), F.coalesce(C("provenance.retry_count"), F.lit(0)).alias("recorded_retry_count_unreliable"),
        p("validation_status").alias("recorded_validation_status"), p("schema_version").alias("input_schema_version"),
    )
    return _hashed(record, "release_record_sha256", H.record_hash(F.struct(*record.columns), "release_record_sha256", emptied=True))


# -- historical rows -----------------------------------------------------------------------------------------------------
#: Flags that keep a historical row out; the only other one asks for a review.
BLOCKING = (
    "blank_answer", "blank_question", "candidate_count_mismatch", "english_identity_mismatch", "invalid_candidate", "invalid_context", "invalid_source_candidate", "invalid_source_context",
    "malformed_supporting_fact", "paragraph_sentence_shortfall", "paragraph_sentence_surplus", "blank_sentence", "supporting_title_missing", "supporting_title_ambiguous", "support_index_out_of_range",
    "unknown_candidate_language", "unknown_question_language",
)
REVIEW = "duplicate_normalized_translated_title"
CELL = "array<struct<title: string, sentences: array<string>, language: string>>"


def typed_cells(context: Column) -> Column:
    """Candidates out of a VARIANT context: null if it isn't a list, null entries where a candidate isn't [title, [sentence …], language]."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))

    def cell(v: Column) -> Column:
        parts = F.try_variant_get(v, "$", "array<variant>")
        lines = F.try_variant_get(F.get(parts, F.lit(1)), "$", "array<variant>")
        shaped = kind(v).startswith("ARRAY") & (F.size(parts) == 3) & (kind(F.get(parts, F.lit(0))) == "STRING") & kind(F.get(parts, F.lit(1))).startswith("ARRAY") & (kind(F.get(parts, F.lit(2))) == "STRING")
        textual = F.forall(F.coalesce(lines, F.array().cast("array<variant>")), lambda x: kind(x) == "STRING")
        return F.when(
            shaped & textual,
            F.struct(F.try_variant_get(v, "$[0]", "string").alias("title"), F.try_variant_get(v, "$[1]", "array<string>").alias("sentences"), F.try_variant_get(v, "$[2]", "string").alias("language")),
        )

    return F.when(kind(context).startswith("ARRAY"), F.transform(F.try_variant_get(context, "$", "array<variant>"), cell))


def public_flags(rows: DataFrame) -> DataFrame:
    """``rows`` with sorted ``structural_flags`` and ``status``.

    ``rows`` has question, answer, language (a name), cells (see CELL; null entries are malformed ones) and the struct source (question, answer, context, supporting_facts).
    """
    cells, context = F.coalesce(C("cells"), F.array().cast(CELL)), _list(C("source.context"), "array<struct<title: string, sentences: array<string>>>")
    known = lambda n: F.coalesce(n.isin(*_NAME.values()), F.lit(False))
    titles = F.transform(context, lambda p: p["title"])
    facts = _list(C("source.supporting_facts"), "array<struct<title: string, sentence_id: int>>")
    whole = F.filter(facts, lambda f: f.isNotNull() & f["title"].isNotNull() & F.coalesce(f["sentence_id"] >= 0, F.lit(False)))
    matches = lambda f: F.size(F.filter(titles, lambda t: t == f["title"]))
    lengths = F.transform(cells, lambda c: F.size(c["sentences"]))
    in_bounds = lambda f: F.coalesce((matches(f) == 1) & (f["sentence_id"] < F.get(lengths, (F.array_position(titles, f["title"]) - 1).cast("int"))), F.lit(False))

    def of_cell(c: Column, i: Column) -> Column:
        source = F.get(context, i)
        there, sound = i < F.size(context), source.isNotNull() & source["title"].isNotNull() & source["sentences"].isNotNull()
        return F.when(c.isNull(), F.array(F.lit("invalid_candidate"))).otherwise(
            F.array(
                _if(~known(c["language"]), "unknown_candidate_language"),
                _if(F.exists(c["sentences"], is_blank), "blank_sentence"),
                _if(there & ~sound, "invalid_source_candidate"),
                _if(there & sound & (F.size(c["sentences"]) < F.size(source["sentences"])), "paragraph_sentence_shortfall"),
                _if(there & sound & (F.size(c["sentences"]) > F.size(source["sentences"])), "paragraph_sentence_surplus"),
                _if(there & sound & (c["language"] == "English") & ((c["title"] != source["title"]) | (c["sentences"] != source["sentences"])), "english_identity_mismatch"),
            )
        )

    own = F.array(
        _if(is_blank(C("question")), "blank_question"),
        _if(is_blank(C("answer")), "blank_answer"),
        _if(~known(C("language")), "unknown_question_language"),
        _if((C("language") == "English") & ~(C("question").eqNullSafe(C("source.question")) & C("answer").eqNullSafe(C("source.answer"))), "english_identity_mismatch"),
        _if(C("source.context").isNull(), "invalid_source_context"),
        _if(C("cells").isNull(), "invalid_context"),
        _if(F.size(cells) != F.size(context), "candidate_count_mismatch"),
        _if(F.size(F.array_distinct("__titles")) < F.size("__titles"), REVIEW),
        _if(F.size(whole) < F.size(facts), "malformed_supporting_fact"),
        _if(F.exists(whole, lambda f: matches(f) == 0), "supporting_title_missing"),
        _if(F.exists(whole, lambda f: matches(f) > 1), "supporting_title_ambiguous"),
        _if(F.exists(whole, lambda f: ~in_bounds(f)), "support_index_out_of_range"),
    )
    flags = F.array_sort(F.array_distinct(F.array_compact(F.concat(own, F.flatten(F.transform(cells, of_cell))))))
    # Titles are normalised in one string, since the built-in functions lack full case folding and a function in Python can't run within an array.
    joined = F.array_join(F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: F.translate(c["title"], "\x1f", " ")), "\x1f")
    titles_of = F.split(normalize_title(joined, F.lit("\x1f")), "\x1f")
    flagged = rows.withColumn("__titles", F.when(F.exists(cells, lambda c: c.isNotNull()), titles_of).otherwise(F.array().cast("array<string>"))).withColumn("structural_flags", flags).drop("__titles")
    blocked = F.arrays_overlap("structural_flags", F.array(*map(F.lit, BLOCKING)))
    return flagged.withColumn("status", F.when(blocked, "quarantined").when(F.array_contains("structural_flags", REVIEW), "review_required").otherwise("accepted"))


def public_release(rows: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """The 22 fields of a public record out of a historical row (see ``public_flags``), which also has source_id, source_split, source_position, release_position, view_index, shard, shard_row and raw_sha256.

    ``provenance`` holds the constants of the release: source_dataset, source_file, translation_model, prompt_version, assignment_version, release_selection and build_version.
    """
    flagged = public_flags(rows)
    context = _list(C("source.context"), "array<struct<title: string, sentences: array<string>>>")
    titles, lengths = F.transform(context, lambda p: p["title"]), F.transform(F.coalesce(C("cells"), F.array().cast(CELL)), lambda c: F.size(c["sentences"]))

    def candidate(c: Column, i: Column) -> Column:
        source = F.get(context, i)
        return F.struct(
            _paragraph_id(i).alias("paragraph_id"), i.cast("smallint").alias("candidate_index"), _text(source["title"]).alias("source_title"), _list(source["sentences"]).alias("source_sentences"),
            c["title"].alias("title"), c["sentences"].alias("sentences"), c["language"].alias("language"), language_code(c["language"]).alias("language_code"),
        )

    def fact(f: Column) -> Column:
        one = F.size(F.filter(titles, lambda t: t == f["title"])) == 1
        index = F.when(one, (F.array_position(titles, f["title"]) - 1).cast("int"))
        return F.struct(
            f["title"].alias("source_title"), F.when(one, _paragraph_id(index)).alias("paragraph_id"), index.cast("smallint").alias("candidate_index"), f["sentence_id"].alias("sentence_index"),
            F.coalesce(f["sentence_id"] < F.get(lengths, index), F.lit(False)).alias("in_bounds"),
        )

    kept = F.filter(F.transform("cells", lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].isNotNull())
    facts = F.filter("source.supporting_facts", lambda f: f["title"].isNotNull() & (f["sentence_id"] >= 0))
    name, code = F.coalesce(C("language"), F.lit("Unknown")), language_code(C("language"))
    kind = lambda n: F.coalesce(C(f"source.{n}"), F.lit("unknown"))
    of_release = [F.lit(provenance[n]).alias(n) for n in ("source_dataset", "source_file")], [F.lit(provenance[n]).alias(n) for n in ("translation_model", "prompt_version", "assignment_version", "release_selection", "build_version")]
    origin = [F.sha2(H.canonical_json(C("source")), 256).alias("source_record_sha256"), C("shard").alias("legacy_shard"), C("shard_row").cast("int").alias("legacy_shard_row"), C("raw_sha256").alias("legacy_raw_sha256")]
    record = flagged.select(
        C("source_id").alias("id"), "source_id", "source_split", C("source_position").cast("int").alias("source_position"), C("release_position").cast("int").alias("release_position"),
        C("view_index").cast("smallint").alias("legacy_view_index"), _text(C("question")).alias("question"), _text(C("answer")).alias("answer"), code.alias("question_language"), name.alias("question_language_name"),
        code.alias("answer_language"), name.alias("answer_language_name"), _text(C("source.question")).alias("source_question"), _text(C("source.answer")).alias("source_answer"), kind("question_type").alias("question_type"),
        kind("difficulty").alias("difficulty"), F.transform(kept, lambda x: candidate(x["c"], x["i"])).alias("candidates"), F.transform(facts, fact).alias("supporting_facts"), "status", "structural_flags",
        F.struct(*of_release[0], *origin, *of_release[1]).alias("provenance"),
    )
    return _hashed(record, "record_sha256", H.record_hash(F.struct(*record.columns, F.lit("").alias("record_sha256")), "record_sha256"))


# -- judge rows -----------------------------------------------------------------------------------------------------------
def reject_reason(targets: Sequence[str]) -> Column:
    """Why a judge row can't be released, null if it can: the first of failed, unit, language, empty_text, paragraph_id, score, score_origin."""
    return (
        F.when(_text(C("error")) != "", "failed")
        .when(~F.coalesce(C("unit").isin(*UNITS), F.lit(False)), "unit")
        .when(~F.coalesce(C("language").isin(*targets), F.lit(False)), "language")
        .when((_text(C("source_text")) == "") | (_text(C("candidate_text")) == ""), "empty_text")
        .when((C("unit") == "paragraph") & (_text(C("paragraph_id")) == ""), "paragraph_id")
        .when(~F.coalesce(C("score").between(0, 100), F.lit(False)), "score")
        .when(S.score_origin(C("score"), C("judge_text"), C("reasoning")).isNull(), "score_origin")
    )


def judge_release(rows: DataFrame, *, targets: Sequence[str], constants: dict[str, str | int | None], prompts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(the 26 fields of released judge rows, without texts and reasoning; the rejected rows with ``reason``).

    ``rows`` has raw_line_number beside the columns of judge results; ``constants`` dataset_version, dataset_revision, dataset_revision_status, requested_judge_model, model_identity_status,
    judge_prompt_version, sampling_seed, run_group and raw_artifact_sha256; ``prompts`` the prompt hash by unit.
    """
    checked = rows.withColumn("reason", reject_reason(targets))
    paragraph = F.when(C("unit") == "paragraph", C("paragraph_id"))
    version = F.lit(constants["dataset_version"])
    identity = F.struct(version.alias("dataset_version"), _text(C("instance_id")).alias("instance_id"), C("unit").alias("unit"), paragraph.alias("paragraph_id"))
    told = S.explanation(_text(C("judge_text")))
    fixed = lambda n, kind="string": F.lit(constants.get(n)).cast(kind).alias(n)
    hashes = F.element_at(F.create_map(*[F.lit(x) for pair in prompts.items() for x in pair]), C("unit"))
    good = checked.where("reason is null").select(
        F.sha2(H.canonical_json(identity), 256).alias("judge_record_id"), fixed("dataset_version"), fixed("dataset_revision"), fixed("dataset_revision_status"), "instance_id", "source_id", "source_split",
        C("language").alias("target_language"), language_name(C("language")).alias("target_language_name"), "unit", paragraph.alias("paragraph_id"), C("score").cast("smallint").alias("score"),
        S.score_origin(C("score"), C("judge_text"), C("reasoning")).alias("score_origin"), told.alias("judge_explanation"), (told != "").alias("judge_explanation_available"),
        F.sha2("source_text", 256).alias("source_text_sha256"), F.sha2("candidate_text", 256).alias("candidate_text_sha256"), fixed("requested_judge_model"), fixed("resolved_judge_revision"), fixed("model_identity_status"),
        fixed("judge_prompt_version"), hashes.alias("judge_prompt_sha256"), fixed("sampling_seed", "long"), fixed("run_group"), fixed("raw_artifact_sha256"), C("raw_line_number").cast("int").alias("raw_line_number"),
    )
    return good, checked.where("reason is not null")


def comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """(unit, first_mean, second_mean): the mean scores of two independent, balanced samples, by unit and (unit null) over all. No pairing is meant."""
    sides = [t.where("score is not null").groupingSets([[], ["unit"]], "unit").agg(F.avg("score").alias(n)) for t, n in ((first, "first_mean"), (second, "second_mean"))]
    a, b = sides[0], sides[1].withColumnRenamed("unit", "u")
    return a.join(b, C("unit").eqNullSafe(C("u")), "full").select(F.coalesce("unit", "u").alias("unit"), "first_mean", "second_mean")
