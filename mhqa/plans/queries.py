"""Queries of the dataset operators over a directory of Parquet tables, and the same in SQL where it can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mhqa.functions import hashing as H
from mhqa.functions import scoring as S
from mhqa.functions import text as X
from mhqa.operators import evaluation, judging, keys, records, releases, validation
from mhqa.runtime import table
from mhqa.schemas import CODES, DIFFICULTIES, LANGUAGES, QUESTION_TYPES, ROLES, SPLITS

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _list(values) -> str:  # noqa: ANN001
    return ", ".join(f"'{v}'" for v in values)


_CODES = f"[{_list(CODES)}]"
_SCRIPTS = "MAP {" + ", ".join(f"'{c}': '{s}'" for c, _, s in LANGUAGES) + "}"


_BLANK = r"(coalesce({0}, '') = '' OR regexp_full_match({0}, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]*'))"
_blank = _BLANK.format


# -- assignment, hashes, keys --------------------------------------------------------------------------------------------
@query(f"SELECT source_id, {_CODES}[CAST(('0x' || substr(sha256('42' || chr(31) || source_id || chr(31) || 'question-answer'), 1, 16))::UBIGINT % 24 AS INTEGER) + 1] AS language FROM hotpot_sources")
def assign_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hotpot_sources").select("source_id", H.assign_language(C("source_id"), F.lit("question-answer"), 42).alias("language"))


@query("SELECT source_id, CAST(('0x' || substr(sha256('public-views|' || source_id), 1, 16))::UBIGINT % 24 AS INTEGER) AS view_index FROM hotpot_sources")
def train_view_select(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hotpot_sources").select("source_id", H.train_view(C("source_id"), "public-views|").alias("view_index"))


@query("SELECT source_id, sha256(to_json({'answer': answer, 'difficulty': difficulty, 'question': question, 'question_type': question_type, 'source_id': source_id})) AS checksum FROM hotpot_sources")
def canonical_checksum(spark: SparkSession, d: str) -> DataFrame:
    record = F.struct("source_id", "question", "answer", "question_type", "difficulty")
    return table(spark, d, "hotpot_sources").select("source_id", F.sha2(H.canonical_json(record), 256).alias("checksum"))


@query("SELECT id, count(*) AS n FROM instances GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return keys.duplicates(table(spark, d, "instances").select("id"), "id")


_LATEST = "SELECT * FROM judge_results QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY judged_at DESC NULLS LAST, loaded_at DESC NULLS LAST, attempts DESC NULLS LAST, score DESC NULLS LAST, rationale DESC NULLS LAST) = 1"


@query(f"SELECT record_id, unit, language, score, attempts FROM ({_LATEST})")
def latest_result(spark: SparkSession, d: str) -> DataFrame:
    return judging.last_results(table(spark, d, "judge_results")).select("record_id", "unit", "language", "score", "attempts")


@query("SELECT count(*) AS n, min(pos) AS \"first\", max(pos) AS \"last\", min(pos) = 0 AND max(pos) = count(*) - 1 AND count(DISTINCT pos) = count(*) AS contiguous FROM hotpot_sources")
def contiguity(spark: SparkSession, d: str) -> DataFrame:
    return keys.is_contiguous(table(spark, d, "hotpot_sources").select("pos"), "pos")


@query(
    "SELECT CAST(count(*) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY c)) AS digest FROM (SELECT c, sha256(string_agg(l || chr(10), '' ORDER BY o)) AS d FROM"
    " (SELECT row_number() OVER (ORDER BY pos) - 1 AS o, (row_number() OVER (ORDER BY pos) - 1) // 1000 AS c, to_json({'pos': pos, 'source_id': source_id}) AS l FROM hotpot_sources) GROUP BY c)".replace("CAST(count(*) AS BIGINT)", "(SELECT count(*) FROM hotpot_sources)")
)
def order_digest(spark: SparkSession, d: str) -> DataFrame:
    numbered = keys.with_ordinal(table(spark, d, "hotpot_sources").select("pos", "source_id"), "pos")
    return keys.ordered_digest(numbered, H.canonical_json(F.struct("pos", "source_id")), "ordinal")


_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(
    "SELECT o.ordinal, o.o_orderkey, CAST(l.r % 4 AS INTEGER) AS member, l.l_orderkey, l.l_linenumber, l.l_quantity FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey FROM orders) o"
    f" JOIN (SELECT row_number() OVER (ORDER BY {_LINES}) - 1 AS r, * FROM lineitem) l ON l.r // 4 = o.ordinal"
)
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    joined = keys.positional_join(table(spark, d, "orders").select("o_orderkey"), lines, left_order=["o_orderkey"], right_order=_LINES.split(", "), group=4)
    return joined.select("ordinal", "o_orderkey", "member", "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    done = table(spark, d, "lineitem").select(C("l_orderkey").alias("o_orderkey")).distinct().join(orders, "o_orderkey", "left_semi")
    return keys.pending(orders, done, ["o_orderkey"])


@query("SELECT DISTINCT source_id FROM instances WHERE source_split = 'train' INTERSECT SELECT source_id FROM instances WHERE source_split = 'validation'")
def split_intersection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "instances").select("source_id", "source_split")
    return rows.where("source_split = 'train'").select("source_id").intersect(rows.where("source_split = 'validation'").select("source_id"))


# -- expansion, audits -----------------------------------------------------------------------------------------------------
@query("SELECT h.source_id, l.ord, l.code AS language, 'xhp-train-' || h.source_id || '--qa-' || l.code AS id FROM hotpot_sources h CROSS JOIN languages l")
def expand_views(spark: SparkSession, d: str) -> DataFrame:
    return records.view_ids(table(spark, d, "hotpot_sources"))


@query(
    "SELECT h.source_id, CASE WHEN e.m IS NULL THEN 'absent_without_final_error_record' WHEN contains(lower(e.m), 'empty sentence') THEN 'inherited_source_empty_sentence'"
    " WHEN contains(lower(e.m), 'outside') AND contains(lower(e.m), 'supporting sentence') THEN 'inherited_source_support_index_out_of_range' ELSE 'logged_generation_error' END AS reason"
    " FROM (SELECT source_id FROM hotpot_sources WHERE source_id NOT IN (SELECT source_id FROM instances WHERE source_id IS NOT NULL AND source_split = 'validation')) h"
    " LEFT JOIN (SELECT source_id, max(error) AS m FROM judge_results WHERE error IS NOT NULL GROUP BY source_id) e USING (source_id)"
)
def missing_manifest(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "instances").where("source_id is not null and source_split = 'validation'")
    errors = table(spark, d, "judge_results").where("error is not null").groupBy("source_id").agg(F.max("error").alias("error")).withColumn("message", F.lit(None).cast("string"))
    return records.missing_manifest(table(spark, d, "hotpot_sources"), done, errors)


@query(
    "SELECT source_id, title, sentence_id, CASE WHEN n = 1 THEN list_position(titles, title) - 1 END AS paragraph_index, n AS matches FROM (SELECT source_id, f.title AS title, f.sentence_id AS sentence_id, titles,"
    " CAST(len(list_filter(titles, lambda t: t = f.title)) AS INTEGER) AS n FROM (SELECT source_id, list_transform(context, lambda p: p.title) AS titles, unnest(supporting_facts) AS f FROM hotpot_sources))"
)
def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "hotpot_sources").select("source_id", F.transform("context", lambda p: p["title"]).alias("titles"), F.explode("supporting_facts").alias("f")).select("source_id", "f.title", "f.sentence_id", "titles")
    n = F.size(F.filter("titles", lambda t: t == C("title")))
    return titles.select("source_id", "title", "sentence_id", F.when(n == 1, (F.array_position("titles", C("title")) - 1).cast("int")).alias("paragraph_index"), n.alias("matches"))


# The checksum of a record in SQL: its canonical JSON, keys sorted, with what changes from run to run emptied.
_PROVENANCE = (
    "assignment_version': provenance.assignment_version, 'created_at': '', 'decoding': CAST('{' || array_to_string(list_transform(list_sort(json_keys(coalesce(nullif(provenance.decoding, ''), '{}'))), lambda k: chr(34) || k || chr(34) || ':' || CAST(json_extract(provenance.decoding, '/' || k) AS VARCHAR)), ',') || '}' AS JSON), 'prompt_hash': provenance.prompt_hash, 'prompt_version': provenance.prompt_version,"
    " 'retry_count': 0, 'schema_version': provenance.schema_version, 'seed': provenance.seed, 'source_dataset': provenance.source_dataset, 'source_license': provenance.source_license, 'translation_model': provenance.translation_model,"
    " 'translation_revision': provenance.translation_revision, 'validation_status': ''"
)
_CHECKSUM = f"""sha256(CAST(to_json({{'answer': answer, 'answer_language': answer_language,
 'candidates': list_transform(candidates, lambda c: {{'id': c.id, 'language': c.language, 'sentences': c.sentences, 'source_sentences': c.source_sentences, 'source_title': c.source_title, 'title': c.title}}), 'checksum': '', 'difficulty': difficulty,
 'id': id, 'provenance': CASE WHEN coalesce(provenance.assignment_manifest_sha256, '') = '' THEN to_json({{'{_PROVENANCE}}}) ELSE to_json({{'assignment_manifest_sha256': provenance.assignment_manifest_sha256, '{_PROVENANCE}}}) END,
 'question': question, 'question_language': question_language, 'question_type': question_type, 'source_id': source_id, 'source_split': source_split,
 'supporting_facts': list_transform(supporting_facts, lambda f: {{'paragraph_id': f.paragraph_id, 'role': f.role, 'sentence_id': f.sentence_id}})}}) AS VARCHAR))"""


@query(f"SELECT id, checksum, computed, coalesce(checksum, '') <> '' AND checksum = computed AS valid FROM (SELECT id, checksum, {_CHECKSUM} AS computed FROM instances)")
def invalid_checksums(spark: SparkSession, d: str) -> DataFrame:
    return validation.checksums(table(spark, d, "instances"))


def _flag_if(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN '{name}' END"


_SQL_INDEX = "TRY_CAST(nullif(regexp_extract({0}, '^p(\\d{{2}})$', 1), '') AS INTEGER)".format
_SQL_AT = "list_extract(coalesce(h.context, []), {0} + 1)".format  # null beyond the list
_ORIGINAL = f"coalesce({_SQL_AT(_SQL_INDEX('c.id'))}.sentences, [])"
_OF_CANDIDATE = f"""CASE WHEN c IS NULL THEN ['set:malformed_candidate'] ELSE [{_flag_if(f"{_SQL_AT(_SQL_INDEX('c.id'))} IS NULL", 'set:invalid_paragraph_id')},
 {_flag_if(f"{_SQL_INDEX('c.id')} IS DISTINCT FROM k - 1", 'set:candidate_order_mismatch')}, {_flag_if(f"coalesce(c.source_title, '') <> coalesce({_SQL_AT(_SQL_INDEX('c.id'))}.title, '')", 'set:source_title_mismatch')},
 {_flag_if(f"coalesce(c.source_sentences, []) <> {_ORIGINAL}", 'set:source_sentences_mismatch')}, {_flag_if(f"len(list_filter({_ORIGINAL}, lambda x: {_blank('x')})) > 0", 'source:blank_source_sentence')},
 {_flag_if('c.sentences IS NULL', 'set:translation_sentences_not_list')}, {_flag_if(f"len(coalesce(c.sentences, [])) <> len({_ORIGINAL})", 'set:sentence_count_mismatch')},
 {_flag_if(f"len(list_filter(coalesce(c.sentences, []), lambda x: {_blank('x')})) > 0", 'set:blank_translation_sentence')}, {_flag_if(f"NOT coalesce(c.language IN ({_list(CODES)}), false)", 'set:unknown_candidate_language')},
 {_flag_if(_blank('c.title'), 'set:blank_translated_title')},
 {_flag_if(f"c.language <> 'en' AND len(list_filter(list_zip(coalesce(c.sentences, []), {_ORIGINAL}), lambda z: NOT {_blank('z[2]')} AND z[1] = z[2])) > 0", 'quality|set:paragraph_sentence_source_copy')}] END"""
_H_TITLES = "list_transform(coalesce(h.context, []), lambda p: p.title)"
_H_UNIQUE = f"list_filter(coalesce(h.supporting_facts, []), lambda f: len(list_filter({_H_TITLES}, lambda t: t = f.title)) = 1)"
_I_FACTS = "list_filter(coalesce(i.supporting_facts, []), lambda f: f IS NOT NULL)"
_I_LENGTH = f"len({_SQL_AT(_SQL_INDEX('f.paragraph_id'))}.sentences)"
_OWN_FLAGS = f"""[{_flag_if("NOT (coalesce(i.checksum, '') <> '' AND i.checksum = i.computed)", 'set:input_checksum_mismatch')}, {_flag_if(_blank('i.question'), 'set:blank_question')}, {_flag_if(_blank('i.answer'), 'set:blank_answer')},
 {_flag_if(f"NOT coalesce(i.question_language IN ({_list(CODES)}), false)", 'set:unknown_question_language')}, {_flag_if(f"NOT coalesce(i.answer_language IN ({_list(CODES)}), false)", 'set:unknown_answer_language')},
 {_flag_if("coalesce(i.question_language, '') <> coalesce(i.answer_language, '')", 'set:question_answer_language_mismatch')}, {_flag_if('i.candidates IS NULL', 'set:candidates_not_list')},
 {_flag_if('len(coalesce(i.candidates, [])) <> len(coalesce(h.context, []))', 'set:candidate_count_mismatch')}, {_flag_if(f'len({_H_UNIQUE}) <> len(coalesce(h.supporting_facts, []))', 'source:supporting_title_not_unique')},
 {_flag_if('i.supporting_facts IS NULL', 'set:supporting_facts_not_list')}, {_flag_if(f'len({_I_FACTS}) <> len(coalesce(i.supporting_facts, []))', 'set:malformed_supporting_fact')},
 {_flag_if(f'len(list_filter({_I_FACTS}, lambda f: f.sentence_id IS NULL)) > 0', 'set:invalid_support_sentence_id')}, {_flag_if(f'len(list_filter({_I_FACTS}, lambda f: {_I_LENGTH} IS NULL)) > 0', 'set:invalid_support_paragraph_id')},
 {_flag_if(f'len(list_filter({_I_FACTS}, lambda f: {_I_LENGTH} IS NOT NULL AND NOT coalesce(f.sentence_id, -1) BETWEEN 0 AND {_I_LENGTH} - 1)) > 0', 'source:support_index_out_of_range')},
 {_flag_if(f"list_transform({_I_FACTS}, lambda f: coalesce(f.paragraph_id, '') || ' ' || coalesce(f.sentence_id, -1)) <> list_transform({_H_UNIQUE}, lambda f: printf('p%02d', list_position({_H_TITLES}, f.title) - 1) || ' ' || f.sentence_id)", 'set:support_annotation_mismatch')},
 {_flag_if("coalesce(i.question_type, 'unknown') <> coalesce(h.question_type, 'unknown')", 'set:question_type_mismatch')}, {_flag_if("coalesce(i.difficulty, 'unknown') <> coalesce(h.difficulty, 'unknown')", 'set:difficulty_mismatch')},
 {_flag_if('i.provenance IS NULL', 'set:missing_provenance')}, {_flag_if("coalesce(i.question_language, '') <> 'en' AND i.question = h.question", 'quality|set:question_source_copy')},
 {_flag_if("coalesce(i.answer_language, '') <> 'en' AND i.answer = h.answer", 'quality|set:answer_source_copy')}, {_flag_if("coalesce(i.provenance.assignment_manifest_sha256, '') = ''", 'quality|provenance:assignment_manifest_hash_missing')}]"""
_FLAGGED = f"""ins AS MATERIALIZED (SELECT row_number() OVER () AS r, *, {_CHECKSUM} AS computed FROM instances),
exploded AS (SELECT r, source_id, unnest(candidates) AS c, unnest(range(1, len(candidates) + 1)) AS k FROM ins),
of_candidates AS (SELECT r, flatten(list(fl)) AS fl FROM (SELECT e.r, {_OF_CANDIDATE} AS fl FROM exploded e LEFT JOIN hotpot_sources h USING (source_id)) GROUP BY r),
every AS (SELECT i.id, CASE WHEN h.source_id IS NULL THEN ['source:missing'] ELSE list_sort(list_distinct(list_filter(list_concat({_OWN_FLAGS}, coalesce(o.fl, [])), lambda x: x IS NOT NULL))) END AS fl
 FROM ins i LEFT JOIN hotpot_sources h USING (source_id) LEFT JOIN of_candidates o USING (r)),
flagged AS (SELECT id, list_filter(fl, lambda x: NOT starts_with(x, 'quality|')) AS structural, list_transform(list_filter(fl, lambda x: starts_with(x, 'quality|')), lambda x: substr(x, 9)) AS quality FROM every)"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return releases.generated_flags(releases.with_source(table(spark, d, "instances"), table(spark, d, "hotpot_sources")), "set:")


@query(f"WITH {_FLAGGED} SELECT flag, CAST(count(*) AS BIGINT) AS records FROM (SELECT unnest(list_concat(structural, quality)) AS flag FROM flagged) GROUP BY flag")
def source_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return releases.flag_counts(_flagged(spark, d))


@query(
    f"WITH {_FLAGGED} SELECT id, CASE WHEN len(structural) > 0 THEN 'quarantined' WHEN len(quality) > 0 THEN 'review_required' ELSE 'accepted' END AS status, array_to_string(structural, ' ') AS structural_flags,"
    " array_to_string(quality, ' ') AS quality_flags FROM flagged"
)
def generated_status(spark: SparkSession, d: str) -> DataFrame:
    f = _flagged(spark, d)
    return f.select("id", releases.status_of(C("structural_flags"), C("quality_flags")).alias("status"), F.array_join("structural_flags", " ").alias("structural_flags"), F.array_join("quality_flags", " ").alias("quality_flags"))


@query()
def generated_release(spark: SparkSession, d: str) -> DataFrame:
    return releases.generated_release(releases.with_source(table(spark, d, "instances").where("source_id is not null"), table(spark, d, "hotpot_sources")).where("s is not null"), "set:")


def _historical(spark: SparkSession, d: str) -> DataFrame:
    """Instances as the historical rows that they would come from: candidates as cells, languages by name."""
    names = F.create_map(*[F.lit(x) for code, name, _ in LANGUAGES for x in (code, name)])
    cells = F.transform("candidates", lambda c: F.when(c["title"].isNotNull() & c["sentences"].isNotNull() & c["language"].isNotNull(), F.struct(c["title"].alias("title"), c["sentences"].alias("sentences"), F.coalesce(F.element_at(names, c["language"]), c["language"]).alias("language"))))
    context = F.transform("context", lambda p: F.struct(p["title"].alias("title"), p["sentences"].alias("sentences")))
    source = F.struct(C("question"), "answer", "question_type", "difficulty", context.alias("context"), "supporting_facts")
    sources = table(spark, d, "hotpot_sources").select("source_id", C("pos").alias("source_position"), source.alias("source"))
    rows = table(spark, d, "instances").select("id", "source_id", "source_split", "shard", "question", "answer", F.coalesce(F.element_at(names, C("question_language")), C("question_language"), F.lit("Unknown")).alias("language"), cells.alias("cells"))
    return rows.join(sources, "source_id")


_NAME_OF = "MAP {" + ", ".join(f"'{c}': '{n}'" for c, n, _ in LANGUAGES) + "}"
_NAMES = _list(n for _, n, _ in LANGUAGES)
_CELL_NAME = f"coalesce({_NAME_OF}[c.language], c.language)"
_HISTORICAL = f"""rows_ AS MATERIALIZED (SELECT row_number() OVER () AS r, i.id, i.source_id, i.question, i.answer, coalesce({_NAME_OF}[i.question_language], i.question_language, 'Unknown') AS language, i.candidates FROM instances i JOIN hotpot_sources USING (source_id)),
exploded AS (SELECT r, source_id, unnest(candidates) AS c, unnest(range(1, len(candidates) + 1)) AS k FROM rows_),
of_cells AS (SELECT r, flatten(list(fl)) AS fl FROM (SELECT e.r, CASE WHEN c IS NULL OR c.title IS NULL OR c.sentences IS NULL OR c.language IS NULL THEN ['invalid_candidate'] ELSE [{_flag_if(f"{_CELL_NAME} NOT IN ({_NAMES})", 'unknown_candidate_language')},
 {_flag_if(f"len(list_filter(c.sentences, lambda x: {_blank('x')})) > 0", 'blank_sentence')}, {_flag_if("k <= len(h.context) AND (h.context[k].title IS NULL OR h.context[k].sentences IS NULL)", 'invalid_source_candidate')},
 {_flag_if("k <= len(h.context) AND len(c.sentences) < len(h.context[k].sentences)", 'paragraph_sentence_shortfall')}, {_flag_if("k <= len(h.context) AND len(c.sentences) > len(h.context[k].sentences)", 'paragraph_sentence_surplus')},
 {_flag_if(f"k <= len(h.context) AND {_CELL_NAME} = 'English' AND (c.title <> h.context[k].title OR c.sentences <> h.context[k].sentences)", 'english_identity_mismatch')}] END AS fl FROM exploded e JOIN hotpot_sources h USING (source_id)) GROUP BY r),
lengths AS (SELECT r, list(CASE WHEN c.title IS NOT NULL AND c.language IS NOT NULL THEN len(c.sentences) END ORDER BY k) AS n FROM exploded GROUP BY r),
every AS (SELECT i.id, i.language, list_sort(list_distinct(list_filter(list_concat([{_flag_if(_blank('i.question'), 'blank_question')}, {_flag_if(_blank('i.answer'), 'blank_answer')}, {_flag_if(f"i.language NOT IN ({_NAMES})", 'unknown_question_language')},
 {_flag_if("i.language = 'English' AND (i.question IS DISTINCT FROM h.question OR i.answer IS DISTINCT FROM h.answer)", 'english_identity_mismatch')}, {_flag_if('h.context IS NULL', 'invalid_source_context')}, {_flag_if('i.candidates IS NULL', 'invalid_context')},
 {_flag_if('len(coalesce(i.candidates, [])) <> len(coalesce(h.context, []))', 'candidate_count_mismatch')},
 {_flag_if(f"len(list_filter(h.supporting_facts, lambda f: len(list_filter({_H_TITLES}, lambda t: t = f.title)) = 0)) > 0", 'supporting_title_missing')}, {_flag_if(f"len(list_filter(h.supporting_facts, lambda f: len(list_filter({_H_TITLES}, lambda t: t = f.title)) > 1)) > 0", 'supporting_title_ambiguous')},
 {_flag_if(f"len(list_filter(h.supporting_facts, lambda f: NOT coalesce(len(list_filter({_H_TITLES}, lambda t: t = f.title)) = 1 AND f.sentence_id < list_extract(n.n, list_position({_H_TITLES}, f.title)), false))) > 0", 'support_index_out_of_range')}],
 coalesce(o.fl, [])), lambda x: x IS NOT NULL))) AS fl FROM rows_ i JOIN hotpot_sources h USING (source_id) LEFT JOIN of_cells o USING (r) LEFT JOIN lengths n USING (r))"""


@query(f"WITH {_HISTORICAL} SELECT id, language, array_to_string(fl, ' ') AS blocking_flags, len(fl) > 0 AS quarantined FROM every")
def public_flags(spark: SparkSession, d: str) -> DataFrame:
    blocking = F.array_remove("structural_flags", releases.REVIEW)
    return releases.public_flags(_historical(spark, d)).select("id", "language", F.array_join(blocking, " ").alias("blocking_flags"), (C("status") == "quarantined").alias("quarantined"))


@query()
def public_release(spark: SparkSession, d: str) -> DataFrame:
    rows = keys.with_ordinal(_historical(spark, d), "source_position", "id", "shard", into="release_position")
    raw = F.sha2(H.canonical_json(F.struct("question", "answer", "language", "cells")), 256)
    rows = rows.withColumns({"view_index": H.train_view(C("source_id"), "public-views|"), "shard_row": C("release_position"), "raw_sha256": raw})
    constants = dict.fromkeys(("source_dataset", "source_file", "translation_model", "prompt_version", "assignment_version", "release_selection", "build_version"), "test")
    return releases.public_release(rows, constants)


@query(
    "WITH j AS (SELECT i.id, i.question_language AS l, i.question AS q, i.answer AS a, h.question AS hq, h.answer AS ha FROM instances i JOIN hotpot_sources h USING (source_id))"
    " SELECT flag, CAST(count(*) AS BIGINT) AS records FROM (SELECT 'question_source_copy' AS flag FROM j WHERE l <> 'en' AND q = hq UNION ALL SELECT 'answer_source_copy' FROM j WHERE l <> 'en' AND a = ha) GROUP BY flag"
)
def source_copy_flags(spark: SparkSession, d: str) -> DataFrame:
    i, h = table(spark, d, "instances").select("source_id", "question_language", "question", "answer"), table(spark, d, "hotpot_sources").select("source_id", C("question").alias("hq"), C("answer").alias("ha"))
    flags = F.array_compact(F.array(F.when(C("question") == C("hq"), "question_source_copy"), F.when(C("answer") == C("ha"), "answer_source_copy")))
    return i.where("question_language <> 'en'").join(h, "source_id").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("records"))


@query("SELECT DISTINCT id FROM (SELECT r, id, lower(nfc_normalize(trim(regexp_replace(c.title, '\\s+', ' ', 'g')))) AS t FROM (SELECT row_number() OVER () AS r, id, unnest(candidates) AS c FROM instances) WHERE c.title IS NOT NULL) GROUP BY id, t HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    return records.duplicate_titles(table(spark, d, "instances"))


_STRUCTURAL = f"""
CASE WHEN coalesce(id, '') = '' OR coalesce(source_id, '') = '' THEN 'id'
 WHEN NOT coalesce(source_split IN ({_list(SPLITS)}), false) THEN 'split'
 WHEN {_blank('question')} OR {_blank('answer')} THEN 'question_or_answer'
 WHEN NOT coalesce(question_language IN ({_list(CODES)}), false) THEN 'question_language'
 WHEN NOT coalesce(answer_language IN ({_list(CODES)}), false) THEN 'answer_language'
 WHEN question_language <> answer_language THEN 'language_equality'
 WHEN len(coalesce(candidates, [])) = 0 THEN 'no_candidates'
 WHEN len(list_distinct(list_transform(candidates, lambda c: coalesce(c.id, '')))) <> len(candidates) THEN 'duplicate_candidates'
 WHEN len(bad) > 0 THEN bad[1]
 WHEN len(coalesce(supporting_facts, [])) = 0 THEN 'no_facts'
 WHEN len(list_distinct(list_transform(supporting_facts, lambda f: to_json(f)))) <> len(supporting_facts) THEN 'duplicate_facts'
 WHEN len(list_filter(supporting_facts, lambda f: NOT coalesce(f.role IN ({_list(ROLES)}), false))) > 0 THEN 'fact_role'
 WHEN len(list_filter(supporting_facts, lambda f: len(list_filter(candidates, lambda c: c.id = f.paragraph_id)) = 0)) > 0 THEN 'fact_paragraph'
 WHEN len(list_filter(supporting_facts, lambda f: len(list_filter(candidates, lambda c: c.id = f.paragraph_id AND f.sentence_id >= 0 AND f.sentence_id < len(c.sentences))) = 0)) > 0 THEN 'fact_sentence' END"""
_BAD = f"""list_filter(list_transform(coalesce(candidates, []), lambda c: CASE WHEN NOT coalesce(c.language IN ({_list(CODES)}), false) THEN 'candidate_language'
 WHEN coalesce(c.id, '') = '' OR {_blank('c.title')} THEN 'candidate_id_or_title'
 WHEN len(coalesce(c.sentences, [])) = 0 OR len(list_filter(c.sentences, lambda s: {_blank('s')})) > 0 THEN 'candidate_sentences'
 WHEN c.source_sentences IS NOT NULL AND len(c.source_sentences) <> len(c.sentences) THEN 'candidate_cardinality' END), lambda e: e IS NOT NULL)"""
_STRICT = f"""list_filter([CASE WHEN NOT coalesce(question_type IN ({_list(QUESTION_TYPES)}), false) THEN 'question_type' END, CASE WHEN NOT coalesce(difficulty IN ({_list(DIFFICULTIES)}), false) THEN 'difficulty' END,
 {", ".join(f"CASE WHEN {_blank(f'provenance.{n}')} THEN 'provenance.{n}' END" for n in validation.REQUIRED)},
 CASE WHEN NOT coalesce(regexp_full_match(provenance.prompt_hash, '[0-9a-f]{{64}}'), false) THEN 'provenance.prompt_hash' END,
 CASE WHEN coalesce(provenance.assignment_manifest_sha256, '') <> '' AND NOT regexp_full_match(provenance.assignment_manifest_sha256, '[0-9a-f]{{64}}') THEN 'provenance.assignment_manifest_sha256' END,
 CASE WHEN coalesce(provenance.retry_count, 0) < 0 THEN 'provenance.retry_count' END,
 CASE WHEN len(list_filter(candidates, lambda c: {_blank('c.source_title')})) > 0 THEN 'source_title' END, CASE WHEN len(list_filter(candidates, lambda c: c.source_sentences IS NULL)) > 0 THEN 'source_sentences' END], lambda e: e IS NOT NULL)"""


@query(
    f"WITH s AS (SELECT *, {_BAD} AS bad FROM instances), e AS (SELECT *, {_STRUCTURAL} AS error FROM s), a AS (SELECT CASE WHEN error IS NOT NULL THEN [error] ELSE list_transform({_STRICT}, lambda x: 'strict:' || x) END AS codes FROM e)"
    " SELECT code, CAST(count(*) AS BIGINT) AS records FROM (SELECT unnest(codes) AS code FROM a) GROUP BY code"
)
def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    return validation.error_counts(table(spark, d, "instances"))


@query(
    f"WITH s AS (SELECT *, {_BAD} AS bad FROM instances), e AS (SELECT *, {_STRUCTURAL} AS error, {_CHECKSUM} AS computed FROM s), a AS (SELECT source_split, id, error, CASE WHEN error IS NULL THEN len({_STRICT}) ELSE 0 END AS strict,"
    " error IS NULL AND NOT (coalesce(checksum, '') <> '' AND checksum = computed) AS wrong FROM e), g AS (SELECT source_split, id, count(*) AS n, count(error) AS invalid, sum(strict) AS strict, count(*) FILTER (wrong) AS wrong FROM a GROUP BY source_split, id)"
    " SELECT source_split AS split, CAST(sum(n) AS BIGINT) AS records, CAST(sum(invalid) AS BIGINT) AS invalid, CAST(sum(strict) AS BIGINT) AS strict_errors, CAST(sum(greatest(0, n - invalid - 1)) AS BIGINT) AS duplicates,"
    " CAST(sum(wrong) AS BIGINT) AS invalid_checksums FROM g GROUP BY source_split"
)
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validation.validation_report(table(spark, d, "instances"))


@query("SELECT c.language AS language, CAST(count(*) AS BIGINT) AS paragraphs, CAST(sum(len(c.sentences)) AS BIGINT) AS sentences FROM (SELECT unnest(candidates) AS c FROM instances) GROUP BY c.language")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instances").select(F.explode("candidates").alias("c")).groupBy(C("c.language").alias("language")).agg(F.count("*").alias("paragraphs"), F.sum(F.size("c.sentences")).cast("long").alias("sentences"))


# -- evaluation ------------------------------------------------------------------------------------------------------------
_SPACE = r"[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+"
_ARTICLE = r"'(^|[^\pL\pN_])(?:a|an|the)($|[^\pL\pN_])', '\1 \2', 'g'"
_BARE = r"regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\[-\x{{60}}\{{-~]', '', 'g')"
_NORM = f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({_BARE}, {_ARTICLE}), {_ARTICLE}), '{_SPACE}'), lambda w: w <> ''), ' ')"


@query(f"SELECT DISTINCT answer, {_NORM.format('answer')} AS form FROM instances")
def normalize_legacy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instances").select("answer").distinct().select("answer", X.normalize_legacy(C("answer")).alias("form"))


@query()
def normalize_unicode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instances").select("answer", "question_language").distinct().select("answer", "question_language", X.normalize_unicode(C("answer"), C("question_language")).alias("form"))


_GOLD = f"SELECT * FROM (SELECT * FROM instances QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at DESC NULLS LAST) = 1) WHERE question_language IN ({_list(CODES)}) AND len(list_filter(candidates, lambda c: NOT coalesce(c.language IN ({_list(CODES)}), false))) = 0"
_PRED = "SELECT * FROM predictions WHERE id IS NOT NULL AND system IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, system ORDER BY predicted_at DESC NULLS LAST, loaded_at DESC NULLS LAST, answer DESC NULLS LAST) = 1"
_SCORED = f"""gold AS ({_GOLD}), pred AS ({_PRED}), systems AS (SELECT DISTINCT system FROM predictions WHERE system IS NOT NULL),
forms AS (SELECT g.id, y.system, p.id IS NULL AS missing, {_NORM.format('p.answer')} AS pn, {_NORM.format('g.answer')} AS gn, list_distinct(list_transform(coalesce(p.supporting_facts, []), lambda f: f.paragraph_id || chr(31) || f.sentence_id)) AS pf, list_distinct(list_transform(coalesce(g.supporting_facts, []), lambda f: f.paragraph_id || chr(31) || f.sentence_id)) AS gf FROM gold g CROSS JOIN systems y LEFT JOIN pred p ON p.id = g.id AND p.system = y.system),
toks AS (SELECT *, CASE WHEN pn = '' THEN [] ELSE string_split(pn, ' ') END AS pt, CASE WHEN gn = '' THEN [] ELSE string_split(gn, ' ') END AS gt FROM forms),
over AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y = x)), len(list_filter(gt, lambda y: y = x))))), 0) AS k, len(pt) AS n, len(gt) AS m, len(list_intersect(pf, gf)) AS sk, len(pf) AS sn, len(gf) AS sm, (pn IN ('yes', 'no', 'noanswer') OR gn IN ('yes', 'no', 'noanswer')) AND pn <> gn AS zero FROM toks),
parts AS (SELECT id, system, missing, CASE WHEN zero THEN 0.0 ELSE CAST(pn = gn AS INTEGER) END AS aem, CASE WHEN zero THEN 0.0 WHEN n > 0 THEN k / n WHEN m = 0 THEN 1.0 ELSE 0.0 END AS ap, CASE WHEN zero THEN 0.0 WHEN m > 0 THEN k / m WHEN n = 0 THEN 1.0 ELSE 0.0 END AS ar,
 CAST(sn = sm AND sk = sn AS INTEGER) AS sem, CASE WHEN sn > 0 THEN sk / sn WHEN sm = 0 THEN 1.0 ELSE 0.0 END AS sp, CASE WHEN sm > 0 THEN sk / sm WHEN sn = 0 THEN 1.0 ELSE 0.0 END AS sr FROM over),
scores AS (SELECT id, system, missing, CAST(aem AS DOUBLE) AS aem, CASE WHEN ap + ar > 0 THEN 2 * ap * ar / (ap + ar) ELSE 0.0 END AS af1, CAST(sem AS DOUBLE) AS sem, CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0.0 END AS sf1, CAST(aem * sem AS DOUBLE) AS jem, CASE WHEN ap * sp + ar * sr > 0 THEN 2 * (ap * sp) * (ar * sr) / (ap * sp + ar * sr) ELSE 0.0 END AS jf1 FROM parts)"""


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gold_records(table(spark, d, "instances"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions").where("id is not null and system is not null")
    return keys.latest(rows, ["id", "system"], F.desc_nulls_last("predicted_at"), F.desc_nulls_last("loaded_at"), F.desc_nulls_last("answer"))


@query(f"WITH {_SCORED} SELECT id, system, missing, aem AS answer_em, round(af1, 6) AS answer_f1, sem AS support_em, round(sf1, 6) AS support_f1, jem AS joint_em, round(jf1, 6) AS joint_f1 FROM scores")
def evaluate_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.scored(_gold(spark, d), _predictions(spark, d), protocol="legacy_hotpot")
    return rows.select("id", "system", "missing", *[c for n in ("answer", "support", "joint") for c in (C(n)["em"].alias(f"{n}_em"), F.round(C(n)["f1"], 6).alias(f"{n}_f1"))])


@query()
def evaluate_examples_unicode(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.scored(_gold(spark, d), _predictions(spark, d))
    return rows.select("id", "system", "missing", *[c for n in ("answer", "support", "joint") for c in (C(n)["em"].alias(f"{n}_em"), F.round(C(n)["f1"], 6).alias(f"{n}_f1"))])


_STRATA = f"""ids AS (SELECT id, question_language AS q, candidates, list_distinct(list_transform(supporting_facts, lambda f: f.paragraph_id)) AS g FROM ({_GOLD})),
langs AS (SELECT id, q, list_transform(list_filter(g, lambda i: len(list_filter(candidates, lambda c: c.id = i)) > 0), lambda i: list_filter(candidates, lambda c: c.id = i)[1].language) AS g, list_transform(list_filter(candidates, lambda c: NOT list_contains(g, c.id)), lambda c: c.language) AS d, list_transform(candidates, lambda c: c.language) AS k FROM ids),
vals AS (SELECT id, q, len(list_filter(g, lambda x: x <> q)) / len(g) AS rg, CASE WHEN len(d) > 0 THEN len(list_filter(d, lambda x: x <> q)) / len(d) END AS rd,
 CASE WHEN len(g) <= 1 THEN 0.0 ELSE list_sum(list_transform(list_distinct(g), lambda x: -(len(list_filter(g, lambda y: y = x)) / len(g)) * ln(len(list_filter(g, lambda y: y = x)) / len(g)))) / ln(len(g)) END AS h,
 len(list_distinct(g)) AS ng, len(list_distinct(k)) AS nk, len(d) AS nd, list_distinct(list_transform(g, lambda x: {_SCRIPTS}[x])) AS sc, {_SCRIPTS}[q] AS qs FROM langs WHERE len(g) > 0),
strata AS (SELECT id, q, rg, rd, h, ng, nk, nd, CASE WHEN len(sc) = 1 AND sc[1] = qs THEN 'same-script' WHEN list_contains(sc, qs) THEN 'mixed-script' ELSE 'different-script' END AS rel,
 CASE WHEN rg = 0 AND rd IS NULL THEN 'gold-aligned-no-distractors' WHEN rg = 0 AND rd = 0 THEN 'fully-monolingual' WHEN rg = 0 THEN 'multilingual-distractors-only' WHEN rg < 1 THEN 'partial-gold-mismatch' WHEN ng = 1 THEN 'full-mismatch-single-evidence-language' ELSE 'full-mismatch-multilingual-evidence' END AS cond FROM vals)"""


@query(f"WITH {_STRATA} SELECT id, round(rg, 6) AS gold_mismatch, round(rd, 6) AS distractor_mismatch, round(h, 6) AS gold_entropy, CAST(ng AS INTEGER) AS gold_languages, CAST(nk AS INTEGER) AS candidate_languages, CAST(nd AS INTEGER) AS distractors, rel AS script_relation, cond AS condition FROM strata")
def strata(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.strata(_gold(spark, d))
    return s.select("id", *[F.round(n, 6).alias(n) for n in ("gold_mismatch", "distractor_mismatch", "gold_entropy")], "gold_languages", "candidate_languages", "distractors", "script_relation", "condition")


_BIN = "CASE WHEN {0} IS NULL THEN 'not-applicable' WHEN abs({0}) <= 1e-12 THEN 'zero' WHEN abs({0} - 1) <= 1e-9 THEN 'full' ELSE 'partial' END"


@query(
    f"WITH {_SCORED}, {_STRATA}, x AS (SELECT s.*, t.q, t.cond, t.rel, t.rg, t.rd, t.h, t.nk FROM scores s JOIN strata t USING (id)), e AS (SELECT *, unnest([{{'section': 'overall', 'key': ''}}, {{'section': 'question_language', 'key': q}}, {{'section': 'condition', 'key': cond}},"
    f" {{'section': 'script_relation', 'key': rel}}, {{'section': 'gold_mismatch', 'key': {_BIN.format('rg')}}}, {{'section': 'distractor_mismatch', 'key': {_BIN.format('rd')}}}, {{'section': 'gold_entropy', 'key': CASE WHEN abs(h) <= 1e-12 THEN 'zero' WHEN abs(h - 1) <= 1e-9 THEN 'maximal' ELSE 'intermediate' END}},"
    " {'section': 'candidate_languages', 'key': CASE WHEN nk <= 1 THEN 'one' WHEN nk <= 4 THEN 'two-to-four' WHEN nk <= 8 THEN 'five-to-eight' ELSE 'nine-or-more' END}]) AS b FROM x)"
    " SELECT system, b.section AS section, b.key AS key, CAST(count(*) AS BIGINT) AS n, round(avg(aem), 6) AS answer_em, round(avg(af1), 6) AS answer_f1, round(avg(sem), 6) AS support_em, round(avg(sf1), 6) AS support_f1, round(avg(jem), 6) AS joint_em, round(avg(jf1), 6) AS joint_f1 FROM e GROUP BY system, b.section, b.key"
)
def report_long(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.report(_gold(spark, d), _predictions(spark, d), protocol="legacy_hotpot")
    return r.select("system", "section", "key", "n", *[F.round(f"{c}_{m}", 6).alias(f"{c}_{m}") for c in ("answer", "support", "joint") for m in ("em", "f1")])


@query(
    f"WITH {_SCORED}, {_STRATA}, l AS (SELECT system, t.q, avg(aem) AS aem, avg(af1) AS af1, avg(sem) AS sem, avg(sf1) AS sf1, avg(jem) AS jem, avg(jf1) AS jf1 FROM scores s JOIN strata t USING (id) GROUP BY system, t.q)"
    " SELECT system, 'answer' AS component, round(avg(aem), 6) AS em, round(avg(af1), 6) AS f1 FROM l GROUP BY system UNION ALL SELECT system, 'support', round(avg(sem), 6), round(avg(sf1), 6) FROM l GROUP BY system"
    " UNION ALL SELECT system, 'joint', round(avg(jem), 6), round(avg(jf1), 6) FROM l GROUP BY system"
)
def macro_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro(_gold(spark, d), _predictions(spark, d), protocol="legacy_hotpot").select("system", "component", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


@query(
    f"WITH {_STRATA}, v AS (SELECT 'gold_mismatch' AS descriptor, rg AS v FROM strata UNION ALL SELECT 'distractor_mismatch', rd FROM strata UNION ALL SELECT 'gold_entropy', h FROM strata UNION ALL SELECT 'candidate_languages', nk FROM strata)"
    " SELECT descriptor, CAST(count(v) AS BIGINT) AS n, CAST(count(*) - count(v) AS BIGINT) AS not_applicable, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max FROM v GROUP BY descriptor"
)
def descriptor_summaries(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.summaries(evaluation.strata(_gold(spark, d)))
    return r.select("descriptor", "n", "not_applicable", *[F.round(n, 6).alias(n) for n in ("mean", "median", "min", "max")])


@query("SELECT DISTINCT p.id FROM predictions p WHERE p.id IS NOT NULL AND p.id NOT IN (SELECT id FROM instances WHERE id IS NOT NULL)")
def unexpected_predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("id").where("id is not null").distinct().join(table(spark, d, "instances").select("id"), "id", "left_anti")


_FACT_OF = "len(list_filter({0}, lambda f: {1})) > 0".format


@query(
    "WITH k AS (SELECT id, candidates FROM instances QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at DESC NULLS LAST) = 1),"
    " j AS (SELECT p.id, k.id AS known, coalesce(p.supporting_facts, []) AS fl, k.candidates AS c, CASE WHEN p.id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY p.id, p.system) END AS same FROM predictions p LEFT JOIN k ON k.id = p.id)"
    f" SELECT code, CAST(count(*) AS BIGINT) AS rows FROM (SELECT unnest([{_flag_if('id IS NULL', 'null_id')}, {_flag_if('same > 1', 'repeated')}, {_flag_if('known IS NULL', 'unexpected')},"
    f" {_flag_if(_FACT_OF('fl', chr(32).join(['coalesce(f.paragraph_id,', repr(''), ') =', repr(''), 'OR f.sentence_id IS NULL OR f.sentence_id < 0'])), 'malformed_fact')}, {_flag_if('len(list_distinct(list_transform(fl, lambda x: to_json(x)))) < len(fl)', 'repeated_fact')},"
    f" {_flag_if('known IS NOT NULL AND ' + _FACT_OF('fl', 'len(list_filter(c, lambda x: coalesce(x.id = f.paragraph_id AND f.sentence_id < len(x.sentences), false))) = 0'), 'fact_out_of_bounds')}]) AS code FROM j) WHERE code IS NOT NULL GROUP BY code"
)
def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.prediction_errors(table(spark, d, "predictions"), keys.latest(table(spark, d, "instances").select("id", "candidates", "imported_at"), ["id"], F.desc_nulls_last("imported_at")))


# -- judging ---------------------------------------------------------------------------------------------------------------
@query(
    f"SELECT CASE WHEN grouping(unit) = 1 THEN 'overall' WHEN grouping(language) = 1 THEN 'unit' ELSE 'language_unit' END AS level, language, unit, CAST(count(*) AS BIGINT) AS n, CAST(count(score) AS BIGINT) AS judged, CAST(count(*) - count(score) AS BIGINT) AS failed,"
    f" round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max, CAST(sum(greatest(coalesce(attempts, 1) - 1, 0)) AS BIGINT) AS retries FROM ({_LATEST}) GROUP BY GROUPING SETS ((), (unit), (language, unit))"
)
def judge_report(spark: SparkSession, d: str) -> DataFrame:
    return judging.report(judging.last_results(table(spark, d, "judge_results"))).withColumn("mean", F.round("mean", 6))


_SUMMARY = "CAST(count(score) AS BIGINT) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS sd, min(score) AS min, max(score) AS max, CAST(count(*) FILTER (score < 60) AS BIGINT) AS below_60, CAST(count(*) FILTER (score < 80) AS BIGINT) AS below_80, CAST(count(*) FILTER (score >= 90) AS BIGINT) AS from_90"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in ("mean", "median", "sd")})


@query(f"SELECT unit, {_SUMMARY} FROM ({_LATEST}) WHERE score IS NOT NULL GROUP BY unit")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(judging.score_summary(judging.last_results(table(spark, d, "judge_results")), "unit"))


@query(
    "SELECT CASE WHEN grouping(source_split) = 0 THEN 'split' WHEN grouping(unit) = 0 AND grouping(language) = 0 THEN 'language_unit' WHEN grouping(unit) = 0 THEN 'unit' WHEN grouping(language) = 0 THEN 'language' ELSE 'overall' END AS level, language, unit, source_split AS split,"
    f" {_SUMMARY} FROM ({_LATEST}) WHERE score IS NOT NULL GROUP BY GROUPING SETS ((), (unit), (language), (language, unit), (source_split))"
)
def summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(judging.summary_cube(judging.last_results(table(spark, d, "judge_results"))))


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return judging.interval(judging.bootstrap(judging.last_results(table(spark, d, "judge_results")), replicates=1000, seed=20260821))


@query()
def bootstrap_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = judging.last_results(table(spark, d, "judge_results"))
    first, second = (judging.bootstrap(rows.where(C("source_split") == s), replicates=1000, seed=k) for s, k in (("train", 20260821), ("validation", 20260822)))
    return judging.bootstrap_difference(first, second)


_INSTANCES = "SELECT * FROM instances QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at DESC NULLS LAST) = 1"
_UNITS = f"""i AS ({_INSTANCES}), x AS (SELECT id, source_id, unnest(candidates) AS p FROM i),
u AS (SELECT id AS instance_id, source_id, p.language AS language, 'paragraph' AS unit, p.id AS paragraph_id FROM x WHERE p.language <> 'en' AND p.source_sentences IS NOT NULL
 UNION ALL SELECT i.id, i.source_id, i.question_language, v.unit, NULL FROM i JOIN hotpot_sources h USING (source_id) CROSS JOIN (VALUES ('question'), ('answer')) v(unit) WHERE i.question_language <> 'en'),
r AS (SELECT *, CASE WHEN unit = 'paragraph' THEN sha256('20260810' || chr(0) || language || ':paragraph' || chr(0) || sha256(to_json({{'instance_id': instance_id, 'language': language, 'paragraph_id': paragraph_id, 'source_id': source_id, 'unit': unit}}))) ELSE sha256('20260810' || chr(0) || language || ':qa' || chr(0) || instance_id) END AS rank FROM u)"""


@query(f"WITH {_UNITS} SELECT language, unit, instance_id, paragraph_id, rank, CAST(row_number() OVER (PARTITION BY language, unit ORDER BY rank, instance_id, paragraph_id) AS INTEGER) AS n FROM r QUALIFY n <= CASE WHEN unit = 'paragraph' THEN 80 ELSE 20 END")
def stable_sample(spark: SparkSession, d: str) -> DataFrame:
    instances = keys.latest(table(spark, d, "instances"), ["id"], F.desc_nulls_last("imported_at"))
    return judging.sample(judging.units(instances, table(spark, d, "hotpot_sources"))).select("language", "unit", "instance_id", "paragraph_id", "rank", "n")


@query(
    "SELECT doc_id, greatest(0, least(100, CAST(s AS INTEGER))) AS score FROM (SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i:SCORE)\\s*[:\\-]?\\s*(\\d{1,3})', 1), ''),"
    " list_extract(regexp_extract_all(regexp_replace(text, '([^\\pL\\pN_])', '\\1\\1', 'g'), '(?:^|[^\\pL\\pN_])([0-9]{1,3})(?:$|[^\\pL\\pN_])', 1), -1)) AS s FROM documents) WHERE s IS NOT NULL"
)
def score_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.score_from_text(C("text")).alias("score")).where("score is not null")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
