"""Schemas of the nested records, the language dimension and its orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CANDIDATE = "struct<id: string, title: string, sentences: array<string>, language: string, source_title: string, source_sentences: array<string>>"
FACT = "struct<paragraph_id: string, sentence_id: int, role: string>"
PROVENANCE = (
    "struct<schema_version: string, source_dataset: string, source_license: string, assignment_version: string, assignment_manifest_sha256: string, seed: bigint,"
    " translation_model: string, translation_revision: string, prompt_version: string, prompt_hash: string, retry_count: int, created_at: string, validation_status: string, decoding: string>"
)
CANONICAL = (
    "id string, source_id string, source_split string, question string, answer string, question_language string, answer_language string,"
    f" candidates array<{CANDIDATE}>, supporting_facts array<{FACT}>, question_type string, difficulty string, provenance {PROVENANCE}, checksum string"
)
HOTPOT_SOURCE = "source_id string, question string, answer string, question_type string, difficulty string, pos int, context array<struct<paragraph_id: string, title: string, sentences: array<string>>>, supporting_facts array<struct<title: string, sentence_id: int>>"
PREDICTION = "id string, answer string, supporting_facts array<struct<paragraph_id: string, sentence_id: int>>"
JUDGE_SAMPLE = "record_id string, instance_id string, source_id string, source_split string, language string, unit string, paragraph_id string, source_text string, candidate_text string, context_question string"

# -- fixed values: the language inventory, in its order ------------------------------------------------------------------
LANGUAGES = (
    ("en", "English", "Latin"), ("zh", "Mandarin Chinese", "Han"), ("hi", "Hindi", "Devanagari"), ("es", "Spanish", "Latin"), ("ar", "Arabic", "Arabic"), ("fr", "French", "Latin"),
    ("bn", "Bengali", "Bengali"), ("pt", "Portuguese", "Latin"), ("ru", "Russian", "Cyrillic"), ("ur", "Urdu", "Arabic"), ("id", "Indonesian", "Latin"), ("de", "German", "Latin"),
    ("ja", "Japanese", "Japanese"), ("tr", "Turkish", "Latin"), ("vi", "Vietnamese", "Latin"), ("sw", "Swahili", "Latin"), ("ko", "Korean", "Hangul"), ("fa", "Persian", "Arabic"),
    ("it", "Italian", "Latin"), ("th", "Thai", "Thai"), ("nl", "Dutch", "Latin"), ("pl", "Polish", "Latin"), ("el", "Greek", "Greek"), ("sv", "Swedish", "Latin"),
)
#: The order in which the 24 views of a source stand in historical shards.
LEGACY_ORDER = "en zh es hi ar fr ru pt bn ur id ja de sw tr vi ko it fa th nl pl el sv".split()
#: Roles, splits, types and difficulties that records may have.
ROLES = ("answer", "bridge", "comparison", "support")
SPLITS = ("train", "validation")
QUESTION_TYPES = ("bridge", "comparison")
DIFFICULTIES = ("easy", "medium", "hard")
#: Scripts whose answers are compared by characters.
CHARACTER_SCRIPTS = ("Han", "Japanese", "Thai")
# ----------------------------------------------------------------------------------------------------------------------

CODES = tuple(code for code, _, _ in LANGUAGES)


def languages(spark: SparkSession) -> DataFrame:
    """(ord, legacy_ord, code, name, script): 24 rows."""
    rows = [(k, LEGACY_ORDER.index(code), code, name, script) for k, (code, name, script) in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "ord int, legacy_ord int, code string, name string, script string")
