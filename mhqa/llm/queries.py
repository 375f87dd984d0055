"""Queries of the training-text operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mhqa.llm import alignment, langid, leakage, overlap, pairs, privacy, textforms, tokenize, truncation, units
from mhqa.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.mislabelled(table(spark, sf_dir, "instances"), table(spark, sf_dir, "languages"))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = table(spark, sf_dir, "instances")
    known = langid.inventory(table(spark, sf_dir, "languages"))
    texts = units.sentences(instances).unionByName(units.field(instances, "question", "question_language"))
    return langid.segments(texts, langid.fit(instances, known), known).drop("label").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "instances"), table(spark, sf_dir, "languages"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "instances"), table(spark, sf_dir, "languages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "instances"), table(spark, sf_dir, "languages"), table(spark, sf_dir, "hotpot_sources"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.pairs(table(spark, sf_dir, "paragraph_drafts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = table(spark, sf_dir, "instances")
    texts = units.sentences(instances).unionByName(units.field(instances, "answer", "answer_language"))
    return textforms.deviating(texts.where("text is not null and text != ''")).select("id", "paragraph_id", "sentence_id").distinct()


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = table(spark, sf_dir, "instances")
    texts = units.sentences(instances).unionByName(units.field(instances, "answer", "answer_language"))
    return textforms.normalise(texts.where("text is not null")).select("id", "paragraph_id", "sentence_id", "form", "form_changes").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "instances"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "instances"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.record_coverage(table(spark, sf_dir, "instances"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "kind", "begin_at").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "redacted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_rates, p3_found, p4_found, p5_found, p5_forms, p6_found, p6_report, p6_records, p7_ids, p8_found, p8_report, p9_found, p9_redacted)}

# The rules of p5_found as patterns; what SQL lacks is the case of whole words of look-alikes in another script.
_L, _C, _G, _A, _M = r"A-Za-z\x{aa}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2af}\x{1e00}-\x{1eff}", r"\x{400}-\x{52f}", r"\x{370}-\x{3ff}", r"[\x{620}-\x{6ff}\x{750}-\x{77f}]", r"[\x{300}-\x{36f}]*"
_OFF = (
    r"[\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{200d}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{ad}\x{34f}\x{61c}\x{feff}\x{fe00}-\x{fe0f}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}"
    r"\x{ff41}-\x{ff5a}\x{fb00}-\x{fb06}]"
)
_MIXED = f"[{_L}]{_M}[{_C}{_G}]|[{_C}{_G}]{_M}[{_L}]|[{_C}]{_M}[{_G}]|[{_G}]{_M}[{_C}]"
_JOINED = f"regexp_replace({{0}}, '({_A.replace('{', '{{').replace('}', '}}')})\\x{{{{200c}}}}({_A.replace('{', '{{').replace('}', '}}')})', '\\1\\2', 'g')"

SQL: dict[str, str] = {
    "p5_found": "WITH u AS (SELECT id, '' AS paragraph_id, -1 AS sentence_id, answer AS s FROM instances UNION ALL SELECT id, c.id, CAST(k - 1 AS INTEGER), c.sentences[k] FROM (SELECT id, c, unnest(range(1, len(c.sentences) + 1)) AS k FROM (SELECT id, unnest(candidates) AS c FROM instances)))"
    f" SELECT DISTINCT id, paragraph_id, sentence_id FROM u WHERE s <> '' AND (nfc_normalize(s) <> s OR regexp_matches(s, '{_OFF}') OR regexp_matches({_JOINED.format(_JOINED.format('s'))}, '\\x{{200c}}') OR regexp_matches(nfc_normalize(s), '{_MIXED}'))"
}
