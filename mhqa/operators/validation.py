"""Structural and strict checks of canonical records; the dataset report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mhqa.functions.hashing import checksum, is_sha256
from mhqa.functions.text import is_blank
from mhqa.schemas import CODES, DIFFICULTIES, QUESTION_TYPES, ROLES, SPLITS

C = F.col


def structural_error() -> Column:
    """The code of the first rule that a record breaks, null if it breaks none. Null fields break the rule on them."""
    unknown = lambda x: ~F.coalesce(x.isin(*CODES), F.lit(False))
    candidates, facts = F.coalesce(C("candidates"), F.array()), F.coalesce(C("supporting_facts"), F.array())
    ids = F.transform(candidates, lambda c: c["id"])
    lengths = F.map_from_arrays(F.array_distinct(F.transform(ids, lambda i: F.coalesce(i, F.lit("")))), F.transform(F.array_distinct(F.transform(ids, lambda i: F.coalesce(i, F.lit("")))), lambda i: F.size(F.coalesce(F.get(F.filter(candidates, lambda c: F.coalesce(c["id"], F.lit("")) == i), F.lit(0))["sentences"], F.array()))))
    triples = F.transform(facts, lambda f: F.struct(f["paragraph_id"], f["sentence_id"], f["role"]))
    first_bad = F.filter(
        F.transform(
            candidates,
            lambda c: F.when(unknown(c["language"]), "candidate_language")
            .when((F.coalesce(c["id"], F.lit("")) == "") | is_blank(c["title"]), "candidate_id_or_title")
            .when((F.size(F.coalesce(c["sentences"], F.array())) == 0) | F.exists(F.coalesce(c["sentences"], F.array()), is_blank), "candidate_sentences")
            .when(c["source_sentences"].isNotNull() & (F.size(c["source_sentences"]) != F.size(c["sentences"])), "candidate_cardinality"),
        ),
        lambda e: e.isNotNull(),
    )
    return (
        F.when((F.coalesce(C("id"), F.lit("")) == "") | (F.coalesce(C("source_id"), F.lit("")) == ""), "id")
        .when(~F.coalesce(C("source_split").isin(*SPLITS), F.lit(False)), "split")
        .when(is_blank(C("question")) | is_blank(C("answer")), "question_or_answer")
        .when(unknown(C("question_language")), "question_language")
        .when(unknown(C("answer_language")), "answer_language")
        .when(C("question_language") != C("answer_language"), "language_equality")
        .when(F.size(candidates) == 0, "no_candidates")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_candidates")
        .when(F.size(first_bad) > 0, F.try_element_at(first_bad, F.lit(1)))
        .when(F.size(facts) == 0, "no_facts")
        .when(F.size(F.array_distinct(triples)) != F.size(triples), "duplicate_facts")
        .when(F.exists(facts, lambda f: ~F.coalesce(f["role"].isin(*ROLES), F.lit(False))), "fact_role")
        .when(F.exists(facts, lambda f: ~F.array_contains(ids, F.coalesce(f["paragraph_id"], F.lit("")))), "fact_paragraph")
        .when(F.exists(facts, lambda f: ~F.coalesce((f["sentence_id"] >= 0) & (f["sentence_id"] < F.try_element_at(lengths, f["paragraph_id"])), F.lit(False))), "fact_sentence")
    )


REQUIRED = ("schema_version", "source_dataset", "source_license", "assignment_version", "translation_model", "translation_revision", "prompt_version", "created_at", "validation_status")


def strict_errors() -> Column:
    """The codes of all release rules that a record breaks."""
    p = C("provenance")
    own = F.array(
        F.when(~F.coalesce(C("question_type").isin(*QUESTION_TYPES), F.lit(False)), "question_type"),
        F.when(~F.coalesce(C("difficulty").isin(*DIFFICULTIES), F.lit(False)), "difficulty"),
        *[F.when(is_blank(p[n]), f"provenance.{n}") for n in REQUIRED],
        F.when(~is_sha256(p["prompt_hash"]), "provenance.prompt_hash"),
        F.when((F.coalesce(p["assignment_manifest_sha256"], F.lit("")) != "") & ~is_sha256(p["assignment_manifest_sha256"]), "provenance.assignment_manifest_sha256"),
        F.when(F.coalesce(p["retry_count"], F.lit(0)) < 0, "provenance.retry_count"),
    )
    of_candidates = F.flatten(F.transform(F.coalesce(C("candidates"), F.array()), lambda c: F.array(F.when(is_blank(c["source_title"]), "source_title"), F.when(c["source_sentences"].isNull(), "source_sentences"))))
    return F.array_compact(F.concat(own, of_candidates))


def validated(instances: DataFrame) -> DataFrame:
    """``instances`` with ``error`` (the first structural one) and ``strict`` (all release errors of records without it)."""
    return instances.withColumn("error", structural_error()).withColumn("strict", F.when(C("error").isNull(), strict_errors()).otherwise(F.array().cast("array<string>")))


RECORD = ("id", "source_id", "source_split", "question", "answer", "question_language", "answer_language", "candidates", "supporting_facts", "question_type", "difficulty", "provenance", "checksum")


def checksums(instances: DataFrame) -> DataFrame:
    """(id, checksum, computed, valid): the stored checksum of each row beside that of its content. A blank one isn't valid."""
    rows = instances.select("id", "checksum", checksum(F.struct(*RECORD)).alias("computed"))
    return rows.withColumn("valid", (F.coalesce(C("checksum"), F.lit("")) != "") & C("checksum").eqNullSafe(C("computed")))


def validation_report(instances: DataFrame) -> DataFrame:
    """(split, records, invalid, strict_errors, duplicates, invalid_checksums): duplicates count repeated ids among structurally valid records, and checksums are those of valid records."""
    checked = validated(instances.select(*RECORD)).withColumn("bad", C("error").isNull() & ~((F.coalesce(C("checksum"), F.lit("")) != "") & C("checksum").eqNullSafe(checksum(F.struct(*RECORD)))))
    by_id = checked.groupBy("source_split", "id").agg(F.count("*").alias("n"), F.count_if(C("error").isNotNull()).alias("invalid"), F.sum(F.size("strict")).alias("strict"), F.count_if("bad").alias("bad"))
    return by_id.groupBy(C("source_split").alias("split")).agg(
        F.sum("n").alias("records"), F.sum("invalid").alias("invalid"), F.sum("strict").cast("long").alias("strict_errors"), F.sum(F.greatest(F.lit(0), C("n") - C("invalid") - 1)).cast("long").alias("duplicates"),
        F.sum("bad").alias("invalid_checksums"),
    )


def error_counts(instances: DataFrame) -> DataFrame:
    """(code, records): how many records break each rule, the first structural one and all strict ones."""
    checked = validated(instances)
    return checked.select(F.explode(F.array_distinct(F.array_compact(F.concat(F.array("error"), F.transform("strict", lambda e: F.concat(F.lit("strict:"), e)))))).alias("code")).groupBy("code").agg(F.count("*").alias("records"))
