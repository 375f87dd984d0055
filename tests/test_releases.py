import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_operators import candidate, frame, instance, source

from mhqa.functions import hashing as H
from mhqa.operators import releases as R
from mhqa.operators import validation


def python_checksum(record):
    """The checksum by its definition, on plain values."""
    record = json.loads(json.dumps(record))
    record["checksum"] = ""
    p = record["provenance"]
    p.update(created_at="", retry_count=0, validation_status="")
    if not p.get("assignment_manifest_sha256"):
        p.pop("assignment_manifest_sha256", None)
    p["decoding"] = json.loads(p.get("decoding") or "{}")
    return hashlib.sha256(json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_checksum_by_definition(spark):
    row = frame(spark, instance(question="Wér?")).first().asDict(recursive=True)
    good = frame(spark, row | {"checksum": python_checksum(row)})
    assert validation.checksums(good).first().valid and not validation.checksums(frame(spark, row)).first().valid
    assert validation.checksums(frame(spark, row | {"checksum": python_checksum(row), "answer": "Eve"})).first().valid is False
    report = validation.validation_report(good).first()
    assert (report.records, report.invalid_checksums) == (1, 0)


def flags(spark, row, **over):
    r = R.generated_flags(R.with_source(frame(spark, row), source(spark, **over)), "set:").first()
    return set(r.structural_flags), set(r.quality_flags)


def test_generated_flags(spark):
    row = frame(spark, instance(q="en")).first().asDict(recursive=True)
    row["checksum"] = python_checksum(row)
    assert flags(spark, row) == (set(), {"provenance:assignment_manifest_hash_missing"})
    structural, quality = flags(spark, instance(q="de", candidates=[candidate(language="de")]))
    assert structural == {"set:input_checksum_mismatch"} and quality == {"provenance:assignment_manifest_hash_missing", "set:answer_source_copy", "set:paragraph_sentence_source_copy", "set:question_source_copy"}
    odd, _ = flags(spark, instance(candidates=[candidate("p01")], facts=(("p00", 7),)))
    assert {"set:invalid_paragraph_id", "set:candidate_order_mismatch", "source:support_index_out_of_range", "set:support_annotation_mismatch"} <= odd
    nulls, _ = flags(spark, instance(candidates=None) | {"candidates": None, "supporting_facts": None, "provenance": None}, context=None, supporting_facts=None)
    assert {"set:candidates_not_list", "set:supporting_facts_not_list", "set:missing_provenance"} <= nulls
    broken, _ = flags(spark, instance() | {"candidates": [None, candidate("p01", sentences=None)], "supporting_facts": [None, dict(paragraph_id="p00", sentence_id=None, role="support")]})
    assert {"set:malformed_candidate", "set:translation_sentences_not_list", "set:malformed_supporting_fact", "set:invalid_support_sentence_id"} <= broken
    assert flags(spark, instance(source_id="none")) == ({"source:missing"}, set())
    split = R.generated_flags(R.with_source(frame(spark, instance()), source(spark)), "set:", split="train").first()
    assert "set:source_split_mismatch" in split.structural_flags
    assert R.generated_flags(R.with_source(frame(spark).limit(0), source(spark)), "set:").count() == 0


def test_generated_release(spark):
    r = R.generated_release(R.with_source(frame(spark, instance(q="de", candidates=[candidate(language="de")])), source(spark)), "set:").first()
    assert len(r) == 35 and r.status == "quarantined" and r.question_language_name == "German" and r.candidates[0].source_match and r.supporting_facts[0].in_bounds
    plain = r.asDict(recursive=True) | {"release_record_sha256": ""}
    assert r.release_record_sha256 == hashlib.sha256(json.dumps(plain, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    views = R.status_views(spark.createDataFrame([("accepted",), ("quarantined",), ("review_required",)], "status string"))
    assert [views[v].count() for v in ("complete", "usable", "accepted")] == [3, 2, 1]


def historical(spark, cells='[["Lac", ["un", "deux"], "French"]]', question="Qui ?", answer="Ada", language="French", context=(("Lake", ("one", "two")),), facts=(("Lake", 1),)):
    schema = (
        "raw string, question string, answer string, language string, source struct<question: string, answer: string, question_type: string, difficulty: string, context: array<struct<title: string, sentences: array<string>>>,"
        " supporting_facts: array<struct<title: string, sentence_id: int>>>, source_id string, source_split string, source_position int, release_position int, view_index int, shard string, shard_row int, raw_sha256 string"
    )
    rows = [(cells, question, answer, language, ("Who?", "Ada", "bridge", "hard", context, facts), "1", "train", 0, 0, 3, "s", 5, "f" * 64)]
    return spark.createDataFrame(rows, schema).withColumn("cells", R.typed_cells(F.parse_json("raw"))).drop("raw")


@pytest.mark.parametrize(
    ("over", "expected", "status"),
    [
        ({}, [], "accepted"), ({"cells": '"x"'}, ["candidate_count_mismatch", "invalid_context", "support_index_out_of_range"], "quarantined"), ({"cells": '[["Lac", ["un"], "French"]]'}, ["paragraph_sentence_shortfall", "support_index_out_of_range"], "quarantined"),
        ({"cells": '[["Lac", ["un", "deux", "trois"], "Klingon"]]'}, ["paragraph_sentence_surplus", "unknown_candidate_language"], "quarantined"), ({"cells": '[["Lac", ["un", 2], "French"]]'}, ["invalid_candidate", "support_index_out_of_range"], "quarantined"),
        ({"cells": '[["Lake", ["one", "2"], "English"]]'}, ["english_identity_mismatch"], "quarantined"), ({"language": None, "question": " "}, ["blank_question", "unknown_question_language"], "quarantined"),
        ({"facts": (("Sea", 0), ("Lake", -1))}, ["malformed_supporting_fact", "support_index_out_of_range", "supporting_title_missing"], "quarantined"), ({"cells": '[["Lac", ["un", " "], "French"]]'}, ["blank_sentence"], "quarantined"),
        ({"cells": '[["Ｌac", ["a", "b"], "French"], ["LAC ", ["c"], "French"]]', "context": (("Lake", ("one", "two")), ("Mill", ("x",)))}, ["duplicate_normalized_translated_title"], "review_required"),
        ({"context": (("Lake", ("one", "two")), ("Lake", ("x",))), "cells": '[["Lac", ["a", "b"], "French"], ["M", ["c"], "French"]]'}, ["support_index_out_of_range", "supporting_title_ambiguous"], "quarantined"),
        ({"context": None, "facts": None}, ["candidate_count_mismatch", "invalid_source_context"], "quarantined"),
    ],
)
def test_public_flags(spark, over, expected, status):
    r = R.public_flags(historical(spark, **over)).first()
    assert (r.structural_flags, r.status) == (expected, status)


def test_public_release(spark):
    constants = dict.fromkeys(("source_dataset", "source_file", "translation_model", "prompt_version", "assignment_version", "release_selection", "build_version"), "t")
    r = R.public_release(historical(spark), constants).first()
    assert len(r) == 22 and r.candidates[0].language_code == "fr" and r.candidates[0].source_title == "Lake" and r.supporting_facts[0].paragraph_id == "p00" and r.provenance.legacy_shard_row == 5
    plain = r.asDict(recursive=True)
    plain.pop("record_sha256")
    assert r.record_sha256 == hashlib.sha256(json.dumps(plain, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


JUDGED = "instance_id string, source_id string, source_split string, language string, unit string, paragraph_id string, score int, judge_text string, reasoning string, error string, source_text string, candidate_text string, raw_line_number long"


def test_judge_release(spark):
    row = ("i", "s", "train", "de", "answer", "p1", 91, "Fine.\nSCORE: 91", "", None, "a", "b", 1)
    change = lambda **over: tuple(over.get(n.split()[0], v) for n, v in zip(JUDGED.split(", "), row))
    rows = spark.createDataFrame([row, change(error="x"), change(unit="z"), change(language="en"), change(source_text=""), change(unit="paragraph", paragraph_id=None), change(score=101), change(score=90)], JUDGED)
    good, bad = R.judge_release(rows, targets=["de"], constants={"dataset_version": "v", "sampling_seed": 7}, prompts={"answer": "h"})
    (r,) = good.collect()
    assert len(r) == 26 and r.paragraph_id is None and r.judge_explanation == "Fine." and r.score_origin == "visible_explicit" and r.sampling_seed == 7 and r.judge_prompt_sha256 == "h"
    identity = {"dataset_version": "v", "instance_id": "i", "unit": "answer", "paragraph_id": None}
    assert r.judge_record_id == hashlib.sha256(H.dumps(identity).encode()).hexdigest()
    assert sorted(x.reason for x in bad.collect()) == sorted(["failed", "unit", "language", "empty_text", "paragraph_id", "score", "score_origin"])
    means = {x.unit: (x.first_mean, x.second_mean) for x in R.comparison(good.select("unit", "score"), rows.where("score = 90").select("unit", "score")).collect()}
    assert means == {"answer": (91, 90), None: (91, 90)}
