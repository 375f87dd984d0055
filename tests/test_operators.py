import pytest
from pyspark.sql import functions as F

from mhqa.operators import evaluation, judging, keys, records, validation
from mhqa.schemas import CANONICAL, CODES, HOTPOT_SOURCE

FULL = dict(schema_version="v2", source_dataset="d", source_license="l", assignment_version="a", assignment_manifest_sha256=None, seed=1, translation_model="m", translation_revision="r", prompt_version="p", prompt_hash="a" * 64, retry_count=0, created_at="t", validation_status="ok", decoding="{}")


def candidate(i="p00", language="en", sentences=("Ada wrote it.",), title="Ada", source=True):
    return dict(id=i, title=title, sentences=None if sentences is None else list(sentences), language=language, source_title="Ada" if source else None, source_sentences=list(sentences or ()) if source else None)


def instance(i="xhp-validation-1", q="en", candidates=None, facts=(("p00", 0),), **over):
    base = dict(id=i, source_id="1", source_split="validation", question="Who?", answer="Ada", question_language=q, answer_language=q, candidates=candidates or [candidate()], supporting_facts=[dict(paragraph_id=p, sentence_id=s, role="support") for p, s in facts], question_type="bridge", difficulty="hard", provenance=FULL, checksum=None)
    return base | over


def frame(spark, *rows, extra=""):
    return spark.createDataFrame(list(rows), CANONICAL + extra)


@pytest.mark.parametrize(
    ("row", "code"),
    [
        (instance(), None), (instance(i=""), "id"), (instance(source_split="dev"), "split"), (instance(question=" "), "question_or_answer"), (instance(answer=None), "question_or_answer"), (instance(q="xx"), "question_language"),
        (instance(answer_language="de"), "language_equality"), (instance(candidates=[candidate(), candidate()]), "duplicate_candidates"), (instance(candidates=[candidate(language="xx")]), "candidate_language"),
        (instance(candidates=[candidate(sentences=("", "x"))]), "candidate_sentences"), (instance(candidates=[candidate(sentences=None)]), "candidate_sentences"), (instance(candidates=[candidate() | {"source_sentences": []}]), "candidate_cardinality"),
        (instance(facts=()), "no_facts"), (instance(facts=(("p00", 0), ("p00", 0))), "duplicate_facts"), (instance(facts=(("p09", 0),)), "fact_paragraph"), (instance(facts=(("p00", 3),)), "fact_sentence"), (instance(facts=(("p00", -1),)), "fact_sentence"),
        (instance(supporting_facts=[dict(paragraph_id="p00", sentence_id=0, role="x")]), "fact_role"),
    ],
)
def test_structural(spark, row, code):
    assert validation.validated(frame(spark, row)).first().error == code


def test_strict(spark):
    bad = instance(question_type="unknown", candidates=[candidate(source=False)], provenance=FULL | {"translation_model": "", "prompt_hash": "x", "retry_count": -1})
    assert sorted(validation.validated(frame(spark, bad)).first().strict) == sorted(["question_type", "provenance.translation_model", "provenance.prompt_hash", "provenance.retry_count", "source_title", "source_sentences"])


def test_validation_report(spark):
    rows = [instance(), instance(), instance(i="2", question=""), instance(i="3", source_split="train")]
    report = {r.split: (r.records, r.invalid, r.duplicates) for r in validation.validation_report(frame(spark, *rows)).collect()}
    assert report == {"validation": (3, 1, 1), "train": (1, 0, 0)}
    assert validation.validation_report(frame(spark)).count() == 0


PREDICTION = "id string, answer string, supporting_facts array<struct<paragraph_id: string, sentence_id: int>>"


def gold(spark):
    return frame(
        spark,
        instance("xhp-validation-1", "en", [candidate("p0", "en"), candidate("p1", "fa")], (("p0", 0),)),
        instance("xhp-validation-2", "en", [candidate("p0", "fa"), candidate("p1", "ja"), candidate("p2", "en")], (("p0", 0), ("p1", 0))),
    )


def test_report(spark):
    predictions = spark.createDataFrame([("xhp-validation-1", "Ada", [("p0", 0)]), ("xhp-validation-2", "Ada", [("p0", 0), ("p1", 0)])], PREDICTION)
    rows = {(r.section, r.key): r for r in evaluation.report(gold(spark), predictions).collect()}
    assert rows["overall", ""].n == 2 and rows["overall", ""].joint_f1 == 1
    for key in (("script_relation", "same-script"), ("script_relation", "different-script"), ("gold_mismatch", "zero"), ("gold_mismatch", "full"), ("distractor_mismatch", "zero"), ("distractor_mismatch", "full"), ("gold_entropy", "zero"), ("gold_entropy", "maximal")):
        assert rows[key].n == 1, key
    means = {r.descriptor: r.mean for r in evaluation.summaries(evaluation.strata(gold(spark))).collect()}
    assert means == {"gold_mismatch": 0.5, "distractor_mismatch": 0.5, "gold_entropy": 0.5, "candidate_languages": 2.5}


def test_missing_predictions_score_nothing(spark):
    none = spark.createDataFrame([], PREDICTION)
    rows = evaluation.scored(gold(spark), none).collect()
    assert all(r.missing and r.answer.f1 == 0 and r.joint.f1 == 0 for r in rows)
    assert evaluation.macro(gold(spark), none).where("component = 'answer'").first().f1 == 0


def test_conditions(spark):
    rows = frame(
        spark,
        instance("a", "en", [candidate("p0", "fa"), candidate("p1", "ja"), candidate("p2", "en")], (("p0", 0), ("p1", 0))), instance("b", "en", [candidate("p0")], (("p0", 0),)), instance("c", "en", [candidate("p0"), candidate("p1")], (("p0", 0),)),
        instance("d", "en", [candidate("p0"), candidate("p1", "fa")], (("p0", 0),)), instance("e", "en", [candidate("p0"), candidate("p1", "fa")], (("p0", 0), ("p1", 0))), instance("f", "en", [candidate("p0", "fa")], (("p0", 0),)),
    )
    found = {r.id: (r.condition, r.distractor_mismatch, r.script_relation) for r in evaluation.strata(rows).collect()}
    assert found["a"][0] == "full-mismatch-multilingual-evidence" and found["b"][:2] == ("gold-aligned-no-distractors", None) and found["c"][0] == "fully-monolingual"
    assert found["d"][0] == "multilingual-distractors-only" and found["e"][0] == "partial-gold-mismatch" and found["e"][2] == "mixed-script" and found["f"][0] == "full-mismatch-single-evidence-language"


def test_prediction_errors(spark):
    rows = spark.createDataFrame([("xhp-validation-1", "s", [("p0", 9)]), ("xhp-validation-1", "s", [("", 0)]), ("zz", "s", None), (None, "s", [("p0", 0), ("p0", 0)])], "id string, system string, supporting_facts array<struct<paragraph_id: string, sentence_id: int>>")
    assert {r.code: r["rows"] for r in evaluation.prediction_errors(rows, gold(spark)).collect()} == {"repeated": 2, "fact_out_of_bounds": 2, "malformed_fact": 1, "unexpected": 2, "null_id": 1, "repeated_fact": 1}


def test_ordinal_and_positional_join(spark):
    left = spark.createDataFrame([(f"s{k:03d}",) for k in range(50)], "s string").repartition(7)
    right = spark.createDataFrame([(k, f"r{k}") for k in range(150)], "k int, r string").repartition(5)
    rows = keys.positional_join(left, right, left_order=["s"], right_order=["k"], group=3).collect()
    assert len(rows) == 150 and all(r.s == f"s{r.k // 3:03d}" and r.member == r.k % 3 for r in rows)
    with pytest.raises(keys.ContractError):
        keys.positional_join(left, right.where("k < 149"), left_order=["s"], right_order=["k"], group=3)
    numbered = keys.with_ordinal(left, "s")
    assert keys.is_contiguous(numbered, "ordinal").first().contiguous
    assert keys.is_contiguous(left.limit(0).withColumn("o", F.lit(1)), "o").first().contiguous


def test_ordered_digest_depends_on_order(spark):
    rows = spark.range(2500).withColumnRenamed("id", "o")
    a = keys.ordered_digest(rows, F.col("o").cast("string"), "o").first()
    b = keys.ordered_digest(rows, (2499 - F.col("o")).cast("string"), "o").first()
    assert a.n == b.n == 2500 and a.digest != b.digest


def test_exact_join_and_pending(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert keys.exact_join(a, b, ["k"]).count() == 2
    with pytest.raises(keys.ContractError, match="unused"):
        keys.exact_join(a.where("k = 'x'"), b, ["k"])
    assert [r.k for r in keys.pending(a, b.select("k").where("k = 'x'"), ["k"]).collect()] == ["y"]
    with pytest.raises(keys.ContractError):
        keys.pending(a.where("k = 'x'"), b.select("k"), ["k"])


def test_gate(spark):
    df = spark.createDataFrame([(1,), (None,)], "v int")
    assert keys.gate(df.where("v is not null"), positive=F.col("v") > 0) == {"positive": 0}
    with pytest.raises(keys.ContractError):
        keys.gate(df, positive=F.col("v") > 0)


def translations(spark, source="1", drop=None):
    return spark.createDataFrame([(source, c, f"q {c}", f"a {c}") for c in CODES if c != drop], "source_id string, language string, question string, answer string")


def test_expand(spark):
    base = frame(spark, instance("xhp-train-1", "en", source_split="train"))
    views = records.expand(base, translations(spark))
    rows = views.collect()
    assert len(rows) == 24 and {r.id for r in rows} == {f"xhp-train-1--qa-{c}" for c in CODES} and all(r.question == f"q {r.question_language}" for r in rows)
    assert records.relation_errors(base, views).count() == 0
    broken = views.where("question_language != 'de'").withColumn("difficulty", F.when(F.col("question_language") == "fa", "easy").otherwise(F.col("difficulty")))
    assert sorted((r.id, r.problem) for r in records.relation_errors(base, broken).collect()) == [("xhp-train-1--qa-de", "missing"), ("xhp-train-1--qa-fa", "changed difficulty")]
    for bad in (translations(spark, drop="de"), translations(spark, source="2")):
        with pytest.raises(keys.ContractError):
            records.expand(base, bad)


def test_missing_manifest(spark):
    sources = spark.createDataFrame([(s,) for s in "abcde"], "source_id string")
    ledger = spark.createDataFrame([("b", "Empty sentence here", None), ("c", None, "Supporting sentence 3 is outside 'p01'"), ("d", "boom", None)], "source_id string, error string, message string")
    found = {r.source_id: r.reason for r in records.missing_manifest(sources, sources.where("source_id = 'e'"), ledger).collect()}
    assert found == {"a": "absent_without_final_error_record", "b": "inherited_source_empty_sentence", "c": "inherited_source_support_index_out_of_range", "d": "logged_generation_error"}


def source(spark, **over):
    base = dict(source_id="1", question="Who?", answer="Ada", question_type="bridge", difficulty="hard", pos=0, context=[dict(paragraph_id="p00", title="Ada", sentences=["Ada wrote it."])], supporting_facts=[dict(title="Ada", sentence_id=0)])
    return spark.createDataFrame([base | over], HOTPOT_SOURCE)


def judge_rows(spark):
    rows = [(f"r{k}", lang, unit, score, "train", 1 + (k == 3)) for k, (lang, unit, score) in enumerate([("de", "answer", 90), ("de", "answer", 50), ("fr", "answer", None), ("fr", "question", 70)])]
    return spark.createDataFrame(rows, "record_id string, language string, unit string, score int, source_split string, attempts int")


def test_judge_report(spark):
    rows = {(r.level, r.language, r.unit): r for r in judging.report(judge_rows(spark)).collect()}
    o = rows["overall", None, None]
    assert (o.n, o.judged, o.failed, o.mean, o.retries) == (4, 3, 1, 70, 1) and rows["language_unit", "de", "answer"].mean == 70
    s = judging.score_summary(judge_rows(spark)).first()
    assert (s.n, s.median, s.below_60, s.below_80, s.from_90, s.sd) == (3, 70, 1, 2, 1, 20)
    assert {r.level for r in judging.summary_cube(judge_rows(spark)).collect()} == {"overall", "unit", "language", "language_unit", "split"}


def test_bootstrap(spark):
    rows = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("record_id"), F.when(F.col("id") % 2 == 0, "de").otherwise("fr").alias("language"), F.lit("answer").alias("unit"), (F.col("id") % 101).cast("int").alias("score"), F.lit("train").alias("source_split"))
    d = judging.bootstrap(rows, replicates=400, seed=5)
    i = judging.interval(d).where("unit = 'answer'").first()
    mean, sd = rows.agg(F.avg("score"), F.stddev("score")).first()
    half = 1.96 * sd / 4000**0.5
    assert i.replicates == 400 and abs(i.mean - mean) < half / 2 and abs((i.high - i.low) / 2 - half) < half / 4
    again = judging.interval(judging.bootstrap(rows.repartition(9), replicates=400, seed=5)).where("unit = 'answer'").first()
    assert again == i
    diff = judging.bootstrap_difference(d, judging.bootstrap(rows, replicates=400, seed=6)).where("unit is null").first()
    assert diff.low < 0 < diff.high


def test_sample_does_not_depend_on_order(spark):
    rows = [instance(f"i{k}", "fa", [candidate("p00", "fa")], source_id=f"s{k}") for k in range(8)]
    sources = spark.createDataFrame([(f"s{k}", "Q", "A") for k in range(8)], "source_id string, question string, answer string")
    pick = lambda df: sorted((r.unit, r.instance_id, r.n) for r in judging.sample(judging.units(df, sources), paragraphs=3, questions=2, answers=2, seed=42).collect())
    first = pick(frame(spark, *rows))
    assert first == pick(frame(spark, *rows[::-1]).repartition(3)) and len(first) == 7
    assert {i for u, i, _ in first if u == "question"} == {i for u, i, _ in first if u == "answer"}


def test_balance(spark):
    rows = judge_rows(spark).where("unit = 'answer'")
    with pytest.raises(keys.ContractError):
        judging.require_balance(rows, {"answer": 2}, languages=2)
    judging.require_balance(rows.where("language = 'de'"), {"answer": 2}, languages=1)


def legacy(spark, context, question='"q"', answer='"a"', target='"Persian"'):
    df = spark.createDataFrame([(context, question, answer, target)], "c string, q string, a string, t string")
    return records.legacy_issues(
        df.select(F.parse_json("c").alias("context"), F.parse_json("q").alias("question"), F.parse_json("a").alias("answer"), F.parse_json("t").alias("target_language"), F.expr("array(named_struct('title', 'T', 'sentences', array('s')))").alias("source_context"), F.expr("array(named_struct('paragraph_id', 'p00', 'sentence_id', 0))").alias("source_facts"))
    ).first().issues


def test_legacy_issues(spark):
    assert legacy(spark, '[["T", ["s"], "Persian"]]') == []
    assert legacy(spark, '[["T", [], "Persian"]]') == ["empty_paragraph", "sentence_cardinality_mismatch", "supporting_fact_out_of_bounds"]
    assert legacy(spark, '"x"') == ["invalid_context_type"] and legacy(spark, "[]") == ["candidate_count_mismatch"]
    assert legacy(spark, '[["T", ["s"]]]') == ["invalid_candidate_shape"]
    assert legacy(spark, '[[1, ["s", 2], "Klingon"]]') == ["invalid_sentences_type", "invalid_title_type", "sentence_cardinality_mismatch", "unsupported_language"][:2] + ["unsupported_language"]
    assert legacy(spark, '[["T", ["s"], "Persian"]]', question="1", answer='" "', target="null") == ["empty_answer", "invalid_language_type", "invalid_question_type"]


def test_assignment_units(spark):
    rows = lambda m: spark.createDataFrame([({"source-1": m},)], "assignments map<string, map<string, string>>")
    found = records.assignment_units(rows({"paragraph:1": "de", "question-answer": "fa", "paragraph:0": "en"})).orderBy("ord").collect()
    assert [(r.unit_id, r.language) for r in found] == [("question-answer", "fa"), ("paragraph:0", "en"), ("paragraph:1", "de")]
    for bad in ({"question-answer": "fa", "paragraph:1": "de"}, {"paragraph:0": "de"}, {"question-answer": "xx"}, {"question-answer": "fa", "paragraph:x": "de"}):
        with pytest.raises(keys.ContractError):
            records.assignment_units(rows(bad))


def test_duplicate_titles(spark):
    assert [r.id for r in records.duplicate_titles(frame(spark, instance("a", candidates=[candidate("p0", title="Ａda "), candidate("p1", title="ADA")]), instance("b"))).collect()] == ["a"]
