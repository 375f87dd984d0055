import hashlib
import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mhqa.functions import hashing as H
from mhqa.functions import scoring as S
from mhqa.functions import text as X
from mhqa.schemas import CODES, LEGACY_ORDER, languages


def one(spark, column, **values):
    return spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")).alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


def test_language_inventory(spark):
    rows = languages(spark).orderBy("ord").collect()
    assert len(rows) == 24 and rows[1].code == "zh" and sorted(LEGACY_ORDER) == sorted(CODES) and [r.code for r in sorted(rows, key=lambda r: r.legacy_ord)][2:4] == ["es", "hi"]


def test_assignment_golden(spark):
    assert one(spark, H.assign_language(F.col("s"), F.col("u"), 42), s="source-1", u="question-answer") == "ru"


def test_assignment_against_python(spark):
    ids = [f"s{k}" for k in range(200)]
    rows = spark.createDataFrame([(i,) for i in ids], "s string").select("s", H.assign_language(F.col("s"), F.lit("paragraph:3"), 7).alias("l"), H.train_view(F.col("s"), "view|").alias("v")).collect()
    for r in rows:
        number = int.from_bytes(hashlib.sha256(f"7\x1f{r.s}\x1fparagraph:3".encode()).digest()[:8], "big")
        assert r.l == CODES[number % 24] and r.v == int.from_bytes(hashlib.sha256(f"view|{r.s}".encode()).digest()[:8], "big") % 24


def test_canonical_json(spark):
    record = F.struct(F.lit("bé\"\n").alias("z"), F.lit(None).cast("string").alias("a"), F.lit(3).alias("m"))
    assert spark.range(1).select(H.canonical_json(record)).first()[0] == json.dumps({"z": 'bé"\n', "a": None, "m": 3}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_checksum_ignores_volatile_fields(spark):
    schema = "n int, id string, question string, provenance struct<created_at: string, retry_count: int, validation_status: string, assignment_manifest_sha256: string, decoding: string>, checksum string"
    variants = [("t1", 0, "", "Who?"), ("t2", 5, None, "Who?"), ("t1", 0, "f" * 64, "Who?"), ("t1", 0, "", "What?")]
    rows = spark.createDataFrame([(n, "1", q, (c, r, "x", m, '{"temperature":0}'), "old") for n, (c, r, m, q) in enumerate(variants)], schema)
    a, b, c, d = (r.h for r in rows.select("n", H.checksum(F.struct("id", "question", "provenance", "checksum")).alias("h")).orderBy("n").collect())
    assert a == b and len({a, c, d}) == 3


def test_record_hash_conventions(spark):
    r = F.struct(F.lit("x").alias("a"), F.lit("h").alias("own"))
    removed, emptied = spark.range(1).select(H.record_hash(r, "own"), H.record_hash(r, "own", emptied=True)).first()
    assert removed == hashlib.sha256(b'{"a":"x"}').hexdigest() and emptied == hashlib.sha256(b'{"a":"x","own":""}').hexdigest()


@pytest.mark.parametrize(("text", "blank"), [("", True), (" \t 　", True), ("\x1c\x1f", True), ("a", False), (None, True)])
def test_blank(spark, text, blank):
    assert spark.range(1).select(X.is_blank(F.lit(text).cast("string"))).first()[0] is blank


def test_normalisations(spark):
    assert one(spark, X.normalize_legacy(F.col("t")), t="The  café—bar, a DOG!") == "café—bar dog"
    assert one(spark, X.normalize_unicode(F.col("t"), F.lit("en")), t="The café—bar") == "café bar"
    assert one(spark, X.normalize_unicode(F.col("t"), F.lit("de")), t="Straße") == one(spark, X.normalize_unicode(F.col("t"), F.lit("de")), t="STRASSE")
    assert one(spark, X.normalize_legacy(F.col("t")), t="Straße") != one(spark, X.normalize_legacy(F.col("t")), t="STRASSE")
    assert one(spark, X.unicode_tokens(F.col("t"), F.lit("zh")), t="北京 大学") == list("北京大学")
    assert one(spark, X.unicode_tokens(F.col("t"), F.lit("en")), t="１２ dogs") == ["12", "dogs"]


def score(spark, p, g):
    return one(spark, S.answer_score(F.col("p"), F.col("g"), F.col("pt"), F.col("gt")), p=p, g=g, pt=p.split(), gt=g.split())


def test_answer_scores(spark):
    r = score(spark, "blue whale", "blue whale")
    assert (r.em, r.p, r.r, r.f1) == (1, 1, 1, 1)
    r = score(spark, "yes", "no")
    assert (r.em, r.f1) == (0, 0)
    assert score(spark, "", "").f1 == 1 and score(spark, "", "x").f1 == 0 and score(spark, "x", "").p == 0


def test_joint_score(spark):
    facts = lambda *p: F.array(*[F.struct(F.lit(x).alias("p"), F.lit(y).alias("s")) for x, y in p])
    support = S.support_score(facts(("p0", 0)), facts(("p0", 0), ("p1", 1)))
    answer = S.answer_score(F.lit("blue whale"), F.lit("blue whale"), F.array(F.lit("blue"), F.lit("whale")), F.array(F.lit("blue"), F.lit("whale")))
    r = spark.range(1).select(S.joint_score(answer, support).alias("j"), support.alias("s")).first()
    assert (r.s.p, r.s.r, r.j.p, r.j.r) == (1, 0.5, 1, 0.5) and r.j.f1 == pytest.approx(2 / 3)


@settings(max_examples=15, deadline=None)
@given(a=st.lists(st.sampled_from("abc"), max_size=6), b=st.lists(st.sampled_from("abc"), max_size=6))
def test_bag_overlap(spark, a, b):
    assert one(spark, S.bag_overlap(F.col("a"), F.col("b")), a=a, b=b) == sum((Counter(a) & Counter(b)).values())


def test_bins(spark):
    values = spark.createDataFrame([(None,), (0.0,), (0.5,), (1.0,)], "v double").select(S.mismatch_bin(F.col("v")), S.entropy_bin(F.coalesce("v", F.lit(0.0)))).collect()
    assert [tuple(v) for v in values] == [("not-applicable", "zero"), ("zero", "zero"), ("partial", "intermediate"), ("full", "maximal")]
    assert [r[0] for r in spark.createDataFrame([(k,) for k in (1, 2, 4, 5, 8, 9)], "n int").select(S.count_bin(F.col("n"))).collect()] == ["one", "two-to-four", "two-to-four", "five-to-eight", "five-to-eight", "nine-or-more"]


@pytest.mark.parametrize(("text", "value"), [("SCORE: 91", 91), ("fine 12 then 250", 100), ("none", None), ("score - 7 of 10", 7), ("1234", None)])
def test_score_from_text(spark, text, value):
    assert one(spark, S.score_from_text(F.col("t")), t=text) == value


def test_explanation_and_origin(spark):
    assert one(spark, S.explanation(F.col("t")), t="Good.\nSCORE: 91") == "Good."
    origin = lambda s, v, r: one(spark, S.score_origin(F.col("s"), F.col("v"), F.col("r")), s=s, v=v, r=r)
    assert [origin(91, "SCORE: 91", ""), origin(91, "a 91", ""), origin(91, "", "SCORE 91"), origin(91, "", "is 91"), origin(91, "SCORE: 90", "SCORE: 91")] == [*S.ORIGINS, None]
