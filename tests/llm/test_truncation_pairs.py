import pytest
from pyspark.sql import functions as F

from mhqa.llm import pairs as P
from mhqa.llm import truncation as T

CANDIDATES = "candidates array<struct<id: string, title: string, sentences: array<string>, language: string, source_title: string, source_sentences: array<string>>>"
SCHEMA = f"id string, source_id string, shard string, question string, answer string, question_language string, {CANDIDATES}, extra int"


@pytest.mark.parametrize(("text", "body", "ended", "marked"), [("Done here.", "Done here", True, False), ("Done here", "Done here", False, False), ("cut he [...]", "cut he", False, True), ("cut he…", "cut he", False, True), ("cut\\u00", "cut", False, True), ("a&am", "a", False, True), ("", "", False, False), ("...", "", True, False), ("完了。", "完了", True, False)])
def test_body(text, body, ended, marked):
    assert T.body(text) == (body, ended, marked)


def test_mask():
    assert T.mask("Bèkin Lørnño was born on July 5, 1768 in Goa") == "N was born on N 0, 0 in N" and T.mask('the book "A B" and "C') == "the book § and “N"


def test_record_checks():
    record = "In Vülgrad 21765 people live. Rasar Rüidis left."
    assert T.cut_in_record("born in Vül", record) and not T.cut_in_record("born in Vülgrad", record) and T.cut_in_record("about 2176", record) and not T.cut_in_record("in x", record)
    assert T.continued_in_record("Rasar", record) and not T.continued_in_record("Vülgrad", record)


def test_context_hashes():
    a, b = T.context_hashes("the old mill"), T.context_hashes("by the old mill")
    assert [h[-1] for h in a][-1:] == [h[-1] for h in b][-1:]  # the shortest context of both ends is the same
    assert T.context_hashes("x") == [] or all(len(h) for h in T.context_hashes("x"))


def instances(spark, repeat=1):
    towns = ["Goa", "Vülgrad", "Mornberg", "Tamby", "Hèmford", "Rastörn"]
    rows = []
    for k in range(60):
        town, n = towns[k % 6], 1800 + k
        sentences = [f"{town} is a small town on the river Lila with about {n}0 inhabitants.", f"The town hall of {town} was built in {n} after plans by Tom Berg."]
        rows.append((f"i{k}", f"s{k}", "a" if k % 2 else "b", f"When was the town hall of {town} built near the river Lila?", str(n), "en", [("p0", town, sentences, "en", town, sentences)], 1))
    full = rows[0][6][0][5]
    cut = [("p0", "Goa", ["Goa is a small town on the river Lila with about", full[1][:-1]], "en", "Goa", full)]
    rows += [("cut", "s0", "a", rows[0][3], "18", "en", cut, 1)] * repeat
    rows += [("null", None, None, None, None, None, None, None), ("empty", "e", "a", "", "", "", [("p0", None, [None, ""], None, None, None)], 1)]
    return spark.createDataFrame(rows, SCHEMA)


def languages(spark):
    return spark.createDataFrame([("en", "English"), ("de", "German")], "code string, name string")


def test_truncated(spark):
    found = {tuple(r) for r in T.truncated(instances(spark, 2), languages(spark)).collect()}
    assert ("cut", "p0", 0) in found and ("cut", "p0", 1) not in found and ("cut", "", -1) in found and {i for i, _, _ in found} == {"cut"}
    rates = {(r.shard, r.column): (r.texts, r.cut) for r in T.truncation_rates(instances(spark, 2), languages(spark)).collect()}
    assert rates["a", "sentences"] == (62, 1) and rates["b", "sentences"] == (60, 0)
    assert T.truncated(instances(spark).limit(0), languages(spark)).count() == 0


@pytest.mark.parametrize("answer", [None, "", "  ", "—", "N/A", "null", "...", "[]", "​", "[answer]", "?"])
def test_empty(answer):
    assert P.is_empty(answer)


@pytest.mark.parametrize("answer", ["no", "нет", "0", "Noa", "是的"])
def test_not_empty(answer):
    assert not P.is_empty(answer)


def test_copy():
    q = "Which town lies on the river Graeis and is the birthplace of Tom Berg?"
    assert P.is_copy(q, q) and P.is_copy(q, q.lower() + " " + q) and P.is_copy(q, "town lies on the river Graeis and is the birthplace of Tom") and P.is_copy(q, "Q: " + q)
    assert not P.is_copy(q, "Goa is a small town on the river Graeis with about 7000 inhabitants.") and not P.is_copy(q, "Tom Berg") and not P.is_copy(None, "x") and not P.is_copy(q, None)
    assert not P.is_copy("谁创立了由Vèma首任负责、总部设在Goa的机构？", "Bralkhia由Viar于1909年创立，总部设在Goa。")


@pytest.mark.parametrize("answer", ["I am sorry, but I cannot answer this question.", "Je préfère ne pas me prononcer.", "Als Sprachmodell darf ich dazu keine Auskunft geben.", "к сожалению, я не могу ответить на этот вопрос.", "情報が足りないため回答できません。", "我不便回应这个问题。", "ترجیح می‌دهم پاسخی ندهم.", "أفضل عدم الرد على هذا.", "उत्तर देने के लिए जानकारी काफी नहीं है।", "Wolę na to nie odpowiadać."])
def test_refusal(answer):
    assert P.is_refusal(answer, "Goa is a town.")


@pytest.mark.parametrize("answer", ['Tom wrote the book "I Cannot Answer the Well".', "Goa", "It was answered in 1912 by Tom.", None, "«I Cannot Answer»"])
def test_no_refusal(answer):
    assert not P.is_refusal(answer, "Goa is a town, Tom a writer.")


def test_defects(spark):
    base = instances(spark)
    bad = [(f"b{k}", f"t{k}", "a", "When was the town hall of Goa built near the river Lila?", a, "en", None, 1) for k, a in enumerate([None, "N/A", "I am sorry, but I cannot answer this question.", "When was the town hall of Goa built near the river Lila?", "Goa is a small town on the river Lila with about"])]
    found = {r.id: r.defect for r in P.defects(base.unionByName(spark.createDataFrame(bad * 2, SCHEMA)), languages(spark)).collect()}
    assert {k: found.get(k) for k in ("b0", "b1", "b2", "b3", "b4")} == {"b0": "empty", "b1": "empty", "b2": "refusal", "b3": "copy", "b4": "truncated"}
    assert found["null"] == found["empty"] == "empty" and not any(k.startswith("i") for k in found)
    assert P.defects(base.limit(0), languages(spark)).count() == 0


def test_refusals_need_a_sign_of_declining():
    for t in ("assistant coach of the team", "theory of information retrieval", "the answer to everything", "help desk worker", "x", "answer"):
        assert not P.is_refusal(t, "") and not P.is_empty(t)
    for t in ("I am sorry, but I cannot answer this question.", "Ich kann diese Frage leider nicht beantworten.", "我不便回应这个问题。", "Prefiero no contestar.", "As a language model I am not able to provide that information."):
        assert P.is_refusal(t, ""), t
    assert P.is_empty("[answer]") and P.is_empty("<missing>") and P.is_empty("n/a")


def test_length_limits_and_sorted_neighbours(spark):
    rows = [(None, "abc", None, [], False, 30 + k % 9) for k in range(45)] + [("s", f"form {k}", None, [], False, 60) for k in range(20)]
    df = spark.createDataFrame(rows, "source_id string, form string, value string, question_languages array<string>, ended boolean, length int").withColumns({"defect": F.lit(None).cast("string"), "id": F.col("form")})
    assert [r.length for r in P.length_limits(df).collect()] == [60]
    cut = spark.createDataFrame([("1", "s", "in the old", False), ("2", "s", "in the old town", True), ("3", None, "in the old", False)], "id string, source_id string, form string, ended boolean")
    cut = cut.withColumns({"value": F.lit(None).cast("string"), "question_languages": F.array().cast("array<string>"), "defect": F.lit(None).cast("string")})
    assert [r.id for r in P.shortened(cut, None).collect()] == ["1"]
