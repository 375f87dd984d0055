import json
import os

import pytest
from pyspark.sql import functions as F

from mhqa.operators.keys import ContractError
from mhqa.plans import runs
from mhqa.schemas import HOTPOT_SOURCE
from mhqa.streaming import generation as G


def sources(spark, n=3):
    rows = [
        (f"s{k}", f"Who built mill {k}?", "Ada", "bridge", "hard", k, [("p00", "Mill", ["A mill.", "It stands."]), ("p01", "Lake", ["A lake."])], [("Mill", 1)]) for k in range(n)
    ]
    return spark.createDataFrame(rows, HOTPOT_SOURCE)


def translator(fail="", log=None):
    def make():
        import json as js

        def client(request):
            content = js.loads(js.loads(request)[1]["content"])
            if log:
                with open(log, "a") as file:
                    file.write(request + "\n")
            if fail and fail in str(content["texts"]):
                return '{"translations": []}'
            return js.dumps({"translations": [f"{content['target_language']} {t}" for t in content["texts"]]})

        return client

    return make


PROVENANCE = {"schema_version": "v2", "source_dataset": "d", "source_license": "l", "assignment_version": "a", "assignment_manifest_sha256": "", "seed": 7, "translation_model": "m", "translation_revision": "r", "prompt_version": "p",
              "prompt_hash": "a" * 64, "decoding": '{"temperature":0}'}


def all_in(*languages):
    def assign(units):
        names = F.array(*map(F.lit, languages))
        return units.withColumn("language", F.get(names, F.when(F.col("unit_id") == "question-answer", 0).otherwise(F.pmod(F.regexp_extract("unit_id", r"(\d+)$", 1).cast("int"), F.lit(len(languages))))))

    return assign


def test_generation(spark, tmp_path):
    out = str(tmp_path / "out")
    seen = []
    run = lambda df, make, **over: runs.generate(spark, df, out, make, all_in("de", "en"), split="validation", provenance=PROVENANCE | over, system="Translate.", retries=1, checkpoint_every=2, progress=seen.append)
    first = run(sources(spark), translator(fail="mill 1"))
    assert first == {"input": 3, "completed_before": 0, "attempted": 3, "written": 2, "failed": 1, "output": 2, "errors": 1} and seen[-1] == {"attempted": 3, "of": 3, "written": 2}
    r = spark.read.parquet(f"{out}/records").where("source_id = 's0'").first()
    assert r.question == "de Who built mill 0?" and r.candidates[0].sentences == ["de A mill.", "de It stands."] and r.candidates[1].title == "Lake" and r.candidates[1].language == "en" and r.supporting_facts[0].paragraph_id == "p00"
    e = spark.read.parquet(f"{out}/ledger").first()
    assert (e.source_id, e.origin, e.code) == ("s1", "transformation", "structured_response_exhausted")
    assert spark.read.parquet(f"{out}/audit").where("error is not null").count() == 2
    second = run(sources(spark), translator())
    assert (second["completed_before"], second["attempted"], second["written"], second["errors"], second["output"]) == (2, 1, 1, 0, 3)
    assert run(sources(spark), translator())["attempted"] == 0
    with pytest.raises(ContractError, match="another configuration"):
        run(sources(spark), translator(), translation_model="other")
    with pytest.raises(ContractError, match="without input"):
        run(sources(spark, 2), translator())
    with pytest.raises(ContractError, match="repeat"):
        run(sources(spark).unionByName(sources(spark)), translator())


def test_unresolved_titles_go_to_the_ledger(spark, tmp_path):
    odd = sources(spark, 1).withColumn("supporting_facts", F.expr("array(named_struct('title', 'Sea', 'sentence_id', 0))"))
    out = runs.generate(spark, odd, str(tmp_path / "o"), translator(), all_in("de"), split="train", provenance=PROVENANCE, system="x")
    assert (out["written"], out["failed"]) == (0, 1) and spark.read.parquet(str(tmp_path / "o" / "ledger")).first().code == "invalid_source_annotation"


def test_assignments(spark):
    units = runs.units_of(sources(spark, 1))
    assert sorted(r.unit_id for r in units.collect()) == ["paragraph:0", "paragraph:1", "question-answer"]
    assert {r.language for r in runs.by_hash(42)(units).collect()} and runs.by_hash(42)(units).collect() == runs.by_hash(42)(units).collect()
    manifest = spark.createDataFrame([("s0", u, "fa") for u in ("question-answer", "paragraph:0", "paragraph:1")] + [("zz", "question-answer", "de")], "source_id string, unit_id string, language string")
    assert {r.language for r in runs.by_manifest(manifest)(units).collect()} == {"fa"}
    with pytest.raises(ContractError):
        runs.by_manifest(manifest.where("unit_id != 'paragraph:1'"))(units).count()


def judge_client(broken="", log=None):
    def make():
        import json as js

        def client(request):
            content = js.loads(js.loads(request)[1]["content"])
            if log:
                with open(log, "a") as file:
                    file.write(content["candidate_text"] + "\n")
            return "nothing" if broken and broken in content["candidate_text"] else js.dumps({"score": 90, "rationale": "fine", "error_tags": []})

        return client

    return make


UNITS = "instance_id string, source_id string, source_split string, language string, unit string, paragraph_id string, source_text string, candidate_text string, context_question string"


def test_judge_run(spark, tmp_path):
    rows = [(f"i{k}", f"s{k}", "train", lang, unit, None, "src", f"text {k} {lang}", "Q?" if unit == "answer" else None) for k in range(3) for lang in ("de", "fr") for unit in ("question", "answer")]
    units, out, log = spark.createDataFrame(rows, UNITS), str(tmp_path / "j"), str(tmp_path / "log")
    run = lambda make, **over: runs.judge(spark, units, out, make, prompts={"answer": "Judge the answer.", "other": "Judge."}, model=over.get("model", "m"), prompt_version="1", retries=0, paragraphs=1, questions=2, answers=2, seed=3)
    report = run(judge_client(broken="fr"))
    assert {(r["level"], r["n"], r["failed"]) for r in report if r["level"] == "overall"} == {("overall", 8, 4)}
    report = run(judge_client(log=log))
    assert next(r for r in report if r["level"] == "overall")["failed"] == 0 and len(open(log).read().split("\n")) == 5  # the failed ones alone
    kept = spark.read.parquet(f"{out}/records")
    assert kept.count() == 8 and json.load(open(f"{out}/report.json"))["levels"][0]["level"] == "overall" and kept.select("prompt_hash").distinct().first()[0] == runs.prompt_identity("Judge the answer.", "Judge.")
    with pytest.raises(ContractError, match="another configuration"):
        run(judge_client(), model="n")
    with pytest.raises(ContractError, match="frozen"):
        runs.judge(spark, units.where("instance_id != 'i0'"), out, judge_client(), prompts={"answer": "a", "other": "b"}, model="m", prompt_version="1", paragraphs=1, questions=2, answers=2, seed=3)
    assert not os.path.exists(f"{out}.lock")


def test_order_of_the_pool():
    import time

    def slow(x):
        time.sleep(0.02 * (3 - x % 3))
        return x * 2

    assert list(G.in_order(range(20), slow, 4)) == [2 * k for k in range(20)]


def test_chat_client():
    made = []
    client = G.ChatClient(lambda: made.append(1) or "c", lambda c, m: [{"content": " yes ", "finish_reason": "stop"}])
    request = json.dumps([{"role": "user", "content": "x"}])
    assert not made and client(request) == "yes" and client(request) == "yes" and made == [1]
    for choices in ([], [{"content": None}], [{"content": "x", "finish_reason": "length"}]):
        with pytest.raises(ValueError):
            G.ChatClient(lambda: 1, lambda c, m: choices)(request)
    for bad in ("[]", '[{"role": "x", "content": "y"}]', '[{"role": "user", "content": " "}]'):
        with pytest.raises(ValueError):
            client(bad)


def test_errors_are_stored_without_keys():
    def client(text):
        raise RuntimeError("denied for key=abcdefghijkl\nagain")

    value, attempts, error, audit = G.attempts_of("x", lambda: client, str, 1)
    assert value is None and attempts == 2 and "abcdefghijkl" not in error and "\n" not in error and len(audit) == 2


def test_unreadable_sink_is_an_error(spark, tmp_path):
    (tmp_path / "sink").mkdir()
    (tmp_path / "sink" / "x.parquet").write_text("no parquet")
    assert G.existing(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark raises
        G.existing(spark, str(tmp_path / "sink"))


def test_report_order():
    rows = [{"level": "language_unit", "language": "sv", "unit": "answer"}, {"level": "language_unit", "language": "en", "unit": "question"}, {"level": "overall", "language": None, "unit": None}, {"level": "unit", "language": None, "unit": "answer"}]
    assert [r["level"] for r in runs.ordered_report(rows)] == ["overall", "unit", "language_unit", "language_unit"] and runs.ordered_report(rows)[2]["language"] == "en"
