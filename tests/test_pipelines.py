import hashlib
import json

import pytest
from test_releases import python_checksum

from mhqa.cli import main
from mhqa.operators.keys import ContractError
from mhqa.plans import pipelines
from mhqa.schemas import CODES, LANGUAGES, LEGACY_ORDER
from mhqa.sources import readers

NAMES = {c: n for c, n, _ in LANGUAGES}


def source(tmp_path, n=1):
    rows = [{"_id": f"rec{k}", "question": "Q", "answer": "A", "type": "bridge", "level": "hard", "supporting_facts": [["Lake Orn", 0]], "context": [["Lake Orn", ["It is deep."]], ["Orn Mill", ["It is old."]]]} for k in range(n)]
    p = tmp_path / "source.json"
    p.write_text(json.dumps(rows))
    return str(p)


def shard(tmp_path, contexts, languages, name="shard.json"):
    n = range(len(contexts))
    p = tmp_path / name
    p.write_text(json.dumps({"translate_context": {str(k): contexts[k] for k in n}, "translate_question": {str(k): f"q{k}" for k in n}, "translate_answer": {str(k): "a" for k in n}, "target_language": {str(k): NAMES[languages[k]] for k in n}}))
    return str(p)


GOOD = [["Ornsee", ["Er ist tief."], "German"], ["Moulin", ["Il est vieux."], "French"]]


def test_validation_import(spark, tmp_path, capsys):
    bad = [["Ornsee", [], "German"], ["Moulin", ["Il est vieux."], "French"]]
    s = shard(tmp_path, [GOOD, bad], ["de", "de"])
    assert main(["import-legacy", source(tmp_path, 2), str(tmp_path / "out"), s, "--split", "validation"], spark) == 1
    out = json.loads(capsys.readouterr().out)
    assert (out["accepted"], out["quarantined"]) == (1, 1) and {"sentence_cardinality_mismatch", "supporting_fact_out_of_bounds"} <= out["issues"].keys()
    text = "".join(p.read_text() for p in (tmp_path / "out" / "accepted").glob("part*"))
    made = json.loads(text)
    assert made["id"] == "xhp-validation-rec0" and made["candidates"][1]["source_title"] == "Orn Mill" and made["supporting_facts"] == [{"paragraph_id": "p00", "role": "support", "sentence_id": 0}]
    assert made["checksum"] == python_checksum(made)
    raw = [json.loads(x) for p in sorted((tmp_path / "out" / "raw").glob("part*")) for x in p.read_text().splitlines()]
    assert [r["outcome"] for r in raw] == ["accepted", "quarantined"] and all(len(r["raw_sha256"]) == 64 for r in raw)
    first = {"target_language": "German", "translate_answer": "a", "translate_context": GOOD, "translate_question": "q0"}
    assert raw[0]["raw_sha256"] == hashlib.sha256(json.dumps(first, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    # The same again, the second row corrected.
    fixed = made | {"id": "xhp-validation-rec1", "source_id": "rec1", "answer": "b"}
    fix = lambda h, **over: (tmp_path / "fix.jsonl").write_text(json.dumps({"legacy_id": "xhp-validation-rec1", "raw_sha256": h, "reason": "lost", "replacement": fixed | over}) + "\n")
    again = lambda: pipelines.import_legacy(spark, [s], source(tmp_path, 2), str(tmp_path / "c"), split="validation", corrections=str(tmp_path / "fix.jsonl"))
    fix(raw[1]["raw_sha256"])
    assert (again()["accepted"], again()["corrections"]) == (2, 1)
    fix("f" * 64)
    assert "correction_raw_hash_mismatch" in again()["issues"]
    fix(raw[1]["raw_sha256"], supporting_facts=[{"paragraph_id": "p01", "sentence_id": 0, "role": "support"}])
    assert "invalid_correction" in again()["issues"]
    fix(raw[1]["raw_sha256"], question=" ")
    assert "invalid_correction" in again()["issues"]


def test_train_import_needs_the_order(spark, tmp_path):
    good = shard(tmp_path, [GOOD] * 24, LEGACY_ORDER)
    assert pipelines.import_legacy(spark, [good], source(tmp_path), str(tmp_path / "o"), split="train")["accepted"] == 24
    with pytest.raises(ContractError, match="target order"):
        pipelines.import_legacy(spark, [shard(tmp_path, [GOOD] * 24, LEGACY_ORDER[::-1], "r.json")], source(tmp_path), str(tmp_path / "p"), split="train")
    with pytest.raises(ContractError, match="contexts"):
        pipelines.import_legacy(spark, [shard(tmp_path, [GOOD] * 23 + [GOOD[:1] + [["Mühle", ["Alt."], "German"]]], LEGACY_ORDER, "t.json")], source(tmp_path), str(tmp_path / "r"), split="train")
    with pytest.raises(ContractError):
        pipelines.import_legacy(spark, [shard(tmp_path, [GOOD] * 23, LEGACY_ORDER[:23], "s.json")], source(tmp_path), str(tmp_path / "q"), split="train")


def record():
    c = {"id": "p00", "title": "Ada", "sentences": ["Ada wrote it."], "language": "en", "source_title": "Ada", "source_sentences": ["Ada wrote it."]}
    p = dict(schema_version="v", source_dataset="d", source_license="l", assignment_version="a", translation_model="m", translation_revision="r", prompt_version="p", prompt_hash="a" * 64, retry_count=0, created_at="t", validation_status="s")
    return {"id": "xhp-validation-1", "source_id": "1", "source_split": "validation", "question": "Who?", "answer": "Ada", "question_language": "en", "answer_language": "en", "candidates": [c], "supporting_facts": [{"paragraph_id": "p00", "sentence_id": 0, "role": "support"}], "question_type": "bridge", "difficulty": "hard", "provenance": p}


def _written(path, row):
    path.write_text(json.dumps(row) + "\n")
    return str(path)


def test_validate_evaluate_expand(spark, tmp_path, capsys):
    gold = tmp_path / "gold.jsonl"
    whole = readers.instances(spark, _written(gold, record())).first().asDict(recursive=True)
    _written(gold, record() | {"checksum": python_checksum(whole)})
    assert main(["validate", str(gold), "--strict", "--expected", "1"], spark) == 0 and main(["validate", str(gold), "--expected", "2"], spark) == 1
    predictions = tmp_path / "p.jsonl"
    predictions.write_text(json.dumps({"id": "xhp-validation-1", "answer": "ada", "supporting_facts": []}) + "\n" + json.dumps({"id": "other", "answer": None, "supporting_facts": []}) + "\n")
    out = pipelines.evaluate(spark, str(gold), str(predictions))
    assert (out["missing"], out["unexpected"]) == (0, 1) and next(s for s in out["sections"] if s["section"] == "overall")["answer_f1"] == 1
    texts = tmp_path / "t.jsonl"
    texts.write_text(json.dumps({"source_id": "1", "translations": {c: {"question": f"q {c}", "answer": "a"} for c in CODES}}) + "\n")
    assert pipelines.expand(spark, str(gold), str(texts), str(tmp_path / "views")) == 24


def test_configuration():
    assert pipelines.ModelConfig.of({"model": "m"}).max_retries == 2
    for bad in ({"model": "m", "x": 1}, {"model": ""}, {"model": "m", "workers": True}, {"model": "m", "temperature": 3.0}):
        with pytest.raises(ContractError):
            pipelines.ModelConfig.of(bad)
    assert pipelines.connection("http://127.0.0.1:8000/v1/", None) == ("http://127.0.0.1:8000/v1", "none")
    for url, key in (("http://example.org", None), ("ftp://localhost", "k"), ("http://u:p@localhost", "k"), ("http://localhost?a=1", "k")):
        with pytest.raises(ContractError):
            pipelines.connection(url, key)


def test_card(tmp_path):
    good = "---\nlicense: x\nsize_categories:\n- 10K<n<100K\nlanguage:\n" + "".join(f"- {c}\n" for c in CODES) + "configs:\n- config_name: d\n  data_files: x\n---\n# Card\n"
    assert pipelines.card_problems(good) == [] and pipelines.card_problems("# x") == ["front matter"] and "language de" in pipelines.card_problems(good.replace("- de\n", ""))


def echo():
    def make():
        import json as js

        def client(request):
            content = js.loads(js.loads(request)[1]["content"])
            if "unit" in content:
                return js.dumps({"score": 80, "rationale": "fine", "error_tags": []})
            return js.dumps({"translations": [f"x {t}" for t in content["texts"]]})

        return client

    return make


def test_generate_judge_release_commands(spark, tmp_path, capsys):
    config, prompt, base = tmp_path / "c.json", tmp_path / "p.txt", source(tmp_path, 3)
    config.write_text(json.dumps({"model": "m"}))
    prompt.write_text("Translate.")
    out = str(tmp_path / "g")
    assert main(["generate", str(config), base, out, "--split", "validation", "--prompt", str(prompt)], spark, make_client=echo()) == 0
    assert json.loads(capsys.readouterr().out)["written"] == 3
    made = tmp_path / "made.jsonl"
    rows = spark.read.parquet(f"{out}/records").drop("signature")
    made.write_text("".join(json.dumps(r.asDict(recursive=True)) + "\n" for r in rows.collect()))
    assert main(["validate", str(made), "--expected", "3"], spark) == 0
    capsys.readouterr()
    config.write_text(json.dumps({"model": "m", "paragraphs": 2}))
    assert main(["judge", str(config), str(made), base, str(tmp_path / "j")], spark, make_client=echo()) == 0
    assert main(["release", str(made), base, str(tmp_path / "r"), "--split", "validation", "--prefix", "set:"], spark) in (0, 1)
    manifest = json.loads((tmp_path / "r" / "manifest.json").read_text())
    assert sum(manifest["status"].values()) == 3 and manifest["files"][0]["rows"] == 3


def test_upload_stops_before_sending(spark, tmp_path, capsys):
    card, data = tmp_path / "README.md", tmp_path / "train.jsonl"
    data.write_text("{}")
    head = "---\nlicense: x\nsize_categories:\n- 10K<n<100K\nlanguage:\n" + "".join(f"- {c}\n" for c in CODES) + "configs:\n- config_name: d\n  data_files:\n  - path: train.jsonl\n---\n"
    card.write_text(head)
    assert main(["upload", str(card), f"train.jsonl={data}", "--dry-run"], spark) == 0 and json.loads(capsys.readouterr().out)["files"]["train.jsonl"]["bytes"] == 2
    card.write_text(head.replace("10K<n<100K", "many").replace("train.jsonl", "x.jsonl"))
    with pytest.raises(ContractError, match="size category.*path train.jsonl"):
        main(["upload", str(card), f"train.jsonl={data}", "--dry-run"], spark)


def test_configurations_from_files(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "answers": 3}))
    assert pipelines.JudgeConfig.of(pipelines.load_config(str(tmp_path / "c.json"))).answers == 3
    for bad in ("[1]", '{"model": "m", "answers": 0}', '{"model": "m", "seed": "x"}'):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(ContractError):
            pipelines.JudgeConfig.of(pipelines.load_config(str(tmp_path / "c.json")))
