import json
import os

import pytest
from pyspark.sql import functions as F

from mhqa.operators.keys import ContractError
from mhqa.sources import readers, sinks
from mhqa.streaming import generation


def lines(path, *rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_jsonl_keeps_line_numbers(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", {"a": 1}, "", {"a": 2})
    assert [(r.line, r.a) for r in readers.jsonl(spark, p, schema="a int").select("line", "record.a").orderBy("line").collect()] == [(1, 1), (3, 2)]
    for bad in ("[1]", "{", '{"a":1,"a":2}'):
        with pytest.raises(ContractError, match="2"):
            readers.jsonl(spark, lines(tmp_path / "b.jsonl", {"a": 1}, bad))


def test_predictions(spark, tmp_path):
    good = {"id": "x", "answer": "Ada", "supporting_facts": [{"paragraph_id": "p0", "sentence_id": 0}], "extra": 1}
    assert readers.predictions(spark, lines(tmp_path / "p.jsonl", good)).first().supporting_facts[0].sentence_id == 0
    for bad in ({"id": 1}, {**good, "supporting_facts": "x"}, {**good, "supporting_facts": [["p0", 0]]}, {**good, "supporting_facts": [{"paragraph_id": "p0", "sentence_id": True}]}, {**good, "supporting_facts": [{"paragraph_id": "p0", "sentence_id": -1}]}, {**good, "supporting_facts": good["supporting_facts"] * 2}):
        with pytest.raises(ContractError):
            readers.predictions(spark, lines(tmp_path / "q.jsonl", bad))
    with pytest.raises(ContractError, match="repeat"):
        readers.predictions(spark, lines(tmp_path / "r.jsonl", good, good))


def test_source_array(spark, tmp_path):
    row = lambda i, level: {"_id": i, "question": "Q", "answer": "A", "type": "bridge", "level": level, "supporting_facts": [["T", 0]], "context": [["T", ["s1", "s2"]]]}
    p = tmp_path / "s.json"
    p.write_text(json.dumps([row("a", "hard"), row("b", "easy"), row("c", "hard")]))
    found = readers.source_array(spark, str(p), difficulty="hard").orderBy("pos").collect()
    assert [(r.source_id, r.pos, r.selected_pos) for r in found] == [("a", 0, 0), ("c", 2, 1)] and found[0].context[0].paragraph_id == "p00" and found[0].supporting_facts[0].title == "T"


def test_column_shard(spark, tmp_path):
    n = 12
    shard = {"translate_context": {str(k): [["T", ["s"], "Persian"]] for k in range(n)}, "translate_question": {str(k): f"q{k}" for k in range(n)}, "translate_answer": {str(k): "a" for k in range(n)}, "target_language": {str(k): "Persian" for k in range(n)}}
    p = tmp_path / "s.json"
    p.write_text(json.dumps(shard))
    rows = readers.column_shard(spark, str(p), ordinal=3).select("shard_row", "shard_ord", F.try_variant_get("question", "$", "string").alias("q")).orderBy("shard_row").collect()
    assert [(r.shard_row, r.q) for r in rows] == [(k, f"q{k}") for k in range(n)] and rows[0].shard_ord == 3
    del shard["translate_answer"]["5"]
    p.write_text(json.dumps(shard))
    with pytest.raises(ContractError):
        readers.column_shard(spark, str(p))


def test_manifest_translations_ledger_locks(spark, tmp_path):
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"schema_version": "1", "assignment_version": "v", "assignments": {"s": {"question-answer": "fa"}}}))
    assert readers.manifest(spark, str(m)).first().assignments == {"s": {"question-answer": "fa"}}
    m.write_text(json.dumps({"assignment_version": "v", "assignments": {}}))
    with pytest.raises(ContractError):
        readers.manifest(spark, str(m))
    t = lines(tmp_path / "t.jsonl", {"source_id": "s", "translations": {"de": {"question": "q", "answer": "a"}}})
    assert readers.translations(spark, t).first().language == "de"
    o = tmp_path / "t.json"
    o.write_text(json.dumps({"s": {"de": {"question": "q", "answer": "a"}}}))
    assert readers.translations(spark, str(o)).first().question == "q"
    e = lines(tmp_path / "e.jsonl", {"source_id": "s", "message": "boom"})
    assert readers.ledger(spark, e).first().message == "boom"
    facts = readers.file_facts(spark, e)
    readers.require_locks(facts, facts.select("name", "bytes", "sha256"))
    with pytest.raises(ContractError):
        readers.require_locks(facts, facts.select("name", (F.col("bytes") + 1).alias("bytes"), "sha256"))


def test_shards_and_manifest(spark, tmp_path):
    df = spark.range(23).select("id", F.concat(F.lit("v"), "id").alias("v"))
    names = sinks.write_shards(df, str(tmp_path / "out"), "id", rows=10, split="train")
    assert names == [f"train-{k:05d}-of-00003.parquet" for k in range(3)]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out" / names[1])).collect()] == list(range(10, 20))
    made = sinks.manifest(spark, str(tmp_path / "out"), rows=23)
    assert len(made["files"]) == 3 and len(made["fingerprint"]) == 64 and [f["rows"] for f in made["files"]] == [10, 10, 3]


def test_staging_keeps_the_old_output(spark, tmp_path):
    path = str(tmp_path / "o")
    sinks.write_jsonl(spark.createDataFrame([(2, "ä"), (1, "b")], "k int, v string"), path, "k")
    text = "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    assert text == '{"k":1,"v":"b"}\n{"k":2,"v":"ä"}\n'

    def broken(stage):
        os.makedirs(stage)
        raise ValueError

    with pytest.raises(ValueError):
        sinks.staged(path, broken)
    assert os.path.exists(path) and not os.path.exists(f"{path}.staged") and not os.path.exists(f"{path}.lock")
    with sinks.exclusive(path), pytest.raises(ContractError):
        sinks.staged(path, broken)


def test_language_table(spark, tmp_path):
    sinks.language_table(spark.createDataFrame([("de", "answer", 2, 90.5), ("de", "question", 1, 80.0)], "language string, unit string, n long, mean double"), str(tmp_path / "t"))
    (part,) = [f for f in os.listdir(tmp_path / "t") if f.endswith(".csv")]
    assert "90.50000000" in (tmp_path / "t" / part).read_text()


def make_flaky():
    def flaky():  # a local function goes to the workers by value
        seen = {}

        def client(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "never" or text == "second" and seen[text] == 1:
                return "SCORE: 99"
            return json.dumps({"score": 91, "rationale": "fine", "error_tags": []})

        return client

    return flaky


def test_model_map(spark):
    rows = spark.createDataFrame([(1, "first"), (2, "second"), (3, "never"), (4, None)], "k int, r string")
    found = {r.k: r for r in generation.model_map(rows, "k", "r", make_flaky(), generation.judged, retries=1).collect()}
    assert (found[1].attempts, found[2].attempts, found[3].attempts, found[4].attempts) == (1, 2, 2, 0)
    assert json.loads(found[2].value)["score"] == 91 and found[3].value is None and found[3].error and found[4].error == "null request"


@pytest.mark.parametrize("text", ["SCORE: 99", '{"score":1,"score":2,"rationale":"x","error_tags":[]}', '{"score":true,"rationale":"x","error_tags":[]}', '{"score":101,"rationale":"x","error_tags":[]}', '{"score":1,"rationale":" ","error_tags":[]}', '{"score":1,"rationale":"x"}', '{"score":1,"rationale":"x","error_tags":[1]}'])
def test_judge_contract(text):
    with pytest.raises(ValueError):
        generation.judged(text)


def test_translation_contract():
    assert json.loads(generation.translated('{"translation":"x"}')) == {"translation": "x"}
    assert json.loads(generation.translated('{"translations":["a","b"]}', count=2))["translations"] == ["a", "b"]
    for text, n in (('{"translation":""}', None), ('{"translations":["a"]}', 2), ('{"translations":["a",""]}', 2)):
        with pytest.raises(ValueError):
            generation.translated(text, count=n)


def test_resume(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    os.makedirs(source)
    schema = "k string, r string"
    build = lambda df: generation.model_map(df, "k", "r", make_flaky(), generation.judged, retries=0)
    lines(tmp_path / "in" / "a.json", {"k": "1", "r": "x"}, {"k": "1", "r": "x"}, {"k": "2", "r": "y"})
    generation.resume(spark, source, schema, sink, checkpoint, build, key="k", signature="s1")
    lines(tmp_path / "in" / "b.json", {"k": "2", "r": "y"}, {"k": "3", "r": "z"})
    generation.resume(spark, source, schema, sink, checkpoint, build, key="k", signature="s1")
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == ["1", "2", "3"]
    with pytest.raises(ContractError):
        generation.resume(spark, source, schema, sink, checkpoint, build, key="k", signature="s2")


def test_numbered_lines_by_ranges(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("".join(f"line {k} {'ä' * (k % 7)}\n" for k in range(500)) + "last", encoding="utf-8")
    rows = readers.numbered_lines(spark, str(p), size=97).orderBy("line").collect()
    assert [r.line for r in rows] == list(range(1, 502)) and rows[321].value.startswith("line 321 ") and rows[-1].value == "last"


def test_json_stream():
    import io

    from mhqa.sources.streams import JsonStream

    value = {"a": {"0": [1, "x\u00e9 ]}", {"k": None}], "1": 12345}, "b": {}}
    text = json.dumps(value, ensure_ascii=False, indent=1)
    for chunk in (1, 3, 7, 4096):
        s = JsonStream(io.BytesIO(text.encode()), chunk)
        found = {key: {k: json.loads(s.value()) for k in s.entries()} for key in s.entries()}
        s.finish()
        assert found == value
        s = JsonStream(io.BytesIO(b"[1, 23, [4]]"), chunk)
        assert [json.loads(s.value()) for _ in s.entries()] == [1, 23, [4]]
    for bad in ("[1", "{1: 2}", "[1 2]", "[1] x"):
        with pytest.raises(ValueError):
            s = JsonStream(io.BytesIO(bad.encode()), 2)
            for _ in s.entries():
                s.value()
            s.finish()


@pytest.mark.skipif(not os.environ.get("LARGE_TESTS"), reason="writes 300 MB")
def test_large_shard(spark, tmp_path):
    n, text = 3000, "x" * 25_000
    p = tmp_path / "big.json"
    with p.open("w") as file:
        for k, (column, cell) in enumerate((("translate_context", [["T", [text] * 4, "Persian"]]), ("translate_question", "q"), ("translate_answer", "a"), ("target_language", "Persian"))):
            file.write(("{" if not k else ", ") + f'"{column}": {{' + ", ".join(f'"{i}": {json.dumps(cell)}' for i in range(n)) + "}")
        file.write("}")
    assert p.stat().st_size > 300_000_000 and readers.column_shard(spark, str(p)).count() == n


def test_corrections_reader(spark, tmp_path):
    good = {"legacy_id": "a", "raw_sha256": "f" * 64, "reason": "typo", "replacement": {"id": "a"}}
    assert json.loads(readers.corrections(spark, lines(tmp_path / "c.jsonl", good)).first().replacement) == {"id": "a"}
    for bad in ({**good, "extra": 1}, {**good, "raw_sha256": "x"}, {**good, "reason": " "}, {**good, "replacement": "x"}, {**good, "legacy_id": ""}):
        with pytest.raises(ContractError):
            readers.corrections(spark, lines(tmp_path / "d.jsonl", bad))
    with pytest.raises(ContractError, match="repeat"):
        readers.corrections(spark, lines(tmp_path / "e.jsonl", good, good))


def test_typed_sources(spark, tmp_path):
    def array(name, *ids):
        (tmp_path / name).write_text(json.dumps([{"_id": i, "question": "Q", "answer": "A", "context": [], "supporting_facts": []} for i in ids]))
        return str(tmp_path / name)

    assert readers.typed_sources(spark, array("a.json", "x", "y"), array("b.json", "z")).count() == 3
    with pytest.raises(ContractError, match="repeat"):
        readers.typed_sources(spark, array("a.json", "x"), array("b.json", "x"))
    with pytest.raises(ContractError, match="without id"):
        readers.typed_sources(spark, array("c.json", ""))


def test_locks_notice_changes(spark, tmp_path):
    p = lines(tmp_path / "x.jsonl", {"a": 1})
    locks = readers.file_facts(spark, p).select("name", "bytes", "sha256").withColumn("ord", F.lit(0))
    with readers.locked(spark, [p], locks):
        pass
    with pytest.raises(ContractError, match="changed"), readers.locked(spark, [p], locks):
        lines(tmp_path / "x.jsonl", {"a": 1}, {"a": 2})


def test_documents_and_metadata(spark, tmp_path):
    import pyarrow.parquet as pq

    sinks.write_document(str(tmp_path / "d" / "x.json"), {"b": 1, "a": "ä"})
    assert (tmp_path / "d" / "x.json").read_text(encoding="utf-8") == '{\n  "a": "ä",\n  "b": 1\n}\n' and os.listdir(tmp_path / "d") == ["x.json"]
    sinks.write_table(spark.range(3), str(tmp_path / "t"), {"config": "v2"}, "id")
    assert spark.read.parquet(str(tmp_path / "t")).schema["id"].metadata == {"config": "v2"}
    part = min(f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet"))
    assert b"v2" in pq.read_metadata(tmp_path / "t" / part).metadata[b"org.apache.spark.sql.parquet.row.metadata"]
