"""Readers: JSON lines with lineage, source arrays, column-wise shards, manifests, translation maps, ledgers, input locks."""

from __future__ import annotations

import contextlib
import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mhqa.functions.hashing import is_sha256
from mhqa.functions.text import is_blank
from mhqa.operators.keys import ContractError, require_empty, with_ordinal
from mhqa.runtime import materialise
from mhqa.schemas import CANONICAL, CODES, PREDICTION
from mhqa.sources.streams import RANGE, JsonEntries, LineRanges, open_binary

C = F.col


def numbered_lines(spark: SparkSession, *paths: str, size: int = RANGE) -> DataFrame:
    """(path, line, value) of text files, blank lines counted; each ``size`` bytes of a file are a task's. The lines of the ranges before, one row a range, give the offsets."""
    spark.dataSource.register(LineRanges)
    lines = spark.read.format("line_ranges").option("paths", "\n".join(paths)).option("bytes", size).load()
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy("path", "range").agg(F.count("*").alias("n")).select("path", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(offsets), ["path", "range"]).select("path", (C("before") + C("number")).alias("line"), "value")


def _parsed(lines: DataFrame, schema: str | None) -> tuple[DataFrame, DataFrame]:
    """(the lines that aren't blank with ``record``; those among them that aren't one JSON object)."""
    parsed = lines.where("trim(value) != ''").withColumn("v", F.try_parse_json("value"))
    record = F.from_json("value", schema, {"mode": "FAILFAST"}) if schema else C("v")
    return parsed.withColumn("record", record), parsed.where(C("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"))


def jsonl(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """(path, line, record) of JSON lines; ``record`` is VARIANT, or a struct with ``schema``. Blank lines are skipped; a line that isn't one JSON object is a ContractError that names it."""
    good, bad = _parsed(numbered_lines(spark, *paths), schema)
    require_empty(bad, "not a JSON object", "path", "line")
    return good.select("path", "line", "record")


def json_records(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """(record) of JSON lines, read and split by the built-in text source; lines are counted only to name one that isn't a JSON object."""
    good, bad = _parsed(spark.read.text(list(paths)), schema)
    if not bad.isEmpty():
        jsonl(spark, *paths, schema=schema)
    return good.select("record")


def instances(spark: SparkSession, *paths: str, validate: bool = True) -> DataFrame:
    """Canonical records of JSON lines; the open ``decoding`` map stays JSON text. With ``validate`` a record that breaks a structural rule is a ContractError."""
    rows = json_records(spark, *paths, schema=CANONICAL).select("record.*")
    if validate:
        from mhqa.operators.validation import structural_error

        require_empty(rows.withColumn("__e", structural_error()).where("__e is not null"), "invalid records", "id", "__e")
    return rows


def predictions(spark: SparkSession, *paths: str) -> DataFrame:
    """Predictions of JSON lines. Ids must be strings and unique, facts a list of objects with a paragraph, not empty, and a whole, non-negative sentence number."""
    raw = jsonl(spark, *paths)
    kind = lambda p: F.schema_of_variant(F.try_variant_get("record", p, "variant"))
    facts = F.try_variant_get("record", "$.supporting_facts", "array<variant>")
    bad = lambda f: (
        ~F.coalesce(F.schema_of_variant(F.try_variant_get(f, "$.paragraph_id", "variant")) == "STRING", F.lit(False))
        | (F.coalesce(F.try_variant_get(f, "$.paragraph_id", "string"), F.lit("")) == "")
        | ~F.coalesce(F.schema_of_variant(F.try_variant_get(f, "$.sentence_id", "variant")) == "BIGINT", F.lit(False))
        | F.coalesce(F.try_variant_get(f, "$.sentence_id", "int") < 0, F.lit(True))
    )
    require_empty(raw.where(~F.coalesce(kind("$.id") == "STRING", F.lit(False))), "ids must be strings", "path", "line")
    require_empty(raw.where(F.coalesce(~kind("$.supporting_facts").startswith("ARRAY"), F.lit(False)) | F.coalesce(F.exists(facts, bad), F.lit(False))), "malformed facts", "path", "line")
    rows = raw.select(F.from_json(F.to_json("record"), PREDICTION).alias("r")).select("r.*")
    require_empty(rows.groupBy("id").count().where("count > 1"), "predictions repeat", "id")
    require_empty(rows.where(F.size(F.array_distinct(F.coalesce("supporting_facts", F.array()))) < F.size(F.coalesce("supporting_facts", F.array()))), "facts repeat", "id")
    return rows


def json_entries(spark: SparkSession, *paths: str, nested: bool = False) -> DataFrame:
    """(path, section, key, pos, value) of the entries of JSON objects or arrays, streamed, each value as JSON text. See ``streams.JsonEntries``."""
    spark.dataSource.register(JsonEntries)
    return spark.read.format("json_entries").option("paths", "\n".join(paths)).option("nested", str(nested).lower()).load()


def source_array(spark: SparkSession, path: str, *, difficulty: str | None = None) -> DataFrame:
    """HOTPOT_SOURCE records of a JSON array file, with ``pos`` (in the file) and ``selected_pos`` (among those of ``difficulty``). The array is streamed, item by item."""
    items = json_entries(spark, path).select("pos", F.parse_json("value").alias("x"))
    text = lambda p: F.try_variant_get("x", p, "string")
    context = F.transform(F.try_variant_get("x", "$.context", "array<variant>"), lambda p, i: F.struct(F.format_string("p%02d", i).alias("paragraph_id"), F.try_variant_get(p, "$[0]", "string").alias("title"), F.try_variant_get(p, "$[1]", "array<string>").alias("sentences")))
    facts = F.transform(F.try_variant_get("x", "$.supporting_facts", "array<variant>"), lambda f: F.struct(F.try_variant_get(f, "$[0]", "string").alias("title"), F.try_variant_get(f, "$[1]", "int").alias("sentence_id")))
    rows = items.select(
        F.coalesce(text("$._id"), text("$.id")).alias("source_id"), text("$.question").alias("question"), text("$.answer").alias("answer"), F.coalesce(text("$.type"), F.lit("unknown")).alias("question_type"),
        F.coalesce(text("$.level"), F.lit("unknown")).alias("difficulty"), C("pos").cast("int").alias("pos"), context.alias("context"), facts.alias("supporting_facts"),
    )
    kept = rows.where(C("difficulty") == difficulty) if difficulty else rows
    return with_ordinal(kept, "pos", into="selected_pos").withColumn("selected_pos", C("selected_pos").cast("int"))


def typed_sources(spark: SparkSession, *paths: str) -> DataFrame:
    """The source records of several array files; ids must be there and unique across the files."""
    rows = reduce(DataFrame.unionByName, [source_array(spark, p) for p in paths])
    require_empty(rows.where("source_id is null or source_id = ''"), "sources without id", "pos")
    require_empty(rows.groupBy("source_id").count().where("count > 1"), "sources repeat", "source_id")
    return rows


#: The columns of historical shards.
SHARD_COLUMNS = {"translate_context": "context", "translate_question": "question", "translate_answer": "answer", "target_language": "target_language"}


def column_shard(spark: SparkSession, path: str, *, ordinal: int = 0) -> DataFrame:
    """(shard, shard_ord, shard_row, context, question, answer, target_language) of a file that holds four columns as objects keyed by row number; the cells are VARIANT.

    The file is streamed once, cell by cell, and the cells of a row meet in one aggregation. A row that a column lacks or has twice, a gap, another column or a key that is no
    number is a ContractError.
    """
    cells = json_entries(spark, path, nested=True).withColumn("shard_row", F.expr("try_cast(key as int)"))
    require_empty(cells.where(~C("section").isin(*SHARD_COLUMNS) | C("shard_row").isNull()).select("section", "key"), "other columns, or rows without number", "section", "key")
    rows = materialise(cells.groupBy("shard_row").agg(F.count("*").alias("n"), F.countDistinct("section").alias("d"), *[F.max(F.when(C("section") == c, C("value"))).alias(n) for c, n in SHARD_COLUMNS.items()]))
    require_empty(rows.where((C("n") != len(SHARD_COLUMNS)) | (C("d") != len(SHARD_COLUMNS))), "columns of unequal rows", "shard_row")
    n, last = rows.agg(F.count("*"), F.max("shard_row")).first()
    if n and last != n - 1:
        raise ContractError(f"rows of {path} aren't numbered without gap")
    return rows.select("shard_row", *[F.parse_json(c).alias(c) for c in SHARD_COLUMNS.values()], F.lit(path.rsplit("/", 1)[-1]).alias("shard"), F.lit(ordinal).alias("shard_ord"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """(legacy_id, raw_sha256, reason, replacement) of a file of corrections, the replacement as JSON text. Other fields, repeated ids, malformed hashes and blank reasons are ContractErrors."""
    raw = jsonl(spark, path)
    fields = ("legacy_id", "raw_sha256", "reason", "replacement")
    require_empty(raw.where(F.size(F.array_except(F.json_object_keys(F.to_json("record")), F.array(*map(F.lit, fields)))) > 0), "unexpected fields", "path", "line")
    text = lambda n: F.when(F.schema_of_variant(F.try_variant_get("record", f"$.{n}", "variant")) == "STRING", F.try_variant_get("record", f"$.{n}", "string"))
    whole = F.try_variant_get("record", "$.replacement", "variant")
    rows = raw.select("line", *[text(n).alias(n) for n in fields[:3]], F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.to_json(whole)).alias("replacement"))
    require_empty(rows.where(C("legacy_id").isNull() | (C("legacy_id") == "") | ~is_sha256(C("raw_sha256")) | is_blank(C("reason")) | C("replacement").isNull()), "malformed corrections", "line")
    require_empty(rows.groupBy("legacy_id").count().where("count > 1"), "corrections repeat", "legacy_id")
    return rows.drop("line")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, assignment_version, assignments map<source, map<unit, language>>) of an assignment manifest; duplicate keys are an error."""
    raw = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), F.parse_json(F.decode("content", "UTF-8")).alias("v"))
    keys = F.array_sort(F.json_object_keys(F.to_json("v")))
    require_empty(raw.where(keys != F.array(*map(F.lit, sorted(("assignment_version", "assignments", "schema_version"))))), "root keys differ", "sha256")
    return raw.select("sha256", F.try_variant_get("v", "$.assignment_version", "string").alias("assignment_version"), F.try_variant_get("v", "$.assignments", "map<string, map<string, string>>").alias("assignments"))


def translations(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, language, question, answer) of a translation map: JSON lines {source_id, translations}, or one JSON object by source."""
    entry = "map<string, struct<question: string, answer: string>>"
    if path.endswith(".jsonl"):
        raw = jsonl(spark, path)
        require_empty(raw.where(F.array_sort(F.json_object_keys(F.to_json("record"))) != F.array(F.lit("source_id"), F.lit("translations"))), "unexpected fields", "path", "line")
        rows = raw.select(F.try_variant_get("record", "$.source_id", "string").alias("source_id"), F.try_variant_get("record", "$.translations", entry).alias("t"))
    else:
        rows = json_entries(spark, path).select(C("key").alias("source_id"), F.try_variant_get(F.parse_json("value"), "$", entry).alias("t"))
    require_empty(rows.groupBy("source_id").count().where("count > 1"), "sources repeat", "source_id")
    found = rows.select("source_id", F.explode("t").alias("language", "x")).select("source_id", "language", "x.question", "x.answer")
    require_empty(found.where(~C("language").isin(*CODES)), "unknown languages", "source_id", "language")
    return found


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, error, message) of an error ledger of either dialect; sources must be unique."""
    rows = jsonl(spark, path, schema="source_id string, error string, message string").select("record.*")
    require_empty(rows.groupBy("source_id").count().where("count > 1"), "sources repeat", "source_id")
    return rows


def file_facts(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, bytes, sha256, modified) of files, or of those in a folder but for hidden ones; read in chunks, one file a task, so that their size doesn't matter."""
    found = sorted({f for p in paths for f in ([e.path for e in os.scandir(p) if e.is_file() and e.name[0] not in "._"] if os.path.isdir(p) else [p])})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                sha, size = hashlib.sha256(), 0
                with open_binary(path) as stream:
                    while data := stream.read(8 << 20):
                        sha.update(data)
                        size += len(data)
                rows.append((path.rsplit("/", 1)[-1], size, sha.hexdigest(), os.stat(path).st_mtime_ns // 1000 if os.path.exists(path) else None))
            names, sizes, hashes, times = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(times, pa.int64())], names=["name", "bytes", "sha256", "modified"])

    rows = spark.createDataFrame([(f,) for f in found], "path string").repartition(max(1, len(found)))
    return rows.mapInArrow(digest, "name string, bytes long, sha256 string, modified long").withColumn("modified", F.timestamp_micros("modified"))


@contextlib.contextmanager
def locked(spark: SparkSession, paths: Sequence[str], locks: DataFrame) -> Iterator[None]:
    """For a run over ``paths``: they must agree with ``locks`` (in this order, where it has ``ord``) before it, and have the same sizes and times of change after it."""
    if "ord" in locks.columns:
        expected = [r.name for r in locks.orderBy("ord").select("name").collect()]  # one row an input file
        if expected != [p.rsplit("/", 1)[-1] for p in paths]:
            raise ContractError("inputs stand in another order than their locks")
    require_locks(file_facts(spark, *paths), locks)
    state = [(os.stat(p).st_size, os.stat(p).st_mtime_ns) for p in paths]
    yield
    if state != [(os.stat(p).st_size, os.stat(p).st_mtime_ns) for p in paths]:
        raise ContractError("an input changed during the run")


def require_locks(found: DataFrame, locks: DataFrame) -> None:
    """ContractError unless the files have exactly the names, sizes and digests of ``locks`` (name, bytes, sha256)."""
    a, b = found.select("name", "bytes", "sha256"), locks.select("name", C("bytes").alias("b"), C("sha256").alias("s"))
    require_empty(a.join(b, "name", "full").where(~(C("bytes").eqNullSafe(C("b")) & C("sha256").eqNullSafe(C("s")))), "inputs differ from their locks", "name")


def equal_schema(df: DataFrame, expected: str) -> Column:
    """Whether ``df`` has the names and types of ``expected``, whatever may be null."""
    return F.lit([(f.name, f.dataType.simpleString()) for f in df.schema] == [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(expected)])
