"""Whole runs over files: validation, evaluation, expansion, legacy import, judging, release preflight."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Collection
from dataclasses import dataclass, fields
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mhqa.operators import evaluation, judging, keys, records, releases, validation
from mhqa.operators.keys import ContractError
from mhqa.plans import runs
from mhqa.plans.imports import import_legacy  # noqa: F401 - one of the pipelines
from mhqa.schemas import CODES
from mhqa.sources import readers, sinks
from mhqa.streaming import generation

C = F.col


def rows(df: DataFrame) -> list[dict]:
    """The rows of a report, whose number doesn't grow with the data."""
    return [r.asDict(recursive=True) for r in df.collect()]


def validate(spark: SparkSession, path: str, *, strict: bool = False, expected: int | None = None) -> tuple[dict, bool]:
    """(report, ok) of a file of canonical records."""
    report = rows(validation.validation_report(readers.instances(spark, path, validate=False)))
    total = sum(r["records"] for r in report)
    bad = sum(r["invalid"] + r["duplicates"] + r["invalid_checksums"] + (r["strict_errors"] if strict else 0) for r in report)
    return {"splits": report, "records": total, "expected": expected}, not bad and expected in (None, total)


def evaluate(spark: SparkSession, gold: str, predictions: str, *, protocol: str = evaluation.PROTOCOLS[0]) -> dict:
    """The report of one system: sections, macro means, descriptor summaries, missing and unexpected predictions."""
    g, p = readers.instances(spark, gold), readers.predictions(spark, predictions)
    keys.require_empty(keys.duplicates(g, "id"), "gold ids repeat", "id")
    return {
        "protocol": protocol, "sections": rows(evaluation.report(g, p, protocol=protocol)), "macro": rows(evaluation.macro(g, p, protocol=protocol)), "descriptors": rows(evaluation.summaries(evaluation.strata(g))),
        "missing": g.join(p, "id", "left_anti").count(), "unexpected": p.join(g, "id", "left_anti").count(),
    }


def expand(spark: SparkSession, bases: str, translations: str, output: str) -> int:
    """Writes the 24 views of each base record as JSON lines; the number of views. An earlier output survives a failure."""
    views = records.expand(readers.instances(spark, bases), readers.translations(spark, translations))
    sinks.write_jsonl(views.join(F.broadcast(spark.createDataFrame([(k, c) for k, c in enumerate(CODES)], "__o int, question_language string")), "question_language").select(*views.columns, "__o"), output, "source_id", "__o")
    return views.count()


def judge_report(results: DataFrame) -> list[dict]:
    return rows(judging.report(judging.last_results(results)))


@dataclass(frozen=True)
class ModelConfig:
    """How a model is asked. Unknown keys, wrong types and values out of range are errors."""

    model: str
    base_url: str = "http://127.0.0.1:8000/v1"
    temperature: float = 0.0
    max_tokens: int = 4096
    max_retries: int = 2
    workers: int = 1

    def __post_init__(self) -> None:
        for name in ("max_tokens", "max_retries", "workers"):
            if type(getattr(self, name)) is not int or getattr(self, name) < (name != "max_retries"):
                raise ContractError(f"{name} must be a whole number in range")
        if not self.model.strip() or isinstance(self.temperature, bool) or not 0 <= self.temperature <= 2:
            raise ContractError("model or temperature out of range")

    @classmethod
    def of(cls, values: dict) -> ModelConfig:
        if unknown := values.keys() - {f.name for f in fields(cls)}:
            raise ContractError(f"unknown keys {sorted(unknown)}")
        return cls(**values)


def connection(url: str, key: str | None) -> tuple[str, str]:
    """(url, key): only a loopback address may go without a key; credentials, queries and fragments in the address are errors."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password or parts.query or parts.fragment:
        raise ContractError("the address must be plain http(s)")
    loopback = parts.hostname in ("localhost", "::1") or parts.hostname.startswith("127.")
    if not key and not loopback:
        raise ContractError("a key is needed beyond this machine")
    return url.rstrip("/"), key or "none"


def load_config(path: str) -> dict:
    """The mapping of a JSON or YAML file; ContractError for anything else."""
    text = open(path, encoding="utf-8").read()
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise ContractError("YAML isn't installed here; give the configuration as JSON") from error
        values = yaml.safe_load(text)
    if not isinstance(values, dict):
        raise ContractError(f"{path} holds no mapping")
    return values


@dataclass(frozen=True)
class JudgeConfig(ModelConfig):
    """How a judge is asked, and how many units of each language it gets."""

    prompt_version: str = "1"
    answer_prompt: str = "Judge the translated answer beside its question. Reply with JSON alone."
    other_prompt: str = "Judge the translation. Reply with JSON alone."
    paragraphs: int = 80
    questions: int = 20
    answers: int = 20
    seed: int = 20260810

    def __post_init__(self) -> None:
        super().__post_init__()
        for name in ("paragraphs", "questions", "answers"):
            if type(getattr(self, name)) is not int or getattr(self, name) < 1:
                raise ContractError(f"{name} must be a whole number in range")
        if type(self.seed) is not int or not self.answer_prompt.strip() or not self.other_prompt.strip():
            raise ContractError("seed or prompts out of range")


def client_of(config: ModelConfig, key: str | None, *, seed: int | None = None) -> Callable:
    """Makes clients for ``config``, after a check of its address and key."""
    url, secret = connection(config.base_url, key)
    return generation.http_client(url, secret, config.model, temperature=config.temperature, max_tokens=config.max_tokens, seed=seed)


def generate(spark: SparkSession, config: ModelConfig, sources: str, output: str, *, split: str, seed: int = 42, manifest: str | None = None, system: str, key: str | None = None, difficulty: str | None = None, make_client: Callable | None = None) -> dict:
    """Generates records for the sources of an array file; languages by a manifest or by hash."""
    rows = readers.source_array(spark, sources, difficulty=difficulty)
    facts = {"assignment_version": f"hash-{seed}", "assignment_manifest_sha256": "", "seed": seed}
    assign = runs.by_hash(seed)
    if manifest:
        held = readers.manifest(spark, manifest)
        first = held.select("sha256", "assignment_version").first()
        facts = {"assignment_version": first.assignment_version, "assignment_manifest_sha256": first.sha256, "seed": None}
        assign = runs.by_manifest(records.assignment_units(held))
    decoding = json.dumps({"max_tokens": config.max_tokens, "temperature": config.temperature}, sort_keys=True)
    provenance = {"schema_version": "record-v2", "source_dataset": "", "source_license": "", "translation_model": config.model, "translation_revision": "", "prompt_version": "1", "prompt_hash": runs.prompt_identity(system), "decoding": decoding, **facts}
    return runs.generate(spark, rows.drop("selected_pos"), output, make_client or client_of(config, key), assign, split=split, provenance=provenance, system=system, retries=config.max_retries, workers=config.workers)


def judge(spark: SparkSession, config: JudgeConfig, instances: str, sources: str, output: str, *, key: str | None = None, make_client: Callable | None = None) -> list[dict]:
    """Judges a balanced sample of the records of a file against their sources; every source must be there."""
    gold, base = readers.instances(spark, instances), readers.source_array(spark, sources)
    keys.require_empty(judging.missing_sources(gold, base), "sources are missing", "id", "source_id")
    units = judging.units(gold, base)
    sizes = {"paragraphs": config.paragraphs, "questions": config.questions, "answers": config.answers, "seed": config.seed}
    prompts = {"answer": config.answer_prompt, "other": config.other_prompt}
    return runs.judge(spark, units, output, make_client or client_of(config, key, seed=config.seed), prompts=prompts, model=config.model, prompt_version=config.prompt_version, retries=config.max_retries, workers=config.workers, **sizes)


def release(spark: SparkSession, instances: str, sources: str, output: str, *, own: str, split: str, rows: int = 5000) -> dict:
    """Builds the release of generated records: ordered shards of the 35 fields, the missing sources, the manifest; the counts by status."""
    base = readers.typed_sources(spark, sources)
    records_ = readers.instances(spark, instances, validate=False)
    keys.require_empty(records_.join(base, "source_id", "left_anti"), "records without source", "source_id")
    made = releases.generated_release(releases.with_source(records_, base), own, split=split)
    names = sinks.write_shards(made, f"{output}/data", "source_position", "id", rows=rows, split=split)
    ledger = spark.createDataFrame([], "source_id string, error string, message string")
    sinks.write_table(records.missing_manifest(base, records_, ledger), f"{output}/missing", {"split": split}, "source_id")
    counts = {r.status: r["count"] for r in made.groupBy("status").count().collect()}  # three at most
    sinks.write_document(f"{output}/manifest.json", sinks.manifest(spark, f"{output}/data", split=split, shards=names, status=counts))
    return counts


def judge_payload(spark: SparkSession, rows: DataFrame, output: str, *, targets: list[str], constants: dict, prompts: dict[str, str], expected: dict[str, int], replicates: int = 10_000, seed: int = 20260821) -> dict:
    """Writes the released judge rows, SUMMARY and BOOTSTRAP documents, the language table and the manifest; rejected rows or an unbalanced sample are ContractErrors."""
    good, bad = releases.judge_release(rows, targets=targets, constants=constants, prompts=prompts)
    keys.require_empty(bad, "rows that can't be released", "raw_line_number", "reason")
    scored = good.select(C("judge_record_id").alias("record_id"), C("target_language").alias("language"), "unit", "score", "source_split", "score_origin")
    judging.require_balance(scored, expected, languages=len(targets))
    sinks.write_table(good, f"{output}/data", {"config": str(constants.get("dataset_version"))}, "target_language", "unit", "judge_record_id")
    origins = {r.score_origin: r["count"] for r in scored.groupBy("score_origin").count().collect()}
    sinks.write_document(f"{output}/SUMMARY.json", {"levels": rows_of(judging.summary_cube(scored)), "score_origin_counts": origins})
    sinks.write_document(f"{output}/BOOTSTRAP.json", {"replicates": replicates, "seed": seed, "intervals": rows_of(judging.interval(judging.bootstrap(scored, replicates=replicates, seed=seed)))})
    sinks.language_table(judging.score_summary(scored, "language", "unit"), f"{output}/languages")
    made = sinks.manifest(spark, f"{output}/data", rows=good.count())
    sinks.write_document(f"{output}/manifest.json", made)
    return made


def upload_plan(spark: SparkSession, card: str, files: dict[str, str]) -> dict:
    """What a publication would send: the card and the data files with their digests, after all checks. Nothing is sent, and no credentials are read."""
    problems = card_problems(open(card, encoding="utf-8").read(), paths=files)
    missing = [p for p in files.values() if not os.path.isfile(p)]
    if problems or missing:
        raise ContractError(f"not ready: {problems + missing}")
    facts = {r.name: {"bytes": r.bytes, "sha256": r.sha256} for r in readers.file_facts(spark, *files.values()).collect()}
    return {"dry_run": True, "card": os.path.basename(card), "files": {name: facts[os.path.basename(path)] for name, path in files.items()}}


def card_problems(card: str, *, paths: Collection[str] = ()) -> list[str]:
    """What a dataset card lacks: front matter, licence, all languages, a known size category, configurations with data files, and each of ``paths`` among these."""
    front = re.match(r"---\n(.*?)\n---\n", card, re.S)
    if not front:
        return ["front matter"]
    body = front.group(1)
    listed = set(re.findall(r"^\s*-\s*([a-z]{2})\s*$", body, re.M))
    problems = [f"language {c}" for c in CODES if c not in listed]
    problems += [name for name in ("license", "configs", "data_files", "size_categories") if not re.search(rf"^\s*-?\s*{name}:", body, re.M)]
    if "size_categories" not in problems and not re.search(r"^\s*-\s*(?:n<1K|\d+[KMB]<n<\d+[KMBT]|n>1T)\s*$", body, re.M):
        problems.append("size category")
    return problems + [f"path {p}" for p in paths if not re.search(rf"(?:path|data_files):\s*['\"]?{re.escape(p)}['\"]?\s*$", body, re.M)]


rows_of = rows
