"""Resumable runs around a model: generation of records from sources, and judging of a frozen sample."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mhqa.functions import hashing as H
from mhqa.operators import judging, keys
from mhqa.operators.keys import ContractError, require_empty
from mhqa.operators.validation import structural_error
from mhqa.runtime import materialise
from mhqa.schemas import CANDIDATE, CODES, FACT, LANGUAGES, PROVENANCE
from mhqa.sources import sinks
from mhqa.streaming import generation as G

C = F.col
#: The unit of question and answer, and origins and codes of errors.
QUESTION_ANSWER = "question-answer"
SOURCE_ERRORS = "^(Candidate |Supporting sentence |Supporting title |Unknown supporting paragraph)"
Assign = Callable[[DataFrame], DataFrame]


def utc(moment: datetime | None = None) -> str:
    """ISO 8601 in UTC, of now if no moment is given."""
    return (moment or datetime.now(timezone.utc)).astimezone(timezone.utc).isoformat()


def prompt_identity(*prompts: str) -> str:
    """SHA-256 over the texts of all prompts, in order."""
    return hashlib.sha256("\0".join(prompts).encode()).hexdigest()


# -- generation ----------------------------------------------------------------------------------------------------------
def by_hash(seed: int) -> Assign:
    """Assigns languages to units by hash."""
    return lambda units: units.withColumn("language", H.assign_language(C("source_id"), C("unit_id"), seed))


def by_manifest(assigned: DataFrame) -> Assign:
    """Assigns the languages of a manifest's (source_id, unit_id, language). Its units must be exactly those of each source asked for."""

    def assign(units: DataFrame) -> DataFrame:
        mine = assigned.select("source_id", "unit_id", "language").join(units.select("source_id").distinct(), "source_id", "left_semi")
        return keys.exact_join(units, mine, ["source_id", "unit_id"])

    return assign


def units_of(sources: DataFrame) -> DataFrame:
    """(source_id, unit_id): question and answer together, and each paragraph."""
    count = F.size(F.coalesce("context", F.array()))
    paragraphs = F.transform(F.filter(F.sequence(F.lit(0), count), lambda k: k < count), lambda k: F.concat(F.lit("paragraph:"), k.cast("string")))
    return sources.select("source_id", F.explode(F.concat(F.array(F.lit(QUESTION_ANSWER)), paragraphs)).alias("unit_id"))


def texts_of(sources: DataFrame, assign: Assign) -> DataFrame:
    """(request_id, source_id, kind, paragraph, language, texts): what is to be translated, one row a call; ``texts`` holds one text, or the sentences of a paragraph."""
    assigned = assign(units_of(sources))
    require_empty(assigned.where(~F.coalesce(C("language").isin(*CODES), F.lit(False))), "units without language", "source_id", "unit_id")
    joined = assigned.join(sources.select("source_id", "question", "answer", "context"), "source_id")
    index = F.when(C("unit_id") != QUESTION_ANSWER, F.regexp_extract("unit_id", r"(\d+)$", 1).cast("int"))
    call = lambda kind, texts: F.struct(F.lit(kind).alias("kind"), texts.alias("texts"))
    part = F.get("context", index)
    calls = F.when(index.isNull(), F.array(call("question", F.array("question")), call("answer", F.array("answer")))).otherwise(F.array(call("title", F.array(part["title"])), call("sentences", part["sentences"])))
    rows = joined.select("source_id", index.alias("paragraph"), "language", F.explode(calls).alias("c")).select("source_id", "paragraph", "language", "c.*")
    return rows.withColumn("request_id", F.concat_ws("|", "source_id", F.coalesce(C("paragraph").cast("string"), F.lit("")), "kind"))


def translate(texts: DataFrame, make_client: Callable[[], G.Client], *, system: str, retries: int = 2, workers: int = 1) -> DataFrame:
    """``texts`` with ``translated`` (array, as many as ``texts``), ``attempts``, ``error`` and ``audit``. English stays as it is, without a call; a wrong number of sentences isn't accepted."""
    names = F.create_map(*[F.lit(x) for code, name, _ in LANGUAGES for x in (code, name)])
    payload = H.canonical_json(F.struct("kind", C("language").alias("target_language"), F.element_at(names, C("language")).alias("target_language_name"), C("texts").alias("texts")))
    message = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), payload.alias("content"))))
    # The number of sentences is checked after the call has been accepted as a list, so that one function serves all kinds.
    asked = texts.where("language != 'en'").select("request_id", F.to_json(F.struct(F.size("texts").alias("n"), message.alias("m"))).alias("request"))

    def client() -> G.Client:
        inner = make_client()

        def ask(request: str) -> str:
            wrapped = json.loads(request)
            return json.dumps({"n": wrapped["n"], "reply": inner(wrapped["m"])})

        return ask

    def accept(reply: str) -> str:
        wrapped = json.loads(reply)
        return G.translated(wrapped["reply"], count=wrapped["n"])

    answers = G.model_map(asked, "request_id", "request", client, accept, retries=retries, workers=workers)
    done = texts.join(answers, "request_id", "left")
    value = F.from_json("value", "translations array<string>")["translations"]
    return done.withColumns({"translated": F.when(C("language") == "en", C("texts")).otherwise(value), "attempts": F.coalesce("attempts", F.lit(0))}).drop("value")


def records_of(sources: DataFrame, translated: DataFrame, *, split: str, provenance: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(canonical records, ledger rows): a source's record out of its translated units, or why there is none.

    Retries of a record are those of its units together. Ledger: (source_id, origin, code, error_type, message).
    """
    of_source = translated.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("kind", "paragraph", "language", "translated"))).alias("units"), F.sum(F.greatest(C("attempts") - 1, F.lit(0))).cast("int").alias("retries"), F.min("error").alias("failed"),
    )
    joined = sources.select("source_id", "question_type", "difficulty", "context", C("supporting_facts").alias("sf")).join(of_source, "source_id")
    one = lambda kind, i=None: F.get(F.filter("units", lambda u: (u["kind"] == kind) & (F.lit(True) if i is None else u["paragraph"] == i)), F.lit(0))
    candidates = F.transform(
        "context",
        lambda p, i: F.struct(
            F.format_string("p%02d", i).alias("id"), F.get(one("title", i)["translated"], F.lit(0)).alias("title"), one("sentences", i)["translated"].alias("sentences"), one("title", i)["language"].alias("language"),
            p["title"].alias("source_title"), p["sentences"].alias("source_sentences"),
        ),
    )
    titles = F.transform("context", lambda p: p["title"])
    matches = lambda f: F.size(F.filter(titles, lambda t: t == f["title"]))
    facts = F.transform("sf", lambda f: F.struct(F.format_string("p%02d", (F.array_position(titles, f["title"]) - 1).cast("int")).alias("paragraph_id"), f["sentence_id"].alias("sentence_id"), F.lit("support").alias("role")))
    lost = F.get(F.filter("sf", lambda f: matches(f) != 1), F.lit(0))
    fixed = F.from_json(F.lit("{}"), PROVENANCE)
    for name, value in {"created_at": utc(), "validation_status": "structural-passed", **provenance}.items():
        fixed = fixed.withField(name, F.lit(value))
    language = one("question")["language"]
    built = joined.select(
        F.concat(F.lit(f"xhp-{split}-"), "source_id").alias("id"), "source_id", F.lit(split).alias("source_split"), F.get(one("question")["translated"], F.lit(0)).alias("question"), F.get(one("answer")["translated"], F.lit(0)).alias("answer"),
        language.alias("question_language"), language.alias("answer_language"), candidates.cast(f"array<{CANDIDATE}>").alias("candidates"), facts.cast(f"array<{FACT}>").alias("supporting_facts"), "question_type", "difficulty",
        fixed.withField("retry_count", C("retries")).alias("provenance"), F.lit("").alias("checksum"), "failed",
        F.when(lost.isNotNull(), F.format_string("Supporting title '%s' maps to %d candidates", lost["title"], matches(lost))).alias("unresolved"),
    )
    checked = built.withColumn("broken", F.concat(F.lit("Candidate or record breaks the rule "), structural_error()))
    message = F.coalesce("failed", "unresolved", F.when(C("failed").isNull(), C("broken")))
    told = materialise(checked.withColumn("message", message).drop("failed", "unresolved", "broken"))
    good = told.where("message is null").drop("message")
    names = good.columns
    source_error = C("message").rlike(SOURCE_ERRORS)
    exhausted = C("message").startswith("Exhausted")
    ledger = told.where("message is not null").select(
        "source_id", F.when(exhausted, "transformation").when(source_error, "source").otherwise("execution").alias("origin"),
        F.when(exhausted, "structured_response_exhausted").when(source_error, "invalid_source_annotation").otherwise("generation_exception").alias("code"),
        F.when(source_error, "ValueError").otherwise(F.regexp_extract("message", r"^(\w+):", 1)).alias("error_type"), F.substring("message", 1, 500).alias("message"),
    )
    return good.withColumn("checksum", H.checksum(F.struct(*names))), ledger


def reconcile(old: DataFrame | None, new: DataFrame, completed: DataFrame) -> DataFrame:
    """The ledger after a run: new entries, and old ones of sources that neither completed nor failed anew. One row a source."""
    left = new if old is None else old.join(completed.select("source_id"), "source_id", "left_anti").join(new.select("source_id"), "source_id", "left_anti").unionByName(new)
    return left


def signature_of(provenance: dict[str, Any]) -> str:
    """What records of one output must have in common, in canonical form."""
    names = ("schema_version", "assignment_version", "assignment_manifest_sha256", "seed", "translation_model", "translation_revision", "prompt_version", "prompt_hash", "decoding")
    return H.dumps({n: provenance.get(n) for n in names})


def completed_records(spark: SparkSession, path: str, *, split: str, signature: str) -> DataFrame | None:
    """The records at ``path``, after a check that each is valid, of ``split``, with the right checksum, of this configuration, and that no source comes twice."""
    old = G.existing(spark, path)
    if old is None:
        return None
    bad = F.when(~C("signature").eqNullSafe(signature), "another configuration").when(~C("source_split").eqNullSafe(split), "another split").otherwise(structural_error())
    names = [c for c in old.columns if c not in ("signature", "batch")]
    require_empty(old.withColumn("problem", F.coalesce(bad, F.when(~C("checksum").eqNullSafe(H.checksum(F.struct(*names))), "checksum"))).where("problem is not null"), "existing output", "source_id", "problem")
    require_empty(old.groupBy("source_id").count().where("count > 1"), "existing output repeats sources", "source_id")
    return old


def generate(
    spark: SparkSession, sources: DataFrame, output: str, make_client: Callable[[], G.Client], assign: Assign, *, split: str, provenance: dict[str, Any], system: str, retries: int = 2, workers: int = 1,
    checkpoint_every: int = 1000, progress: Callable[[dict[str, int]], None] | None = None,
) -> dict[str, int]:
    """Generates the records that ``output`` lacks; the counts of the run.

    ``output/records`` is appended to after every ``checkpoint_every`` sources, ``output/audit`` (private) beside it; ``output/ledger`` is replaced as a whole. Sources that failed
    are tried again by the next run.
    """
    if checkpoint_every < 1 or workers < 1:
        raise ContractError("checkpoint_every and workers must be positive")
    require_empty(sources.where("source_id is null or source_id = ''"), "sources without id", "source_id")
    require_empty(sources.groupBy("source_id").count().where("count > 1"), "sources repeat", "source_id")
    records, audit, signature = f"{output}/records", f"{output}/audit", signature_of(provenance)
    with sinks.exclusive(output):
        done = completed_records(spark, records, split=split, signature=signature)
        if done is not None:
            require_empty(done.join(sources, "source_id", "left_anti"), "completed without input", "source_id")
        before = 0 if done is None else done.count()
        pending = sources if done is None else sources.join(done.select("source_id"), "source_id", "left_anti")
        numbered = materialise(keys.with_ordinal(pending.withColumn("__id", C("source_id")), "__id").drop("__id"))
        attempted, written, ledgers = numbered.count(), 0, []
        for start in range(0, attempted, checkpoint_every):  # one job a checkpoint, not a row
            part = numbered.where(C("ordinal").between(start, start + checkpoint_every - 1)).drop("ordinal")
            answered = materialise(translate(texts_of(part, assign), make_client, system=system, retries=retries, workers=workers))
            good, bad = records_of(part, answered.drop("audit"), split=split, provenance=provenance)
            good = materialise(good)
            good.withColumn("signature", F.lit(signature)).write.mode("append").parquet(records)
            answered.select("request_id", F.explode("audit").alias("a")).select("request_id", "a.*").write.mode("append").parquet(audit)
            ledgers.append(materialise(bad))
            written += good.count()
            if progress:
                progress({"attempted": min(attempted, start + checkpoint_every), "of": attempted, "written": written})
        old = G.existing(spark, f"{output}/ledger")
        completed = G.existing(spark, records)
        nothing = sources.select("source_id").limit(0)
        new = None
        for ledger in ledgers:
            new = ledger if new is None else new.unionByName(ledger)
        if new is not None:
            ledger = materialise(reconcile(None if old is None else materialise(old), new, nothing if completed is None else completed))
            sinks.staged(f"{output}/ledger", lambda p: ledger.orderBy("source_id").write.parquet(p))
        errors = G.existing(spark, f"{output}/ledger")
    return {"input": sources.count(), "completed_before": before, "attempted": attempted, "written": written, "failed": attempted - written, "output": before + written, "errors": 0 if errors is None else errors.count()}


# -- judging ---------------------------------------------------------------------------------------------------------------
RESPONSE_SCHEMA = '{"score": "whole number from 0 to 100", "rationale": "text", "error_tags": ["text"]}'


def judge_prompt(prompts: dict[str, str]) -> Column:
    """The request for a unit: a list of messages, the system prompt by unit (``prompts`` has answer and other), the payload as canonical JSON."""
    names = F.create_map(*[F.lit(x) for code, name, _ in LANGUAGES for x in (code, name)])
    base = [C("unit"), F.lit("English").alias("source_language"), C("language").alias("target_language_code"), F.coalesce(F.element_at(names, C("language")), C("language")).alias("target_language_name"), C("source_text"), C("candidate_text"),
            F.lit(RESPONSE_SCHEMA).alias("response_schema")]
    payload = F.when(F.coalesce(C("context_question"), F.lit("")) == "", H.canonical_json(F.struct(*base))).otherwise(H.canonical_json(F.struct(*base, C("context_question"))))
    system = F.when(C("unit") == "answer", prompts["answer"]).otherwise(prompts["other"])
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), payload.alias("content"))))


SAMPLE = ("record_id", "instance_id", "source_id", "source_split", "language", "unit", "paragraph_id", "source_text", "candidate_text", "context_question")


def frozen_sample(spark: SparkSession, units: DataFrame, path: str, **sizes: int) -> tuple[DataFrame, str]:
    """(the sample with ``ordinal``, its digest). It is written once; a later run must draw the very same, or it is a ContractError."""
    drawn = judging.sample(units, **sizes)
    identity = judging.record_id(C("instance_id"), C("language"), C("paragraph_id"), C("source_id"), C("unit"))
    order = F.create_map(*[F.lit(x) for k, u in enumerate(judging.UNITS) for x in (u, k)])
    rows = drawn.withColumns({"record_id": identity, "o": F.element_at(order, C("unit"))}).select(*SAMPLE, "o", "n")
    numbered = keys.with_ordinal(rows, "language", "o", "n").drop("o", "n")
    old = G.existing(spark, path)
    if old is None:
        sinks.staged(path, lambda p: numbered.write.parquet(p))
    kept = spark.read.parquet(path)
    line = lambda: H.canonical_json(F.struct(*SAMPLE))
    digest = keys.ordered_digest(kept, line(), "ordinal").first().digest
    if old is not None and keys.ordered_digest(numbered, line(), "ordinal").first().digest != digest:
        raise ContractError("the sample differs from the frozen one")
    return kept, digest


def judge(
    spark: SparkSession, units: DataFrame, output: str, make_client: Callable[[], G.Client], *, prompts: dict[str, str], model: str, prompt_version: str, retries: int = 2, workers: int = 1, **sizes: int
) -> list[dict]:
    """Judges what a frozen sample lacks or failed before; the report. ``output/sample`` is frozen, ``output/records`` has one row a unit, in sample order, after each run."""
    with sinks.exclusive(output):
        sample, digest = frozen_sample(spark, units, f"{output}/sample", **sizes)
        identity = {"model_id": model, "prompt_version": prompt_version, "prompt_hash": prompt_identity(prompts["answer"], prompts["other"]), "sample_manifest_sha256": digest}
        old = G.existing(spark, f"{output}/records")
        if old is not None:
            old = materialise(old)
            other = ~F.lit(True)
            for name, value in identity.items():
                other = other | ~C(name).eqNullSafe(F.lit(value))
            require_empty(old.where(other), "results of another configuration", "record_id")
            require_empty(old.join(sample, "record_id", "left_anti"), "results without sampled unit", "record_id")
        judged = sample.select("record_id").limit(0) if old is None else old.where("score is not null").select("record_id")
        pending = sample.join(judged, "record_id", "left_anti")
        answers = G.model_map(pending.withColumn("request", judge_prompt(prompts)), "record_id", "request", make_client, G.judged, retries=retries, workers=workers)
        reply = F.from_json("value", "score int, rationale string, error_tags array<string>")
        columns = ["record_id", "score", "rationale", "error_tags", "error", "attempts"]
        new = answers.withColumn("r", reply).select("record_id", "r.score", "r.rationale", F.coalesce("r.error_tags", F.array().cast("array<string>")).alias("error_tags"), "error", "attempts")
        results = new if old is None else new.unionByName(old.join(pending.select("record_id"), "record_id", "left_anti").select(*columns))
        compact = materialise(sample.join(results, "record_id", "left").withColumns({n: F.lit(v) for n, v in identity.items()}))
        sinks.staged(f"{output}/records", lambda p: compact.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(p))
        report = [r.asDict() for r in judging.report(compact).collect()]  # one row for each level, language and unit
        sinks.write_bytes(f"{output}/report.json", (json.dumps({"sample_manifest_sha256": digest, "levels": ordered_report(report)}, ensure_ascii=False, indent=2) + "\n").encode())
    return report


def ordered_report(rows: Sequence[dict]) -> list[dict]:
    """Report rows in a fixed order: by level, then by the inventory's order of languages, then by unit."""
    levels, places = ("overall", "unit", "language_unit"), {c: k for k, c in enumerate(CODES)}
    return sorted(rows, key=lambda r: (levels.index(r["level"]), places.get(r["language"], len(places)), judging.UNITS.index(r["unit"]) if r["unit"] in judging.UNITS else -1))
