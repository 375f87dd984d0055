"""Import of historical shards: positional join to the sources, audit, canonical records, quarantine, corrections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mhqa.functions import hashing as H
from mhqa.operators import keys, records, releases
from mhqa.operators.keys import ContractError
from mhqa.operators.validation import structural_error
from mhqa.runtime import materialise
from mhqa.schemas import CANDIDATE, CANONICAL, CODES, FACT, LEGACY_ORDER, PROVENANCE
from mhqa.sources import readers, sinks

C = F.col
VIEWS = {"train": len(CODES), "validation": 1}
CELLS = ("context", "question", "answer", "target_language")
#: The provenance of historical records, as far as it is known.
HISTORICAL = {
    "source_dataset": "", "source_license": "", "schema_version": "", "assignment_version": "legacy-random-v1-unseeded", "translation_model": "gpt-4o-mini", "translation_revision": "provider-resolved-revision-unavailable",
    "prompt_version": "legacy-script-unversioned", "validation_status": "legacy-import-audited", "decoding": '{"provenance_status":"incomplete"}',
}


def joined_rows(spark: SparkSession, shards: Sequence[str], source: str, *, split: str) -> DataFrame:
    """Historical rows with the source each belongs to by position: 24 consecutive rows (train) or one (validation) for each. Cells come as JSON text (``cell_*``), since VARIANT can't be shuffled."""
    if not shards:
        raise ContractError("no shards")
    sources = readers.source_array(spark, source, difficulty="hard" if split == "train" else None)
    require = keys.require_empty
    require(sources.where(F.exists("supporting_facts", lambda f: f["title"].isNull() | F.coalesce(f["sentence_id"] < 0, F.lit(True)))), "malformed facts of sources", "source_id")
    cells = reduce(DataFrame.unionByName, [readers.column_shard(spark, shard, ordinal=k) for k, shard in enumerate(shards)])
    packed = cells.select("shard", "shard_ord", "shard_row", *[F.to_json(F.struct(C(n).alias("v"))).alias(f"cell_{n}") for n in CELLS])
    titles = F.transform("context", lambda p: p["title"])
    facts = F.transform("supporting_facts", lambda f: F.struct(F.format_string("p%02d", (F.array_position(titles, f["title"]) - 1).cast("int")).alias("paragraph_id"), f["sentence_id"].alias("sentence_id")))
    wanted = sources.select("pos", "source_id", "question_type", "difficulty", F.transform("context", lambda p: F.struct(p["title"].alias("title"), p["sentences"].alias("sentences"))).alias("source_context"), facts.alias("source_facts"))
    wanted = wanted.withColumnRenamed("pos", "source_position")
    return keys.positional_join(wanted, packed, left_order=["source_position"], right_order=["shard_ord", "shard_row"], group=VIEWS[split])


def raw_hash() -> Column:
    """SHA-256 of a historical row's canonical JSON."""
    names = {"context": "translate_context", "question": "translate_question", "answer": "translate_answer", "target_language": "target_language"}
    parts = [F.concat(F.lit(f'"{names[n]}":'), F.regexp_extract(f"cell_{n}", r'(?s)^\{"v":(.*)\}$', 1)) for n in CELLS]
    return F.sha2(H.canonical_text(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))), 256)


def require_groups(audited: DataFrame) -> None:
    """ContractError unless the 24 views of a source stand in the historical order and have the same context."""
    order = F.create_map(*[F.lit(x) for k, c in enumerate(LEGACY_ORDER) for x in (c, k)])
    keys.require_empty(audited.where(C("language").isNotNull() & (F.element_at(order, C("language")) != C("member"))), "target order differs", "source_id", "member")
    contexts = audited.groupBy("source_id").agg(F.min(F.sha2("cell_context", 256)).alias("a"), F.max(F.sha2("cell_context", 256)).alias("b"))
    keys.require_empty(contexts.where("a != b"), "contexts of a source's views differ", "source_id")


def canonical(audited: DataFrame, *, split: str, provenance: dict[str, str] = HISTORICAL) -> DataFrame:
    """``audited`` (see ``audit``) with ``record``: the canonical record as a struct, null where issues don't let one be built; and the issue canonical_validation_error where it breaks a rule."""
    code = F.create_map(*[F.lit(x) for n, c in records.NAMES.items() for x in (n, c)])
    cells = releases.typed_cells(C("context"))
    candidates = F.transform(
        cells,
        lambda c, i: F.struct(
            F.format_string("p%02d", i).alias("id"), c["title"].alias("title"), c["sentences"].alias("sentences"), F.element_at(code, c["language"]).alias("language"),
            F.get(C("source_context"), i)["title"].alias("source_title"), F.get(C("source_context"), i)["sentences"].alias("source_sentences"),
        ),
    ).cast(f"array<{CANDIDATE}>")
    facts = F.transform("source_facts", lambda f: F.struct(f["paragraph_id"].alias("paragraph_id"), f["sentence_id"].alias("sentence_id"), F.lit("support").alias("role"))).cast(f"array<{FACT}>")
    fixed = F.from_json(F.lit("{}"), PROVENANCE)
    for name, value in {"assignment_manifest_sha256": "", "prompt_hash": "", "created_at": "", **provenance}.items():
        fixed = fixed.withField(name, F.lit(value))
    text = lambda n: F.try_variant_get(C(n), "$", "string")
    built = audited.withColumns(
        {
            "id": C("legacy_id"), "source_split": F.lit(split), "question_text": text("question"), "answer_text": text("answer"), "candidates": candidates, "supporting_facts": facts,
            "provenance": fixed.withField("retry_count", F.lit(0)), "checksum": F.lit(""),
        }
    )
    flat = built.select(
        *audited.columns, F.struct("id", "source_id", "source_split", C("question_text").alias("question"), C("answer_text").alias("answer"), C("language").alias("question_language"), C("language").alias("answer_language"),
                                   "candidates", "supporting_facts", "question_type", "difficulty", "provenance", "checksum").alias("record")
    )
    with_sum = flat.withColumn("record", C("record").withField("checksum", H.checksum(C("record"))))
    buildable = ~F.arrays_overlap("issues", F.array(*[F.lit(x) for x in ("invalid_context_type", "candidate_count_mismatch", "invalid_candidate_shape", "invalid_title_type", "invalid_sentences_type", "invalid_language_type", "unsupported_language", "invalid_question_type", "invalid_answer_type")]))
    return _validated(with_sum.withColumn("record", F.when(buildable, C("record"))))


def _validated(df: DataFrame) -> DataFrame:
    """``df`` with the issue canonical_validation_error where ``record`` is there and breaks a structural rule."""
    own = df.select("legacy_id", "member", "record.*").withColumn("__e", structural_error()).where("id is not null and __e is not null").select("legacy_id", "member", F.lit(True).alias("__bad")).distinct()
    issues = F.when(C("__bad"), F.array_sort(F.array_distinct(F.concat("issues", F.array(F.lit("canonical_validation_error")))))).otherwise(C("issues"))
    return df.join(own, ["legacy_id", "member"], "left").withColumn("issues", issues).drop("__bad")


def audit(joined: DataFrame, *, split: str) -> DataFrame:
    """``joined`` with the raw cells as VARIANT, ``language``, ``legacy_id``, ``raw_sha256`` and sorted ``issues``."""
    typed = joined.withColumns({n: F.try_variant_get(F.parse_json(f"cell_{n}"), "$.v", "variant") for n in CELLS})
    named = typed.withColumn("language", records.legacy_language(C("target_language")))
    view = F.when(F.lit(split == "train") & C("language").isNotNull(), F.concat(F.lit("--qa-"), C("language"))).otherwise("")
    return records.legacy_issues(named.withColumns({"legacy_id": F.concat(F.lit(f"xhp-{split}-"), C("source_id"), view), "raw_sha256": raw_hash()}))


def corrected(built: DataFrame, corrections: DataFrame, *, split: str) -> DataFrame:
    """``built`` with the records that ``corrections`` replace, and ``reason``. A correction that no row uses is a ContractError; one for other raw content gets the issue
    correction_raw_hash_mismatch, one that is no valid record or changes identity, candidates' sources or facts invalid_correction.
    """
    keys.require_empty(corrections.join(built, "legacy_id", "left_anti"), "corrections that no row uses", "legacy_id")
    found = built.join(corrections.select("legacy_id", C("raw_sha256").alias("__h"), C("reason"), F.from_json("replacement", CANONICAL, {"mode": "PERMISSIVE"}).alias("__r")), "legacy_id", "left")
    replaced = C("__r").withField("checksum", H.checksum(C("__r")))
    sources = F.transform("source_context", lambda p, i: F.struct(F.format_string("p%02d", i), p["title"], p["sentences"]))
    facts = F.transform("source_facts", lambda f: F.struct(f["paragraph_id"], f["sentence_id"], F.lit("support")))
    same = (
        C("__r.id").eqNullSafe(C("legacy_id")) & C("__r.source_id").eqNullSafe(C("source_id")) & C("__r.source_split").eqNullSafe(split)
        & F.transform("__r.candidates", lambda c: F.struct(c["id"], c["source_title"], c["source_sentences"])).cast("array<struct<a: string, b: string, c: array<string>>>").eqNullSafe(sources.cast("array<struct<a: string, b: string, c: array<string>>>"))
        & F.transform("__r.supporting_facts", lambda f: F.struct(f["paragraph_id"], f["sentence_id"], F.coalesce(f["role"], F.lit("support")))).cast("array<struct<a: string, b: int, c: string>>").eqNullSafe(facts.cast("array<struct<a: string, b: int, c: string>>"))
    )
    broken = found.where("__h is not null").select("legacy_id", "member", "__r.*").withColumn("__e", structural_error()).where("__e is not null or id is null").select("legacy_id", "member", F.lit(True).alias("__bad")).distinct()
    judged = found.join(broken, ["legacy_id", "member"], "left")
    one = lambda code: F.array(F.lit(code))
    issues = (
        F.when(C("__h").isNull(), C("issues")).when(C("__h") != C("raw_sha256"), F.array_sort(F.array_union("issues", one("correction_raw_hash_mismatch"))))
        .when(F.coalesce(C("__bad"), F.lit(False)) | ~F.coalesce(same, F.lit(False)), F.array_sort(F.array_union("issues", one("invalid_correction")))).otherwise(F.array().cast("array<string>"))
    )
    settled = judged.withColumn("__i", issues)
    applied = C("__h").isNotNull() & (F.size("__i") == 0)
    return settled.withColumns({"record": F.when(applied, replaced).otherwise(C("record")), "corrected": F.coalesce(applied, F.lit(False)), "issues": C("__i")}).drop("__h", "__r", "__bad", "__i")


def import_legacy(
    spark: SparkSession, shards: Sequence[str], source: str, output: str, *, split: str, corrections: str | None = None, provenance: dict[str, str] = HISTORICAL
) -> dict:
    """Writes canonical records, the quarantined rows with their raw cells and issues, the corrections applied, and the raw manifest, each as JSON lines in source order; the counts."""
    audited = audit(joined_rows(spark, shards, source, split=split), split=split)
    if split == "train":
        require_groups(audited)
    built = canonical(audited, split=split, provenance=provenance).withColumns({"corrected": F.lit(False), "reason": F.lit(None).cast("string")})
    if corrections:
        built = corrected(built.drop("corrected", "reason"), readers.corrections(spark, corrections), split=split)
    # VARIANT columns can't be written before the last step; the cells stay as text.
    rows = materialise(built.drop(*CELLS))
    locator = F.struct("shard", "shard_row", "raw_sha256").alias("raw")
    ordered = ["source_position", "member"]
    good, bad = records.route(rows)
    sinks.write_jsonl(good.select("record.*", *ordered), f"{output}/accepted", *ordered, drop=ordered)
    sinks.write_jsonl(bad.select("legacy_id", "source_id", "language", "issues", locator, *[C(f"cell_{n}").alias(n) for n in CELLS], *ordered), f"{output}/quarantine", *ordered, drop=ordered)
    sinks.write_jsonl(rows.where("corrected").select("legacy_id", "reason", locator, *ordered), f"{output}/corrections", *ordered, drop=ordered)
    sinks.write_jsonl(rows.select("legacy_id", "source_position", "shard", "shard_row", "raw_sha256", F.when(F.size("issues") == 0, "accepted").otherwise("quarantined").alias("outcome"), "member"), f"{output}/raw", *ordered)
    counts = rows.agg(F.count("*"), F.count_if(F.size("issues") == 0), F.count_if("corrected"), F.countDistinct("source_id")).first()
    issues = {r.issue: r.n for r in rows.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).collect()}  # at most 19 codes
    return {"sources": counts[3], "rows": counts[0], "accepted": counts[1], "quarantined": counts[0] - counts[1], "corrections": counts[2], "issues": issues}
