"""Judge samples and results: units, balanced samples, reports, summaries, bootstrap."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mhqa.functions.hashing import canonical_json, sample_rank
from mhqa.operators.keys import ContractError, latest

C = F.col
UNITS = ("paragraph", "question", "answer")
#: More combinations of language and unit than this can't be a balanced sample.
MAX_GROUPS = 10_000


def record_id(instance: Column, language: Column, paragraph: Column, source: Column, unit: Column) -> Column:
    """The identity of a unit: the hash of its canonical JSON."""
    return F.sha2(canonical_json(F.struct(instance.alias("instance_id"), language.alias("language"), paragraph.alias("paragraph_id"), source.alias("source_id"), unit.alias("unit"))), 256)


def units(instances: DataFrame, sources: DataFrame) -> DataFrame:
    """The judged units: paragraphs, questions and answers that aren't English, with the English text they come from.

    Paragraphs without source sentences and questions without source record are left out; ``missing_sources`` lists the latter.
    """
    keys = ["instance_id", "source_id", "source_split", "language", "unit", "paragraph_id", "source_text", "candidate_text", "context_question"]
    base = instances.select(C("id").alias("instance_id"), "source_id", "source_split", "question", "answer", C("question_language").alias("q"), "candidates")
    paragraphs = base.select("instance_id", "source_id", "source_split", F.explode("candidates").alias("c")).where("c.language != 'en' and c.source_sentences is not null").select(
        "instance_id", "source_id", "source_split", C("c.language").alias("language"), F.lit("paragraph").alias("unit"), C("c.id").alias("paragraph_id"), F.array_join("c.source_sentences", " ").alias("source_text"), F.array_join("c.sentences", " ").alias("candidate_text"), F.lit(None).cast("string").alias("context_question")
    )
    paired = base.where("q != 'en'").join(sources.select("source_id", C("question").alias("sq"), C("answer").alias("sa")), "source_id")
    none = F.lit(None).cast("string")
    pair = F.explode(F.array(F.struct(F.lit("question").alias("unit"), C("sq").alias("source_text"), C("question").alias("candidate_text"), none.alias("context_question")), F.struct(F.lit("answer").alias("unit"), C("sa").alias("source_text"), C("answer").alias("candidate_text"), C("sq").alias("context_question")))).alias("u")
    pairs = paired.select("instance_id", "source_id", "source_split", C("q").alias("language"), pair).select("instance_id", "source_id", "source_split", "language", "u.unit", none.alias("paragraph_id"), "u.source_text", "u.candidate_text", "u.context_question")
    return paragraphs.select(keys).unionByName(pairs.select(keys))


def missing_sources(instances: DataFrame, sources: DataFrame) -> DataFrame:
    return instances.where("question_language != 'en'").select("id", "source_id").join(sources.select("source_id"), "source_id", "left_anti")


def sample(units: DataFrame, *, paragraphs: int = 80, questions: int = 20, answers: int = 20, seed: int = 20260810) -> DataFrame:
    """The units with the least ranks of each language, whatever the order of the input; questions and answers are drawn in pairs.

    Only the first ranks of each language are kept while sorting (a group limit below the window), so a hot language costs no large sort.
    """
    ranked = units.withColumn("rank", sample_rank(seed, F.concat("language", F.when(C("unit") == "paragraph", ":paragraph").otherwise(":qa")), F.when(C("unit") == "paragraph", record_id(C("instance_id"), C("language"), C("paragraph_id"), C("source_id"), C("unit"))).otherwise(C("instance_id"))))
    n = F.row_number().over(Window.partitionBy("language", "unit").orderBy("rank", "instance_id", "paragraph_id"))
    limit = F.when(C("unit") == "paragraph", paragraphs).when(C("unit") == "question", questions).otherwise(answers)
    return ranked.withColumn("n", n).where(C("n") <= max(paragraphs, questions, answers)).where(C("n") <= limit)


def last_results(results: DataFrame) -> DataFrame:
    """The last row of each record: by time of judging, then of loading, then by attempts and score, so that ties are settled."""
    return latest(results, ["record_id"], F.desc_nulls_last("judged_at"), F.desc_nulls_last("loaded_at"), F.desc_nulls_last("attempts"), F.desc_nulls_last("score"), F.desc_nulls_last("rationale"))


def report(results: DataFrame) -> DataFrame:
    """(level, language, unit, n, judged, failed, mean, min, max, retries): overall, by unit, by language and unit; null scores are failed."""
    sets = results.groupingSets([[], ["unit"], ["language", "unit"]], "language", "unit").agg(
        F.grouping_id().cast("int").alias("g"), F.count("*").alias("n"), F.count("score").alias("judged"), F.count_if(C("score").isNull()).alias("failed"), F.avg("score").alias("mean"),
        F.min("score").alias("min"), F.max("score").alias("max"), F.sum(F.greatest(F.coalesce(C("attempts"), F.lit(1)) - 1, F.lit(0))).cast("long").alias("retries"),
    )
    level = F.when(C("g") == 3, "overall").when(C("g") == 2, "unit").otherwise("language_unit")
    return sets.select(level.alias("level"), "language", "unit", "n", "judged", "failed", "mean", "min", "max", "retries")


def _summary() -> list[Column]:
    return [
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.stddev_samp("score").alias("sd"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.count_if(C("score") < 60).alias("below_60"), F.count_if(C("score") < 80).alias("below_80"), F.count_if(C("score") >= 90).alias("from_90"),
    ]


def score_summary(results: DataFrame, *by: str) -> DataFrame:
    """(*by, n, mean, median, sd, min, max, below_60, below_80, from_90) of the scores that aren't null."""
    return results.where("score is not null").groupBy(*by).agg(*_summary())


def summary_cube(results: DataFrame) -> DataFrame:
    """The score summary overall, by unit, by language, by both, and by split, in one pass: (level, language, unit, split, …)."""
    scored = results.where("score is not null").withColumnRenamed("source_split", "split")
    sets = scored.groupingSets([[], ["unit"], ["language"], ["language", "unit"], ["split"]], "language", "unit", "split").agg(F.grouping_id().cast("int").alias("g"), *_summary())
    level = F.when(C("g") == 7, "overall").when(C("g") == 5, "unit").when(C("g") == 3, "language").when(C("g") == 1, "language_unit").otherwise("split")
    return sets.select(level.alias("level"), "language", "unit", "split", "n", "mean", "median", "sd", "min", "max", "below_60", "below_80", "from_90")


def require_balance(results: DataFrame, expected: dict[str, int], *, languages: int) -> None:
    """ContractError unless ids are unique and every language has the expected number of each unit."""
    if (groups := results.select("language", "unit").distinct().count()) > MAX_GROUPS:
        raise ContractError(f"{groups} groups of language and unit")
    total, distinct = results.agg(F.count("*"), F.countDistinct("record_id")).first()
    counts = {(r.language, r.unit): r.n for r in results.groupBy("language", "unit").agg(F.count("*").alias("n")).collect()}
    found = {language for language, _ in counts}
    wrong = {(x, u): counts.get((x, u), 0) for x in found for u, n in expected.items() if counts.get((x, u), 0) != n}
    if total != distinct or len(found) != languages or wrong or total != languages * sum(expected.values()):
        raise ContractError(f"unbalanced: {total} rows, {distinct} ids, {len(found)} languages, {dict(list(wrong.items())[:5])}")


def bootstrap(results: DataFrame, *, replicates: int, seed: int, strata: tuple[str, ...] = ("language", "unit")) -> DataFrame:
    """(unit, replicate, mean): means of a stratified bootstrap, n out of n with replacement within each stratum; ``unit`` is null for all units.

    Scores are whole numbers, so each stratum is first counted by score; a replicate is then one multinomial draw over at most 101 counts,
    however many rows the stratum has. Draws depend on seed, stratum and replicate alone.
    """
    histogram = results.where("score is not null").groupBy(*strata, "score").agg(F.count("*").alias("n"))
    lists = histogram.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct("score", "n"))).alias("h")).withColumn("key", F.concat_ws("\x1f", *[F.coalesce(C(c).cast("string"), F.lit("\x1e")) for c in strata]))
    schema = pa.schema([("unit", pa.string()), ("replicate", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, key, entries in zip(batch["unit"].to_pylist(), batch["key"].to_pylist(), batch["h"].to_pylist()):
                scores, counts = np.array([e["score"] for e in entries]), np.array([e["n"] for e in entries])
                generator = np.random.default_rng([seed, zlib.crc32(key.encode())])
                totals = generator.multinomial(counts.sum(), counts / counts.sum(), size=replicates) @ scores
                yield pa.RecordBatch.from_arrays([pa.array([unit] * replicates, pa.string()), pa.array(range(replicates), pa.int32()), pa.array(totals, pa.int64()), pa.array([int(counts.sum())] * replicates, pa.int64())], schema=schema)

    drawn = lists.select("unit", "key", "h").mapInArrow(draw, "unit string, replicate int, total long, n long")
    return drawn.groupingSets([["unit", "replicate"], ["replicate"]], "unit", "replicate").agg((F.sum("total") / F.sum("n")).alias("mean"))


def interval(distribution: DataFrame) -> DataFrame:
    """(unit, replicates, mean, low, high): the percentile interval of 95 % with linear interpolation."""
    return distribution.groupBy("unit").agg(F.count("*").alias("replicates"), F.avg("mean").alias("mean"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def bootstrap_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """The interval of second - first of two independent distributions, replicate by replicate."""
    a, b = first.select("unit", "replicate", C("mean").alias("a")), second.select("unit", "replicate", C("mean").alias("b"))
    joined = a.join(b, a["unit"].eqNullSafe(b["unit"]) & (a["replicate"] == b["replicate"])).select(a["unit"], a["replicate"], (C("b") - C("a")).alias("mean"))
    return interval(joined)
