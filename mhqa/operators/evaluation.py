"""Scores of predictions, language strata and the report over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mhqa.functions import scoring as S
from mhqa.functions import text as X
from mhqa.operators.keys import latest
from mhqa.schemas import CODES

C = F.col
PROTOCOLS = ("unicode_script_aware", "legacy_hotpot")


def gold_records(instances: DataFrame) -> DataFrame:
    """One row for each id (the last import), with known languages only, as the evaluation needs them."""
    one = latest(instances.select("id", "answer", "question_language", "candidates", "supporting_facts", "imported_at"), ["id"], F.desc_nulls_last("imported_at"))
    return one.where(C("question_language").isin(*CODES) & F.forall("candidates", lambda c: F.coalesce(c["language"].isin(*CODES), F.lit(False)))).drop("imported_at")


def strata(gold: DataFrame, *keep: str) -> DataFrame:
    """(*keep, id, question_language, gold_mismatch, distractor_mismatch, gold_entropy, gold_languages, candidate_languages, distractors, condition, script_relation)."""
    ids = F.array_distinct(F.transform("supporting_facts", lambda f: f["paragraph_id"]))
    of_gold = F.array_compact(F.transform(ids, lambda i: F.get(F.filter("candidates", lambda c: c["id"] == i), F.lit(0))["language"]))
    of_rest = F.transform(F.filter("candidates", lambda c: ~F.array_contains(ids, c["id"])), lambda c: c["language"])
    df = gold.select(*keep, "id", "question_language", of_gold.alias("g"), of_rest.alias("d"), F.transform("candidates", lambda c: c["language"]).alias("k")).where(F.size("g") > 0)
    described = df.select(
        *keep, "id", "question_language",
        S.mismatch(C("question_language"), C("g")).alias("gold_mismatch"), S.mismatch(C("question_language"), C("d")).alias("distractor_mismatch"), S.entropy(C("g")).alias("gold_entropy"),
        F.size(F.array_distinct("g")).alias("gold_languages"), F.size(F.array_distinct("k")).alias("candidate_languages"), F.size("d").alias("distractors"),
        S.script_relation(S.script(C("question_language")), F.transform("g", S.script)).alias("script_relation"),
    )
    return described.withColumn("condition", S.condition(C("gold_mismatch"), C("distractor_mismatch"), C("gold_languages")))


def scored(gold: DataFrame, predictions: DataFrame, *, protocol: str = PROTOCOLS[0], keep: Sequence[str] = ()) -> DataFrame:
    """(id, [system,] missing, answer, support, joint, *keep): a struct(em, p, r, f1) for each score. A missing prediction, answer or list of facts counts as empty.

    Where ``predictions`` has a column ``system``, each system is scored on all gold records; the systems, a handful of names, are broadcast.
    """
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol!r}")
    own = [c for c in predictions.columns if c == "system"]
    wanted = gold.select("id", "question_language", C("answer").alias("g"), C("supporting_facts").alias("gf"), *[c for c in keep if c not in ("id", "question_language")])
    if own:
        wanted = wanted.crossJoin(F.broadcast(predictions.select("system").where("system is not null").distinct()))
    pairs = wanted.join(predictions.select("id", *own, C("answer").alias("p"), C("supporting_facts").alias("pf"), F.lit(True).alias("there")), ["id", *own], "left")
    fact = lambda f: F.struct(f["paragraph_id"].alias("p"), f["sentence_id"].alias("s"))
    facts = lambda c: F.transform(F.coalesce(C(c), F.array()), fact)
    if protocol == "legacy_hotpot":
        form, words = X.normalize_legacy, X.legacy_tokens
    else:
        form, words = (lambda t: X.normalize_unicode(F.coalesce(t, F.lit("")), C("question_language"))), (lambda t: X.unicode_tokens(F.coalesce(t, F.lit("")), C("question_language")))
    forms = pairs.select("id", *own, *keep, C("there").isNull().alias("missing"), form(C("p")).alias("pn"), form(C("g")).alias("gn"), words(C("p")).alias("pt"), words(C("g")).alias("gt"), facts("pf").alias("pf"), facts("gf").alias("gf"))
    both = forms.select("id", *own, *keep, "missing", S.answer_score(C("pn"), C("gn"), C("pt"), C("gt")).alias("answer"), S.support_score(C("pf"), C("gf")).alias("support"))
    return both.withColumn("joint", S.joint_score(C("answer"), C("support")))


_METRICS = [f"{c}_{m}" for c in ("answer", "support", "joint") for m in ("em", "p", "r", "f1")]


def _means() -> list[Column]:
    return [F.avg(C(n.rsplit("_", 1)[0])[n.rsplit("_", 1)[1]]).alias(n) for n in _METRICS]


def report(gold: DataFrame, predictions: DataFrame, *, protocol: str = PROTOCOLS[0]) -> DataFrame:
    """([system,] section, key, n, the means of twelve metrics): overall and by seven properties, in one pass over the scored examples, which carry their descriptors along."""
    described = strata(gold, "answer", "supporting_facts")
    examples = scored(described, predictions, protocol=protocol, keep=[c for c in described.columns if c not in ("id", "answer", "supporting_facts")])
    own = [c for c in predictions.columns if c == "system"]
    sections = F.array(
        F.struct(F.lit("overall").alias("section"), F.lit("").alias("key")),
        *[
            F.struct(F.lit(n).alias("section"), F.coalesce(v.cast("string"), F.lit("")).alias("key"))
            for n, v in (
                ("question_language", C("question_language")), ("condition", C("condition")), ("script_relation", C("script_relation")), ("gold_mismatch", S.mismatch_bin(C("gold_mismatch"))),
                ("distractor_mismatch", S.mismatch_bin(C("distractor_mismatch"))), ("gold_entropy", S.entropy_bin(C("gold_entropy"))), ("candidate_languages", S.count_bin(C("candidate_languages"))),
            )
        ],
    )
    return examples.select(*own, "answer", "support", "joint", F.explode(sections).alias("s")).groupBy(*own, C("s.section").alias("section"), C("s.key").alias("key")).agg(F.count("*").alias("n"), *_means())


def macro(gold: DataFrame, predictions: DataFrame, *, protocol: str = PROTOCOLS[0]) -> DataFrame:
    """([system,] component, em, f1): the unweighted mean of the languages' means."""
    by = report(gold, predictions, protocol=protocol).where("section = 'question_language'")
    own = [c for c in predictions.columns if c == "system"]
    one = by.groupBy(*own).agg(*[F.avg(f"{c}_{m}").alias(f"{c}_{m}") for c in ("answer", "support", "joint") for m in ("em", "f1")])
    return one.select(*own, F.explode(F.array(*[F.struct(F.lit(c).alias("component"), C(f"{c}_em").alias("em"), C(f"{c}_f1").alias("f1")) for c in ("answer", "support", "joint")])).alias("x")).select(*own, "x.*")


def summaries(described: DataFrame) -> DataFrame:
    """(descriptor, n, not_applicable, mean, median, min, max) of the four numeric descriptors."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("descriptor"), C(n).cast("double").alias("v")) for n in ("gold_mismatch", "distractor_mismatch", "gold_entropy", "candidate_languages")])).alias("x")
    return described.select(values).groupBy("x.descriptor").agg(
        F.count("x.v").alias("n"), F.count_if(C("x.v").isNull()).alias("not_applicable"), F.avg("x.v").alias("mean"), F.median("x.v").alias("median"), F.min("x.v").alias("min"), F.max("x.v").alias("max")
    )


def prediction_errors(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(code, rows): predictions with null ids, repeated ids of a system, ids that no gold record has, and facts that are malformed, repeated or out of bounds."""
    known = gold.select("id", F.transform("candidates", lambda c: F.struct(c["id"].alias("id"), F.size(c["sentences"]).alias("n"))).alias("sizes"))
    counts = predictions.where("id is not null").groupBy("id", "system").agg(F.count("*").alias("same")).where("same > 1")  # null ids, maybe many, need no count
    rows = predictions.select("id", "system", C("supporting_facts").alias("f"))
    joined = rows.join(counts.withColumnRenamed("id", "i").withColumnRenamed("system", "s"), (C("id") == C("i")) & C("system").eqNullSafe(C("s")), "left").drop("i", "s").join(known, "id", "left")
    facts = F.coalesce(C("f"), F.array())
    codes = F.array(
        F.when(C("id").isNull(), "null_id"), F.when(C("same") > 1, "repeated"), F.when(C("sizes").isNull(), "unexpected"),
        F.when(F.exists(facts, lambda f: f["paragraph_id"].isNull() | (f["paragraph_id"] == "") | f["sentence_id"].isNull() | (f["sentence_id"] < 0)), "malformed_fact"),
        F.when(F.size(F.array_distinct(facts)) < F.size(facts), "repeated_fact"),
        F.when(C("sizes").isNotNull() & F.exists(facts, lambda f: ~F.exists("sizes", lambda c: F.coalesce((c["id"] == f["paragraph_id"]) & (f["sentence_id"] < c["n"]), F.lit(False)))), "fact_out_of_bounds"),
    )
    return joined.select(F.explode(F.array_compact(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("rows"))

