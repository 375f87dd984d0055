"""Texts that stop before their end, and how often each source cuts (problem 2).

A backward character n-gram model reads each masked text from its end: how often does this final context end a text, and how often does the
same context go on? Names, figures and quoted titles are masked, so that the contexts recur. Where the model can't know, because only the last
name or figure is cut, an exact check follows: the last word is the beginning of a longer word of the same record, or of a word that often ends
texts of this language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mhqa.llm.langid import QUOTES, inventory, label_code
from mhqa.llm.textforms import clean
from mhqa.runtime import materialise

# -- fixed values ------------------------------------------------------------------------------------------------------
#: Marks that a cut leaves: ellipses, brackets, halves of escapes and entities, the replacement character.
CUT_MARKS = re.compile(r"(?:\s*(?:\[\s*(?:\.{2,}|…)?\s*\]?|\(\s*(?:\.{2,}|…)\s*\)?|…|\.{2,}|�+|\\u?[0-9a-fA-F]{0,4}|&(?:[a-zA-Z]{0,5}|#x?[0-9a-fA-F]{0,5});?|<[^<>\s]{0,12}|[-–—~|/]+))+\s*$")
TERMINAL = ".!?。！？؟۔।॥"
CLOSING = "\"'”’»）)]』」》“"
# ----------------------------------------------------------------------------------------------------------------------

_LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"
_QUOTED = re.compile("|".join(f"{re.escape(a)}[^{re.escape(b)}]{{1,90}}{re.escape(b)}" for a, b in QUOTES))
_OPEN = re.compile("[„“«《『「\"]")
_NAME = re.compile(f"[{_LATIN}]+(?:[-'’.][{_LATIN}]+)*|[Ѐ-ӿ]+(?:-[Ѐ-ӿ]+)*")
_NAMES = re.compile(r"N(?:\s+N)+")
_FIGURE = re.compile(r"\d+(?:[.,:]\d+)*")
_LAST = re.compile(rf"(?:[{_LATIN}]+|[Ѐ-ӿ]+|\d+|[؀-ۿ]+|[ऀ-ॿ]+)$")

ORDERS = (24, 16, 11, 7)
EVIDENCE, SMOOTHING = 4, 0.5
#: Answers without the end of a sentence and with so many masked characters at most are values (names, dates, words), which no sentence's context describes.
PLAIN, PLAIN_SHARE = 24, 0.25
#: Thresholds: of log-odds for a text without and with the end of a sentence; the share of ended texts that may fall under the latter; the least frequency of a known last word.
LOG_ODDS_ENDED, QUANTILE, FREQUENT, FREQUENT_LEAST = -4.0, 0.002, 1e-5, 3
#: The limit of texts that don't end as a sentence: the odds that this share of the ended texts of the language and column don't reach, within these bounds.
OPEN_QUANTILE, OPEN_BOUNDS = 0.01, (-1.5, -0.75)


def body(text: str) -> tuple[str, bool, bool]:
    """(``text`` in consistent form without what stands at its end, whether it ends as a sentence does, whether a cut mark stands there)."""
    text = clean(text).strip()
    marked = CUT_MARKS.search(text)
    if marked and marked.start():
        text = text[: marked.start()].rstrip()
    stripped = text.rstrip(TERMINAL + CLOSING + " ")
    ended = any(c in TERMINAL for c in text[len(stripped) :])
    return text.rstrip(TERMINAL + " "), ended, bool(marked and marked.start())


def mask(text: str) -> str:
    """``text`` with closed quotations as §, runs of capitalised words as N and figures as 0; an open quotation keeps its mark."""
    text = _OPEN.sub("“", _QUOTED.sub("§", text))
    text = _NAME.sub(lambda m: "N" if m.group()[0].isupper() else m.group(), text) if any(c.islower() for c in text) else _NAME.sub("N", text)
    return _FIGURE.sub("0", _NAMES.sub("N", text))


def last_word(text: str) -> str:
    found = _LAST.search(text)
    return found.group() if found else ""


def cut_in_record(text: str, record: str) -> bool:
    """Whether the last word of ``text`` is no word of ``record`` but begins longer words of it."""
    word = last_word(text)
    if not word or len(word) < 2 and not (word.isdigit() or word.isupper()):
        return False
    at, longer = record.find(word), False
    while at >= 0:
        if not (at and record[at - 1].isalnum()):
            after = record[at + len(word) : at + len(word) + 1]
            if not after.isalnum():
                return False
            longer = True
        at = record.find(word, at + 1)
    return longer


def continued_in_record(text: str, record: str) -> bool:
    """Whether ``text``, a name or its first part, is always followed by a further capitalised word where it occurs in ``record``."""
    if not text[:1].isupper():
        return False
    at, n = record.find(text), 0
    while at >= 0:
        before, after = record[at - 1 : at] if at else "", record[at + len(text) : at + len(text) + 2]
        if not before.isalnum() and not after[:1].isalnum():
            n += 1
            if not (after[:1] == " " and after[1:].isupper()):
                return False
        at = record.find(text, at + 1)
    return n > 0


_ODD, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def context_hashes(masked: str) -> list[np.ndarray]:
    """For each order, the hash of the context before each position of the text (with its start marked); an order longer than what precedes has no entry there."""
    codes = np.frombuffer(("^" + masked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(7)
    with np.errstate(over="ignore"):
        down = np.cumprod(np.full(len(codes), _INVERSE, np.uint64))
        up = np.cumprod(np.full(len(codes), _ODD, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * down)])
        return [(sums[k:] - sums[:-k]) * up[k - 1 :] * np.uint64(2 * k + 1) for k in ORDERS if k <= len(codes)]


def ngrams(masked: DataFrame) -> DataFrame:
    """(column, masked) -> (context, goes_on, ends): how often each context that ends some text goes on and ends. ``masked`` has (masked, n).

    Contexts are hashed; those that never end a text are dropped after the count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on, on_n, end, end_n = [], [], [], []
            for text, n in zip(batch["masked"].to_pylist(), batch["n"].to_pylist()):
                for hashes in context_hashes(text):
                    on.append(hashes[:-1])
                    on_n.append(np.full(len(hashes) - 1, n))
                    end.append(hashes[-1:])
                    end_n.append(n)
            if not end:
                continue
            keys, at = np.unique(np.concatenate(on + end), return_inverse=True)
            split = sum(map(len, on))
            goes_on = np.bincount(at[:split], np.concatenate(on_n), len(keys)).astype(np.int64)
            ends = np.bincount(at[split:], np.array(end_n), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(goes_on), pa.array(ends)], names=["context", "goes_on", "ends"])

    counted = masked.mapInArrow(count, "context long, goes_on long, ends long")
    return counted.groupBy("context").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends")).where("ends > 0")


def final_contexts(forms: DataFrame) -> DataFrame:
    """``forms`` (with masked) exploded to (…, order, context), the longest order first."""

    @F.arrow_udf("array<long>")
    def hashes(values: pa.Array) -> pa.Array:
        return pa.array([[int(h[-1:].view(np.int64)[0]) for h in context_hashes(v)] for v in values.to_pylist()], pa.list_(pa.int64()))

    return forms.select("*", F.posexplode(hashes("masked")).alias("order", "context"))


_UNITS = "id string, paragraph_id string, sentence_id int, shard string, column string, language string, masked string, word string, ended boolean, marked boolean, open boolean, in_record boolean, plain boolean"


def unit_features(instances: DataFrame, known: dict[str, str]) -> DataFrame:
    """One row for each non-empty sentence and answer, with what the decision needs; null, blank and sign-only texts and copies of the question give none."""
    fields = [f.split() for f in _UNITS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in fields])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str | None, str] = {}

        def code(label: str | None) -> str:
            if label not in codes:
                codes[label] = label_code(label, known) or "und"
            return codes[label]

        for batch in batches:
            rows: list[tuple] = []
            for i, shard, question, answer, label, candidates in zip(*(batch[c].to_pylist() for c in ("id", "shard", "question", "answer", "question_language", "candidates"))):
                candidates = [c for c in candidates or [] if c]
                english = [s for c in candidates for s in c["source_sentences"] or [] if s] + [question or ""] + [t for c in candidates for t in (c["title"], c["source_title"]) if t]
                whole = ""
                for c in candidates:
                    sentences = c["sentences"] or []
                    for k, s in enumerate(sentences):
                        text, ended, marked = body(s) if s else ("", False, False)
                        if not text:
                            continue
                        masked = mask(text)
                        record = False
                        if not ended:
                            others = "\n".join([*english, *(x for j, x in enumerate(sentences) if j != k and x)])
                            record = cut_in_record(text, others) or continued_in_record(last_word(text), others)
                        rows.append((i, c["id"], k, shard, "sentences", code(c["language"]), masked, last_word(text).casefold(), ended, marked, "“" in masked, record, False))
                text, ended, marked = body(answer) if answer else ("", False, False)
                if text and any(x.isalnum() for x in text) and not copies(question, answer):
                    whole = "\n".join([*english, *(s for c in candidates for s in c["sentences"] or [] if s)])
                    masked = mask(text)
                    plain = not ended and len(masked) <= PLAIN
                    record = not ended and (cut_in_record(text, whole) or continued_in_record(text if plain else last_word(text), whole))
                    rows.append((i, "", -1, shard, "answer", code(label), masked, (text if plain else last_word(text)).casefold(), ended, marked, "“" in masked, record, plain))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    chosen = instances.select(
        "id", "shard", "question", "answer", "question_language",
        F.transform("candidates", lambda c: F.struct(*(c[n].alias(n) for n in ("id", "title", "sentences", "language", "source_title", "source_sentences")))).alias("candidates"),
    )
    return chosen.mapInArrow(features, _UNITS)


def copies(question: str | None, answer: str | None) -> bool:
    """Whether ``answer`` begins as ``question`` does, for half of it at least: then it repeats the question and isn't a text of its own."""
    if not question or not answer or len(answer) < 12:
        return False
    q, a = clean(question).strip().casefold(), clean(answer).strip().casefold()
    return a[: len(a) // 2] in q or q[: len(q) // 2] in a


def truncated_units(instances: DataFrame, known: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(all units, the cut ones): rows of ``unit_features``, the cut ones distinct.

    A text is cut if a cut mark stands at its end, if it doesn't end as a sentence does and an opened quotation stays open, its final context
    goes on more often than it ends (log-odds under a limit learned for its language and column), or its last word is only the beginning of
    a word; or if it ends as a sentence does but its context hardly ever ends a text.
    """
    units = materialise(unit_features(instances, known))
    forms = units.groupBy("column", "language", "masked", "plain").agg(F.count("*").alias("n"), F.count_if("ended").alias("n_ended"))
    model = ngrams(forms.where("not plain").groupBy("masked").agg(F.sum("n").alias("n")))
    evidence = final_contexts(forms.where("not plain")).join(model, "context").where(F.col("goes_on") + F.col("ends") >= EVIDENCE)
    odds = F.log((F.col("ends") + SMOOTHING) / (F.col("goes_on") + SMOOTHING))
    longest = evidence.groupBy("column", "language", "masked").agg(F.min_by(odds, "order").alias("odds"), F.first("n_ended").alias("n_ended"))
    limits = longest.where("n_ended > 0").groupBy("column", "language").agg(
        F.expr(f"percentile(round(odds, 2), {QUANTILE}, n_ended)").alias("ended_limit"), F.expr(f"percentile(round(odds, 2), {OPEN_QUANTILE}, n_ended)").alias("open_limit")
    )
    open_limit = F.greatest(F.lit(OPEN_BOUNDS[0]), F.least(F.lit(OPEN_BOUNDS[1]), F.coalesce("open_limit", F.lit(OPEN_BOUNDS[0]))))
    low = longest.join(F.broadcast(limits), ["column", "language"], "left").where(F.col("odds") < open_limit)  # one row for each language and column
    low = low.select("column", "language", "masked", F.lit(True).alias("low"), (F.col("odds") <= F.least(F.coalesce("ended_limit", F.lit(LOG_ODDS_ENDED)), F.lit(LOG_ODDS_ENDED))).alias("very_low"))

    total = units.count()
    final = units.where("(ended or plain) and word != '' and not marked").groupBy("column", "word").agg(F.count("*").alias("n")).where(F.col("n") >= max(FREQUENT_LEAST, int(FREQUENT * total)))
    beginnings = final.select("column", F.explode(F.expr("transform(sequence(3, greatest(3, length(word) - 1)), k -> substring(word, 1, k))")).alias("word")).distinct().join(final, ["column", "word"], "left_anti")
    words = final.select("column", "word", F.lit(True).alias("frequent")).unionByName(beginnings.select("column", "word", F.lit(False).alias("frequent")))

    # A value whose form is rare beside the forms that go on from it, as a day and month beside whole dates.
    values = forms.where("plain").groupBy("column", "language", "masked").agg(F.sum("n").alias("n"))
    parts = F.expr("transform(sequence(1, greatest(1, size(split(masked, ' ')) - 1)), k -> array_join(slice(split(masked, ' '), 1, k), ' '))")
    longer = values.where("instr(masked, ' ') > 0").select("column", "language", F.explode(parts).alias("masked"), "n").groupBy("column", "language", "masked").agg(F.sum("n").alias("longer"))
    partial = values.join(longer, ["column", "language", "masked"]).where(F.col("longer") >= EVIDENCE).where(F.col("n") < PLAIN_SHARE * F.col("longer"))
    low = low.unionByName(partial.select("column", "language", "masked", F.lit(True).alias("low"), F.lit(False).alias("very_low")))

    joined = units.join(low, ["column", "language", "masked"], "left").join(words, ["column", "word"], "left")
    cut = joined.where(
        "marked or not ended and (open or coalesce(low, false) and not (plain and coalesce(frequent, false)) or in_record and not coalesce(frequent, false) or coalesce(not frequent, false))"
        " or ended and coalesce(very_low, false)"
    )
    return units, cut.select(*units.columns).distinct()


def truncated(instances: DataFrame, languages: DataFrame) -> DataFrame:
    """p2_found: (id, paragraph_id, sentence_id) of each sentence or answer of which words are lost at the end."""
    return truncated_units(instances, inventory(languages))[1].select("id", "paragraph_id", "sentence_id").distinct()


def truncation_rates(instances: DataFrame, languages: DataFrame) -> DataFrame:
    """(shard, column, texts, cut, rate): how often each source cuts. Repeated rows of an id count once; texts without words don't count."""
    units, cut = truncated_units(instances, inventory(languages))
    key = ["id", "paragraph_id", "sentence_id"]
    seen = units.groupBy(*key, "column").agg(F.min("shard").alias("shard")).join(cut.select(*key).distinct().withColumn("cut", F.lit(1)), key, "left")
    return seen.groupBy("shard", "column").agg(F.count("*").alias("texts"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut")).withColumn("rate", F.col("cut") / F.col("texts"))
