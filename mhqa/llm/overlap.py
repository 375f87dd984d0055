"""The same or nearly the same records in different splits, by fingerprints (problem 6).

Each text is a question or the source sentences of a candidate, one line each. Of enough lines of a text of one split (the left one) the least of the line's uncommon and
capitalised words by rarity and hash are selected; each, or a near spelling of it, must stand in a line with the same figures of a text of the other split. So only pairs that share a rare word and all figures of a line are
compared: their shared word triples (rolling hashes of the words' codes) are chained in order, the chain is extended by alignment, and coverage of both texts, figures and
names decides. Only distinct texts are compared; the records that have them are joined at the end.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator, Mapping
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mhqa.llm.textforms import plain
from mhqa.runtime import materialise

_IDEO = "㐀-鿿぀-ヿ"
_TOKEN = re.compile(rf"[{_IDEO}]|\d+|[^\W\d_{_IDEO}]+")
_OTHER_DIGIT = re.compile("[٠-٩۰-۹०-९]")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "0123456789" * 3)

GRAM = 3
ROLL, MASK, BEHIND = 1_000_003, (1 << 61) - 1, 1 << 61
#: A word is common if at least this share of all texts has it. Shares from COUNTED_SHARE on are known to every task: at most (words a text) / COUNTED_SHARE words.
COMMON_SHARE, COMMON_LEAST, COUNTED_SHARE = 0.0008, 12, 0.0001
#: Words of a larger share of all texts aren't selected.
SELECTED_SHARE = 0.01
#: So many words of a line are selected, no two of them neighbours. A line of fewer, and in the other split one of so many or fewer, also goes by its words run together.
LEADS, FEW_WORDS = 3, 4
SAME_SENTENCES, COVERAGE = 2 / 3, 0.6


CAPITAL = "^"


def form_of(text: str) -> str:
    """Words, figures and ideographs of ``text`` with single spaces between, without case, accents, punctuation and differences of character form.

    A word written with a capital, but for the first one, has CAPITAL before it: names, words of titles.
    """
    if not text.isascii():
        if _OTHER_DIGIT.search(text):
            text = text.translate(_DIGITS)
        text = plain(text, fold=False)
    written = _TOKEN.findall(text)
    folded = " ".join(written).casefold().split(" ")
    return " ".join([CAPITAL + w if k and t[0].isupper() else w for k, (t, w) in enumerate(zip(written, folded))])


def words_of(form: str) -> list[str]:
    return form.replace(CAPITAL, "").split()


def tokens(text: str) -> list[str]:
    return words_of(form_of(text))


@lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    return zlib.crc32(word.encode())


def fingerprints(words: list[str], common: frozenset[str]) -> list[int]:
    """Hashes of all word triples; those of common words alone sort behind all others."""
    if not words:
        return []
    codes, usual = [_code(w) for w in words], [w in common for w in words]
    if len(words) < GRAM:
        return [(sum(c * ROLL**k for k, c in enumerate(codes)) & MASK) + (BEHIND if all(usual) else 0)]
    # Each triple's hash follows from its words' codes by rolling.
    return sorted({((a * ROLL + b) * ROLL + c & MASK) + (BEHIND if x and y and z else 0) for a, b, c, x, y, z in zip(codes, codes[1:], codes[2:], usual, usual[1:], usual[2:])})


@lru_cache(maxsize=100_000)
def spellings(word: str) -> tuple[int, ...]:
    """Codes of ``word`` and, from four letters on, of what is left without one letter. Two words that are ``near`` share one."""
    found = {word}
    if not word[0].isdigit() and len(word) >= 4:
        found |= {word[:k] + word[k + 1 :] for k in range(len(word))}
    return tuple(_code(w) * ROLL & MASK for w in found)


def figures_of(words: list[str]) -> int:
    return _code(" ".join(sorted(w for w in words if w[0].isdigit())))


def _indexed(word: str, shares: Mapping[str, float]) -> bool:
    return len(word) > 1 and not word[0].isdigit() and shares.get(word, 0.0) < SELECTED_SHARE


def run_together(words: list[str], i: int) -> list[str]:
    """The word of place ``i`` with the one before it, and with the one behind it."""
    return [words[k] + words[k + 1] for k in (i - 1, i) if 0 <= k < len(words) - 1 and not words[k][0].isdigit() and not words[k + 1][0].isdigit()]


def mark_of(figures: int, a: str, b: str | None) -> int:
    """What a line is found by: two of its words, or one, and all its figures. The same in SQL: ``_mark``."""
    x, y = _code(a), _code(b) if b is not None else 0
    return ((x + y) * ROLL + (x ^ y)) ^ figures * ROLL


def _mark(figures: Column, a: Column, b: Column) -> Column:
    x, y = F.crc32(a.cast("binary")), F.coalesce(F.crc32(b.cast("binary")), F.lit(0).cast("long"))
    return ((x + y) * F.lit(ROLL).cast("long") + x.bitwiseXOR(y)).bitwiseXOR(figures * F.lit(ROLL).cast("long"))


def _of_field(mark: Column) -> Column:
    """Marks of questions and of sentences differ."""
    return F.when(F.col("field") == "question", mark.bitwiseXOR(F.lit(1 << 62))).otherwise(mark)


def short_key() -> Column:
    """64 bits of a text's field and key: enough to find candidates by, since these are compared as texts."""
    return F.xxhash64("field", "key")


def selected(form: str, shares: Mapping[str, float]) -> list[tuple[int, str, str | None, bool, bool]] | None:
    """What a left text is found by: (figures of the line, word, another word, whether each may be misspelt), of so many lines that at least one of them must have its counterpart; None if too few have such words, uncommon or capitalised.

    Of three selected words of a line any two do, so that one may be written apart or together with its neighbour in the counterpart. Fewer are also taken run together with
    their neighbours.
    """
    lines = []
    for line in form.split("\n"):
        words, written = words_of(line), line.split(" ")
        telling = [i for i, w in enumerate(words) if _indexed(w, shares) and (shares.get(w, 0.0) < COMMON_SHARE or written[i][0] == CAPITAL)]
        chosen: list[int] = []
        for i in sorted(telling, key=lambda i: (shares.get(words[i], 0.0), _code(words[i]), i)):
            if len(chosen) < LEADS and all(abs(i - j) > 1 for j in chosen):
                chosen.append(i)
        if not chosen:
            continue
        figures, found = figures_of(words), []
        if len(chosen) == 1:
            found = [(figures, words[chosen[0]], None, True, False), *((figures, w, None, False, False) for w in run_together(words, chosen[0]))]
        for i, j in combinations(chosen, 2):
            found.append((figures, words[i], words[j], True, True))
            if len(chosen) == 2:
                found += [(figures, w, words[j], False, True) for w in run_together(words, i)] + [(figures, words[i], w, True, False) for w in run_together(words, j)]
        lines.append((-len(chosen), shares.get(words[chosen[0]], 0.0), found))
    need = len(form.split("\n")) // 3 + 1  # as many lines may lack a counterpart, and one more
    if len(lines) < need:
        return None
    return [x for _, _, found in sorted(lines, key=lambda x: x[:2])[:need] for x in found]


def indexed(form: str, shares: Mapping[str, float]) -> tuple[set[str], set[int]]:
    """(words, marks) that a text of the other split is found by: all pairs of the words of a line, and if few are uncommon, each word alone and pairs with words run together."""
    vocabulary: set[str] = set()
    marks: set[int] = set()
    for line in form.split("\n"):
        words = words_of(line)
        places = [i for i, w in enumerate(words) if _indexed(w, shares)]
        mine, figures = {words[i] for i in places}, figures_of(words)
        vocabulary |= mine
        marks.update(mark_of(figures, a, b) for a, b in combinations(mine, 2))
        if sum(shares.get(w, 0.0) < COMMON_SHARE for w in mine) <= FEW_WORDS:
            joined = {w for i in places for w in run_together(words, i)}
            marks.update(mark_of(figures, a, None) for a in mine | joined)
            marks.update(mark_of(figures, a, b) for a in mine for b in joined)
    return vocabulary, marks


def common_marks(form: str, common: frozenset[str]) -> list[int]:
    return sorted({h for line in form.split("\n") for h in fingerprints(words_of(line), common) if h >= BEHIND})


def near(a: str, b: str) -> bool:
    """Whether two words may be the same, one misspelt: one letter more, less or other, or two neighbours swapped, from four letters on. Figures must be equal."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if min(n, m) < 4 or abs(n - m) > 1 or a[0].isdigit() or b[0].isdigit():
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(n, m))
    if n != m:
        return a[k + 1 :] == b[k:] if n > m else a[k:] == b[k + 1 :]
    return a[k + 1 :] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]


def chain(a: list[str], b: list[str]) -> tuple[list[bool], list[bool]]:
    """Which words of ``a`` and of ``b`` a collinear chain of shared pieces, extended by alignment, matches."""
    where: dict[tuple[str, ...], list[int]] = defaultdict(list)
    size = GRAM if min(len(a), len(b)) > 2 * GRAM else 1
    for j in range(len(b) - size + 1):
        where[tuple(b[j : j + size])].append(j)
    seeds = [(i, j) for i in range(len(a) - size + 1) for j in reversed(where.get(tuple(a[i : i + size]), ()))]
    tails: list[int] = []  # longest increasing subsequence over the second positions
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(seeds):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    links: list[tuple[int, int]] = []
    k = at[-1] if at else -1
    while k >= 0:
        i, j = seeds[k]
        links += [(i + d, j + d) for d in range(size)]
        k = back[k]
    hit_a, hit_b = [False] * len(a), [False] * len(b)
    anchors = [(-1, -1)]
    for i, j in sorted(set(links)):
        if i > anchors[-1][0] and j > anchors[-1][1]:
            anchors.append((i, j))
            hit_a[i] = hit_b[j] = True
    anchors.append((len(a), len(b)))
    for (i, j), (i2, j2) in zip(anchors, anchors[1:]):  # between two anchors, words in order that are equal or near
        y = j + 1
        for x in range(i + 1, i2):
            for z in range(y, min(j2, y + 6)):
                if near(a[x], b[z]):
                    hit_a[x] = hit_b[z] = True
                    y = z + 1
                    break
    return hit_a, hit_b


def same(a: str, b: str, common: Container[str]) -> bool:
    """Whether two forms say the same about the same: the same figures, all capitalised and uncommon words of each in the other, in order, and most of the rest."""
    x, y = words_of(a), words_of(b)
    if x == y:
        return True
    if not x or not y or min(len(x), len(y)) < 0.5 * max(len(x), len(y)):
        return False
    if sorted(t for t in x if t[0].isdigit()) != sorted(t for t in y if t[0].isdigit()):
        return False
    if len(set(x) & set(y)) < 0.3 * min(len(set(x)), len(set(y))):
        return False
    for form, words, other in ((a, x, y), (b, y, x)):
        names, there = {w[1:] for w in form.split() if w[0] == CAPITAL}, set(other)
        missing = {t for t in words if len(t) > 1 and t not in there and (t in names or t not in common)}
        if missing:  # near spellings, and words that are written apart or together with a neighbour; else it is another name
            missing = {t for t in missing if not any(near(t, o) for o in there)}
        if missing:
            apart = {p + q for p, q in zip(other, other[1:])}
            together = {t for p, q in zip(words, words[1:]) if p + q in there for t in (p, q)}
            if missing - apart - together:
                return False
    return min(_shares(x, y)) >= COVERAGE


def _shares(x: list[str], y: list[str]) -> tuple[float, float]:
    left, right = chain(x, y)
    return sum(left) / len(left), sum(right) / len(right)


def coverage(field: str, a: str, b: str, common: Container[str]) -> tuple[float, float] | None:
    """The shares of two forms of a field that the other covers (of a question's words, of a candidate's lines), None if they don't overlap."""
    if field == "question":
        a, b = a.replace("\n", " "), b.replace("\n", " ")  # line breaks mean nothing in a question
        x, y = words_of(a), words_of(b)
        return (1.0, 1.0) if x == y else _shares(x, y) if same(a, b, common) else None
    swapped = a.count("\n") < b.count("\n")
    left, right = (b.split("\n"), a.split("\n")) if swapped else (a.split("\n"), b.split("\n"))
    need = SAME_SENTENCES * len(left) - 1e-9
    if len(right) < need:
        return None
    bare = [s.replace(CAPITAL, "") for s in right]
    free, found = list(range(len(right))), 0
    for k, s in enumerate(left):
        plain_s = s.replace(CAPITAL, "")
        match = next((j for j in free if bare[j] == plain_s), None)
        if match is None:
            match = next((j for j in free if same(s, right[j], common)), None)
        if match is not None:
            free.remove(match)
            found += 1
        if found + len(left) - k - 1 < need:
            return None
    shares = found / len(left), found / len(right)
    return shares[::-1] if swapped else shares


def same_forms(field: str, a: str, b: str, common: Container[str]) -> bool:
    """Whether two forms of a field overlap; those of source sentences come as lines."""
    return coverage(field, a, b, common) is not None


def same_texts(field: str, a: str, b: str, common: frozenset[str]) -> bool:
    """Whether two texts of a field overlap; source sentences come as lines."""
    return same_forms(field, *("\n".join(map(form_of, t.split("\n"))) for t in (a, b)), common)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str, str]]:
    """(row, field, text) of the questions and source sentences of a batch; null and blank ones are left out."""
    for k, (question, candidates) in enumerate(zip(batch["question"].to_pylist(), batch["candidates"].to_pylist())):
        if question and not question.isspace():
            yield k, "question", question
        for sentences in candidates or []:
            lines = [" ".join(s.split()) for s in sentences or [] if s and not s.isspace()]
            if lines:
                yield k, "source_sentences", "\n".join(lines)


_TABLE = "id string, split string, shard string, field string, key binary, bag binary, form string"


def text_table(records: DataFrame) -> DataFrame:
    """One row for each text of each record: its key (128 bits of its form), a bag that is equal for texts of equal words (lines in whatever order), and the form where its task meets it first."""
    schema = pa.schema([(n, pa.binary() if n in ("key", "bag") else pa.string()) for n in ("id", "split", "shard", "field", "key", "bag", "form")])

    def digest(text: str) -> bytes:
        return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str | None, str, str], tuple[bytes, bytes, None]] = {}
        for batch in batches:
            ids, splits, shards = (batch[c].to_pylist() for c in ("id", "source_split", "shard"))
            rows = []
            if len(known) > 50_000:
                known.clear()
            for k, field, text in _texts(batch):
                found = known.get((splits[k], field, text))
                if found is None:
                    lines = [form_of(s) for s in text.split("\n")]
                    form = "\n".join(lines)
                    found = digest(field[:1] + form), digest(field[:1] + "\n".join(sorted(lines)).replace(CAPITAL, "")), form
                    known[splits[k], field, text] = *found[:2], None
                rows.append((ids[k], splits[k], shards[k], field, *found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return records.mapInArrow(run, _TABLE)


def word_shares(distinct: DataFrame) -> dict[str, float]:
    """The share of all distinct texts that has each word, of the words from COUNTED_SHARE (and COMMON_LEAST texts) on; that share bounds their number."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for form in batch["form"].to_pylist():
                counts.update(set(words_of(form)))
                counts[""] += 1
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema)
                counts.clear()
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema)

    counted = distinct.select("form").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = distinct.count()
    rows = counted.where((F.col("n") >= max(COMMON_LEAST, COUNTED_SHARE * total)) & (F.col("word") != "")).toLocalIterator()
    return {r.word: r.n / total for r in rows}


def common_words(distinct: DataFrame) -> frozenset[str]:
    """Words that at least COMMON_SHARE of all distinct texts have."""
    return frozenset(w for w, share in word_shares(distinct).items() if share >= COMMON_SHARE)


def near_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, other): the words of ``a`` with other words of ``b`` that may be the same, misspelt; some that aren't ``near`` are among them."""

    @F.arrow_udf("array<long>")
    def codes(words: pa.Array) -> pa.Array:
        return pa.array([spellings(w) for w in words.to_pylist()], pa.list_(pa.int64()))

    left, right = (t.select(F.col("word").alias(name), F.explode(codes("word")).alias("code")) for t, name in ((a, "word"), (b, "other")))
    letters = lambda w: F.array_sort(F.split(w, ""))
    swapped = (F.length("word") == F.length("other")) & (F.levenshtein("word", "other", 2) >= 0) & (letters("word") == letters("other"))
    return left.join(right, "code").where((F.col("word") != F.col("other")) & ((F.levenshtein("word", "other", 1) >= 0) | swapped)).select("word", "other").distinct()


def candidate_pairs(distinct: DataFrame, shares: dict[str, float], left: str, right: str) -> DataFrame:
    """(key_left, key_right), distinct, short keys: pairs of texts of the two splits whose numbers of lines allow an overlap and of which a line of the left one has two of its selected words (one of them may be a near one), or its only one, in a line of the right one with the same figures.

    Left texts of common words alone meet those of the other split by triples of common words.
    """
    spark = distinct.sparkSession
    known = spark.sparkContext.broadcast(shares)
    mark = pa.struct([("figures", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("near_a", pa.bool_()), ("near_b", pa.bool_())])
    place = pa.struct([("words", pa.list_(pa.string())), ("marks", pa.list_(pa.int64()))])

    @F.arrow_udf("array<struct<figures: bigint, a: string, b: string, near_a: boolean, near_b: boolean>>")
    def select(forms: pa.Array) -> pa.Array:
        found = [selected(t, known.value) for t in forms.to_pylist()]
        return pa.array([None if x is None else [dict(zip(("figures", "a", "b", "near_a", "near_b"), m)) for m in x] for x in found], pa.list_(mark))

    @F.arrow_udf("struct<words: array<string>, marks: array<bigint>>")
    def index(forms: pa.Array) -> pa.Array:
        return pa.array([{"words": sorted(words), "marks": sorted(marks)} for words, marks in (indexed(t, known.value) for t in forms.to_pylist())], place)

    @F.arrow_udf("array<long>")
    def usual(forms: pa.Array) -> pa.Array:
        common = frozenset(w for w, share in known.value.items() if share >= COMMON_SHARE)
        return pa.array([common_marks(t, common) for t in forms.to_pylist()], pa.list_(pa.int64()))

    # Line breaks mean nothing in a question.
    distinct = distinct.select("field", "split", "key", F.when(F.col("field") == "question", F.translate("form", "\n", " ")).otherwise(F.col("form")).alias("form")).withColumn("lines", F.size(F.split("form", "\n")))
    of_left, of_right = (distinct.where(F.col("split") == split).select("field", short_key().alias(f"key_{n}"), F.col("lines").alias(f"lines_{n}"), "form") for split, n in ((left, "left"), (right, "right")))
    chosen = materialise(of_left.withColumn("marks", select("form")).select("field", "key_left", "lines_left", F.when(F.col("marks").isNull(), F.col("form")).alias("form"), F.explode_outer("marks").alias("m")).select("*", "m.*").drop("m"))
    there = materialise(of_right.select("field", "key_right", "lines_right", index("form").alias("m")).select("field", "key_right", "lines_right", "m.*"))
    fits = F.least("lines_left", "lines_right") >= SAME_SENTENCES * F.greatest("lines_left", "lines_right") - 1e-9
    wanted = chosen.where("form is null").drop("form")
    vocabulary = wanted.where("near_a").select(F.col("a").alias("word")).unionByName(wanted.where("near_b").select(F.col("b").alias("word"))).distinct()
    close = near_words(vocabulary, there.select(F.explode("words").alias("word")).distinct())
    of_a = wanted.where("near_a").join(close.withColumnRenamed("word", "a"), "a").withColumn("a", F.col("other")).drop("other")
    of_b = wanted.where("near_b").join(close.withColumnRenamed("word", "b"), "b").withColumn("b", F.col("other")).drop("other")
    ours = wanted.unionByName(of_a).unionByName(of_b).select(_of_field(_mark(F.col("figures"), F.col("a"), F.col("b"))).alias("mark"), "key_left", "lines_left")
    theirs = there.select("field", "key_right", "lines_right", F.explode("marks").alias("mark")).select(_of_field(F.col("mark")).alias("mark"), "key_right", "lines_right")
    found = ours.join(theirs, "mark").where(fits).select("key_left", "key_right")
    poor = chosen.where("form is not null").select("field", "key_left", "lines_left", F.explode(usual("form")).alias("mark"))
    every = of_right.select("field", "key_right", "lines_right", F.explode(usual("form")).alias("mark"))
    return found.unionByName(poor.join(every, ["field", "mark"]).where(fits).select("key_left", "key_right")).distinct()


def overlapping_texts(instances: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """(the text table, (field, key_left, key_right, cover_left, cover_right) of the distinct texts of the two splits that overlap)."""
    spark = instances.sparkSession
    records = instances.where(F.col("source_split").isin(left, right)).select("id", "source_split", "shard", "question", F.transform("candidates", lambda c: c["source_sentences"]).alias("candidates"))
    table = materialise(text_table(records))
    distinct = materialise(table.where("form is not null").select("field", "split", "key", "bag", "form").distinct())
    shares = word_shares(distinct)
    candidates = candidate_pairs(distinct, shares, left, right)
    of_left = distinct.where(F.col("split") == left).select("field", F.col("key").alias("key_left"), "bag", F.col("form").alias("text_left"))
    of_right = distinct.where(F.col("split") == right).select("field", F.col("key").alias("key_right"), "bag", F.col("form").alias("text_right"))
    known = spark.sparkContext.broadcast(shares)

    @F.arrow_udf("array<double>")
    def covers(field: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        common = frozenset(w for w, share in known.value.items() if share >= COMMON_SHARE)
        return pa.array([coverage(f, s, t, common) for f, s, t in zip(field.to_pylist(), x.to_pylist(), y.to_pylist())], pa.list_(pa.float64()))

    equal = of_left.select("field", "bag", "key_left").join(of_right.select("field", "bag", "key_right"), ["field", "bag"]).select("field", "key_left", "key_right")
    sides = (t.select(F.xxhash64("field", f"key_{n}").alias(n), *(["field"] if n == "left" else []), f"key_{n}", "bag", f"text_{n}").withColumnRenamed("bag", f"bag_{n}") for t, n in ((of_left, "left"), (of_right, "right")))
    compared = candidates.select(F.col("key_left").alias("left"), F.col("key_right").alias("right")).join(next(sides), "left").join(next(sides), "right").where("bag_left != bag_right")
    verified = compared.withColumn("c", covers("field", "text_left", "text_right")).where("c is not null").select("field", "key_left", "key_right", F.col("c")[0].alias("cover_left"), F.col("c")[1].alias("cover_right"))
    return table, verified.unionByName(equal.withColumns({"cover_left": F.lit(1.0), "cover_right": F.lit(1.0)}))


def overlaps(instances: DataFrame, *, left: str = "train", right: str = "validation") -> DataFrame:
    """p6_found: (id_a, id_b, field), the smaller id first, for each record of ``left`` and of ``right`` that overlap in ``field``.

    Repeated rows of an id count once. Records without question or source sentences give no pair in that field. Only distinct texts are compared;
    the records that have them are joined at the end.
    """
    table, texts = overlapping_texts(instances, left, right)
    members = table.select("id", "split", "field", "key").distinct()
    a = members.where(F.col("split") == left).select("field", F.col("id").alias("x"), F.col("key").alias("key_left"))
    b = members.where(F.col("split") == right).select("field", F.col("id").alias("y"), F.col("key").alias("key_right"))
    pairs = texts.join(a, ["field", "key_left"]).join(b, ["field", "key_right"])
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "field").where("id_a != id_b").distinct()


def record_coverage(instances: DataFrame, *, left: str = "train", right: str = "validation") -> DataFrame:
    """(id, split, shard, field, coverage): of each record with a text of ``field``, the greatest share of such a text that one of the other split covers, 0 if none overlaps.

    A record that was sent in several shards goes by the least of them.
    """
    table, texts = overlapping_texts(instances, left, right)
    covered = [texts.select("field", F.col(f"key_{n}").alias("key"), F.lit(split).alias("split"), F.col(f"cover_{n}").alias("c")) for n, split in (("left", left), ("right", right))]
    best = covered[0].unionByName(covered[1]).groupBy("field", "key", "split").agg(F.max("c").alias("c"))
    of_text = table.select("id", "split", "shard", "field", "key").join(best, ["field", "key", "split"], "left")
    return of_text.groupBy("id", "split", "field").agg(F.min("shard").alias("shard"), F.coalesce(F.max("c"), F.lit(0.0)).alias("coverage")).select("id", "split", "shard", "field", "coverage")


def overlap_report(instances: DataFrame, *, left: str = "train", right: str = "validation") -> DataFrame:
    """(split, shard, field, records, overlapping, share, coverage): how many records of each split and source overlap with the other split, their share, and the mean coverage of those that do."""
    hit = F.col("coverage") > 0
    return (
        record_coverage(instances, left=left, right=right).groupBy("split", "shard", "field")
        .agg(F.count("*").alias("records"), F.count_if(hit).alias("overlapping"), F.avg(F.when(hit, F.col("coverage"))).alias("coverage"))
        .select("split", "shard", "field", "records", "overlapping", (F.col("overlapping") / F.col("records")).alias("share"), "coverage")
    )
