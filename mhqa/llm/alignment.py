"""Pairs of sentences that translate each other in rough translations (problem 4).

Word translation tables are learned from the drafts themselves: sentences that share names and figures give first pairs, and the other words of these give tables. With them
each sentence becomes a weighted bag of words of the other language; inverted indexes over a draft's sentences retrieve counterparts in both directions, matches found from both
sides are kept, and sentences left over join a counterpart that holds them as well (merges). The tables stay distributed: shares are computed in SQL, and each block of
drafts gets the entries of its own words, by a broadcast where the whole table is small, else by a join.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mhqa.llm.textforms import clean
from mhqa.runtime import materialise

# -- fixed values: plain Latin spellings of Cyrillic letters ------------------------------------------------------------
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e o zh z i i k l m n o p r s t u f kh ts ch sh sch  y  e u a".split(" ")))
#: Spellings that sound alike, brought to one.
ALIKE = (("x", "ks"), ("ck", "k"), ("w", "v"), ("th", "t"), ("ph", "f"), ("y", "i"), ("j", "i"), ("ø", "o"), ("æ", "e"), ("ae", "e"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "t"), ("ß", "ss"), ("ı", "i"))
# ----------------------------------------------------------------------------------------------------------------------

_IDEO = "㐀-鿿぀-ヿ"
_TOKEN = re.compile(rf"[{_IDEO}]+|\d+|[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]+|(?:[^\W\d_A-Za-zÀ-ɏ{_IDEO}]|[ऀ-ॿ‌])+")
_OTHER_DIGIT = re.compile("[٠-٩۰-۹०-९]")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "0123456789" * 3)

#: Words and word pairs of fewer linked sentences, and entries of a smaller share beyond chance, say nothing.
LEAST_COUNT, LEAST_SHARE = 3, 0.03
IDENTITY, FIRST_LINK, LINK, FLOOR, MERGE, GAIN = 1.6, 0.5, 0.68, 0.33, 0.7, 0.12
#: Tables of no more rows are broadcast (a row takes some 200 bytes in a worker); of larger ones each block of drafts, of about BLOCK_ROWS, gets the rows of its words.
BROADCAST_ROWS, BLOCK_ROWS = 400_000, 20_000


@lru_cache(maxsize=20_000)
def sound(name: str) -> str:
    """A plain spelling of a name, the same for its Latin and its Cyrillic form where they correspond."""
    out = "".join(CYRILLIC.get(c, c) for c in name.casefold())
    out = "".join(c for c in unicodedata.normalize("NFD", out) if not unicodedata.combining(c))
    for a, b in ALIKE:
        out = out.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", out)


@lru_cache(maxsize=1_000)  # sentences come again within their draft, hardly elsewhere
def parts(sentence: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """(words in lower case, names and figures in plain spelling, the words that these are written as) of a sentence. Runs of ideographs become pairs of characters."""
    words, names, written = [], [], []
    text = clean(sentence)
    for t in _TOKEN.findall(text.translate(_DIGITS) if _OTHER_DIGIT.search(text) else text):
        if t.isdigit():
            names.append(t)
            written.append(t)
        elif "㐀" <= t[0] <= "鿿" or "぀" <= t[0] <= "ヿ":
            words += [t] if len(t) == 1 else list(map("".join, zip(t, t[1:])))
        elif t[0].isupper():
            names.append(sound(t))
            written.append(t.casefold())
            words.append(t.casefold())
        else:
            words.append(t.casefold())
    return tuple(words), tuple(names), tuple(written)


class Tables:
    """Translation shares of words of the target language, and weights of the words of both sides: the rarer, the more."""

    def __init__(self, entries: Iterable[tuple[str, str, float]], left: dict[str, float], right: dict[str, float]) -> None:
        self.left, self.right = left, right
        self.shares: dict[str, dict[str, float]] = defaultdict(dict)
        for f, e, share in entries:
            self.shares[f][e] = share

    @classmethod
    def of_rows(cls, kinds: list[str], fs: list[str | None], es: list[str | None], values: list[float]) -> Tables:
        rows = list(zip(kinds, fs, es, values))
        return cls(((f, e, v) for k, f, e, v in rows if k == "share"), {f: v for k, f, _, v in rows if k == "left"}, {e: v for k, _, e, v in rows if k == "right"})


def _identity(names: list[tuple[str, ...]]) -> dict[str, float]:
    """Weights of names and figures within one side of a draft: the fewer sentences have it, the more."""
    df = Counter(t for ns in names for t in set(ns))
    n = len(names)
    return {t: math.log((n + 1) / (d + 0.2)) / math.log(n + 1) if n > 1 else 1.0 for t, d in df.items()}


def _weights(sentence: str, own: dict[str, float], there: Container[str], counts: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """The share of a sentence's weight that each of its words, and each of its names and figures, has.

    A capitalised word counts as a name if the other side has it too (``there``) or if it is no word that the tables know.
    """
    words, names, written = parts(sentence)
    of_words = {t: counts[t] for t in words if t in counts}
    of_names = {t: IDENTITY * own[t] for t, w in zip(names, written) if t in there or w not in counts}
    if there:
        for t, w in zip(names, written):
            if t in there:
                of_words.pop(w, None)
    whole = sum(of_words.values()) + sum(of_names.values()) or 1.0
    return {t: w / whole for t, w in of_words.items()}, {t: w / whole for t, w in of_names.items()}


def _matrix(bags: list[dict[str, float]], index: dict[str, int]) -> np.ndarray:
    """One row a bag, one column a word of ``index``."""
    out = np.zeros((len(bags), len(index)))
    for i, bag in enumerate(bags):
        for t, w in bag.items():
            if t in index:
                out[i, index[t]] = w
    return out


class Sides:
    """Both sides of a draft, and what each pair of their sentences covers of each other by names, figures and word tables."""

    def __init__(self, targets: list[str], sources: list[str], tables: Tables | None) -> None:
        own_left, own_right = _identity([parts(s)[1] for s in targets]), _identity([parts(s)[1] for s in sources])
        left = [_weights(s, own_left, own_right.keys(), tables.left if tables else {}) for s in targets]
        right = [_weights(s, own_right, own_left.keys(), tables.right if tables else {}) for s in sources]
        names = {t: k for k, t in enumerate(own_left.keys() & own_right.keys())}
        self.left_names, self.right_names = (_matrix([n for _, n in side], names) for side in (left, right))
        by_source = (self.left_names > 0) @ self.right_names.T
        by_target = self.left_names @ (self.right_names > 0).T
        self.tables = tables
        if tables:
            ours, theirs = ({t: k for k, t in enumerate({t for of_words, _ in side for t in of_words})} for side in (left, right))
            shares = np.zeros((len(ours), len(theirs)))
            for f, k in ours.items():
                entries = tables.shares.get(f)
                if entries:
                    for e in entries.keys() & theirs.keys():
                        shares[k, theirs[e]] = entries[e]
            self.left_words, self.right_words = _matrix([w for w, _ in left], ours), _matrix([w for w, _ in right], theirs)
            self.shares = shares
            self.bags = (self.left_words > 0) @ shares  # of each target, its words in the other language
            self.met = shares @ (self.right_words > 0).T
            by_source += np.minimum(self.bags, 1.0) @ self.right_words.T
            by_target += self.left_words @ np.minimum(self.met, 1.0)
        #: (target, source): the share of the source's weight that the target covers, and of the target's that the source covers.
        self.by_source, self.by_target = by_source, by_target

    def gain_of_target(self, i: int, first: int, other: int) -> float:
        """What source ``other`` adds to the share of target ``i`` that source ``first`` explains."""
        both = self.shares @ (self.right_words[[first, other]] > 0).any(0)
        names = ((self.right_names[other] > 0) & (self.right_names[first] == 0)) @ self.left_names[i]
        return names + self.left_words[i] @ (np.minimum(both, 1.0) - np.minimum(self.met[:, first], 1.0))

    def gain_of_source(self, j: int, first: int, other: int) -> float:
        """What target ``other`` adds to the share of source ``j`` that target ``first`` explains."""
        both = (self.left_words[[first, other]] > 0).any(0) @ self.shares
        names = ((self.left_names[other] > 0) & (self.left_names[first] == 0)) @ self.right_names[j]
        return names + self.right_words[j] @ (np.minimum(both, 1.0) - np.minimum(self.bags[first], 1.0))


def align(targets: list[str | None], sources: list[str | None], tables: Tables | None, *, merges: bool = True) -> list[tuple[int, int]]:
    """The pairs of positions that translate each other. Null and blank sentences have no counterpart."""
    at_target, at_source = ([i for i, s in enumerate(side) if s and not s.isspace()] for side in (targets, sources))
    if not at_target or not at_source:
        return []
    both = Sides([targets[i] for i in at_target], [sources[j] for j in at_source], tables)
    a, b = both.by_source, both.by_target
    values = np.sqrt(a * b)
    values[(np.maximum(a, b) < (LINK if tables else FIRST_LINK)) | (np.minimum(a, b) < FLOOR)] = -1.0
    of_target: dict[int, int] = {}
    of_source: dict[int, int] = {}
    while True:  # what is best seen from both sides, then the same among the rest
        best_of_target, best_of_source = values.argmax(1), values.argmax(0)
        mutual = [(i, j) for i, j in enumerate(best_of_target.tolist()) if values[i, j] >= 0 and best_of_source[j] == i]
        if not mutual:
            break
        for i, j in mutual:
            of_target[i], of_source[j] = j, i
            values[i, :] = values[:, j] = -1.0
    pairs = set(of_target.items())
    if merges and tables:
        # A sentence left over belongs to a matched one if that holds it and what its match doesn't explain of it is explained by the sentence left over.
        grown = [(both.gain_of_target(i, of_target[i], j), i, j) for i, j in np.argwhere(a >= MERGE).tolist() if j not in of_source and i in of_target]
        grown += [(both.gain_of_source(j, of_source[j], i), i, j) for i, j in np.argwhere(b >= MERGE).tolist() if i not in of_target and j in of_source]
        taken_target, taken_source = set(of_target), set(of_source)
        for gain, i, j in sorted(grown, key=lambda x: (-x[0], x[1], x[2])):
            if gain >= GAIN and (j not in taken_source or i not in taken_target):
                pairs.add((i, j))
                taken_target.add(i)
                taken_source.add(j)
    return sorted((at_target[i], at_source[j]) for i, j in pairs)


def linked_words(target: str, source: str) -> tuple[list[str], list[str]]:
    """The distinct words of two linked sentences, without the names and figures that both have."""
    (words, names, written), (other_words, other_names, other_written) = parts(target), parts(source)
    shared = set(names) & set(other_names)
    own, other = ({w for n, w in zip(ns, ws) if n in shared} for ns, ws in ((names, written), (other_names, other_written)))
    return sorted(set(words) - own), sorted(set(other_words) - other)


def _counted(drafts: DataFrame) -> DataFrame:
    """(f, e, n): in how many pairs of sentences that names and figures link word f of the target and word e of the source stand; e or f null for each word alone, both null for all pairs."""
    schema = pa.schema([("f", pa.string()), ("e", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = {}, {}
            codes, firsts, seconds, total = [], [], [], 0
            for targets, sources in zip(batch["sentences"].to_pylist(), batch["source_sentences"].to_pylist()):
                for i, j in align(targets or [], sources or [], None):
                    fs, es = linked_words(targets[i], sources[j])
                    f = np.fromiter((left.setdefault(w, len(left)) for w in fs), np.int64, len(fs))
                    e = np.fromiter((right.setdefault(w, len(right)) for w in es), np.int64, len(es))
                    codes.append((f[:, None] << 32 | e[None, :]).ravel())
                    firsts.append(f)
                    seconds.append(e)
                    total += 1
            f_words, e_words = pa.array(list(left) + [None], pa.string()), pa.array(list(right) + [None], pa.string())
            (pair, n), (f, nf), (e, ne) = (np.unique(np.concatenate(x) if x else np.zeros(0, np.int64), return_counts=True) for x in (codes, firsts, seconds))
            at_f = np.concatenate([pair >> 32, f, np.full(len(e) + 1, len(left))])
            at_e = np.concatenate([pair & 0xFFFFFFFF, np.full(len(f), len(right)), e, [len(right)]])
            yield pa.RecordBatch.from_arrays([f_words.take(pa.array(at_f)), e_words.take(pa.array(at_e)), pa.array(np.concatenate([n, nf, ne, [total]]), pa.int64())], schema=schema)

    return drafts.mapInArrow(count, "f string, e string, n long").groupBy("f", "e").agg(F.sum("n").alias("n"))


def tables_of(drafts: DataFrame) -> DataFrame:
    """(kind, f, e, value): the translation shares (kind share) and the weights of the words of the target (left) and the source (right)."""
    counted = materialise(_counted(drafts))
    total = counted.where("f is null and e is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    enough = counted.where(F.col("n") >= LEAST_COUNT)
    weight = F.when(F.col("total") > 1, F.ln((F.col("total") + 1) / (F.col("n") + 1)) / F.ln(F.col("total") + 1)).otherwise(F.lit(1.0))
    left, right = enough.where("f is not null and e is null"), enough.where("f is null and e is not null")
    pairs = enough.where("f is not null and e is not null").join(left.select("f", F.col("n").alias("nf")), "f").join(right.select("e", F.col("n").alias("ne")), "e").crossJoin(F.broadcast(total))
    share = (F.col("n") - F.col("nf") * F.col("ne") / F.greatest(F.col("total"), F.lit(1))) / F.col("nf")  # what goes beyond chance
    shares = pairs.select(F.lit("share").alias("kind"), "f", "e", share.alias("value")).where(F.col("value") >= LEAST_SHARE)
    weights = left.unionByName(right).crossJoin(F.broadcast(total)).select(F.when(F.col("e").isNull(), "left").otherwise("right").alias("kind"), "f", "e", weight.alias("value"))
    return materialise(shares.unionByName(weights))


_ALIGNED = "sentence_id int, source_sentence_id int"


def _rows(batch: pa.RecordBatch | pa.Table, tables: Tables) -> pa.RecordBatch:
    rows = [(d, i, j) for d, t, s in zip(*(batch[c].to_pylist() for c in ("draft_id", "sentences", "source_sentences"))) for i, j in align(t or [], s or [], tables)]
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("draft_id").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["draft_id", "sentence_id", "source_sentence_id"])


def pairs(drafts: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """p4_found: (draft_id, sentence_id, source_sentence_id), distinct. A draft whose lists are null or empty gives no row; drafts sent again are aligned once.

    Beyond ``broadcast_rows`` rows of tables the drafts are put into blocks of about ``block_rows``, and each block is joined with the rows of its own words; the result is the same.
    """
    wanted = drafts.select("draft_id", "sentences", "source_sentences").where("size(sentences) > 0 and size(source_sentences) > 0").distinct()
    tables = tables_of(wanted.select("sentences", "source_sentences"))
    kind = dict(wanted.dtypes)["draft_id"]
    out = f"draft_id {kind}, {_ALIGNED}"
    if tables.count() <= broadcast_rows:
        rows = tables.select("kind", "f", "e", "value").collect()
        shared = drafts.sparkSession.sparkContext.broadcast(tuple(list(c) for c in zip(*rows)) or ([], [], [], []))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Tables.of_rows(*shared.value)
            for batch in batches:
                yield _rows(batch, mine)

        return wanted.mapInArrow(run, out).distinct()
    return _by_blocks(wanted, tables, block_rows).distinct()


def _by_blocks(wanted: DataFrame, tables: DataFrame, block_rows: int) -> DataFrame:
    """The pairs of positions of all drafts, each block of drafts with the rows of ``tables`` that have one of its words."""
    blocks = -(-wanted.count() // block_rows)
    blocked = materialise(wanted.withColumn("block", F.pmod(F.xxhash64("draft_id", "sentences"), F.lit(blocks)).cast("int")))
    schema = pa.schema([("block", pa.int32()), ("side", pa.string()), ("word", pa.string())])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {
                (b, side, w) for b, t, s in zip(*(batch[c].to_pylist() for c in ("block", "sentences", "source_sentences"))) for side, sentences in (("f", t), ("e", s)) for x in sentences if x for w in parts(x)[0]
            }
            columns = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    used = materialise(blocked.select("block", "sentences", "source_sentences").mapInArrow(words, "block int, side string, word string").distinct())
    of_side = lambda side: used.where(F.col("side") == side).select("block", F.col("word").alias(side))
    mine = tables.where("f is not null").join(of_side("f"), "f").select("block", "kind", "f", "e", "value").unionByName(tables.where("f is null").join(of_side("e"), "e").select("block", "kind", "f", "e", "value"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(left, Tables.of_rows(*(right[c].to_pylist() for c in ("kind", "f", "e", "value"))))])

    out = f"draft_id {dict(wanted.dtypes)['draft_id']}, {_ALIGNED}"
    return blocked.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, out)
