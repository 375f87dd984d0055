"""Held-out evaluation texts inside a corpus, found by greedy string tiling (problem 8).

Questions, passage sentences and whole passages of the held-out items are token units. Rare pairs of neighbouring tokens are seeds that lead from
a document to a unit and a place; there the unit and the text are tiled greedily by running Karp-Rabin matching: the longest common pieces that
don't overlap are marked first, by hashes that roll over both texts. Places of one unit that fail alone are tiled together, so reordered passages count. The covered share of
the unit's tokens, and of those that only this item has, decides. Each document is put into tokens once; those of documents with a seed are kept for the tiling.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mhqa.llm.textforms import clean, plain
from mhqa.runtime import materialise

_IDEO = "㐀-鿿぀-ヿ"
_TOKEN = re.compile(rf"[{_IDEO}]|\d+|[^\W\d_{_IDEO}]+")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n\s*(?=[^\W\d_])")
#: What follows a day's full stop in German dates, where no sentence ends.
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_SENTENCE = re.compile(rf"(?<=[.!?؟।])\s+(?!(?:{_MONTHS})\b)|(?<=[。！？])")

SEED_HITS, FIGURE = 2, 0.3
#: Pairs beside a name or figure that more items have aren't needed as seeds where each part of a unit has a rarer one.
SEED_ITEMS = 12
#: Units of fewer tokens must be covered whole; a single token is no unit.
SHORT = 4
#: Parts of a unit that stand in another order have so many tokens at least.
PART = 6
#: Each part of so many pairs of a unit has a seed, the rarest of its pairs if there is no other.
SEED_PART = 8
#: A token is an item's own if no larger share of the held-out items and of the documents (or, of few, no more of them) has it; or if, of the documents, most
#: that have it have most names of one of its units: then it leaked.
OWN_SHARE, OWN_LEAST, LEAKED_SHARE, BESIDE = 0.004, 4, 0.5, 0.9
COVERAGE, OWN_COVERAGE = 0.78, 0.78
#: Of the weight of all capitalised tokens so much is covered too, since the same phrasing with other names is no case; those of a larger share of the items, or of too many documents (as
#: nouns that are written with capitals) weigh less.
NAMED_COVERAGE, USUAL_SHARE, USUAL = 0.6, 0.04, 0.3
#: With so high a coverage, fewer of the own tokens suffice: a name may be lost or run together with the next word.
HIGH_COVERAGE, LOW_OWN_COVERAGE = 0.93, 0.6
RUN_WORDS, RUN_CHARACTERS, RUN_COVERAGE = 18, 40, 0.8
#: Held-out items of more bytes are searched in parts. A byte takes some 50 in a worker.
MAX_REFERENCE_BYTES = 8 << 20
ROLL, PRIME = 1_000_003, (1 << 61) - 1


def tokens(text: str) -> list[str]:
    """Tokens of plain text: words, figures, ideographs, in compatibility form, case-folded, each word in one script, without accents."""
    return _TOKEN.findall(plain(text))


def document_tokens(text: str) -> list[str]:
    """Tokens of a document, without markup and escapes."""
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text).replace("\\n", "\n").replace("\\t", " ").replace("\\/", "/")
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-\n" in text or "‐\n" in text or "­" in text or "-\r" in text:
        text = _HYPHENATED.sub("", text.replace("\r\n", "\n"))
    return tokens(text)


def units_of(question: str | None, passage: str | None) -> list[tuple[str, list[str]]]:
    """The token units of an item: its question, each sentence of its passage, and the whole passage."""
    sentences = [tokens(s) for s in _SENTENCE.split(passage or "")]
    return [("question", tokens(question or "")), *(("sentence", s) for s in sentences), ("passage", [t for s in sentences for t in s])]


class Reference:
    """The units of the held-out items and the seeds that lead to them. ``items`` has (item_id, question, passage), ``documents`` how many documents have each name, and have it beside most other names of a unit; without it none has.

    Units of equal tokens are one unit of several items, and items with an equal question count as one where it matters how many items have a token.
    """

    def __init__(self, items: list[tuple[int, str | None, str | None]], documents: dict[str, tuple[int, int]] | None = None, total: int = 0) -> None:
        texts = [clean(text) for _, question, passage in items for text in (question, passage) if text]
        written = {t for text in texts for t in _TOKEN.findall(text)}
        names = {plain(t) for t in written if t[0].isupper()} - {plain(t) for t in written if t.islower()}
        parts = [(item, [(k, t) for k, t in units_of(question, passage) if len(t) >= 2]) for item, question, passage in items]
        groups: dict[tuple[str, ...], list[tuple[str, list[str]]]] = defaultdict(list)
        for item, mine in parts:
            groups[next((("question", *t) for k, t in mine if k == "question"), ("item", str(item)))] += mine
        with_token, with_pair = (Counter(x for mine in groups.values() for x in {x for _, unit in mine for x in zip(*(unit[k:] for k in range(n)))}) for n in (1, 2))
        rare = max(OWN_LEAST, OWN_SHARE * len(groups))
        few = {t for t in names if with_token[t,] <= rare}
        owners: dict[tuple[str, tuple[str, ...]], set[int]] = defaultdict(set)
        for item, mine in parts:
            for kind, unit in mine:
                owners[kind, tuple(unit)].add(item)
        self.units: list[tuple[tuple[int, ...], str, list[str]]] = [(tuple(sorted(held)), kind, list(unit)) for (kind, unit), held in owners.items()]  # items, kind, tokens
        self.few = frozenset(few)
        self.names = [frozenset(names.intersection(unit)) for _, _, unit in self.units]  # of each unit
        rare = max(OWN_LEAST, OWN_SHARE * total)
        few_everywhere = {t for t in few for n, beside in [(documents or {}).get(t, (0, 0))] if n <= rare or beside > LEAKED_SHARE * n}
        self.own: list[dict[int, float]] = []  # weights of the positions of capitalised tokens that few items and documents have, and of figures
        usual = max(OWN_LEAST, USUAL_SHARE * len(groups))
        often = few - few_everywhere
        self.named: list[dict[int, float]] = [{i: USUAL if with_token[t,] > usual or t in often else 1.0 for i, t in enumerate(unit) if t in names} for _, _, unit in self.units]
        self.seeds: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        self.hits: list[int] = []  # seeds on one diagonal that a unit needs
        for number, (_, _, unit) in enumerate(self.units):
            own = {i: FIGURE if t.isdigit() else 1.0 for i, t in enumerate(unit) if t.isdigit() or t in few_everywhere}
            self.own.append(own)
            leads = {i for i, t in enumerate(unit) if t in few_everywhere} or set(own)
            pairs = list(zip(unit, unit[1:]))
            chosen = {i for i, pair in enumerate(pairs) if (i in leads or i + 1 in leads) and with_pair[pair] <= SEED_ITEMS}
            for begin in range(0, len(pairs), SEED_PART):
                part = range(begin, min(begin + SEED_PART, len(pairs)))
                if chosen.isdisjoint(part):
                    chosen.add(min(part, key=lambda i: (with_pair[pairs[i]], i)))
            for i in chosen:
                self.seeds[pairs[i]].append((number, i))
            self.hits.append(min(SEED_HITS, len(chosen)))


def rolling(codes: list[int]) -> list[int]:
    """Hashes of all beginnings of a text of word codes; each follows from the one before."""
    out = [0]
    for c in codes:
        out.append((out[-1] * ROLL + c) % PRIME)
    return out


def tile(left: list[str], right: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (begin in left, begin in right, length) of common pieces of ``least`` tokens or more, the longest first, none overlapping.

    Running Karp-Rabin: pieces of the current search length are looked up by their rolling hash and extended; when one longer than twice the length comes
    up, the length is raised to it.
    """
    code = {t: k for k, t in enumerate(set(left), 1)}
    a, b = [code[t] for t in left], [code.get(t, 0) for t in right]  # 0: a token that ``left`` lacks, no part of any piece
    hash_a, hash_b = rolling(a), rolling(b)
    free_a, free_b = [True] * len(a), [c > 0 for c in b]
    tiles: list[tuple[int, int, int]] = []
    length = min(len(a), len(b), 20)
    while length >= least:
        power = pow(ROLL, length, PRIME)
        places: dict[int, list[int]] = {}
        for j in _free_runs(free_b, length):
            places.setdefault((hash_b[j + length] - hash_b[j] * power) % PRIME, []).append(j)
        matches, longest = [], length
        if places:
            for i in _free_runs(free_a, length):
                for j in places.get((hash_a[i + length] - hash_a[i] * power) % PRIME, ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                        n += 1
                    if n >= length:
                        matches.append((n, i, j))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = [False] * n
                free_b[j : j + n] = [False] * n
                tiles.append((i, j, n))
        length = length // 2 if length > 2 * least else length - 1
    return tiles


def _free_runs(free: list[bool], length: int) -> Iterator[int]:
    run = 0
    for i, x in enumerate(free):
        run = run + 1 if x else 0
        if run >= length:
            yield i - length + 1


def near(a: str, b: str) -> bool:
    """Whether two tokens may be the same word misspelt: one edit from four letters on, two from eight."""
    if a == b:
        return True
    n, m = len(a), len(b)
    limit = 2 if min(n, m) >= 8 else 1 if min(n, m) >= 4 else 0
    if abs(n - m) > limit or not limit or a.isdigit() or b.isdigit():
        return False
    k = 0
    while k < n and k < m and a[k] == b[k]:
        k += 1
    while n > k and m > k and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[k:n], b[k:m]  # what is left without the common begin and end
    n, m = n - k, m - k
    if min(n, m) == 0 or max(n, m) == 1 or a == b[::-1] and n == 2:
        return max(n, m) <= limit or n == 2
    if limit == 1:
        return False
    older: list[int] = []
    before = list(range(m + 1))
    for i in range(1, n + 1):
        now = [i]
        for j in range(1, m + 1):
            cost = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, older[j - 2] + 1)
            now.append(cost)
        if min(now) > limit:
            return False
        older, before = before, now
    return before[m] <= limit


def covered(unit: list[str], window: list[str]) -> list[bool]:
    """For each token of ``unit``, whether the tiling with ``window`` covers it, or a lone equal or misspelt token stands where the tiles leave room."""
    mark, taken = [False] * len(unit), [False] * len(window)
    where: dict[int, int] = {}
    for i, j, n in tile(unit, window):
        mark[i : i + n] = [True] * n
        taken[j : j + n] = [True] * n
        where.update(zip(range(i, i + n), range(j, j + n)))
    for i, done in enumerate(mark):
        if not done:
            before = next((where[k] for k in range(i - 1, max(-1, i - 4), -1) if k in where), None)
            after = next((where[k] for k in range(i + 1, min(len(unit), i + 4)) if k in where), None)
            low = before + 1 if before is not None else (after - 3 if after is not None else None)
            if low is None:
                continue
            high = after if after is not None and after > low else low + 3
            for j in range(max(0, low), min(len(window), high, low + 6)):
                if not taken[j] and near(unit[i], window[j]):
                    mark[i], taken[j], where[i] = True, True, j
                    break
    return mark


def leaks(text: list[str], reference: Reference) -> dict[int, tuple[str, float, float]]:
    """{item: (kind of unit, coverage, coverage of its own tokens)} of what ``text`` holds."""
    hits: dict[int, Counter] = defaultdict(Counter)
    seeds, units = reference.seeds, reference.units
    for p, pair in enumerate(zip(text, text[1:])):
        if pair in seeds:
            for unit, i in seeds[pair]:
                hits[unit][p - i] += 1
    found: dict[int, tuple[str, float, float]] = {}
    for unit, diagonals in hits.items():
        items, kind, target = units[unit]
        if all(item in found for item in items):
            continue
        own, named, need, slack = reference.own[unit], reference.named[unit], reference.hits[unit], 4 + len(target) // 6
        tried: list[int] = []
        windows: list[tuple[int, int]] = []
        detail = None
        for d, _ in diagonals.most_common():
            if any(abs(d - x) <= 6 for x in tried):
                continue
            tried.append(d)
            windows.append((max(0, d - slack), d + len(target) + slack))
            if sum(n for x, n in diagonals.items() if abs(x - d) <= 6) >= need:
                detail = _judged(kind, target, text[windows[-1][0] : windows[-1][1]], own, named)
                if detail:
                    break
        if not detail and kind != "passage" and len(windows) > 1 and sum(diagonals.values()) >= need:  # parts in another order; the sentences of a passage are units themselves
            joined: list[str] = []
            end = 0
            for low, high in sorted(windows):
                if low > end:
                    joined.append("")
                joined += text[max(low, end) : high]
                end = max(end, high)
            mark = [False] * len(target)
            for i, _, n in tile(target, joined, PART):
                mark[i : i + n] = [True] * n
            share, own_share = sum(mark) / len(mark), _own_share(mark, own, 0, len(mark))
            if share >= COVERAGE and own_share >= OWN_COVERAGE and _own_share(mark, named, 0, len(mark)) >= NAMED_COVERAGE:
                detail = kind, share, own_share
        if detail:
            found.update((item, detail) for item in items if item not in found)
    return found


def _judged(kind: str, target: list[str], window: list[str], own: dict[int, float], named: dict[int, float]) -> tuple[str, float, float] | None:
    """(kind, coverage, own coverage) if ``window`` holds the unit ``target``, else None."""
    mark = covered(target, window)
    share, own_share = sum(mark) / len(mark), _own_share(mark, own, 0, len(mark))
    if len(target) < SHORT:
        good = any(target == window[j : j + len(target)] for j in range(len(window) - len(target) + 1))
    else:
        good = run(mark, target, own, named) if kind == "passage" else holds(share, own_share) and _own_share(mark, named, 0, len(mark)) >= NAMED_COVERAGE
    return (kind, share, own_share) if good else None


def holds(share: float, own_share: float) -> bool:
    return share >= COVERAGE and own_share >= OWN_COVERAGE or share >= HIGH_COVERAGE and own_share >= LOW_OWN_COVERAGE


def _own_share(mark: list[bool], own: dict[int, float], begin: int, end: int) -> float:
    """The covered share of the weights of names and figures in [begin, end); 1 if there are none."""
    total = sum(w for i, w in own.items() if begin <= i < end)
    return sum(w for i, w in own.items() if begin <= i < end and mark[i]) / total if total else 1.0


def run(mark: list[bool], unit: list[str], own: dict[int, float], named: dict[int, float]) -> bool:
    """Whether so many consecutive words of a passage are there (for ideographs, characters), a few being changed."""
    ideographs = sum(len(t) == 1 and not t.isascii() for t in unit) > len(unit) / 3
    sizes = [len(t) if ideographs else 1 for t in unit]
    need = RUN_CHARACTERS if ideographs else RUN_WORDS
    size, hit = [0], [0]
    for s, m in zip(sizes, mark):
        size.append(size[-1] + s)
        hit.append(hit[-1] + (s if m else 0))
    if hit[-1] < RUN_COVERAGE * need:
        return False
    ends = [k for k, m in enumerate(mark) if m]
    for a in ends:
        for b in reversed(ends):
            total = size[b + 1] - size[a]
            if total < need:
                break
            if hit[b + 1] - hit[a] >= RUN_COVERAGE * total and _own_share(mark, own, a, b + 1) >= OWN_COVERAGE and _own_share(mark, named, a, b + 1) >= NAMED_COVERAGE:
                return True
    return False


def candidates(documents: DataFrame, reference: Reference) -> DataFrame:
    """What one pass over the documents gives: (doc_id, text) with the tokens of each document that has a seed, and (token, n, beside) with how many documents of a task have each name, and have it beside most names of one of its units; the empty token counts all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(reference)
    key = dict(documents.select("doc_id").dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_token: dict[str, list[frozenset[str]]] = defaultdict(list)
        for names in set(shared.value.names):
            for t in names & shared.value.few:
                of_token[t].append(names)
        seeds = shared.value.seeds.keys()
        counts, beside = Counter(), Counter()
        kind = None
        for batch in batches:
            kind = batch["doc_id"].type
            kept, texts = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                counts[""] += 1
                if text:
                    found = document_tokens(text)
                    there = set(found)
                    for t in there & of_token.keys():
                        counts[t] += 1
                        beside[t] += any(len(names & there) >= BESIDE * len(names) for names in of_token[t])
                    if not seeds.isdisjoint(zip(found, found[1:])):
                        kept.append(doc)
                        texts.append(" ".join(found))
            none = [None] * len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(kept, kind), pa.array(texts, pa.string()), pa.array(none, pa.string()), pa.array(none, pa.int64()), pa.array(none, pa.int64())], names=["doc_id", "text", "token", "n", "beside"])
        if kind is not None:
            none = [None] * len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(none, kind), pa.array(none, pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([beside[t] for t in counts], pa.int64())],
                names=["doc_id", "text", "token", "n", "beside"],
            )

    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {key}, text string, token string, n long, beside long")


def leaked(documents: DataFrame, items: DataFrame, *, max_bytes: int = MAX_REFERENCE_BYTES) -> DataFrame:
    """p8_found with details: (doc_id, item_id, unit, coverage, own_coverage), one row for each document and item of which it holds a unit.

    The held-out items are broadcast after a check of their size; beyond ``max_bytes`` they are taken in parts by hash, each part as a search of its own (how rare a name is then goes by its
    part). Null and empty texts, questions and passages give no row. Documents aren't shuffled.
    """
    size = items.agg(F.sum(F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("passage"), F.lit(0)))).first()[0] or 0
    parts = -(-size // max_bytes) or 1
    out = None
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        found = _leaked(documents, [tuple(r) for r in part.select("item_id", "question", "passage").distinct().toLocalIterator()])
        out = found if out is None else out.unionByName(found)
    return out


def _leaked(documents: DataFrame, held: list[tuple[int, str | None, str | None]]) -> DataFrame:
    spark = documents.sparkSession
    scanned = materialise(candidates(documents, Reference(held)))
    # No more rows come to the driver than the items have names.
    counts = {r.token: (r.n, r.beside) for r in scanned.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"), F.sum("beside").alias("beside")).collect()}
    total = counts.pop("", (0, 0))[0]
    shared = spark.sparkContext.broadcast(Reference(held, counts, total))
    key = dict(documents.select("doc_id").dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                rows += [(doc, item, *detail) for item, detail in leaks(text.split(" "), reference).items()]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch["doc_id"].type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64())],
                names=["doc_id", "item_id", "unit", "coverage", "own_coverage"],
            )

    return scanned.where("text is not null").select("doc_id", "text").mapInArrow(find, f"doc_id {key}, item_id long, unit string, coverage double, own_coverage double")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, source_split, documents): how many documents hold something of each leaked item."""
    return leaked(documents, items).select("doc_id", "item_id").distinct().groupBy("item_id").agg(F.count("*").alias("documents")).join(items.select("item_id", "source_split"), "item_id").select("item_id", "source_split", "documents")
