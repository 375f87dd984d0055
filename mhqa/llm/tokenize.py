"""Encoding of a corpus with a public byte-pair tokenizer by merge replay (problem 7).

Not word by word: all distinct words of a block of the corpus lie in one array of symbols. An inverted index leads from each pair of symbols to
its positions; the merges are applied in rank order, each to all its positions at once, and only the neighbours of what was merged are
looked up anew. A block is an Arrow batch; words that earlier blocks of the task had keep their ids. No text moves between tasks.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern by which the byte-level tokenizers of 50,257 entries split text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 for itself, the rest counted up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and ranked merges of a byte-level BPE file, as ids."""

    def __init__(self, byte_ids: list[int], pairs: list[tuple[int, int, int]]) -> None:
        self.byte_ids = np.array(byte_ids, np.int32)
        self.rank = {(a << 20) | b: r for r, (a, b, _) in enumerate(pairs)}
        self.pairs = pairs
        keys = np.array([(a << 20) | b for a, b, _ in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the two don't merge."""
        keys = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def load(path: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(id of each byte, (left, right, merged) of each merge in rank order) from a tokenizer file in JSON."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, alphabet = model["vocab"], byte_alphabet()
    byte_ids = [0] * 256
    for char, byte in alphabet.items():
        byte_ids[byte] = vocabulary[char]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return byte_ids, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]


SMALL = 24


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, number of ids of each word)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = merges.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbols)
    if not n:
        return symbols, lengths
    ends = np.cumsum(lengths)
    starts = ends - lengths
    after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
    filled = lengths > 0
    after[ends[filled] - 1] = -1
    before[starts[filled]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list] = {}  # rank -> positions and arrays of positions at which the pair (may) stand

    def note(positions: np.ndarray, ranks: np.ndarray) -> None:
        known = ranks >= 0
        positions, ranks = positions[known], ranks[known]
        if len(ranks) < SMALL:
            for p, r in zip(positions.tolist(), ranks.tolist()):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for part, r in zip(np.split(positions, cuts), ranks[np.concatenate([[0], cuts])].tolist()):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    heap: list[int] = []
    first = np.flatnonzero(after >= 0)
    note(first, merges.ranks(symbols[first], symbols[after[first]]))
    while heap:
        rank = heapq.heappop(heap)
        left, right, merged = merges.pairs[rank]
        entries = index.pop(rank)
        singles = [p for p in entries if type(p) is int]
        arrays = [p for p in entries if type(p) is not int]
        at = np.unique(np.concatenate([*arrays, np.array(singles, np.int64)])) if len(entries) > 1 or arrays else np.array(singles, np.int64)
        follow = after[at]
        valid = alive[at] & (symbols[at] == left) & (follow >= 0)
        valid &= symbols[follow] == right  # follow is -1 only where it is masked already
        at, follow = at[valid], follow[valid]
        if not len(at):
            continue
        if left == right:  # of overlapping pairs in a run, each second one, from the left
            chained = np.concatenate([[False], follow[:-1] == at[1:]])
            if chained.any():
                position = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(chained, 0, position))
                keep = (position - begin) % 2 == 0
                at, follow = at[keep], follow[keep]
        symbols[at] = merged
        alive[follow] = False
        beyond = after[follow]
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        behind = before[at]
        outer = behind >= 0
        touched = np.concatenate([at[inner], behind[outer]])
        note(touched, merges.ranks(symbols[touched], symbols[after[touched]]))
    kept = np.add.reduceat(alive, starts[filled]) if filled.any() else np.zeros(0, np.int64)
    counts = np.zeros(len(words), np.int64)
    counts[filled] = kept
    return symbols[alive], counts


class Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes batches of texts; ids of words are kept for later batches, up to a bounded number of words."""

    def __init__(self, merges: Merges, pattern: str = PATTERN, cache_words: int = CACHE_WORDS) -> None:
        self.merges, self.words, self.cache_words = merges, regex.compile(pattern), cache_words
        self._reset()

    def _reset(self) -> None:
        self.number = Numbers()
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text; an empty list for an empty or null text."""
        if len(self.number) > self.cache_words:
            self._reset()
        number, find, of = self.number, self.words.findall, self.number.__getitem__
        known = len(number)
        found: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                words = find(text)
                per_text[k] = len(words)
                found.extend(map(of, words))
        if len(number) > known:
            fresh = [w.encode("utf-8", "surrogatepass") for w in list(number)[known:]]
            ids, counts = replay(fresh, self.merges)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        words = np.array(found, np.int64)
        counts = self.counts[words]
        ends = np.cumsum(counts)
        positions = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[words] - (ends - counts), counts)
        text_ends = np.concatenate([[0], np.cumsum(per_text)])
        offsets = np.concatenate([[0], ends])[text_ends]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.ids[positions], pa.int32()))


def encode(df: DataFrame, key: str, text: str, *, tokenizer: str = "byte_bpe_50k.json", directory: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens; null and empty texts get an empty list.

    The driver reads the tokenizer file and broadcasts it: its 50,257 entries bound the size. Rows that repeat are encoded as often.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(os.path.join(directory, tokenizer)))
    kind = dict(df.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(*shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], encoder.encode(batch[1].to_pylist())], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
