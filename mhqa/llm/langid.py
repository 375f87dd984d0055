"""Language of each text and of each piece of a mixed text, by compression (problem 1).

For each language a raw-content zstandard dictionary is filled with running text of that language; a text belongs to the language whose
dictionary compresses it best. Names, titles of works and figures are masked before, because they keep their form in every language; what is
left recurs often, so that each distinct masked piece is compressed once a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mhqa.llm import units
from mhqa.llm.textforms import clean

# -- fixed values ------------------------------------------------------------------------------------------------------
#: ISO 639-2 and 639-3 codes and further English names of the inventory's languages.
NOTATIONS = {
    "en": "eng", "zh": "zho chi cmn chinese mandarin", "hi": "hin", "es": "spa castilian", "ar": "ara arb", "fr": "fra fre", "bn": "ben bangla",
    "pt": "por", "ru": "rus", "ur": "urd", "id": "ind in", "de": "deu ger", "ja": "jpn", "tr": "tur", "vi": "vie", "sw": "swa swh kiswahili",
    "ko": "kor", "fa": "fas per pes farsi", "it": "ita", "th": "tha", "nl": "nld dut flemish", "pl": "pol", "el": "ell gre", "sv": "swe",
}
#: Names of the inventory's languages in themselves.
OWN_NAMES = {
    "en": "english", "zh": "中文 汉语 漢語", "hi": "हिन्दी हिंदी", "es": "español castellano", "ar": "العربية عربي", "fr": "français", "bn": "বাংলা", "pt": "português",
    "ru": "русский", "ur": "اردو", "de": "deutsch", "ja": "日本語", "tr": "türkçe", "ko": "한국어", "fa": "فارسی", "it": "italiano", "nl": "nederlands", "pl": "polski", "sv": "svenska",
}
#: Scripts that a language may use for its running text.
SCRIPTS = {
    "zh": ("han",), "ja": ("han", "kana"), "ko": ("hangul", "han"), "hi": ("devanagari",), "bn": ("bengali",), "th": ("thai",), "ru": ("cyrillic",),
    "el": ("greek",), "ar": ("arabic",), "fa": ("arabic",), "ur": ("arabic",),
}
_SCRIPT_RANGES = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-Ͽ", "arabic": "ؠ-ۿݐ-ݿ", "devanagari": "ऀ-ॿ",
    "bengali": "ঀ-৿", "thai": "฀-๿", "hangul": "가-힣", "kana": "぀-ヿ", "han": "㐀-鿿",
}
#: Quotation marks, opening and closing.
QUOTES = ('""', "“”", "„“", "„”", "«»", "《》", "『』", "「」", "‚‘")
# ----------------------------------------------------------------------------------------------------------------------

_QUOTED = re.compile("|".join(f"{re.escape(a)}[^{re.escape(b)}]{{1,90}}{re.escape(b)}" for a, b in QUOTES))
_CASED = re.compile("[{0}]+(?:[-'’.][{0}]+)*|[{1}]+(?:-[{1}]+)*".format(_SCRIPT_RANGES["latin"], _SCRIPT_RANGES["cyrillic"]))
_TOKEN = re.compile(r"[^\W\d_][^\W\d_'’‌ऀ-ॿ]*")
_PIECE_END = re.compile(r"(?<=[.!?…؟۔])\s+|(?<=[。！？।॥])\s*|[\n\r]+|\s+/\s+|\s*\|\s*")
_LETTER = {s: re.compile(f"[{r}]") for s, r in _SCRIPT_RANGES.items()}

MIN_WORDS, MIN_CHARS, MARGIN = 2, 8, 0.06
#: A text of a script with one language of the inventory is in it if this share of its letters are letters that make up at least the other share of that language's texts.
KNOWN_LETTERS, LETTER_SHARE = 0.95, 0.0005
FIT_ROWS, FIT_TEXTS, DICTIONARY_BYTES, LEVEL, CONTRADICTION, MINOR = 20_000, 1_000, 32_768, 9, 0.25, 0.1


def _drop_capitalised(match: re.Match) -> str:
    word = match.group()
    return " " if word[0].isupper() else word


def mask(text: str) -> str:
    """Running text of ``text``: words only, without quoted titles, capitalised words (if the text has lower case at all) and figures, in lower case."""
    text = _QUOTED.sub(" ", text)
    if any(c.islower() for c in text):
        text = _CASED.sub(_drop_capitalised, text)
    return " ".join(_TOKEN.findall(text)).lower()


def pieces(text: str) -> list[str]:
    """The sentence-long pieces of ``text``."""
    return [p for p in _PIECE_END.split(text) if p and not p.isspace()]


def scripts_of(masked: str) -> dict[str, int]:
    return {s: n for s, p in _LETTER.items() if (n := len(p.findall(masked)))}


def _letters(text: str, script: str) -> frozenset[str]:
    """The letters of a script that make up LETTER_SHARE of a language's texts, at least."""
    counts = Counter(c for c in text if _LETTER[script].match(c))
    return frozenset(c for c, n in counts.items() if n >= LETTER_SHARE * counts.total())


class Classifier:
    """Compression classifier over raw-content dictionaries, ``{language: text}``."""

    def __init__(self, corpora: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> None:
        self.margin = margin
        self.by = {}
        for language, content in sorted(corpora.items()):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            self.by[language] = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.of_script = defaultdict(list)
        for language in self.by:
            for script in SCRIPTS.get(language, ("latin",)):
                self.of_script[script].append(language)
        # Of scripts with one language of the inventory, the letters that its texts have: others of the script's languages use letters that it lacks.
        self.letters = {script: _letters(corpora[able[0]].decode("utf-8", "ignore"), script) for script, able in self.of_script.items() if len(able) == 1}
        self.masked = lru_cache(maxsize=200_000)(self._masked)
        self.text = lru_cache(maxsize=20_000)(self._text)

    def _masked(self, masked: str) -> tuple[str | None, float]:
        """(language, confidence) of masked text; (None, confidence) if there is too little of it or the margin is narrow."""
        scripts = scripts_of(masked)
        if not scripts:
            return None, 0.0
        main = "kana" if scripts.get("kana") and scripts["kana"] + scripts.get("han", 0) > sum(scripts.values()) / 2 else max(scripts, key=lambda s: scripts[s])
        able = self.of_script.get(main, [])
        ideographic = main in ("han", "kana", "thai")
        if len(able) == 0:
            return None, 0.0
        if len(able) == 1:
            if sum(scripts.values()) < (4 if ideographic else MIN_CHARS):
                return None, 0.5
            known = sum(c in self.letters[main] for c in masked if _LETTER[main].match(c)) / scripts[main]
            return (able[0] if ideographic or known >= KNOWN_LETTERS else None), round(known, 4)
        raw = masked.encode()
        if not ideographic and (len(masked.split()) < MIN_WORDS or len(masked) < MIN_CHARS) or ideographic and len(masked) < 4:
            return None, 0.0
        sizes = sorted((len(self.by[x].compress(raw)), x) for x in able)
        (best, language), second = sizes[0], sizes[1][0]
        confidence = (second - best) / second
        return (language if confidence >= self.margin else None), round(confidence, 4)

    def _text(self, text: str) -> tuple[tuple[str, str | None, float], ...]:
        """(piece, language, confidence) for each sentence-long piece of a text."""
        return tuple((p, *self.masked(mask(p))) for p in pieces(clean(text)))

    def whole(self, text: str) -> tuple[str | None, float]:
        """The language of a whole text, however many pieces it has."""
        return self.masked(mask(clean(text)))


def notations(languages: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Every known notation of each (code, name) of the inventory, in lower case."""
    known = {}
    for code, name in languages:
        for form in [code, name.lower(), *NOTATIONS.get(code, "").split(), *OWN_NAMES.get(code, "").split()]:
            known[form] = code
    return known


def label_code(label: str | None, known: dict[str, str]) -> str | None:
    """The inventory code that ``label`` names in any notation (case, spaces, region or script subtag, ISO 639-2/3, English or own name), else None."""
    form = (label or "").strip().lower().replace("_", "-")
    return known.get(form) or known.get(form.split("-")[0].strip()) or known.get(form.split("(")[0].strip())


def inventory(languages: DataFrame) -> dict[str, str]:
    """Notations from the languages table, which has one row for each language of the inventory (24)."""
    return notations((r.code, r.name) for r in languages.select("code", "name").where("code is not null and name is not null").distinct().collect())


_MASKED = "label string, masked string, n long"


def fit(instances: DataFrame, known: dict[str, str], *, rows: int = FIT_ROWS, texts: int = FIT_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries from a bounded sample of labelled rows: sentences of about ``rows`` instances, drawn by a hash of the id.

    Each masked text goes to the label it occurs with most often, so that single wrong labels don't count; of each language the ``texts`` most
    frequent are kept, up to ``size`` bytes. The bounds hold for fitting alone: every text is classified.
    """
    total = instances.count()
    sample = instances if total <= rows else instances.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * rows / total))

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            codes: dict[str | None, str | None] = {}
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
                if label not in codes:
                    codes[label] = label_code(label, known)
                if text and (code := codes[label]):
                    for piece in pieces(clean(text)):
                        if len(m := mask(piece)) >= MIN_CHARS:
                            counts[code, m] += 1
            yield pa.RecordBatch.from_pydict({"label": [k for k, _ in counts], "masked": [m for _, m in counts], "n": list(counts.values())}, pa.schema([("label", pa.string()), ("masked", pa.string()), ("n", pa.int64())]))

    labelled = units.sentences(sample).unionByName(units.field(sample, "question", "question_language")).select("label", "text")
    counted = labelled.mapInArrow(masked, _MASKED).groupBy("label", "masked").agg(F.sum("n").alias("n"))
    best = counted.groupBy("masked").agg(F.max_by("label", F.struct("n", F.col("label"))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("all")).where("n * 2 > all")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "masked"))).where(F.col("rank") <= texts)
    found: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in ranked.select("label", "masked", "rank").collect():  # at most `texts` for each language
        found[r.label].append((r["rank"], r.masked))
    return _contents(_consistent(found, size), size)


def _contents(found: dict[str, list[tuple[int, str]]], size: int) -> dict[str, bytes]:
    corpora = {}
    for language, entries in found.items():
        content = b""
        for _, text in sorted(entries):  # the most frequent last, where references to them are shortest
            raw = text.encode() + b"\n"
            if len(content) + len(raw) > size:
                break
            content = raw + content
        if content:
            corpora[language] = content
    return corpora


def _consistent(found: dict[str, list[tuple[int, str]]], size: int) -> dict[str, list[tuple[int, str]]]:
    """The fitting texts whose label the dictionaries of the other half don't contradict: what only wrong labels brought in goes out."""
    halves: list[dict[str, list[tuple[int, str]]]] = [defaultdict(list), defaultdict(list)]
    for language, entries in found.items():
        for rank, text in entries:
            halves[zlib.crc32(text.encode()) & 1][language].append((rank, text))
    kept: dict[str, list[tuple[int, str]]] = defaultdict(list)
    most = max((len(v) for v in found.values()), default=0)
    for half, other in (halves, halves[::-1]):
        judge = Classifier(_contents(other, size))
        for language, entries in half.items():
            for rank, text in entries:
                judged, confidence = judge.masked(text)
                unjudged = language not in judge.by and len(found[language]) >= MINOR * most  # too little of it to have it in both halves
                if judged in (None, language) or confidence < CONTRADICTION or unjudged:
                    kept[language].append((rank, text))
    return kept


SEGMENTS = "id string, paragraph_id string, sentence_id int, piece int, language string, confidence double, label string"


def segments(texts: DataFrame, corpora: dict[str, bytes], known: dict[str, str]) -> DataFrame:
    """(id, paragraph_id, sentence_id, piece, language, confidence, label) for each sentence-long piece of each unit.

    ``language`` is null where a piece has no running text or the margin between the two best languages is narrow; ``label`` is the code that
    the unit's label names, null if it names none. Null and blank texts give no row, repeated rows repeat theirs.
    """
    schema = pa.schema([("id", pa.string()), ("paragraph_id", pa.string()), ("sentence_id", pa.int32()), ("piece", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("label", pa.string())])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier, codes = Classifier(corpora), {}
        for batch in batches:
            rows: list[tuple] = []
            for i, p, s, text, label in zip(*(batch[c].to_pylist() for c in ("id", "paragraph_id", "sentence_id", "text", "label"))):
                if not text:
                    continue
                if label not in codes:
                    codes[label] = label_code(label, known)
                rows.extend((i, p, s, k, language, confidence, codes[label]) for k, (_, language, confidence) in enumerate(classifier.text(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return texts.select("id", "paragraph_id", "sentence_id", "text", "label").mapInArrow(classify, SEGMENTS)


def mislabelled(instances: DataFrame, languages: DataFrame) -> DataFrame:
    """p1_found: (id, paragraph_id, sentence_id, language) for each language in which a question or sentence, or a piece of it, is written but which its label doesn't name."""
    known = inventory(languages)
    corpora = fit(instances, known)
    if not corpora:
        return instances.sparkSession.createDataFrame([], "id string, paragraph_id string, sentence_id int, language string")
    texts = units.sentences(instances).unionByName(units.field(instances, "question", "question_language"))
    return segments(texts, corpora, known).where("language is not null and not language <=> label").select("id", "paragraph_id", "sentence_id", "language").distinct()
