"""One consistent form for text that looks the same (problem 5).

``inspect`` gives the form and the kinds of deviation; ``comparison_form`` is the key used for comparing texts
(compatibility composition, full case folding, ordinary spaces, no default-ignorable characters, one script a word).
All of it is computed once for each distinct value of an Arrow batch.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- fixed values: code points -----------------------------------------------------------------------------------------
#: Spaces other than U+0020, with the line and tab controls.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0  -     　"
#: Default-ignorable and other invisible characters, but the non-joiner U+200C.
INVISIBLE = (
    "\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xad͏؜ᅟᅠ឴឵᠋-᠏​‍-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
#: Full-width digits and Latin letters, Latin ligatures and digraph letters.
WIDE = "０-９Ａ-Ｚａ-ｚ"
LIGATURES = "ﬀ-ﬆĲĳǄ-ǌǱ-ǳ"
#: Letters that look like Latin ones, by script.
CYRILLIC_LATIN = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝҮүɡ", "ABEKMHOPCTYXSIJaeopcyxsijhdqwYyg"))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικγτχηωϲϳ", "ABEZHIKMNOPTYXavopuikytxnwcj"))
# ----------------------------------------------------------------------------------------------------------------------
#: Latin letters that look like Cyrillic or Greek ones: the same pairs the other way round.
LATIN_CYRILLIC = {x: c for c, x in reversed(CYRILLIC_LATIN.items())}
LATIN_GREEK = {x: g for g, x in reversed(GREEK_LATIN.items())}

LATIN, CYRILLIC, GREEK = "A-Za-zªºÀ-ÖØ-öø-ɏɐ-ʯḀ-ỿ", "Ѐ-ԯᲀ-᲏", "Ͱ-Ͽἀ-῿"
_SPACE = re.compile(f"[{SPACES}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_NON_JOINER = re.compile("(?<![ؠ-ۿݐ-ݿࢠ-ࣿ])‌|‌(?![ؠ-ۿݐ-ݿࢠ-ࣿ])")
_COMPATIBLE = re.compile(f"[{WIDE}{LIGATURES}]")
_MARK = "̀-ͯ"
_MIXED = re.compile(f"[{LATIN}][{_MARK}]*[{CYRILLIC}{GREEK}]|[{CYRILLIC}{GREEK}][{_MARK}]*[{LATIN}]|[{CYRILLIC}][{_MARK}]*[{GREEK}]|[{GREEK}][{_MARK}]*[{CYRILLIC}]")
_WORD = re.compile(f"[{LATIN}{CYRILLIC}{GREEK}{_MARK}]+")
_FOREIGN = re.compile(f"[{CYRILLIC}{GREEK}]")
_ONE = {"latin": re.compile(f"[{LATIN}]"), "cyrillic": re.compile(f"[{CYRILLIC}]"), "greek": re.compile(f"[{GREEK}]")}
_MAPS = {
    ("cyrillic", "latin"): CYRILLIC_LATIN,
    ("greek", "latin"): GREEK_LATIN,
    ("latin", "cyrillic"): LATIN_CYRILLIC,
    ("latin", "greek"): LATIN_GREEK,
    ("greek", "cyrillic"): {g: LATIN_CYRILLIC[x] for g, x in GREEK_LATIN.items() if x in LATIN_CYRILLIC},
    ("cyrillic", "greek"): {c: LATIN_GREEK[x] for c, x in CYRILLIC_LATIN.items() if x in LATIN_GREEK},
}
#: Deviations, as bits.
COMPOSITION, WIDTH, SPACE, IGNORABLE, SCRIPT = 1, 2, 4, 8, 16
KINDS = {COMPOSITION: "composition", WIDTH: "width", SPACE: "space", IGNORABLE: "invisible", SCRIPT: "script"}


def _scripts(word: str) -> dict[str, int]:
    return {s: n for s, p in _ONE.items() if (n := len(p.findall(word)))}


def _to_script(word: str, target: str) -> str:
    """``word`` with look-alikes of other scripts put into ``target``; letters without a look-alike stay."""
    out = unicodedata.normalize("NFD", word)
    for (source, to), table in _MAPS.items():
        if to == target and _ONE[source].search(out):
            out = "".join(table.get(c, c) for c in out)
    return unicodedata.normalize("NFC", out)


def _one_script(text: str) -> tuple[str, bool]:
    """``text`` with each word in one script. A word changes if it mixes scripts, or if it consists of look-alikes only and no other word of the text is surely in its script."""
    words = _WORD.findall(text)
    whole = [s for w in words if len(s := _scripts(w)) == 1]
    pure = {s: sum(s in x for x in whole) for s in _ONE}
    main = max(pure, key=lambda s: pure[s]) if words else "latin"
    sure = {s for w in words if len(x := _scripts(w)) == 1 for s in x if s == main or any((s, main) in _MAPS and c not in _MAPS[s, main] for c in unicodedata.normalize("NFD", w) if c.isalpha())}
    changed = False

    def fix(match: re.Match) -> str:
        nonlocal changed
        word = match.group()
        scripts = _scripts(word)
        if len(scripts) > 1:
            # The script to which all other letters can be mapped; among several, the one with most letters.
            able = [s for s in scripts if all(c in _MAPS[o, s] for o in scripts if o != s for c in unicodedata.normalize("NFD", word) if _ONE[o].match(c))]
            changed = True
            return _to_script(word, max(able or scripts, key=lambda s: (scripts[s], s == main)))
        if scripts and main not in scripts and match.string[max(0, match.start() - 1) : match.start()] not in ("&", "\\"):  # not the rest of an escape
            (own,) = scripts
            letters = [c for c in unicodedata.normalize("NFD", word) if c.isalpha()]
            if all(c in _MAPS[own, main] for c in letters) and (own != "latin" or word.islower()) and (own not in sure or len(letters) == 1 and word.islower()):
                changed = True
                return _to_script(word, main)
        return word

    out = _WORD.sub(fix, text)
    return out, changed


@lru_cache(maxsize=20000)
def inspect(text: str) -> tuple[str, int]:
    """The consistent form of ``text`` and the bits of what had to be changed (0: it is in the form).

    An empty text is in the form. Case, East Asian punctuation and quotation marks stay as they are; the non-joiner stays between two
    letters of the Arabic script.
    """
    if text.isascii():
        kinds = (SPACE if _SPACE.search(text) else 0) | (IGNORABLE if _INVISIBLE.search(text) else 0)
        if not kinds:
            return text, 0
    kinds = 0
    if _SPACE.search(text):
        kinds |= SPACE
        text = _SPACE.sub(" ", text)
    if _INVISIBLE.search(text):
        kinds |= IGNORABLE
        text = _INVISIBLE.sub("", text)
    if "‌" in text and _NON_JOINER.search(text):
        kinds |= IGNORABLE
        text = _NON_JOINER.sub("", text)
    if _COMPATIBLE.search(text):
        kinds |= WIDTH
        text = _COMPATIBLE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if not unicodedata.is_normalized("NFC", text):
        kinds |= COMPOSITION
        text = unicodedata.normalize("NFC", text)
    if _MIXED.search(text) or _FOREIGN.search(text) and _ONE["latin"].search(text):
        text, changed = _one_script(text)
        if changed:
            kinds |= SCRIPT
    return text, kinds


def clean(text: str | None) -> str:
    """The consistent form; '' for null."""
    return inspect(text)[0] if text else ""


def comparison_form(text: str | None) -> str:
    """The key under which texts that look the same are equal: consistent form, NFKC, full case folding, single spaces."""
    if not text:
        return ""
    out = clean(text)
    return " ".join((out.lower() if out.isascii() else unicodedata.normalize("NFKC", out).casefold()).split())


_ACCENTS = re.compile("[̀-ͯ]")


def plain(text: str, *, fold: bool = True) -> str:
    """A coarser key than ``comparison_form`` for long texts: compatibility form, case-folded (unless ``fold`` is false), mixed words in one script, without accents; spaces stay."""
    if text.isascii():
        return text.lower() if fold else text
    if _INVISIBLE.search(text):
        text = _INVISIBLE.sub("", text)
    if _MIXED.search(text):
        text = _WORD.sub(lambda m: _one_script(m.group())[0] if len(_scripts(m.group())) > 1 else m.group(), text)
    text = unicodedata.normalize("NFKD", text)
    return unicodedata.normalize("NFC", _ACCENTS.sub("", text.casefold() if fold else text))


_NORMALISED = T.StructType([T.StructField("form", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType(), False))])


def normalise(df: DataFrame, text: str = "text", *, form: str = "form", kinds: str = "form_changes") -> DataFrame:
    """``df`` with the consistent form of column ``text`` and the kinds of change.

    Null gives null and no kinds; an empty text gives itself. Other columns, repeated rows and their order within partitions stay. The form
    is computed once for each distinct value of a batch.
    """

    @F.arrow_udf(_NORMALISED)
    def per_distinct(values: pa.Array) -> pa.Array:
        encoded = values.dictionary_encode()
        found = [inspect(v) for v in encoded.dictionary.to_pylist()]
        table = pa.StructArray.from_arrays(
            [pa.array([f for f, _ in found], pa.string()), pa.array([[n for b, n in KINDS.items() if k & b] for _, k in found], pa.list_(pa.field("element", pa.string(), False)))],
            fields=[pa.field("form", pa.string()), pa.field("kinds", pa.list_(pa.field("element", pa.string(), False)))],
        )
        return table.take(encoded.indices)

    return df.withColumn("__n", per_distinct(F.col(text))).withColumns({form: F.col("__n.form"), kinds: F.coalesce(F.col("__n.kinds"), F.array().cast("array<string>"))}).drop("__n")


def deviating(units: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``units`` whose ``text`` isn't in the consistent form. Nulls and empty texts are in it."""

    @F.arrow_udf("boolean")
    def off(values: pa.Array) -> pa.Array:
        encoded = values.dictionary_encode()
        found = pa.array([inspect(v)[1] > 0 for v in encoded.dictionary.to_pylist()], pa.bool_())
        return found.take(encoded.indices)

    return units.where(off(F.col(text)))
