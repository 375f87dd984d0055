"""Text functions: blankness, the two answer normalisations, tokens, titles."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mhqa.schemas import CHARACTER_SCRIPTS, LANGUAGES

_ARTICLES = re.compile(r"\b(?:a|an|the)\b")
_CHARACTER_LANGUAGES = {code for code, _, script in LANGUAGES if script in CHARACTER_SCRIPTS}


def is_blank(text: Column) -> Column:
    """Nothing but white space of any kind, Unicode's and the information separators; null is blank."""
    return F.coalesce(text.rlike(r"(?U)^[\s\x1C-\x1F]*$"), F.lit(True))


def normalize_legacy(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces; null as empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    # Articles end at any sign that is neither letter, digit nor underscore, as in "the—end".
    rest = F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.array_join(F.filter(F.split(F.regexp_replace(rest, r"(?U)[\s\x1C-\x1F]+", " "), " "), lambda w: w != ""), " ")


def legacy_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_legacy(text), " "), lambda w: w != "")


def fold(text: str, language: str | None) -> str:
    """Compatibility form, full case folding, punctuation and symbols as spaces, no English articles in English, single spaces."""
    out = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    out = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in out)
    return " ".join((_ARTICLES.sub(" ", out) if language == "en" else out).split())


@F.arrow_udf(T.StringType())
def _unicode(texts: pa.Array, languages: pa.Array) -> pa.Array:
    known: dict[tuple[str, str | None], str] = {}
    out = []
    for t, language in zip(texts.to_pylist(), languages.to_pylist()):
        key = (t or "", language)
        if key not in known:
            known[key] = fold(*key)
        out.append(known[key])
    return pa.array(out, pa.string())


def normalize_unicode(text: Column, language: Column) -> Column:
    """The script-aware normalisation; it needs compatibility forms and full case folding, which the built-in functions lack."""
    return _unicode(text, language)


def unicode_tokens(text: Column, language: Column) -> Column:
    """Characters in scripts without spaces between words, else words, of the script-aware normalisation."""
    form = normalize_unicode(text, language)
    return F.when(language.isin(*sorted(_CHARACTER_LANGUAGES)), F.filter(F.split(F.regexp_replace(form, " ", ""), ""), lambda c: c != "")).otherwise(F.filter(F.split(form, " "), lambda w: w != ""))


@F.arrow_udf(T.StringType())
def _title(titles: pa.Array, separators: pa.Array) -> pa.Array:
    form = lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold()
    return pa.array([None if t is None else s.join(map(form, t.split(s))) if s else form(t) for t, s in zip(titles.to_pylist(), separators.to_pylist())], pa.string())


def normalize_title(title: Column, separator: Column | None = None) -> Column:
    """Compatibility form, single spaces, case-folded; null stays null. With ``separator`` each of the titles between separators."""
    return _title(title, F.lit("") if separator is None else separator)


def redact(message: Column, limit: int = 500) -> Column:
    """An error message without keys and line breaks, cut to ``limit`` characters."""
    return F.substring(F.translate(F.regexp_replace(message, r"(?i)\b(?:sk|key|token|bearer)[-_ =:]+[A-Za-z0-9._-]{8,}", "[redacted]"), "\r\n", "  "), 1, limit)
