"""Broken question-answer pairs and the kind of their defect (problem 3)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mhqa.llm import langid
from mhqa.llm.textforms import clean, comparison_form
from mhqa.llm.truncation import PLAIN, body, truncated_units
from mhqa.runtime import materialise

# -- fixed values ------------------------------------------------------------------------------------------------------
#: Words that stand for a missing answer.
PLACEHOLDERS = frozenset(
    "n/a|na|n.a.|n.a|none|null|nil|nan|nul|undefined|unknown|unk|tbd|tba|tbc|todo|to do|fixme|xxx|xx|no answer"
    "|noanswer|no_answer|#n/a|not available|not applicable|keine angabe|k.a.|s/o|sin respuesta|sans réponse|нет данных|н/д|无|暂无|なし|不明|lorem ipsum".split("|")
)
#: Words that do so in brackets only.
BRACKETED = frozenset("empty blank missing placeholder answer text value x".split())
#: Stems of what is declined, for each language of the inventory: answering, information, and the model that speaks.
REFUSAL = {
    "en": "answer respond reply comply guess information help language_model assistant to_say to_comment",
    "de": "antwort auskunft beantwort beurteil sprachmodell äußer leider kann_ich informationen",
    "fr": "répond réponse prononc modèle_de_langage désolé refus renseign information",
    "es": "respond respuesta contest modelo_de_lenguaje siento pronunci información",
    "pt": "respond resposta modelo_de_linguagem desculp pronunci informaç",
    "it": "rispond risposta modello_linguistic spiacent pronunci informazion dispiace",
    "nl": "antwoord beantwoord taalmodel helaas spijt informatie uitspraak",
    "pl": "odpowie odpowiad model_językow przykro informacj przepraszam",
    "sv": "svar språkmodell tyvärr ledsen information",
    "tr": "yanıt cevap dil_modeli üzgün maalesef bilgi",
    "ru": "ответ отвеч языковая языковой сожален извин данных информац",
    "el": "απαντ γλωσσικ λυπάμαι πληροφορ",
    "ar": "الإجابة إجابة أجيب الرد آسف أعتذر نموذج معلومات المعلومات جواب",
    "fa": "پاسخ متأسف متاسف مدل_زبانی اطلاعات داده‌ها جواب",
    "ur": "جواب معذرت معلومات",
    "hi": "उत्तर जवाब क्षमा भाषा_मॉडल जानकारी कहना_चाह",
    "bn": "উত্তর দুঃখিত তথ্য",
    "zh": "回答 作答 回应 回應 抱歉 无法 不便 语言模型 信息 答复",
    "ja": "答え 回答 お答え 申し訳 言語モデル 情報 控え",
    "ko": "답변 답할 대답 죄송 언어_모델 정보",
    "th": "ตอบ ขออภัย ข้อมูล",
    "vi": "trả_lời xin_lỗi mô_hình_ngôn_ngữ thông_tin",
    "id": "jawab maaf model_bahasa informasi",
    "sw": "jibu samahani taarifa",
}
#: Signs of declining, as patterns: negation, inability, apology, preferring not to. English ones need a speaker or a pointer to the question beside them.
DECLINING = {
    "de": r"\bnicht|\bkein|\bleider|\bleid\b", "fr": r"\bne\b|\bn['’]|\bpas\b|impossible|malheureusement|désol", "es": r"\bno\b|imposible|lament|siento|\bprefier", "pt": r"\bnão\b|impossível|infelizmente|\bprefir|desculp",
    "it": r"\bnon\b|impossibile|dispiac|spiacent|\bpreferisc", "nl": r"\bniet\b|\bgeen\b|helaas|spijt", "pl": r"\bnie\b|przykro|przepraszam|\bwolę\b", "sv": r"\binte\b|\binge[nt]|tyvärr|ledsen", "tr": r"m[ae]m|m[ae]y[ıi]|değil|\byok|maalesef|üzgün",
    "ru": r"\bне\b|\bнет\b|нечего|сожален|извин", "el": r"\bδεν\b|λυπάμαι|αδυνατ", "ar": r"\bلا\b|\bلم\b|\bلن\b|عدم|ليس|آسف|أعتذر", "fa": r"نمی|\bنت|\bند|نیست|متأسف|متاسف", "ur": "نہیں|معذرت", "hi": "नहीं|क्षमा|असमर्थ", "bn": "না|নেই|দুঃখিত",
    "zh": "无法|不|抱歉|没有|恕", "ja": "ません|ない|控え|申し訳", "ko": "없|않|못|죄송", "th": "ไม่|ขออภัย", "vi": r"\bkhông\b|xin lỗi|tiếc", "id": r"\btidak\b|\bmaaf\b|\bbelum\b", "sw": r"\bsiwezi|\bsamahani|\bhatu",
}
ENGLISH_DECLINING = r"\bcan(?:no|['’])t\b|\bcould(?: not|n['’]t)\b|\bunable\b|\bnot\b|\bno\b|\bdecline|\boutside\b|\bsorry\b|\bapolog|\bunfortunately\b|\bwon['’]t\b|\bdon['’]t\b"
ENGLISH_SPEAKER = r"\bi\b|\bi['’]|\bme\b|\bmy\b|\bwe\b|\bthis\b|\bthat\b|\bhere\b|\bsorry\b|\bquestions?\b"
# ----------------------------------------------------------------------------------------------------------------------

_STEMS = {language: re.compile("|".join(re.escape(s.replace("_", " ")) for s in stems.split())) for language, stems in REFUSAL.items()}
_DECLINING = {language: re.compile(pattern) for language, pattern in DECLINING.items()}
_ENGLISH = re.compile(ENGLISH_DECLINING), re.compile(ENGLISH_SPEAKER)
_TOKEN = re.compile(r"\d+|[^\W\d_]+")
_IDEOGRAPH = re.compile("[㐀-鿿぀-ヿ฀-๿]")
_NAME = re.compile("[A-ZÀ-ÖØ-ÞĀ-ɏ][^\\W\\d_]{2,}|[A-Za-zÀ-ɏ]{3,}|[Ѐ-Я][Ѐ-ӿ]{2,}")
COPY_PRECISION, COPY_COVERAGE = 0.85, 0.5
SHARE, SOURCES = 0.12, 3
SPIKE, SPIKE_LEAST, SPIKE_WIDTH = 5.0, 8, 5


def is_empty(answer: str | None) -> bool:
    """Null, blank, signs only, a placeholder word, or, in brackets, a word for a missing answer."""
    text = clean(answer).strip().casefold()
    bare = text.strip("[](){}<>*_-.\"' ")
    return not any(c.isalnum() for c in text) or text in PLACEHOLDERS or bare in PLACEHOLDERS or bare in BRACKETED and text[0] in "[({<" and text[-1] in "])}>"


def tokens(text: str) -> list[str]:
    """Words and figures of the comparison form; pairs of characters in scripts that don't separate words."""
    return [p for w in _TOKEN.findall(comparison_form(text)) for p in ([w] if len(w) < 3 or not _IDEOGRAPH.search(w) else map("".join, zip(w, w[1:])))]


def is_copy(question: str | None, answer: str | None) -> bool:
    """Whether ``answer`` consists of words of ``question`` and has at least half of them, in whatever order; a repeated question counts."""
    q, a = Counter(tokens(question or "")), tokens(answer or "")
    if len(a) < 4 or not q:
        return False
    known = sum(t in q for t in a)
    covered = sum((q & Counter(a)).values())
    return known >= COPY_PRECISION * len(a) and covered >= COPY_COVERAGE * sum(q.values())


def declines(text: str) -> bool:
    """Whether a text, in lower case, names what is declined (answering, information, the model that speaks) and, elsewhere, declines it."""
    for language, stems in _STEMS.items():
        if at := stems.search(text):
            if language == "en":
                if all(p.search(text) for p in _ENGLISH):
                    return True
            elif sign := _DECLINING[language].search(text):
                if sign.span() != at.span() or _DECLINING[language].search(text, sign.end()) or stems.search(text, at.end()):
                    return True
    return False


def is_refusal(answer: str | None, record: str) -> bool:
    """Whether ``answer`` declines: what is declined and a sign of declining in one language, and neither a figure nor a name of the record; words in quotation marks don't count."""
    text = clean(answer)
    plain = langid._QUOTED.sub(" ", text)
    if any(c.isdigit() for c in plain) or plain != text or not declines(plain.casefold()):
        return False
    words = _TOKEN.findall(plain)
    if len(words) < 3 and not (_IDEOGRAPH.search(plain) and len(plain) >= 6):
        return False
    return not any(n in record for n in _NAME.findall(plain)[1:] if n[0].isupper())


_PAIRS = "id string, source_id string, question_languages array<string>, form string, value string, answer_language string, length int, ended boolean, defect string"


def pair_features(instances: DataFrame, corpora: dict[str, bytes]) -> DataFrame:
    """One row for each instance row: what its own texts say. ``defect`` is empty, refusal or copy where they suffice."""
    schema = pa.schema(
        [("id", pa.string()), ("source_id", pa.string()), ("question_languages", pa.list_(pa.string())), ("form", pa.string()), ("value", pa.string()),
         ("answer_language", pa.string()), ("length", pa.int32()), ("ended", pa.bool_()), ("defect", pa.string())]
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = langid.Classifier(corpora)
        for batch in batches:
            rows = []
            for i, source, question, answer, record in zip(*(batch[c].to_pylist() for c in ("id", "source_id", "question", "answer", "record"))):
                spoken = sorted({x for _, x, _ in classifier.text(question) if x}) if question else []
                text, ended, _ = body(answer) if answer else ("", False, False)
                defect = "empty" if is_empty(answer) else "copy" if is_copy(question, answer) else "refusal" if is_refusal(answer, record or "") else None
                value = language = None
                if not defect and text:
                    if len(text) <= PLAIN + 8 and not ended:
                        value = re.sub(r"\d+", "0", comparison_form(text))
                    else:
                        language, confidence = classifier.whole(text)
                        language = language if confidence >= 2 * langid.MARGIN else None
                rows.append((i, source, spoken, comparison_form(text), value, language, len(answer or ""), ended, defect))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    record = F.array_join(F.flatten(F.transform("candidates", lambda c: F.concat(F.coalesce(c["sentences"], F.array()), F.array(c["title"])))), "\n")
    return instances.select("id", "source_id", "question", "answer", record.alias("record")).mapInArrow(features, _PAIRS)


def shortened(pairs: DataFrame, sources: DataFrame | None) -> DataFrame:
    """(id): answers that are the beginning of another answer to the same source question, in any of its languages or in the source itself.

    The distinct answers of a source are sorted by text; an answer and all that go on from it are then neighbours. A source is split by the first two letters, which an
    answer shares with all that go on from it; answers without source have no neighbours.
    """
    forms = pairs.where("form != '' and defect is null and source_id is not null").select("source_id", "form")
    if sources is not None:
        forms = forms.unionByName(sources.select("source_id", F.expr("trim(TRAILING '.' FROM lower(answer))").alias("form")).where("form != ''"))
    order = Window.partitionBy("source_id", F.substring("form", 1, 2)).orderBy("form")
    cut = forms.distinct().withColumn("next", F.lead("form").over(order)).where(F.expr("startswith(next, form) and length(form) >= 2 and length(next) > length(form)"))
    whole = pairs.where("defect is null and not ended").join(usual_values(pairs), ["value", "question_languages"], "left_anti")
    return whole.join(cut.select("source_id", "form"), ["source_id", "form"]).select("id")


def usual_values(pairs: DataFrame) -> DataFrame:
    """(value, question_languages): short answers given to the questions of several sources, hence whole."""
    return pairs.where("value is not null and defect is null").groupBy("value", "question_languages").agg(F.countDistinct("source_id").alias("n")).where(F.col("n") >= SOURCES).select("value", "question_languages")


def length_limits(pairs: DataFrame) -> DataFrame:
    """(length): lengths at which far more unended answers stop than at the lengths around, that is, limits of a field."""
    counts = pairs.where("defect is null and not ended and value is null").groupBy("length").agg(F.count("*").alias("n"))
    near = counts.select(F.explode(F.sequence(F.col("length") - SPIKE_WIDTH, F.col("length") + SPIKE_WIDTH)).alias("length"), F.col("length").alias("at"), F.col("n").alias("m")).where("at != length")
    around = counts.join(near, "length", "left").groupBy("length", "n").agg((F.coalesce(F.sum("m"), F.lit(0)) / (2 * SPIKE_WIDTH)).alias("usual"))
    return around.where((F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE * F.col("usual"))).select("length")


def foreign_values(pairs: DataFrame) -> DataFrame:
    """(value, language): short answers that are hardly ever given to questions in ``language``, though to questions in others.

    Counted by distinct sources, figures masked; names and figures occur with one source or with all languages, so they never come out.
    """
    given = pairs.where("value is not null and defect is null and size(question_languages) = 1 and not value rlike '^[0 .,:/-]*$'").select("value", F.col("question_languages")[0].alias("language"), "source_id").distinct()
    counts = given.groupBy("value", "language").agg(F.count("*").alias("n"))
    most = counts.groupBy("value").agg(F.max("n").alias("most")).where(F.col("most") >= SOURCES)
    return counts.join(most, "value").where(F.col("n") <= SHARE * F.col("most")).select("value", "language")


def defects(instances: DataFrame, languages: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """p3_found: (id, defect), one row for each defective pair; of several kinds the first of empty, copy, refusal, truncated, language.

    Repeated rows of an id count once. A null question has no language and is no model of a copy.
    """
    known = langid.inventory(languages)
    corpora = langid.fit(instances, known)
    pairs = materialise(pair_features(instances, corpora))
    own = pairs.where("defect is not null").select("id", "defect")
    cut = truncated_units(instances, known)[1].where("column = 'answer'").select("id")
    spike = pairs.where("defect is null and not ended and value is null").join(length_limits(pairs), "length", "left_semi").select("id")
    cut = cut.unionByName(shortened(pairs, sources)).unionByName(spike).withColumn("defect", F.lit("truncated"))
    spoken = pairs.where("defect is null and answer_language is not null and size(question_languages) > 0 and not array_contains(question_languages, answer_language)").select("id")
    by_value = pairs.where("defect is null and size(question_languages) = 1").withColumn("language", F.col("question_languages")[0]).join(foreign_values(pairs), ["value", "language"], "left_semi").select("id")
    other = spoken.unionByName(by_value).withColumn("defect", F.lit("language"))
    rank = F.array_position(F.array(*map(F.lit, ("empty", "copy", "refusal", "truncated", "language"))), F.col("defect"))
    return own.unionByName(cut).unionByName(other).groupBy("id").agg(F.min_by("defect", rank).alias("defect"))
