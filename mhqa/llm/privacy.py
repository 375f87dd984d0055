"""Personal information in free text, found by anchor expansion and replaced by typed placeholders (problem 9).

One pass of an Aho-Corasick automaton finds anchors: at-signs, identifier and telephone cues, street words, and the phrases after which people
give names. Around each anchor a deterministic local parser expands to the boundaries and validates what it found; no other part of a text is
looked at twice.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

# -- fixed values: anchors ---------------------------------------------------------------------------------------------
AT = ("@", "＠", "(at)", "[at]", "{at}", "<at>", " AT ", " at ", "(AT)", "[AT]", "\nAT ", " AT\n")
#: Cues before numbers on official papers.
ID_CUES = (
    "passport", "Passport", "PASSPORT", "SSN", "ocial security n", "ocial Security N", "nsurance number", "nsurance no", "Insurance No", "National ID", "national ID", "identity card", "Identity card", "ID card",
    "ID no", "ID number", "driving licence", "Driving licence", "driver's license", "tax number", "Tax ID", "taxpayer", "Rentenversicherungsnummer", "Sozialversicherungsnummer",
    "Personalausweis", "Reisepass", "Ausweis", "Steuer-ID", "Steueridentifikationsnummer", "écurité sociale", "asseport", "arte d'identité", "DNI", "NIE", "NIF", "asaporte", "PESEL", "owód osobisty",
    "owodu osobistego", "aszport", "Паспорт", "паспорт", "СНИЛС", "ИНН", "身份证", "身分証", "护照", "旅券", "パスポート", "マイナンバー", "社会保障号", "کد ملی", "شمارهٔ ملی", "شماره ملی", "گذرنامه",
    "رقم الهوية", "رقم جواز", "جواز السفر", "الرقم القومي", "पासपोर्ट", "आधार", "CPF", "NIF", "Bilhete de Identidade", "artão de cidadão", "odice fiscale", "arta d'identità", "BSN", "urgerservicenummer",
    "TC Kimlik", "T.C. Kimlik", "imlik no", "personnummer",
)
PHONE_CUES = (
    "Tel", "tel", "TEL", "hone", "HONE", "all me", "Call", "call ", "ring ", "Ring ", "reached at", " or ", "obile", "Mobil", "Fax", "Handy", "unter ", "Joindre", " au ", "llamarme", "llámame", "eléfono", "eléfone", "ontact", "ontakt", "ontacto",
    "тел", "Тел", "Звон", "звон", "电话", "電話", "手机", "手機", "携帯", "تلفن", "هاتف", "موبایل", "जवाल", "फ़ोन", "फोन", "दूरभाष", " / ", "tél", "Tél", "telefon", "elefoon", "Telefono", "komórka",
)
#: Phrases after which a person's name stands.
NAME_CUES = (
    "reported by", "Reported by", "Translator:", "translator:", "Translated by", "translated by", "Annotated by", "annotated by", "Annotator:", "Reviewed by", "reviewed by", "Reviewer:", "Checked by", "checked by", "Proofread by",
    "My name is", "my name is", "I am called", "ring ", "Ring ", "holder ", "Holder ", "holder: ", "From:", "To:", "Cc:", "Signed", "regards,", "Regards,", "regards\n", "Regards\n", "Sincerely,", "sincerely,", "Best wishes,", "Yours,", "Cheers,", "Many thanks,", "Thanks,",
    "Rückfragen bitte an", "Rückfragen an", "Übersetzt von", "übersetzt von", "Geprüft von", "geprüft von", "Annotiert von", "Korrektur:", "Ich heiße", "Mein Name ist", "Grüßen", "Gruß", "Grüße",
    "Joindre", "Relu par", "relu par", "Traduit par", "traduit par", "Annoté par", "Je m'appelle", "Je m’appelle", "je m'appelle", "Cordialement", "Bien à vous", "Salutations", "Me llamo", "me llamo", "Mi nombre es", "Anotado por", "anotado por",
    "Traducido por", "Revisado por", "Un saludo", "Saludos", "Atentamente", "Kontakt:", "kontakt:", "Pozdrawiam", "poważaniem", "Tłumaczył", "Tłumaczenie:", "Sprawdził", "Sprawdziła", "Nazywam się", "Przełożył", "Przełożyła",
    "Проверил перевод:", "Проверила перевод:", "Перевёл", "Перевела", "Перевод:", "Меня зовут", "уважением", "Переводчик:", "Рецензент:", "Разметил", "Контакт:", "Контактное лицо:", "Звоните", "联系人", "聯絡人", "译者", "譯者", "翻译：", "审校", "标注员", "标注：", "我叫", "我是",
    "此致", "敬上", "翻訳者", "校閲", "担当", "連絡先", "私の名前は", "敬具", "با احترام", "نام من", "مترجم:", "ویراستار", "بازبین", "تماس با", "اسمي", "المترجم:", "راجعه", "مع التحية", "مع تحيات", "ترجمه از", "ترجمهٔ",
    "मेरा नाम", "अनुवादक:", "सादर", "Chamo-me", "O meu nome é", "Traduzido por", "Revisto por", "Revisado por", "Atenciosamente", "Cumprimentos", "Mi chiamo", "Tradotto da", "Rivisto da", "Distinti saluti", "Cordiali saluti", "Saluti,", "Mijn naam is", "Vertaald door",
    "Nagekeken door", "groet,", "groeten,", "Benim adım", "Adım ", "Çeviren:", "Kontrol eden:", "Saygılarımla", "Selamlar",
)
#: Roles that, at the beginning of a line, announce a person who takes part, if the name fills the line or a bracket, comma or full stop follows.
LINE_CUES = (
    "Written by", "Prepared by", "Edited by", "Submitted by", "Approved by", "Author:", "Editor:", "Interpreter:", "Contributor:", "Moderator:", "Curator:", "Proofreader:", "Contact:", "Sender:", "Name:", "Best,", "Warmly,", "All the best,", "Verfasst von", "Autor:", "Autorin:",
    "Redaktion:", "Redakteur:", "Redakteurin:", "Name:", "Rédigé par", "Auteur :", "Auteure :", "Rédacteur :", "Nom :", "Redactado por", "Autora:", "Nombre:", "Escrito por", "Scritto da", "Autore:", "Geschreven door", "Auteur:", "Redacteur:", "Napisał", "Redaktor:", "Redaktorka:",
    "Автор:", "Редактор:", "Имя:", "Написал", "Написала", "Yazan:", "Editör:", "作者：", "编辑：", "姓名：", "編集者：", "著者：", "氏名：", "نویسنده:", "الكاتب:", "المحرر:", "लेखक:", "संपादक:",
)
#: What speakers say before their own name.
SELF_CUES = ("I'm ", "I’m ", "I am ", "Ich bin ", "Je suis ", "Soy ", "Sono ", "Eu sou ", "Ik ben ", "Jestem ", "Jag är ", "Ben ")
#: Cues before account numbers.
ACCOUNT_CUES = ("IBAN", "iban", "card", "Card", "Karte", "karte", "carte", "Carte", "tarjeta", "cartão", "carta di", "kaart", "karty", "карт", "account", "Account", "Konto", "konto", "compte", "cuenta", "conto", "rekening")
TITLES = (
    "Dr.", "Dr ", "Mr.", "Mr ", "Ms.", "Ms ", "Mrs.", "Mrs ", "Miss ", "Prof.", "Professor ", "Sir ", "Frau ", "Herr ", "Herrn ", "Mme ", "Mme. ", "Madame ", "Mlle ", "M. ", "Monsieur ", "Sr.", "Sra.", "Srta.", "Don ", "Doña ", "Pan ", "Pani ", "г-жа ", "г-н ", "госпожа ",
    "господин ", "Señor ", "Señora ", "Sig.", "Sig.ra ", "Dott.", "Dra.", "Dhr.", "Mevr.", "Sayın ", "آقای ", "خانم ", "السيد ", "السيدة ", "श्री ", "श्रीमती ",
)
#: Titles that alone, without a phrase, announce a person who takes part.
SURE_TITLES = ("Dr. ", "Mr. ", "Ms. ", "Mrs. ", "Prof. ", "Frau ", "Herr ", "Mme ", "Mlle ", "Pani ", "г-жа ", "г-н ")
STREETS = {
    "en": "Street Road Lane Drive Avenue Close Terrace Court Square Crescent Way Place Boulevard Parade Grove Row Hill Gardens Walk Mews St. Rd. Ave. Ln. Dr. Blvd.",
    "de": "straße strasse str. Straße gasse Gasse allee Allee weg Weg platz Platz hof ufer Ufer damm Damm ring steig pfad markt",
    "fr": "rue boulevard impasse avenue allée place chemin quai cours passage square route Rue Boulevard Impasse Avenue Allée",
    "es": "Calle C/ Plaza Avenida Avda. Paseo Camino Ronda Travesía Carrera calle plaza",
    "pt": "Rua Av. Avenida Travessa Largo Praça Estrada",
    "it": "Via Viale Piazza Corso Vicolo Largo",
    "nl": "straat laan weg plein gracht kade singel dijk",
    "pl": "ul. al. os. pl. Ul. Al. Os.",
    "tr": "Sokak Sok. Sk. Cadde Caddesi Cad. Bulvarı Mahallesi Mah.",
    "ru": "ул. пер. просп. пр-т пр. бул. наб. пл. ш. улица переулок проспект бульвар набережная площадь шоссе",
    "zh": "号",
    "ja": "丁目 番地",
    "fa": "خیابان کوچه بلوار میدان بزرگراه",
    "ar": "شارع حي طريق",
    "hi": "मार्ग सड़क गली",
}
# ----------------------------------------------------------------------------------------------------------------------

#: The last one, bank accounts and cards, is only for redaction.
KINDS = ("name", "email", "phone", "id", "address", "account")
_D = "0-9０-９۰-۹٠-٩०-९"
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĶĹĻĽŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽȘȚЀ-ЯΑ-Ω", "a-zß-öø-ÿĀ-ɏЀ-ӿά-ώ"
_S = r"[^\S\r\n]*(?:\r?\n)?[^\S\r\n]*"  # spaces with at most one line break
_SP = r"(?:[^\S\r\n]+(?:\r?\n)?[^\S\r\n]*|\r?\n[^\S\r\n]*)"

# E-mail addresses.
_LOCAL = re.compile(r"[A-Za-z0-9._%+\-]{1,64}$")
_DOT = r"(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)"
_DOMAIN = re.compile(rf"[^\S\r\n]?([A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?){{1,6}})")

# Telephone numbers and identity numbers.
_NUMBER = re.compile(rf"(?<![A-Za-z_{_D}.,/\-–+(＋])(?<![{_D}]:)(?:\(?[+＋])?\(?[{_D}](?:[{_D}]|[   ().\-/‑]{{1,2}}(?=[{_D}(])|\)[ -]?(?=[{_D}])){{5,24}}(?:\s?(?:ext\.?|x|доб\.|Durchwahl)\s?[{_D}]{{1,5}})?(?![\w@])")
_PHONE_FORM = re.compile(
    rf"^(?:\(?[+＋][{_D}]|00[{_D}]{{1,3}}[ \-.(/]|001-|\(0[{_D}]*\)|\([{_D}]{{2,5}}\) ?[{_D}]|0[{_D}]{{1,4}}[ /.\-][{_D}]|[{_D}]{{3}}[\-. ][{_D}]{{3}}[\-. ][{_D}]{{3,4}}$|8 ?\([{_D}]{{3}}\)|8[ \-][{_D}]{{3}}[ \-])"
)
_NOT_PHONE = re.compile(r"(?i)(?:isbn|issn|doi|offset|length|scores?|run|build|pages?|catalogue no\.?|shelf|ratio|total|n =|checksum|record|shard|version|seite|no\.|nr\.?|№|§|temperature|https?:\S*|-|–)\s*[:=#]?\s*$")
_DATE = re.compile(rf"^(?:[{_D}]{{4}}-[{_D}]{{2}}-[{_D}]{{2}}|[{_D}]{{1,2}}[./][{_D}]{{1,2}}[./][{_D}]{{2,4}})$")
_ID_VALUE = re.compile(rf"[^\n\r]{{0,24}}?(?:[:：#№]|(?<=\s)|(?<=是)|号码?|번호)\s*((?=[A-Z{_D}])(?=[A-Z ]{{0,4}}[{_D}])(?:[A-Z]{{1,3}} ?)?[{_D}](?:[{_D}A-Z]|[ .\-/ ](?=[{_D}A-Z])){{4,26}})(?![\w])", re.S)
_ID_WORDS = re.compile(r"[\s\w.\-'’()]*[:：]?\s*$")

# Names.
_FIRST = rf"[{_UP}][{_LOW}'’]+(?:[-‐][{_UP}][{_LOW}'’]+)?"
_LAST_CAPS = rf"[{_UP}][{_UP}'’]{{2,}}(?:[-‐][{_UP}][{_UP}'’]+)*"
_LATIN_NAME = re.compile(
    rf"{_LAST_CAPS},{_SP}(?:{_FIRST}|[{_UP}]\.)(?:{_SP}[{_UP}]\.)?|(?:{_FIRST}|[{_UP}]\.)(?:{_SP}[{_UP}]\.)*(?:{_SP}(?:van|von|de|da|di|del|der|den|la|le))*{_SP}{_FIRST}(?:{_SP}{_FIRST}){{0,1}}|{_FIRST}{_SP}{_LAST_CAPS}"
)
_HAN_NAME = re.compile("[㐀-鿿]{2,4}(?![㐀-鿿])")
_ARABIC_NAME = re.compile("[؀-ۿ‌]{2,}(?: [؀-ۿ‌]{2,}){1,2}")
_DEVANAGARI_NAME = re.compile("[ऀ-ॿ]{2,}(?: [ऀ-ॿ]{2,}){1,2}")
_LEAD = re.compile(rf"[\s:：,，،.!]*")
_TITLE = re.compile("|".join(sorted((re.escape(t.strip()) + r"\s+" for t in TITLES), key=len, reverse=True)) + "|先生|女士")

# Addresses.
_POSTAL = rf"(?:,?{_SP}(?:[A-Z]{{1,2}}[{_D}]?[{_D}A-Z]? ?)?[{_D}]{{4,6}})?"
_CAP = rf"[{_UP}][{_LOW}'’\-]+"
_ADDRESS = {
    "en": re.compile(rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|House) [{_D}]+[A-Za-z]?,{_SP})?[{_D}]{{1,5}}[A-Za-z]?{_SP}(?:{_CAP}{_SP}){{1,4}}(?:{'|'.join(map(re.escape, STREETS['en'].split()))})(?![{_LOW}])(?:,{_SP}(?:Apt|Flat|Unit|Suite)\.? [{_D}]+[A-Za-z]?)?(?:,?{_SP}{_CAP})?(?:,?{_SP}[A-Z]{{2}}[{_D}]? ?[{_D}][{_D}A-Z]{{2,4}})?"),
    "de": re.compile(rf"(?:(?:Am|An der|An dem|Auf der|Auf dem|Im|In der|Zum|Zur|Alter|Alte|Altes|Neuer|Neue|Unter den|Hinter der|Obere|Untere|Großer|Große|Kleine|Kleiner){_SP})?(?:[{_UP}][{_LOW}\-]*{_SP})?[{_UP}][{_LOW}\-]*(?:straße|strasse|str\.|gasse|allee|weg|platz|hof|ufer|damm|ring|steig|pfad|markt|graben|berg|Straße|Allee|Weg|Platz|Gasse)?{_SP}[{_D}]{{1,4}} ?[a-z]?,{_SP}[{_D}]{{5}}{_SP}{_CAP}"),
    "fr": re.compile(rf"[{_D}]{{1,4}}(?:{_SP}(?:bis|ter|quater))?,?{_SP}(?i:rue|boulevard|impasse|avenue|allée|place|chemin|quai|cours|passage|square|route){_SP}(?:d[eu]s?{_SP}|de la{_SP}|de l'|d'|du{_SP})?{_CAP}(?:{_SP}{_CAP}){{0,2}}(?:,?{_SP}[{_D}]{{5}}{_SP}{_CAP})?"),
    "es": re.compile(rf"(?:Calle|C/|Plaza|Avenida|Avda\.|Paseo|Camino|Ronda|Travesía|Carrera){_SP}(?:de(?:l| la| los| las)?{_SP})?{_CAP}(?:{_SP}(?:de(?:l| la| los| las)?{_SP})?{_CAP}){{0,3}},?{_SP}[{_D}]{{1,4}}[^\n\r.;]{{0,12}}(?:\.º[^\n\r.;]{{0,6}})?{_POSTAL}(?:{_SP}{_CAP})?"),
    "pt": re.compile(rf"(?:Rua|Av\.|Avenida|Travessa|Largo|Praça|Estrada){_SP}(?:d[aeo]s?{_SP})?{_CAP}(?:{_SP}(?:d[aeo]s?{_SP})?{_CAP}){{0,3}},?{_SP}(?:n\.?º? ?)?[{_D}]{{1,4}}"),
    "it": re.compile(rf"(?:Via|Viale|Piazza|Corso|Vicolo|Largo){_SP}(?:de(?:l|lla|i|gli|lle)?{_SP}|dell')?{_CAP}(?:{_SP}(?:de(?:l|lla|i|gli|lle)?{_SP}|dell')?{_CAP}){{0,3}},?{_SP}[{_D}]{{1,4}}"),
    "nl": re.compile(rf"[{_UP}][{_LOW}\-]*(?:straat|laan|weg|plein|gracht|kade|singel|dijk){_SP}[{_D}]{{1,4}} ?[a-z]?,?{_SP}[{_D}]{{4}} ?[A-Z]{{2}}"),
    "pl": re.compile(rf"(?i:ul|al|os|pl)\.{_SP}{_CAP}(?:{_SP}{_CAP}){{0,3}}{_SP}[{_D}]{{1,4}}[a-zA-Z]?(?:[/ ]?(?:m\. ?)?[{_D}]{{1,4}})?(?:,{_SP}[{_D}]{{2}}-[{_D}]{{3}}{_SP}{_CAP})?"),
    "tr": re.compile(rf"{_CAP}(?:{_SP}{_CAP}){{0,3}}{_SP}(?:Sokak|Sokağı|Sok\.|Sk\.|Cadde|Caddesi|Cad\.|Bulvarı|Mahallesi|Mah\.),?{_SP}(?:No: ?)?[{_D}]{{1,4}}"),
    "ru": re.compile(rf"(?:(?:ул|пер|просп|пр|пр-т|бул|наб|пл|ш)\.?{_SP}{_CAP}(?:{_SP}{_CAP}){{0,2}}|(?:улица|переулок|проспект|бульвар|набережная|площадь|шоссе){_SP}{_CAP}(?:{_SP}{_CAP}){{0,2}}|{_CAP}(?:{_SP}{_CAP})?{_SP}(?:улица|переулок|проспект|бульвар|набережная|площадь|шоссе)),{_SP}(?:д\.|дом){_S}[{_D}]{{1,4}}[а-я]?(?:,{_SP}(?:кв\.|корп\.|квартира){_S}[{_D}]{{1,4}})*(?:,{_SP}{_CAP})?"),
    "zh": re.compile(rf"(?:(?![是址在于住为到至寄])[㐀-鿿]){{2,8}}?(?:街|巷|路|道|弄|里|胡同)[{_D}]{{1,5}}号(?:[{_D}]{{1,3}}单元)?(?:[{_D}]{{1,5}}(?:室|房))?"),
    "ja": re.compile(rf"(?:〒?[{_D}]{{3}}-[{_D}]{{4}}{_S})?[㐀-鿿]{{2,12}}[{_D}]{{1,3}}(?:丁目[{_D}]{{1,3}}番地?(?:[{_D}]{{1,3}}号)?|番地(?:[{_D}]{{1,3}}号)?)"),
    "fa": re.compile(rf"(?:خیابان|کوچه|کوچهٔ|بلوار|میدان|بزرگراه) [؀-ۿ‌ ]{{2,40}}?، ?(?:پلاک|شماره|کوچه[^،]{{0,20}}، پلاک) ?[{_D}]{{1,4}}(?:، ?واحد ?[{_D}]{{1,4}})?"),
    "ar": re.compile(rf"(?:شارع|طريق|حي) [؀-ۿ ]{{2,40}}?[،,] ?(?:رقم|مبنى|منزل|شقة) ?[{_D}]{{1,4}}|[{_D}]{{1,4}} شارع [؀-ۿ ]{{2,30}}"),
    "hi": re.compile(rf"(?:मकान (?:संख्या|नंबर|नं\.?) ?)[{_D}]{{1,4}},? ?[ऀ-ॿ ]{{2,40}}?(?:मार्ग|सड़क|गली)"),
}
_BEFORE = {"en": 70, "de": 40, "fr": 40, "es": 4, "pt": 4, "it": 4, "nl": 30, "pl": 2, "tr": 50, "ru": 40, "zh": 26, "ja": 26, "fa": 2, "ar": 12, "hi": 50}


@cache
def automaton():  # noqa: ANN201
    """The anchors of all parsers; each leads to what they announce."""
    import ahocorasick

    by: dict[str, list[tuple[str, str]]] = {}
    for what, words in (("email", AT), ("id", ID_CUES), ("phone", PHONE_CUES), ("name", NAME_CUES), ("line", LINE_CUES), ("self", SELF_CUES), ("account", ACCOUNT_CUES), ("title", SURE_TITLES)):
        for w in words:
            by.setdefault(w, []).append((what, ""))
    for language, words in STREETS.items():
        for w in words.split():
            by.setdefault(w, []).append(("address", language))
    for w in ("Am ", "An der ", "Auf der ", "Alter ", "Alte ", "Im "):  # streets without a street word
        by.setdefault(w, []).append(("address", "de"))
    for w in ("+", "(0", "00", "8(", "8 ("):
        by.setdefault(w, []).append(("phone", "number"))
    found = ahocorasick.Automaton()
    for w, entries in by.items():
        found.add_word(w, (len(w), tuple(entries)))
    found.make_automaton()
    return found


def _email(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The address around an at-sign at [start, end)."""
    left = start
    while left and text[left - 1] in "  " and start - left < 1:
        left -= 1
    local = _LOCAL.search(text, max(0, left - 64), left)
    if not local:
        return None
    begin = local.start()
    while begin < left and text[begin] in ".-%":
        begin += 1
    right = _DOMAIN.match(text, end)
    if not right or begin == left or text[left - 1] == ".":
        return None
    labels = re.split(_DOT, right.group(1))
    if len(labels) < 2 or not (labels[-1].isalpha() and len(labels[-1]) >= 2):
        return None
    worded = text[start:end].strip() in ("AT", "at")
    if worded and not (re.search(r"(?i)\bdot\b", right.group(1)) or text[start:end].strip() == "AT"):
        return None
    return begin, right.end()


def _digits(value: str) -> int:
    return sum(c.isdigit() for c in value)


_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])")


def iban_valid(value: str) -> bool:
    """Whether an international account number has its right length at least and check digits (remainder 1 by 97)."""
    bare = value.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def luhn_valid(value: str) -> bool:
    """Whether the digits of a card number add up (each second one from the end doubled)."""
    digits = [int(c) for c in reversed(value) if c.isdigit()]
    return len(digits) >= 12 and len(set(digits)) > 1 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The account or card number that stands within a line's reach of ``at`` and whose check digits are right."""
    for pattern, valid in ((_IBAN, iban_valid), (_CARD, luhn_valid)):
        for m in pattern.finditer(text, max(0, at - 4), min(len(text), at + 90)):
            end = m.end()
            while end > m.start() + 12 and not valid(text[m.start() : end]):  # the next word may look like a part
                end = text.rfind(" ", m.start(), end)
            if end > m.start() + 12:
                return m.start(), end
    return None


_LINE_END = re.compile(r"[^\S\r\n]*(?:$|[\r\n(\[,;.<|—–-])")


def _names(text: str, at: int, cue: str) -> tuple[int, int] | None:
    at = _LEAD.match(text, at).end()
    while title := _TITLE.match(text, at):
        at = title.end()
    for pattern in (_LATIN_NAME, _HAN_NAME, _ARABIC_NAME, _DEVANAGARI_NAME):
        if found := pattern.match(text, at):
            if pattern is _ARABIC_NAME and not any("؀" <= c <= "ۿ" for c in cue) or pattern is _HAN_NAME and not any("㐀" <= c <= "鿿" for c in cue):
                return None
            return found.span()
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of each piece of personal information, in order, without overlaps. Positions count code points."""
    found: dict[tuple[str, int], int] = {}
    blocked: list[tuple[int, int]] = []
    phones, streets = [], set()
    for last, (length, entries) in automaton().iter(text):
        start, end = last - length + 1, last + 1
        for what, extra in entries:
            if what == "email":
                if span := _email(text, start, end):
                    found["email", span[0]] = span[1]
            elif what == "id":
                if start and text[start - 1].isalnum() and length <= 4:
                    continue
                value = _ID_VALUE.match(text, end)
                if value and _digits(value.group(1)) >= 6 and _ID_WORDS.match(text[end : value.start(1)]):
                    found["id", value.start(1)] = value.end(1)
                    blocked.append(value.span(1))
            elif what == "phone":
                phones.append((start, end, extra))
            elif what == "account":
                if span := _account(text, start if text[start:end].upper() == "IBAN" else end):
                    found["account", span[0]] = span[1]
                    blocked.append(span)
            elif what == "line":
                begin = max(text.rfind("\n", 0, start), text.rfind(">", max(0, start - 2), start)) + 1
                span = _names(text, end, text[start:end]) if not text[begin:start].strip(" \t*-•#>_") else None
                if span and _LINE_END.match(text, span[1]):
                    found["name", span[0]] = span[1]
            elif what == "self":
                m = None if start and text[start - 1].isalnum() else _LATIN_NAME.match(text, end)
                if m and not _TITLE.match(text, end):
                    found["name", m.start()] = m.end()
            elif what in ("name", "title"):
                if start and text[start - 1].isalnum() and text[start].isascii() and text[start].isalpha():
                    continue  # within a word
                if span := _names(text, end if what == "name" else start, text[start:end]):
                    found["name", span[0]] = span[1]
            else:
                streets.add((start, end, extra))
    for start, end, language in streets:
        begin = max(0, start - _BEFORE[language])
        for m in _ADDRESS[language].finditer(text, begin, min(len(text), end + 120)):
            if m.start() <= start and m.end() >= end - 1 or m.start() <= start < m.end():
                m = _ADDRESS[language].match(text, m.start()) or m
                if not (m.start() and text[m.start() - 1].isalnum() and text[m.start()].isalnum() and text[m.start()].isascii()):
                    found["address", m.start()] = max(m.end(), found.get(("address", m.start()), 0))
                    blocked.append(m.span())
                break
    if phones:
        tried: set[int] = set()
        for start, end, extra in phones:
            for m in _NUMBER.finditer(text, max(0, start - 1) if extra else start, min(len(text), end + (30 if extra else 70))):
                if m.start() in tried:
                    continue
                m = _NUMBER.match(text, m.start()) or m  # to its end, which may lie beyond the window
                value, n = m.group(), _digits(re.sub(r"(?:ext|x|доб|Durchwahl).*", "", m.group()))
                if not 7 <= n <= 15 or _DATE.match(value) or _NOT_PHONE.search(text, max(0, m.start() - 24), m.start()):
                    continue
                between = text[end : m.start()]
                near = not extra and len(between) <= 40 and "\n\n" not in between and re.fullmatch(r"[^\d]*", between)
                strong = _PHONE_FORM.match(value)
                cue = text[start:end]
                if strong and (extra or near) or near and cue not in (" or ", " au ", " / ", "unter ") and len(between.strip(" .:：()")) <= 12:
                    found["phone", m.start()] = m.start() + len(value.rstrip(" \t\u00a0().-/"))
                    tried.add(m.start())
    out: list[tuple[str, int, int]] = []
    for (kind, begin), end in sorted(found.items(), key=lambda x: (x[0][1], -x[1])):
        if kind in ("phone", "id") and any(a <= begin < b for a, b in blocked if kind == "phone" or ("account", a) in found):
            continue
        if out and begin < out[-1][2] and kind != "email":
            continue
        out.append((kind, begin, end))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in square brackets."""
    parts, at = [], 0
    for kind, begin, end in spans:
        if begin >= at:
            parts += [text[at:begin], f"[{kind.upper()}]"]
            at = end
    return "".join([*parts, text[at:]])


def occurrences(df: DataFrame, key: str, text: str, *, wanted: Collection[str] = KINDS[:5]) -> DataFrame:
    """(key, kind, begin_at, length): one row for each piece of personal information of the kinds ``wanted``. Null and empty texts give none; other columns are not read."""
    kind = dict(df.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *span) for k, t in zip(batch[0].to_pylist(), batch[1].to_pylist()) if t for span in find(t) if span[0] in wanted]
            keys, kinds, begins, ends = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch[0].type), pa.array(kinds, pa.string()), pa.array(begins, pa.int64()), pa.array([e - b for b, e in zip(begins, ends)], pa.int64())], names=[key, "kind", "begin_at", "length"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string, begin_at long, length long")


def redacted(df: DataFrame, text: str, *, into: str = "redacted") -> DataFrame:
    """``df`` with ``text`` in which personal information is replaced by typed placeholders, in the column ``into``; null stays null."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        encoded = values.dictionary_encode()
        return pa.array([redact(t, find(t)) for t in encoded.dictionary.to_pylist()], pa.string()).take(encoded.indices)

    return df.withColumn(into, run(F.col(text)))
