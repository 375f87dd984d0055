import re

import pytest

from mhqa.llm import leakage as L
from mhqa.llm import privacy as P

ITEMS = [(1, "Who founded the Zorn Museum, whose seat is in Vülgrad?", "The Zorn Museum was founded in 1907 by Rámis Kerr and has its seat in Vülgrad. After the death of Ann Moss, the letters were given to the Zorn Museum, where Rámis Kerr put them in order."), (2, None, None), (3, "", "Short."), (4, "在1953年创立Hagox的人是什么职业？", "Charus与Klask一起在Nérd附近创办了一所小学校，该校于1961年停办。")]
TEXTS = {
    1: "x " * 30 + "Who founded the Zorn Museum, whose seat is in Vülgrad? yes", 2: "<b>the zorn&nbsp;museum</b> WAS founded in 1907\nby Ramis Kerr and\thas its seat in Vülgrad!", 3: "The Blix Museum was founded in 1907 by Tom Berg and has its seat in Goa.", 4: "Rámis Kerr likes Vülgrad and the Zorn Museum.",
    5: "After the deth of Ann Moss, the old letters were given to Zorn Museum, where R\\u00e1mis Kerr put them in order.", 6: None, 7: "", 8: "前文。Charus与Klask一起在Nérd附近创办了一所小学校，该校于1961年停办。后文", 9: "in order. " * 400,
}


def test_leaks(spark):
    docs = spark.createDataFrame([*TEXTS.items(), (1, TEXTS[1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, question string, passage string")
    assert {(r.doc_id, r.item_id) for r in L.leaked(docs, items).collect()} == {(1, 1), (2, 1), (5, 1), (8, 4)}
    assert L.leaked(docs.limit(0), items).count() == 0 and L.leaked(docs, items.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in L.leaked(docs, items, max_bytes=400).collect()} == {(1, 1), (2, 1), (5, 1), (8, 4)}  # in two parts


def test_tiles():
    a, b = "a b c d e f".split(), "d e f x a b c".split()
    assert sorted(L.tile(a, b)) == [(0, 4, 3), (3, 0, 3)] and L.tile([], b) == [] and L.tile(["a"], ["a"]) == []
    marks = [n for _, _, n in L.tile("a b c d".split() * 5, "c d a b".split() * 5)]
    assert sum(marks) <= 20


def test_near():
    assert L.near("museum", "musuem") and L.near("institute", "instittue") and not L.near("abc", "abd") and not L.near("1907", "1908") and not L.near("museum", "library")


CASES = [
    ("reported by Maeve O. Tarn-Vell; reply-to: maeve+qa1@example.org", {("name", "Maeve O. Tarn-Vell"), ("email", "maeve+qa1@example.org")}),
    ("From: BROKLING, Leonie <m_c (at) example.com>", {("name", "BROKLING, Leonie"), ("email", "m_c (at) example.com")}),
    ("mail a.b AT post DOT wren DOT test now", {("email", "a.b AT post DOT wren DOT test")}), ("see tfer @ larkmail.example.", {("email", "tfer @ larkmail.example")}), ("x: q＠mail.ondina.invalid", {("email", "q＠mail.ondina.invalid")}),
    ("Use the @context field, not user@.", set()), ("Tel. 202-555-0108 (evenings only)", {("phone", "202-555-0108")}), ("Call me back at +1 (202) 555-0105, please.", {("phone", "+1 (202) 555-0105")}), ("ring Priya Vell on (01632) 960661.", {("name", "Priya Vell"), ("phone", "(01632) 960661")}),
    ("联系人：诸葛子墨，电话10026316110。", {("name", "诸葛子墨"), ("phone", "10026316110")}), ("تلفن تماس: ۰۰۰-۰۸۷۷۶۸۲۱", {("phone", "۰۰۰-۰۸۷۷۶۸۲۱")}), ("Contacto: tel. (+34) 512248247", {("phone", "(+34) 512248247")}),
    ("SSN on file: QQ 77 95 13 C", {("id", "QQ 77 95 13 C")}), ("passport no. 953-46-0270, holder Maeve Vell", {("id", "953-46-0270"), ("name", "Maeve Vell")}), ("身份证号：00000088965719111X", {("id", "00000088965719111X")}), ("Паспорт 000-383-068 80", {("id", "000-383-068 80")}),
    ("send it to Flat 23, 132 Copperbeck Road, Goa", {("address", "Flat 23, 132 Copperbeck Road, Goa")}), ("Мой адрес: ул. Мельничная, д. 211, кв. 72, Тиндфорд", {("address", "ул. Мельничная, д. 211, кв. 72, Тиндфорд")}), ("我的地址是柳荫巷118号3单元368室。", {("address", "柳荫巷118号3单元368室")}),
    ("Mój adres to ul. Garbarska 235/38, 00-191 Goa.", {("address", "ul. Garbarska 235/38, 00-191 Goa")}), ("The mill on Bridge Street has 26 rooms.", set()), ("See ISBN 000-0-00-0223-3234 and ISSN 7996-0214, offset 823882381706, length 12", set()),
    ("scores 91-87-24; run 2026-08-27 at 10:27; pages 5657-6897 are missing; doi 10.00000/cef5f3ad0c91.8695", set()), ("Relu par Mme Hélène Vell.", {("name", "Hélène Vell")}), ("Tom Berg founded the school with Ann Moss.", set()), ("", set()), ("The Wandering Signal", set()),
]


@pytest.mark.parametrize(("text", "found"), CASES)
def test_find(text, found):
    assert {(k, text[b:e]) for k, b, e in P.find(text)} == found


def test_redact():
    text = "reported by Maeve Vell; reply-to: m@example.org"
    assert P.redact(text, P.find(text)) == "reported by [NAME]; reply-to: [EMAIL]"


def test_occurrences(spark):
    rows = spark.createDataFrame([(1, "😀 Tel. 202-555-0108", "n"), (2, None, "n"), (3, "", "n"), (1, "😀 Tel. 202-555-0108", "n")], "doc_id long, text string, kind string")
    assert {(r.doc_id, r.kind, r.begin_at) for r in P.occurrences(rows, "doc_id", "text").collect()} == {(1, "phone", 7)}
    assert [r.redacted for r in P.redacted(rows.where("doc_id = 2"), "text").collect()] == [None] and P.occurrences(rows.limit(0), "doc_id", "text").count() == 0


def test_long_text():
    text = ("word " * 20_000) + "mailto:a@example.org " + "7" * 5000 + "@" * 3000
    assert [(k, text[b:e]) for k, b, e in P.find(text)] == [("email", "a@example.org")]
    assert re.sub(r"\S", "", P.redact(text, P.find(text))).isspace()


def test_widely_leaked(spark):
    question = "Who founded the Zorn Museum, whose seat is in Vülgrad?"
    docs = spark.createDataFrame([(k, question if k < 40 else f"word{k} of another text") for k in range(100)], "doc_id long, text string")
    items = spark.createDataFrame([(1, question, None)], "item_id long, question string, passage string")
    assert {r.doc_id for r in L.leaked(docs, items).collect()} == set(range(40))


@pytest.mark.parametrize("text", ["At the centre of the scarlet estuary stands a young soldier, and the plot ends in Yurdhaven", "the old mill by the river was closed for many years before it was opened again"])
def test_few_seeds(text):
    assert L.leaks(L.document_tokens(f"Before it. {text}. After it."), L.Reference([(1, None, text + ".")])).keys() == {1}


def test_shared_short_and_reordered_units():
    question = "Which town on the river Lila is the birthplace of the glass blower Tom Zorn of Bergwick?"
    items = [(k, question, f"He died. In {1800 + k} the founder Kim{k} Varn of Orntal moved to Sels{k} and there taught the piano for many quiet years.") for k in range(1000)]
    r = L.Reference(items)
    assert L.leaks(L.tokens(f"Note: {question} (copied)"), r).keys() == set(range(1000))
    assert L.leaks(L.tokens("Then it says: He died. The end."), r).keys() == set(range(1000)) and not L.leaks(L.tokens("He lived and died."), r)
    text = L.tokens(items[7][2].split(". ")[1])
    far = L.tokens("nothing of the kind stands here in between these words and it goes on for a while until the other half comes up at last in the end of it all")
    assert 7 in L.leaks(text[len(text) // 2 :] + far + text[: len(text) // 2], r)


def test_rolling_hashes_find_the_tiles():
    left, right = "a b c d e f g h i j".split(), "x f g h i j y a b c z".split()
    assert L.tile(left, right) == [(5, 1, 5), (0, 7, 3)] and L.tile([], right) == [] and L.tile(left, []) == []


def test_names_and_accounts_by_structure():
    named = lambda t: [t[b:e] for k, b, e in P.find(t) if k == "name"]
    for t in ("Written by Anna Kowalska", "Editor: Anna Kowalska", "Best, Anna Kowalska", "I'm Anna Kowalska", "- Autor: Anna Kowalska\nmore"):
        assert named(t) == ["Anna Kowalska"], t
    assert named("The novel was Written by Anna Kowalska in Rome") == [] and named("I am Legend") == []
    account = lambda t: [t[b:e] for k, b, e in P.find(t) if k == "account"]
    assert account("IBAN DE89370400440532013000") == ["DE89370400440532013000"] and account("IBAN DE88370400440532013000") == []
    assert account("my card 4111 1111 1111 1111 here") == ["4111 1111 1111 1111"] and account("card 4111 1111 1111 1112") == []
