import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mhqa.llm import textforms as T


@pytest.mark.parametrize(
    ("text", "form", "kinds"),
    [
        ("plain text", "plain text", 0), ("", "", 0), ("a\u00a0b", "a b", T.SPACE), ("a\tb", "a b", T.SPACE), ("zero​width", "zerowidth", T.IGNORABLE), ("ｆｕｌｌ１", "full1", T.WIDTH), ("ﬁrst", "first", T.WIDTH),
        ("café", "café", T.COMPOSITION), ("Вrültthókеzzа", "Brültthókezza", T.SCRIPT), ("вдoль", "вдоль", T.SCRIPT), ("rοughly", "roughly", T.SCRIPT), ("tеníа", "tenía", T.SCRIPT),
        ("город Kakos Society", "город Kakos Society", 0), ("北京，大学", "北京，大学", 0), ("می‌کرد", "می‌کرد", 0), ("no‌joiner", "nojoiner", T.IGNORABLE), ("« L’été »", "« L’été »", 0), ("Α", "Α", 0),
    ],
)
def test_inspect(text, form, kinds):
    assert T.inspect(text) == (form, kinds)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    form = T.clean(text)
    assert T.clean(form) == form and unicodedata.is_normalized("NFC", form)


def test_comparison_form():
    assert T.comparison_form("Ｓtraße  X") == "strasse x" and T.comparison_form(None) == ""
    assert T.plain("Møšek É") == "møsek e"


def test_normalise(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "k int, text string, kinds string")
    found = {(r.k, r.form, tuple(r.form_changes)) for r in T.normalise(rows).collect()}
    assert found == {(1, "a b", ("space",)), (2, None, ()), (3, "", ())} and T.normalise(rows).count() == 4
    assert [r.k for r in T.deviating(rows.where("text is not null")).collect()] == [1]
    assert T.normalise(rows.limit(0)).count() == 0
