import pytest

from mhqa.llm import langid as L

EN = ["the story of the old mill follows two sisters who leave after the great fire", "as a child he collected pressed plants and kept a diary about", "the town hall was built after plans by a local builder", "critics praised the music but only a few copies were sold in the first year"]
DE = ["als kind sammelte er gepresste pflanzen und schrieb ein tagebuch über die reise", "das rathaus wurde nach plänen von einem baumeister gebaut und steht noch heute", "die kritik lobte die musik doch im ersten jahr wurden nur wenige verkauft", "gemeinsam mit ihr gründete er eine kleine schule die später geschlossen wurde"]
RU = ["в детстве он собирал ракушки и писал дневник о поездке", "ратуша города была построена по проекту местного мастера"]
CORPORA = {"en": "\n".join(EN).encode(), "de": "\n".join(DE).encode(), "ru": "\n".join(RU).encode()}


@pytest.fixture(scope="module")
def classifier():
    return L.Classifier(CORPORA)


def test_mask():
    assert L.mask('Bèkin wrote "The Old Mill" in 1912 near Viskburg') == "wrote in near"
    assert L.mask("ALL UPPER CASE") == "all upper case" and L.mask("") == "" and L.mask("《The Broken Lute》是小说") == "是小说"


def test_classifies(classifier):
    assert classifier.whole("As a child Rámis collected pressed plants in Goa and kept a diary about Tom.")[0] == "en"
    assert classifier.whole("Das Rathaus von Goa wurde 1907 nach Plänen von einem Baumeister gebaut.")[0] == "de"
    assert classifier.whole("Ратуша города Клаксвик была построена в 1907 году.")[0] == "ru"
    assert classifier.whole("Rámis Brukquist") == (None, 0.0)
    pieces = classifier.text("The town hall was built after plans by Tom. Das Rathaus wurde nach Plänen von einem Baumeister gebaut und steht noch heute.")
    assert [p[1] for p in pieces] == ["en", "de"] and all(0 <= p[2] <= 1 for p in pieces)


@pytest.mark.parametrize(("label", "code"), [("en", "en"), ("EN", "en"), ("en-001", "en"), ("eng", "en"), ("English", "en"), ("fr ", "fr"), ("Mandarin Chinese", "zh"), ("und", None), ("-", None), ("", None), (None, None), ("xx", None), ("Deutsch", "de")])
def test_labels(label, code):
    known = L.notations([("en", "English"), ("fr", "French"), ("zh", "Mandarin Chinese"), ("de", "German")])
    assert L.label_code(label, known) == code


SCHEMA = "id string, question string, question_language string, candidates array<struct<id: string, language: string, sentences: array<string>>>, extra string"


def test_mislabelled(spark):
    languages = spark.createDataFrame([("en", "English"), ("de", "German"), ("ru", "Russian")], "code string, name string")
    cap = lambda s: s[0].upper() + s[1:] + "."
    rows = [(f"i{k}", None, None, [("p0", x, [cap(s) for s in texts])], "e") for k, (x, texts) in enumerate([("en", EN), ("de", DE), ("ru", RU), ("English", EN), ("deu", DE)] * 3)]
    rows += [("bad", cap(DE[0]), "en", [("p0", "de", [cap(EN[1]), None, ""]), ("p1", None, [cap(DE[1])])], "e")] * 2 + [("none", None, None, None, "e")]
    found = {tuple(r) for r in L.mislabelled(spark.createDataFrame(rows, SCHEMA), languages).collect()}
    assert found == {("bad", "", -1, "de"), ("bad", "p0", 0, "en"), ("bad", "p1", 0, "de")}
    assert L.mislabelled(spark.createDataFrame([], SCHEMA), languages).count() == 0


def test_held_out_accuracy(spark, data):
    """Sentences that are copies of English source sentences are English, whatever their label; others with a label are mostly right."""
    from mhqa.llm import units

    instances = spark.read.parquet(f"{data}/instances.parquet")
    known = L.inventory(spark.read.parquet(f"{data}/languages.parquet"))
    corpora = L.fit(instances, known)
    rows = L.segments(units.sentences(instances), corpora, known).where("label is not null and language is not null").select("label", "language").collect()
    assert len(rows) > 300 and sum(r.label == r.language for r in rows) / len(rows) > 0.9


def test_other_languages_of_a_script_are_rejected():
    russian = "он родился в большом городе на берегу реки и много лет работал в местном музее где хранятся старые письма жизнь еще щедрые объяснения фьорд цех эхо юг "
    found = L.Classifier({"ru": (russian * 4).encode(), "el": ("η πόλη βρίσκεται στις όχθες του ποταμού " * 9).encode()})
    assert found.whole("он много лет работал в большом музее на берегу реки")[0] == "ru"
    assert found.whole("він народився у великому місті на березі річки і помер")[0] is None
