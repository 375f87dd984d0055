import pytest

from mhqa.llm import alignment as A
from mhqa.llm import overlap as O

DRAFTS = "draft_id long, sentences array<string>, source_sentences array<string>, draft string"


def drafts(spark):
    rows = []
    for k in range(80):
        p, t, y = f"Rámis{k} Berg{k}", f"Vülgrad{k}", 1800 + k
        source = [f"{p} never returned to {t} and died in Goa{k} at the age of {20 + k}.", f"In {y} a storm forced the Berg{k} Museum to close its rooms in {t}.", f"The town hall of {t} was built in {y + 50} after plans by {p}."]
        target = [f"{p} kehrte nie nach {t} zurück und starb in Goa{k} im Alter von {20 + k} Jahren.", f"Im Jahr {y} zwang ein Sturm Berg{k} Museum dazu, die Räume in {t} zu schließen.", f"Das Rathaus von {t} wurde {y + 50} nach Plänen von {p} gebaut."]
        rows.append((k, target[::-1] if k % 2 else target, source, "x"))
    rows.append((900, [rows[0][1][0]], rows[0][2], "x"))
    rows.append((901, [rows[2][1][0][:-1] + ", und " + rows[2][1][1], rows[2][1][2]], rows[2][2], "x"))
    rows += [(902, None, ["a"], "x"), (903, ["a"], None, "x"), (904, [], [], "x"), (905, [None, "", " "], ["The town hall of Goa was built in 1900."], "x"), (0, rows[0][1], rows[0][2], "x")]
    return spark.createDataFrame(rows, DRAFTS)


def test_alignment(spark):
    found = {}
    for r in A.pairs(drafts(spark)).collect():
        found.setdefault(r.draft_id, set()).add((r.sentence_id, r.source_sentence_id))
    right = sum(found.get(k) == ({(0, 2), (1, 1), (2, 0)} if k % 2 else {(0, 0), (1, 1), (2, 2)}) for k in range(80))
    assert right >= 78
    assert found[900] == {(0, 0)} and found[901] == {(0, 0), (0, 1), (1, 2)} and not found.keys() & {902, 903, 904, 905}
    assert A.pairs(drafts(spark).limit(0)).count() == 0


def test_sound():
    assert A.sound("Кисфелл") == A.sound("Kísfell") and A.sound("Клаксвикк") == A.sound("Kláxwick")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Which town lies on the river Lila and is the birthplace of Tom Berg?", "which town  lies on the RIVER lila and is the brithplace of tom berg", True),
        ("Which town lies on the river Lila and is the birthplace of Tom Berg?", "Which small town lies on the river Lila and is the birthplace of Tom Berg?", True),
        ("Which town lies on the river Lila and is the birthplace of Tom Berg?", "Which town lies on the river Lila and is the birthplace of Ann Moss?", False),
        ("Who founded the Lila Museum in 1918 and wrote it?", "Who founded the Lila Museum in 1913 and wrote it?", False), ("", "Who founded it?", False), ("Ｗho founded Lila?", "Who founded Lila?", True),
    ],
)
def test_same(a, b, same):
    common = frozenset("which town lies on the river and is birthplace of who founded in wrote it small museum".split())
    assert O.same(O.form_of(a), O.form_of(b), common) is same and O.same(O.form_of(b), O.form_of(a), common) is same


def test_sentences():
    common = frozenset("the town of has a mill and lies on river hall was built in".split())
    a, b, c = "The town of Goa has a mill.", "The hall of Goa was built in 1907.", "Goa lies on the river Lila."
    assert O.same_texts("source_sentences", "\n".join([a, b, c]), "\n".join([c, a]), common) and not O.same_texts("source_sentences", "\n".join([a, b, c]), a, common)
    assert not O.same_texts("source_sentences", a, a.replace("Goa", "Tamby"), common)


def test_fingerprints_meet():
    common = frozenset()
    long = [f"w{k}" for k in range(40)]
    assert set(O.fingerprints(long, common)) & set(O.fingerprints(["x"] + long[5:30] + ["y"], common))
    assert O.fingerprints([], common) == [] and len(O.fingerprints(["a"], common)) == 1 and O.fingerprints(["a", "b", "c"], frozenset("abc"))


SCHEMA = "id string, source_split string, shard string, question string, candidates array<struct<source_sentences: array<string>>>, key int"


def records(spark):
    rows = [(f"t{k}", "train", "a", f"Which town lies on the river Lila{k} and is the birthplace of Tom{k} Berg?", [([f"The town of Goa{k} has an old mill.", f"The hall of Goa{k} was built in {1800 + k}.", f"Goa{k} lies on the river Lila{k}."],)], 1) for k in range(30)]
    rows += [
        ("v1", "validation", "b", "which town lies on the river lila3 and is the birthplace of tom3 berg", None, 1), ("v2", "validation", "b", "Which town lies on the rivver Lila4 and is the birthplace of Tom4 Berg?", [(None,), (["Goa5 lies on the river Lila5", "The town of Goa5 has an old mill."],)], 1),
        ("v3", "validation", "c", None, [([None, ""],)], 1), ("v4", "validation", "c", "Which town lies on the river Lila9 and is the birthplace of Ann Moss?", [(["The town of Goa6 has an old mill."],)], 1),
    ]
    return spark.createDataFrame(rows + rows[-4:], SCHEMA)


def test_overlaps(spark):
    df = records(spark)
    found = {tuple(r) for r in O.overlaps(df).collect()}
    assert found == {("t3", "v1", "question"), ("t4", "v2", "question"), ("t5", "v2", "source_sentences")}
    rows = df.dropDuplicates(["id"]).collect()
    forms = {O.form_of(r.question) for r in rows if r.question}
    common = O.common_words(spark.createDataFrame([(f,) for f in sorted(forms)], "form string"))
    every = {("question", x.id, y.id) for x in rows for y in rows if x.source_split == "train" and y.source_split == "validation" and x.question and y.question and O.same(O.form_of(x.question), O.form_of(y.question), common)}
    assert {(f, a, b) for a, b, f in found if f == "question"} == every
    report = {(r.split, r.shard, r.field): (r.records, r.overlapping) for r in O.overlap_report(df).collect()}
    assert report["train", "a", "question"] == (30, 2) and report["validation", "b", "question"] == (2, 2) and report["validation", "c", "question"] == (1, 0)
    assert O.overlaps(df.limit(0)).count() == 0


def test_candidates_meet_brute_force(spark):
    usual = "Which old town lies on the river and is the birthplace of the man who wrote it?"
    train = [f"{usual[:-1]} in {1900 + k} near Zorn{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}wick?" for k in range(60)] + [usual]
    near = [t.replace("Zorn", "Zron") for t in train[:20]] + [t.replace("which old town lies", "which town lyes") + "\n" for t in map(str.lower, train[20:40])] + [usual.replace("river", "rivver"), train[50].replace("1950", "1850")]
    rows = [(f"t{k}", "train", "a", q, None, 1) for k, q in enumerate(train)] + [(f"v{k}", "validation", "b", q, None, 1) for k, q in enumerate(near)]
    df = spark.createDataFrame(rows, SCHEMA)
    common = O.common_words(spark.createDataFrame([(O.form_of(q),) for q in sorted({*train, *near})], "form string"))
    every = {(f"t{i}", f"v{j}") for i, a in enumerate(train) for j, b in enumerate(near) if O.same(O.form_of(a), O.form_of(b), common)}
    assert len(every) >= 41 and ("t60", "v40") in every
    assert {(r.id_a, r.id_b) for r in O.overlaps(df).collect()} == every


def test_spellings_meet():
    for a, b in (("zorn", "zron"), ("zorn", "zorns"), ("birthplace", "brithplace"), ("birthplace", "birthplac"), ("proskvall", "proskvxall"), ("abc", "abc")):
        assert O.near(a, b) and set(O.spellings(a)) & set(O.spellings(b))


def test_blocks_give_the_same_pairs(spark):
    df = drafts(spark)
    assert {tuple(r) for r in A.pairs(df, broadcast_rows=0, block_rows=30).collect()} == {tuple(r) for r in A.pairs(df).collect()}


def test_selected_words_meet():
    shares = {w: 0.5 for w in "which town lies on the river and is birthplace of".split()}
    a = "Which town lies on the river Lila and is the birthplace of Tom Zornwick and Ann Moss in 1907?"
    for b in (a.lower(), a.replace("Lila", "Lilla"), a.replace("Zornwick", "Zorn wick"), a.replace("Which town", "Which old town")):
        words, marks = O.indexed(O.form_of(b), shares)
        ours = {O.mark_of(f, x, y) for f, x, y, _, _ in O.selected(O.form_of(a), shares)}
        assert ours & marks, b
    assert not {O.mark_of(f, x, y) for f, x, y, _, _ in O.selected(O.form_of(a), shares)} & O.indexed(O.form_of(a.replace("1907", "1908")), shares)[1]
    assert O.selected(O.form_of("which town lies on the river"), shares) is None


def test_record_coverage(spark):
    rows = {(r.id, r.field): r.coverage for r in O.record_coverage(records(spark)).collect()}
    assert rows["v1", "question"] == 1 and 0.6 < rows["t4", "question"] <= 1 and rows["t9", "question"] == 0 and ("v3", "question") not in rows
