import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import arabic, names, scalars
from quarry.operators import highlight, nodes

TEXT = st.text(alphabet="ابتكويءأإپڭٱًَ كلم.*1aZ\n", max_size=40)


def test_fold_goldens():
    assert arabic.fold("أَحْمَدُ") == "احمد"
    assert arabic.fold("گلستان") == "كلستان"
    assert arabic.fold("ٱلْمُؤْمِنِ") == "لمومن"


def test_root_goldens():
    assert arabic.root_form("كتب") == "ك.ت.ب"
    assert arabic.root_form("قول") == "ق.#.ل"
    assert arabic.root_form("كتب  قول") == "ك.ت.ب ق.#.ل"
    # Dots are punctuation: cleaned once, before the root form.
    assert nodes.term("ك.ت.ب", "root").slots[0].start == "ك.ت.ب"


@given(TEXT)
def test_fold_is_idempotent(text):
    assert arabic.fold(arabic.fold(text)) == arabic.fold(text)


def test_columns_agree_with_python(spark):
    texts = ["أَحْمَدُ گل", "قول كتب", "", "ٱلْمُؤْمِنِ a1", "  x  y "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", arabic.fold_column(F.col("t")), arabic.root_form_column(F.col("t")), arabic.letters_column(F.col("t"))).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {t: (arabic.fold(t), arabic.root_form(t), arabic.letters(t)) for t in texts}


def test_clitics_and_cleaning():
    assert arabic.with_clitics("الكتاب") == ["الكتاب", "والكتاب", "فالكتاب", "بالكتاب", "لالكتاب", "كالكتاب"]
    assert arabic.with_clitics("a b")[1] == "وa b"
    assert arabic.clean_query(" a,  b؟* ") == "a b"
    assert arabic.clean_query("كتا*", keep_star=True) == "كتا*"


@pytest.mark.parametrize(("q", "mode", "ok"), [("أب*", "surface", True), ("أح*مد", "surface", True), ("أ*مد", "surface", False), ("*منصور", "surface", False), ("أب*", "lemma", False), ("أب* ك*", "surface", False), ("ابن", "lemma", True)])
def test_wildcard_rules(q, mode, ok):
    if ok:
        nodes.check_wildcard(q, mode)
    else:
        with pytest.raises(ValueError):
            nodes.check_wildcard(q, mode)


def test_name_goldens():
    assert names.kunya_variants("أبو منصور") == ["ابو منصور", "ابا منصور", "ابي منصور"]
    form = names.NameForm(kunyas=["أبو منصور"], nasab="معمر بن أحمد بن زياد", nisbas=["الأصبهاني"])
    made = names.patterns(form)
    for p in ("ابو منصور بن احمد", "ابو منصور بن احمد بن زياد", "ابو منصور معمر بن احمد", "ابو منصور معمر الاصبهاني", "معمر بن احمد بن زياد", "معمر بن احمد الاصبهاني"):
        assert p in made
    assert made[0] == "ابو منصور معمر بن احمد" and len(made) == len(set(made))
    assert "معمر" not in made
    assert names.patterns(names.NameForm(shuhra="أبو نعيم")) == ["المعروف بابي نعيم", "المشهور بابي نعيم"]
    assert names.patterns(names.NameForm(shuhra="الطبري")) == ["المعروف بالطبري", "المشهور بالطبري"]
    assert names.display_patterns(form)[0] == "اب* منصور معمر بن احمد"
    assert len(names.search_patterns(form)) == 6 * len(made)
    assert names.nasab_parts("فاطمة بنت أسد") == (["فاطمة", "اسد"], "بنت")


@pytest.mark.parametrize(("form", "ok"), [(names.NameForm(), False), (names.NameForm(shuhra="x"), True), (names.NameForm(nasab="a"), False), (names.NameForm(nasab="a", allow_one_nasab=True), True), (names.NameForm(nasab="a", nisbas=["b"]), True), (names.NameForm(nasab="a بن b", allow_two_nasab=True), True)])
def test_name_validity(form, ok):
    assert names.is_valid(form) is ok


def test_token_map():
    text = "قال، الإ1مام abc رحمه"
    m = arabic.token_map(text)
    assert m[0:3] == [0, 0, 0] and m[3] is None
    assert m[text.index("م")] == 1 and m[text.index("1")] is None
    assert max(t for t in m if t is not None) == 2
    assert highlight.ranges_of(text, {0}) == [(0, 3)]
    assert highlight.token_range(text, 1) == (5, 8)
    assert highlight.token_at_char(text, 99) is None


@given(TEXT)
def test_snippet_covers_center(text):
    m = arabic.token_map(text)
    n = max((t for t in m if t is not None), default=-1) + 1
    for c in range(n):
        a, b, _ = highlight.snippet_chars(text, c, 1, 1)
        assert a <= m.index(c) < b


def test_scalars(spark):
    row = spark.createDataFrame([("k: v", "x", '["a"]', "{", "0.1.0-alpha", "1.2", 'a,"b')], "kv string, plain string, j string, bad string, v string, short string, c string")
    r = row.select(
        scalars.key_value(F.col("kv")).alias("kv"), scalars.key_value(F.col("plain")).alias("plain"), scalars.json_strings(F.col("j")).alias("j"), scalars.json_strings(F.col("bad")).alias("bad"),
        scalars.version(F.col("v")).alias("v"), scalars.meets_minimum(F.col("v"), F.lit("1.0.0")).alias("old"), scalars.meets_minimum(F.col("short"), F.lit("9.9.9")).alias("short"),
        (scalars.version(F.lit("0.9.9")) < scalars.version(F.lit("1.0.0"))).alias("less"), scalars.csv_cell(F.col("c")).alias("c"), scalars.label(F.repeat(F.lit("y"), 50)).alias("label"),
        scalars.strip_html(F.lit("a<BR />b<i>c</i>")).alias("html"), scalars.relative_time(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 02:30:00").cast("timestamp")).alias("ago"),
    ).first()
    assert tuple(r["kv"]) == ("k", "v") and tuple(r["plain"]) == (None, "x")
    assert r["j"] == ["a"] and r["bad"] == [] and tuple(r["v"]) == (0, 1, 0)
    assert r["old"] is False and r["short"] is True and r["less"] is True
    assert r["c"] == '"a,""b"' and r["label"] == "y" * 37 + "..." and r["html"] == "a\nbc" and r["ago"] == "2h ago"
