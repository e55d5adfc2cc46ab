import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from webtally.functions import normalize_text, tokens, unify_numerals, word_count
from webtally.functions.normalize import NUMERALS, SORANI_LETTERS, TATWEEL, ZWNJ, Replace, ReplaceRegex
from webtally.operators import profile as pf

# White space to Python's str.split
SPACES = [chr(c) for c in range(0x110000) if not chr(c).split()]


CHARACTERS = st.one_of(st.sampled_from(SPACES), st.characters(exclude_categories=["Cs"]))


def _texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_words_split_like_python(spark):
    assert len(SPACES) == 29
    texts = [f"a{space}b" for space in SPACES] + ["", " ", "\n\t ", " a  b ", "a" + ZWNJ + "b", "é \U0001f600 x", None]
    got = _texts(spark, texts).select("id", tokens("text").alias("t"), word_count("text").alias("n")).collect()
    for row in got:
        want = None if texts[row.id] is None else texts[row.id].split()
        assert row.t == want and row.n == (None if want is None else len(want))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(CHARACTERS), min_size=1, max_size=60))
def test_words_of_any_text(spark, texts):
    for row in _texts(spark, texts).select("id", tokens("text").alias("t")).collect():
        assert row.t == texts[row.id].split()


def test_long_texts_are_taken_whole(spark):
    text = "ر٣ " * 700_000 + "end"
    df = _texts(spark, [text]).select(normalize_text("text").alias("text"), word_count("text").alias("n"))
    row = df.select("n", F.length("text").alias("length"), F.right("text", F.lit(6)).alias("tail")).first()
    assert tuple(row) == (700_001, len(text), "ڕ3 end")


def test_normalisation_sample(spark):
    text = "كوردي  ٣٤ ۵۶ رۆژ ده" + ZWNJ + "ڵێم  ک" + TATWEEL + "تێب"
    got = _texts(spark, [text, None, ""]).orderBy("id").select(normalize_text("text").alias("t")).collect()
    assert [r.t for r in got] == ["کوردی 34 56 ڕۆژ دەڵێم کتێب", None, ""]


def test_one_pass_for_letters_and_digits_changes_nothing(spark):
    """The list as its six separate steps, on random strings of the characters it treats."""
    steps = (
        SORANI_LETTERS,
        Replace("ه" + ZWNJ, "ە"),
        ReplaceRegex(TATWEEL, ""),
        ReplaceRegex(r"(?<![\p{L}\p{M}\p{N}])ر", "ڕ"),
        ReplaceRegex(" +", " "),
        NUMERALS,
    )
    rng = random.Random(7)
    alphabet = "كيىهرر٣۵7 ــ  aé.\n" + "\N{ARABIC FATHA}" + ZWNJ + ZWNJ
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 30))) for _ in range(3000)]
    got = _texts(spark, texts).select(
        "text", normalize_text("text").alias("fast"), normalize_text("text", steps).alias("steps")
    )
    assert got.where("fast <> steps").count() == 0
    assert got.where("fast <> text").count() > 2000


def test_numerals(spark):
    got = _texts(spark, ["٠١٢٣٤٥٦٧٨٩ ۰۱۲۳۴۵۶۷۸۹ x"]).select(unify_numerals("text")).first()[0]
    assert got == "0123456789 0123456789 x"


def test_cast_string(spark):
    df = spark.createDataFrame([(1, 2.5), (None, None)], "i long, d double")
    columns = pf.cast_string("i"), pf.cast_string("d", null_as="nan"), pf.cast_string(F.col("i"), "None")
    got = df.select(*columns).collect()
    assert [tuple(r) for r in got] == [("1", "2.5", "1"), (None, "nan", "None")]


def test_table_profile(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, `a.b` string, m struct<x: int>")
    got = [tuple(r) for r in pf.table_profile(df).orderBy("position").collect()]
    assert got == [(0, "id", 2, "int"), (1, "a.b", 1, "string"), (2, "m", 0, "struct<x:int>")]


def test_text_profile(spark):
    df = _texts(spark, ["b", "a", None, "b", "a", "c", None, None])
    assert tuple(pf.text_profile(df).first()) == (5, 3, "a", 2)
    assert tuple(pf.text_profile_first_seen(df, "id").first()) == (5, 3, "b", 2, 0)
    for none in (df.where("text is null"), df.where("false")):
        assert tuple(pf.text_profile(none).first()) == (0, 0, None, None)
        assert tuple(pf.text_profile_first_seen(none, "id").first()) == (0, 0, None, None, None)


def test_flatten_struct_with_missing_fields(spark):
    schema = "id int, meta struct<warc_headers: struct<`warc-target-uri`: string, `warc-date`: string>>"
    rows = [(1, {"warc_headers": {"warc-target-uri": "u"}}), (2, {"warc_headers": None}), (3, None)]
    df = spark.createDataFrame(rows, schema)
    got = pf.flatten_struct(df, "meta.warc_headers", "id")
    assert got.columns == ["id", "warc-target-uri", "warc-date"]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "u", None), (2, None, None), (3, None, None)]


def test_head(spark):
    assert [r.id for r in pf.head(_texts(spark, list("abcdefg")).repartition(4), "id").collect()] == [0, 1, 2, 3, 4]
