import pytest
from pyspark.sql import functions as F

from sparsight.functions import text as tx
from sparsight.operators import filters

CASES = [
    ("", False, False), ("   ", False, False),
    ("a" * 20, False, False), ("a" * 21, True, True),
    ("A" * 25, False, False), ("1" * 25, False, False),
    ("1234567890 1234567890 x", True, False), ("1234567890 1234567890 xy", True, True),
    ("½" * 25, False, False), ("日本語" * 10, False, False),
    ("a" * 29_999, True, True), ("a" * 30_000, False, True),
    (" " * 40 + "a" * 29_999 + "\n" * 7, True, True),
    ("\xa0" + "b" * 21 + "\t", True, True), ("\x1f　" + "b" * 20 + " ", False, False),
    ("ⅷ" * 25, False, False), ("É" * 24 + "é", True, True),
]


def test_quality_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    got = df.select(
        "i", tx.is_good(F.col("text")).alias("g"), tx.is_strict(F.col("text")).alias("s")
    ).orderBy("i").collect()
    assert [(r.g, r.s) for r in got] == [(g, s) for _, g, s in CASES]


def test_letters_without_a_single_upper_case(spark):
    texts = {"MIXED case text with numbers 123": True, "ß" * 30: True, "ǅ" * 30: True, "MIXED CASE TEXT WITH 123": False}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.g for r in df.select("text", tx.is_good(F.col("text")).alias("g")).collect()} == texts


def test_strip_set_is_what_python_strips():
    assert set(tx.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize(
    "text, expected",
    [("", []), (" \n ", []), (" a  b c\x1cd ", ["a", "b", "c", "d"]), ("x", ["x"])],
)
def test_words(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tx.words(F.col("text")).alias("w")).first()["w"] == expected


def test_report_counts_every_rule(spark):
    df = spark.createDataFrame([("s", c[0]) for c in CASES], "source string, text string")
    row = filters.quality_report(df).first()
    assert row.n_docs == len(CASES) and row.blank == 2
    assert row.kept_good == sum(g for _, g, _ in CASES)
    assert row.kept_strict == sum(s for _, _, s in CASES)


def test_dedup_keeps_the_smallest_key_of_a_hot_group(spark):
    rows = [(i, " same ") for i in range(50)] + [(100, "other"), (101, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in filters.dedup_exact(df).collect()) == [0, 100]


def test_special_ids_as_list_and_as_table(spark):
    rows = spark.createDataFrame([(1, i, i % 4) for i in range(8)], "doc_id long, tok_pos int, token_id int")
    table = spark.createDataFrame([(0,), (1,)], "token_id int")
    a = filters.drop_special(rows, [0, 1]).orderBy("tok_pos").collect()
    b = filters.drop_special(rows, table).orderBy("tok_pos").collect()
    assert a == b and len(a) == 4
