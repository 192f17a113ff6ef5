"""Situations from outside: limits, lists, and what the text says beside them."""

from pyspark.sql import functions as F

from quayside.functions import text as T
from quayside.operators import outside as O

GIVEN = "key int, household_size double, monthly_income double, income_source string, monthly_housing_cost double, age double, housing_status string, has_children boolean, is_veteran boolean, is_pregnant boolean, needs array<string>, conditions array<string>, note string"


def test_limits_and_lists(spark):
    rows = [
        (1, 1.0, 0.0, "mixed", 0.5, 110.0, "unhoused", True, False, True, ["food", "gold", None, "food"], ["hiv_aids", "luck", None], "kept"), (2, 0.9, -0.1, "x", 0.0, 13.9, "x", None, None, False, ["gold"], [], None),
        (3, float("nan"), float("inf"), None, float("nan"), 110.5, None, None, None, None, None, None, None),
    ]
    got = [tuple(r) for r in O.guarded(spark.createDataFrame(rows, GIVEN)).orderBy("key").collect()]
    assert got[0] == (1, 1, 0.0, "mixed", 1.0, 110, "unhoused", True, False, True, ["food"], ["hiv_aids"], "kept")
    assert got[1][1:] == got[2][1:] == (None,) * 12


def test_lists_of_the_text_come_first(spark):
    texts = spark.createDataFrame([(1, "I need food. I have diabetes. I am 34 years old."), (2, "I am a veteran.")], "key int, text string")
    given = spark.createDataFrame([(1, None, None, None, None, 40.0, None, None, None, None, ["legal", "food"], ["cancer"], None), (9, 1.0, None, None, None, None, None, None, None, None, None, None, None)], GIVEN)
    got = {r.key: r for r in O.with_text(given, T.parse(texts)).collect()}
    assert set(got) == {1, 2} and got[1].age == 40 and got[2].is_veteran
    assert got[1].needs[-1] == "legal" and "food" in got[1].needs and got[1].conditions == ["diabetes", "cancer"]


def test_immediate_safety(spark):
    rows = [(["x"], None), ([], "I want to die"), (None, "I am not suicidal"), (None, None), (["x"], "I am not suicidal")]
    got = spark.createDataFrame(rows, "s array<string>, t string").select(O.immediate_safety(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, True]
