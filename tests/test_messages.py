from quayside.operators.messages import coverage, translate

ROWS = [("en", "a", "Hi {n}"), ("es", "a", "Hola {n}"), ("en", "b", "{x} and {y}"), ("es", "b", "{x}"), ("en", "c", "only")]


def test_fallback_and_places(spark):
    m = spark.createDataFrame(ROWS, "lang string, key string, text string")
    asked = spark.createDataFrame([(1, "a", "es", {"n": "Ana"}), (2, "c", "es", None), (3, "zz", "es", {}), (4, "a", "fr", {"n": None})], "id int, key string, lang string, params map<string,string>")
    assert {r.id: r.text for r in translate(asked, m).collect()} == {1: "Hola Ana", 2: "only", 3: "zz", 4: "Hi {n}"}
    assert {(r.key, r.problem) for r in coverage(m).collect()} == {("b", "places"), ("c", "missing")}
