"""Reviews as JSON, publication that is all or nothing, orders by language, dates of files."""

import json

import pytest
from pyspark.sql import functions as F

from quayside.operators import orders
from quayside.operators import promote as R
from quayside.operators import review as V
from quayside.sources.derived import catalogue


def errors(spark, *texts):
    rows = spark.createDataFrame([(str(k), t if t is None or isinstance(t, str) else json.dumps(t)) for k, t in enumerate(texts)], "id string, json string")
    out = {k: set() for k in range(len(texts))}
    for r in V.review_errors(rows).collect():
        out[int(r.id.removeprefix("override "))].add(r.error)
    return list(out.values())


def test_keys_and_kinds(spark):
    by = {"reviewed_at": "2026-01-02", "reviewed_by": "kim"}
    got = errors(
        spark, by, by | {"colour": 1, "size": None}, by | {"eligibility": {"pets": True, "notes": "x", "max_fpl_percent": 1.5}}, by | {"eligibility": {"max_ami_percent": "80", "max_annual_income": 0, "requires_children": "no"}},
        by | {"eligibility": {"housing_status_any_of": "unhoused"}}, by | {"eligibility": {"housing_status_any_of": ["unhoused", 3]}}, by | {"eligibility": {"housing_status_any_of": []}}, by | {"eligibility": ["x"]}, by | {"eligibility": "x"}, by | {"eligibility": None}, by | {"eligibility": {}},
        {}, {"reviewed_at": None, "reviewed_by": "x"}, by | {"exclude": True}, by | {"exclude": 1, "exclude_reason": ""}, by | {"exclude": False}, by | {"exclude": True, "exclude_reason": "closed"}, by | {"phone": None, "address": "x", "required_documents": []}, by | {"phone": 5, "description": None},
        "no json", "[]", None, '{"reviewed_at": "a", "reviewed_by": "b", "active": 1, "response_time_days": "3"}',
    )
    statuses = "housing_status_any_of must list only housed_stable, housed_at_risk, eviction_notice, unhoused"
    assert got == [
        set(), {"unknown field colour", "unknown field size"}, {"unknown eligibility field pets"}, {"eligibility.max_ami_percent must be a number", "eligibility.max_annual_income must be positive", "eligibility.requires_children must be a boolean"},
        {statuses}, {statuses}, set(), {"eligibility must be an object"}, {"eligibility must be an object"}, set(), set(),
        {"reviewed_at and reviewed_by are required"}, {"reviewed_at and reviewed_by are required"}, {"exclude needs a reason"}, {"exclude needs a reason"}, set(), set(), set(), {"phone must be a string", "description must be a string"},
        {"not a JSON object"}, {"not a JSON object"}, {"not a JSON object"}, {"active must be a boolean", "response_time_days must be a non-negative number"},
    ]
    assert V.review_errors(spark.createDataFrame([], "id string, json string")).count() == 0


def test_typed_reviews_convert_nothing(spark):
    rows = [("a", 1, '{"reviewed_by": 7, "active": "yes", "phone": 5, "response_time_days": 3, "eligibility": {"max_ami_percent": "80", "requires_veteran": true, "housing_status_any_of": ["unhoused"]}}'), ("b", 2, "x"), ("c", 3, "{}")]
    got = {r.id: r for r in V.typed_reviews(spark.createDataFrame(rows, "id string, ord long, json string")).collect()}
    a = got["a"]
    assert set(got) == {"a", "c"} and (a.reviewed_by, a.active, a.phone, a.response_time_days, a.exclude) == (None, None, None, 3, False)
    assert (a.rules.max_ami_percent, a.rules.requires_veteran, a.rules.housing_status_any_of) == (None, True, ["unhoused"]) and got["c"].rules is None


def promotion(spark, names, errors=()):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return R.Promotion(one([(n,) for n in names], "name string"), one(list(errors), "id string, error string"), one([], "id string, kind string, other string"), one([], "id string"), one([(len(names),)], "n int"))


def test_publication_is_all_or_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "catalogue")
    names = lambda: sorted(r.name for r in R.current(spark, folder).collect())
    assert R.current(spark, folder) is None
    assert R.publish(promotion(spark, ["a"], [("x", "wrong")]), folder) == 1 and R.current(spark, folder) is None
    assert R.publish(promotion(spark, ["a", "b"]), folder) == 0 and names() == ["a", "b"]
    assert R.publish(promotion(spark, ["c"], [("x", "wrong"), ("y", "wrong")]), folder) == 2 and names() == ["a", "b"]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # the job ends when all is written, before the pointer moves
        m.setattr(R, "switch", killed)
        with pytest.raises(KeyboardInterrupt):
            R.publish(promotion(spark, ["d"]), folder)
    assert names() == ["a", "b"]
    assert R.publish(promotion(spark, ["e"]), folder) == 0 and names() == ["e"]


def test_order_by_language(spark):
    names = ["Zebra", "apple", "Äpfel", "Apple", "banana", "éclair", "eclair", None, "apple"]
    rows = [(k, n) for k, n in enumerate(names)]
    got = orders.catalogue_order(spark.createDataFrame(rows, "id string, name string").repartition(4)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 10))
    assert [r.name for r in got] == [None, "Äpfel", "apple", "apple", "Apple", "banana", "eclair", "éclair", "Zebra"]
    assert orders.candidate_order(spark.createDataFrame([], "name string, source_url string")).count() == 0


def test_places_of_a_name_that_many_share(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"), F.format_string("%09d", "id").alias("source_url"))
    got = [(r.name, r.source_url) for r in orders.candidate_order(df.repartition(7)).orderBy("place").collect()]
    assert got == sorted(got)
    areas = spark.createDataFrame([(1, "B", 2), (1, "a", 2), (1, "C", 5), (1, "*statewide", 9), (2, "x", 1)], "sit_id long, place string, n long")
    assert sorted((r.sit_id, r.rank, r.place) for r in orders.area_order(areas).collect()) == [(1, 1, "C"), (1, 2, "a"), (1, 3, "B"), (2, 1, "x")]


def test_candidate_files_keep_where_they_come_from(spark, tmp_path):
    files = {"a.json": {"generatedAt": "2026-01-05T00:00:00Z", "candidates": [{"id": "1", "name": "one"}, {"id": "2", "name": "two"}]}, "b.json": {"generatedAt": "2026-02-01T00:00:00Z", "candidates": [{"id": "2", "name": "late"}]}}
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    sets = R.read_candidate_sets(spark, [str(tmp_path / n) for n in ("none.json", "a.json", "b.json")], "id string, name string")
    merged = {r.id: (r.name, r.file_path.rsplit("/", 1)[1], r.generated_at[:10]) for r in R.merge_candidate_sets(sets).collect()}
    assert merged == {"1": ("one", "a.json", "2026-01-05"), "2": ("two", "a.json", "2026-01-05")}
    assert R.latest_date(sets).first()[0] == "2026-02-01T00:00:00Z"


def test_errors_of_reviews_stop_a_promotion(spark):
    cat = catalogue(spark, "/root/testdata/sf0.001").withColumns({k: F.lit("https://a.org/x") for k in ("source_url", "application_url")} | {k: F.lit(None).cast("string") for k in ("canonical_url", "phone", "address", "last_verified")} | {"description": F.lit("d")})
    reviews = spark.createDataFrame([("r1", 1, '{"reviewed_at": "d", "reviewed_by": "k", "pets": 1, "active": false}')], "id string, ord long, json string")
    p = R.promote(cat, V.typed_reviews(reviews), cat.limit(0), V.review_errors(reviews))
    assert [r.error for r in p.errors.filter("id = 'override r1'").collect()] == ["unknown field pets"]
    assert p.resources.filter("id = 'r1'").first().active is False
