"""Loading with checks, leads, needs and shared texts."""

import json

import pytest
from pyspark.sql import functions as F

from quayside.operators import catalogue as L


def test_files(spark, tmp_path):
    for name, ids in (("b.json", ["1", "2"]), ("c.json", ["2"])):
        (tmp_path / name).write_text(json.dumps([{"id": i, "name": name} for i in ids]))
    paths = [f"{tmp_path}/{n}" for n in ("a.json", "b.json", "c.json")]
    got = L.read_existing(spark, paths, "id string, name string")
    assert sorted(map(tuple, got.collect())) == [("1", "b.json", 1), ("2", "b.json", 1), ("2", "c.json", 2)]
    with pytest.raises(ValueError, match="none of these exists"):
        L.read_existing(spark, paths[:1], "id string")
    assert L.read_previous(spark, paths[0], "id string").count() == 0
    (tmp_path / "o.json").write_text(json.dumps({"overrides": {"x": {"exclude": True}, "y": {"active": False}}}))
    assert sorted(map(tuple, L.read_overrides(spark, f"{tmp_path}/o.json", "exclude boolean, active boolean").collect())) == [("x", True, None), ("y", None, False)]


def test_snapshot(spark):
    s = spark.createDataFrame([([("a", [("u1",), ("u2",)]), ("b", [])],)], "sources array<struct<id:string,pages:array<struct<url:string>>>>")
    assert [tuple(r) for r in L.flatten_snapshot(s).orderBy("source_ord", "page_ord").collect()] == [(0, 0, "a", "u1"), (0, 1, "a", "u2")]


def test_checked(spark):
    schema = "id string, category string"
    assert L.checked(spark.createDataFrame([("1", "food")], schema)).count() == 1
    with pytest.raises(ValueError, match="empty"):
        L.checked(spark.createDataFrame([], schema))
    for bad in ("yachts", None):
        with pytest.raises(Exception, match="unknown category of 1"):
            L.checked(spark.createDataFrame([("1", bad)], schema)).collect()


def test_valid_entries(spark):
    v = L.PAGE_VERSION
    rows = [("u1", v, "u1", "f", "x"), ("u2", 0, "u2", "f", "x"), ("other", v, "u3", "f", "x"), ("u4", v, "u4", "f", "é" * L.PAGE_BYTES), ("u5", v, "u5", "f", None), ("u6", v, "u6", None, "x"), ("u7", v, "u7", "", "x"), ("u8", v, "u8", "f", "")]
    stored = spark.createDataFrame(rows, "k string, version int, url string, final_url string, html string").withColumn("key", F.sha2("k", 256))
    assert sorted(r.url for r in L.valid_entries(stored).collect()) == ["u1", "u8"]


@pytest.mark.parametrize(("areas", "want"), [
    (["US", "San Jose, CA"], (37.3382, -121.8863)), (["Oakland, CA", "San Jose, CA"], (37.8044, -122.2712)), (["Santa Clara and San Mateo counties, CA"], (37.3382, -121.8863)), (["California"], None), ([], None), (None, None), ([None], None),
])
def test_coordinates(spark, areas, want):
    r = spark.createDataFrame([(areas,)], "a array<string>").select(L.area_coordinates(F.col("a")).alias("at")).first().at
    assert (tuple(r) if r else None) == want


def test_backfill(spark):
    rows = [("p", "d", "Applicants must be veterans.", (None, None), over) for over in (False, True, None)] + [("p", "d", "Applicants must be veterans.", (60.0, None), False), (None, None, None, (None, None), False)]
    df = spark.createDataFrame(rows, "name string, description string, excerpt string, eligibility struct<max_ami_percent:double,requires_veteran:boolean>, overridden boolean")
    assert [(tuple(r.eligibility), r.backfilled) if r.eligibility else None for r in L.backfill(df).collect()] == [((None, True), True), ((None, None), False), ((None, True), True), ((60.0, None), False), ((None, None), False)]


def test_leads(spark):
    rows = [("https://a.org/x.pdf", "p", "Form", False, "s", 1), ("https://a.org/x.pdf#2", "p", "form", False, "s", 1), ("https://a.org/y", "p", "Y", None, None, 1), ("https://a.org/m", "p", "M", True, None, 1), ("https://a.org/deep", "p", "D", False, "s", 9), ("https://a.org/deep2", "p", "D", True, "s", 9), ("https://a.org/ok", "p", "O", False, "s", 1), ("mailto:x", "p", "x", False, None, 1), (None, "p", None, None, None, None)]
    got = L.leads(spark.createDataFrame(rows, "url string, found_from string, text string, navigation boolean, owner string, depth int"), 4)
    assert sorted((r.url, r.reason, r.text) for r in got.collect()) == [("https://a.org/deep", "depth_limit", "D"), ("https://a.org/x.pdf", "document_needs_extraction", "Form"), ("https://a.org/y", "outside_configured_sources", "Y")]


def test_needs_and_signs(spark):
    rows = [(["food", "yachts"], ["legal", "food"]), (["yachts"], ["legal"]), (None, None)]
    got = spark.createDataFrame(rows, "p array<string>, r array<string>").select(L.picked_needs(F.col("p"), F.col("r")).alias("n"), L.indicators(F.col("r"), F.col("p")).alias("i")).collect()
    assert [r.n for r in got] == [["food", "legal"], ["legal"], None] and [r.i for r in got] == [["legal", "food", "yachts"], ["legal", "yachts"], None]


def test_placement_counts(spark):
    dots = spark.createDataFrame([(1, "county"), (1, "near_you"), (1, "address")], "sit_id long, placement string")
    areas = spark.createDataFrame([(1, "*statewide", 3), (1, "*national", 1), (1, "Alameda", 2), (2, "*national", 5)], "sit_id long, place string, n long")
    assert sorted(map(tuple, L.placement_counts(dots, areas).collect())) == [(1, 1, 2, 3), (2, 0, 0, 5)]


def test_share_text_without_anything(spark):
    words = dict.fromkeys(("now", "today", "week", "next"), "") | {"title": "T", "benefits": "B", "steps": "S", "docs": "D", "footer": "F"}
    df = spark.createDataFrame([(None, None, None)], "l array<struct<title:string,value:string>>, s array<struct<when:string,text:string,phone:string>>, d array<string>")
    assert df.select(L.share_text(F.col("l"), F.col("s"), F.col("d"), words)).first()[0] == "T\n\nS\n\nF"
