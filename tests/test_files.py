"""Registries of sources and outlines of counties from files."""

import json

import pytest

from quayside.operators import catalogue as L
from quayside.operators import mapdata as D


def test_outlines(spark, tmp_path):
    square = lambda x, w: [[x, 0.0], [x + w, 0.0], [x + w, w], [x, w], [x, 0.0]]
    shapes = [("a", {"type": "Polygon", "coordinates": [square(0.0, 2.0), square(0.5, 1.0)]}), ("b", {"type": "MultiPolygon", "coordinates": [[square(5.0, 1.0)], [square(10.0, 4.0), square(11.0, 1.0)]]}), ("c", None), ("d", {"type": "Point", "coordinates": [1.0, 2.0]}), ("e", {"type": "MultiPolygon", "coordinates": []}), (None, {"type": "Polygon", "coordinates": [square(0.0, 1.0)]})]
    (tmp_path / "o.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n}, "geometry": g} for n, g in shapes]}, indent=1))
    rings = D.read_outlines(spark, f"{tmp_path}/o.json")
    assert rings.groupBy("name", "ring").count().count() == 3 and rings.count() == 15
    assert sorted(map(tuple, D.centroids(rings).collect())) == [("a", 1.0, 1.0), ("b", 2.0, 12.0)]


def test_sources(spark, tmp_path):
    one = {"id": "a", "name": "A", "startUrl": "https://a.org/", "startUrls": ["https://a.org/x", "https://a.org/"], "allowedOrigins": ["https://a.org"], "allowedPathPrefixes": ["/x"], "crawlOrder": 3, "priority": 7, "maxPages": 5}
    two = {"id": "b", "allowedOrigins": ["https://b.org", "https://www.b.org"], "crawlOrder": 0}
    three = {"id": "c", "allowedOrigins": ["https://c.org"], "allowedPathPrefixes": [], "startUrl": "https://c.org/"}
    (tmp_path / "s.json").write_text(json.dumps([one, two, three]))
    got = {r.source_id: r for r in L.read_sources(spark, [f"{tmp_path}/none", f"{tmp_path}/s.json"]).collect()}
    assert [got[k].ord for k in "abc"] == [1, 0, 2] and got["a"].seeds == ["https://a.org/", "https://a.org/x"] and (got["a"].prefixes, got["b"].prefixes, got["c"].prefixes) == (["/x"], ["/"], ["/"])
    assert (got["a"].priority, got["a"].max_pages, got["b"].priority, got["b"].max_pages, got["b"].seeds) == (7, 5, 0, 20, [])
    for bad, message in (([one, one], "comes twice: a"), ([{"id": "z"}], "no origin of source z"), ([{"allowedOrigins": ["https://a.org"]}], "without an id")):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match=message):
            L.read_sources(spark, [f"{tmp_path}/bad.json"]).collect()


def test_centres_of_counties_without_an_anchor(spark):
    found = spark.createDataFrame([(1, "ranked", 1, "a", ["Napa County, CA"]), (1, "ranked", 2, "b", ["Alameda County, CA"]), (1, "related", 1, "c", ["California"])], "sit_id long, section string, rank int, id string, service_area array<string>")
    sit = spark.createDataFrame([(1, ("Kern County", 35.0, -119.0))], "sit_id long, location struct<county:string,lat:double,lng:double>")
    centres = spark.createDataFrame([("Napa", 38.5, -122.3), ("Alameda", 1.0, 1.0), (None, 2.0, 2.0)], "name string, lat double, lng double")
    of = lambda d: {r.id: (r.placement, r.centre) for r in d.collect()}
    assert of(D.dots(found, sit)) == {"a": ("near_you", "near_you"), "b": ("county", "Alameda"), "c": ("near_you", "near_you")}
    with_centres = D.dots(found, sit, centres)
    assert of(with_centres) == {"a": ("county", "Napa"), "b": ("county", "Alameda"), "c": ("near_you", "near_you")}
    assert all(abs(r.lat - {"Napa": 38.5, "Alameda": 37.8044, "near_you": 35.0}[r.centre]) < 0.05 for r in with_centres.collect())
