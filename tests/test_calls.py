"""What to say in a call, where to apply, files with a record on each line; the texts expected are fixed values."""

import json

from pyspark.sql import functions as F

from quayside.operators import benefits as B
from quayside.operators import catalogue as L
from quayside.operators import packet as K
from quayside.sources.dimensions import BENEFIT_LINKS

SIT = "sit_id long, lang string, location struct<city:string,county:string>, household_size int, monthly_income double, housing_status string, is_veteran boolean"
TOP = "sit_id long, rank int, id string, name string, breakdown array<struct<factor:string,status:string>>"


def test_scripts(spark):
    sit = [(1, None, ("San Jose", "Santa Clara County"), 3, 1234.5, "eviction_notice", True), (2, "es", (None, "Kern County"), 1, 0.0, "housed_at_risk", False), (3, "xx", None, None, None, None, None), (4, "en", (None, None), 0, None, "housed_stable", None)]
    open_ = [("service_area", "unverified"), ("income_limit", "unverified"), ("children", "met"), ("income_limit", "unverified"), ("distance", "unverified"), ("other_conditions", "unverified")]
    top = [(1, 1, "a", "Hall A", open_), (2, 1, "a", "Hall A", open_[:2]), (3, 1, "a", "Hall A", open_[1:2]), (3, 2, "b", "Hall {facts}", None), (4, 1, "a", None, []), (9, 1, "a", "Hall A", open_)]
    got = {(r.sit_id, r.id): r for r in K.scripts(spark.createDataFrame(sit, SIT), spark.createDataFrame(top, TOP)).collect()}
    assert set(got) == {(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "a")}
    assert got[1, "a"].opener == "Hi, I'm calling about Hall A. I live in San Jose. There are 3 people in my household. Our income is about $1,235 a month. I got an eviction notice. I'm a veteran. Could you tell me if I might qualify and how to apply?"
    closing = ["What documents should I bring?", "How long does it usually take to get help?", "Is there a waitlist? Can I get on it today?", "If you can't help, who can?"]
    assert got[1, "a"].questions == ["Do you serve people who live in San Jose?", "What's the income limit for a household of 3?", "Are there any other requirements I should know about?", *closing]
    assert got[2, "a"].opener == "Hola, llamo por Hall A. Vivo en Kern County. Vivo solo. Ahora no tenemos ningún ingreso. Estoy atrasado con la renta. ¿Me puede decir si podría calificar y cómo solicitar?"
    assert got[2, "a"].questions[:2] == ["¿Atienden a personas que viven en Kern County?", "¿Cuál es el límite de ingresos para un hogar de 1?"]
    assert got[3, "a"].opener == "Hi, I'm calling about Hall A. Could you tell me if I might qualify and how to apply?" and got[3, "a"].lang == "xx"
    assert got[3, "a"].questions == ["What's the income limit for a household of ?", *closing] and got[3, "b"].questions == closing
    assert got[4, "a"].opener == "Hi, I'm calling about . Could you tell me if I might qualify and how to apply?" and got[4, "a"].questions == closing
    assert K.scripts(spark.createDataFrame([], SIT), spark.createDataFrame(top, TOP)).count() == 0


def test_applications(spark):
    assert list(BENEFIT_LINKS) == B.ORDER
    fields = "sit_id long, household_size int, monthly_income double, income_source string, monthly_housing_cost double, age int, has_children boolean, is_pregnant boolean, needs array<string>, conditions array<string>"
    sit = spark.createDataFrame([(1, 3, 500.0, "earned", 900.0, 30, True, None, [], []), (2, None, None, None, None, None, None, None, None, None)], fields)
    for day, label in (("2026-09-30", "Oct 2025 – Sep 2026"), ("2026-10-01", "Oct 2026 – Sep 2027"), ("2020-01-01", "Oct 2025 – Sep 2026")):
        rows = B.applications(sit, F.lit(day).cast("date")).collect()
        assert {r.figures for r in rows} == {label} and all((r.url, r.phone) == BENEFIT_LINKS[r.benefit_id] for r in rows)
    assert {r.benefit_id for r in rows if r.sit_id == 1} >= {"calfresh", "medi_cal", "care", "wic", "school_meals", "caleitc"}
    assert len(rows) == B.estimates(sit, F.lit("2020-01-01").cast("date")).count()


def test_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"id": str(i)}) + "\n" for i in range(3)))
    assert sorted(map(tuple, L.read_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/a.json"], "id string", lines=True).collect())) == [("0", 1), ("1", 1), ("2", 1)]
    assert L.read_previous(spark, f"{tmp_path}/a.json", "id string", lines=True).count() == 3 and L.read_previous(spark, f"{tmp_path}/none", "id string", lines=True).count() == 0
    (tmp_path / "o.json").write_text('{"overrides": {"x": {"exclude": true}}}\n{"overrides": {"y": {}, "z": {"exclude": false}}}\n{"overrides": {}}\n')
    assert sorted(map(tuple, L.read_overrides(spark, f"{tmp_path}/o.json", "exclude boolean", lines=True).collect()), key=lambda r: r[0]) == [("x", True), ("y", None), ("z", False)]
