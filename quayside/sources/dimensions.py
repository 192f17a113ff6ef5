"""Reference tables, all of fixed size: incomes, places, programme figures, labels. They are broadcast where they are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Categories, statuses and their order.
CATEGORIES = [
    "rental_assistance", "food", "utility", "shelter", "employment", "legal", "health", "benefits", "family_support",
    "veteran_support", "older_adult_support", "disability", "mental_health", "substance_use", "condition_support",
]
HOUSING_STATUSES = ["housed_stable", "housed_at_risk", "eviction_notice", "unhoused"]
URGENT_STATUSES = ["eviction_notice", "unhoused"]

# Categories that usually matter beside a stated need.
RELATED = {
    "rental_assistance": ["legal", "utility", "benefits", "food"],
    "shelter": ["rental_assistance", "food", "health", "mental_health"],
    "legal": ["rental_assistance", "benefits"],
    "utility": ["benefits", "rental_assistance"],
    "food": ["benefits", "family_support"],
    "employment": ["benefits", "food"],
    "benefits": ["food", "utility", "health"],
    "family_support": ["food", "benefits", "health"],
    "veteran_support": ["rental_assistance", "shelter", "benefits", "health"],
    "older_adult_support": ["benefits", "health", "food"],
    "disability": ["benefits", "health"],
    "mental_health": ["health", "substance_use"],
    "substance_use": ["mental_health", "health"],
    "condition_support": ["health", "disability"],
    "health": ["benefits"],
}

# Points of a match.
WEIGHTS = {"area": 15, "need": 30, "urgency": 15, "income_met": 20, "income_none": 10, "requirement": 10, "documents": 10, "near": 10, "mid": 5}
NEAR_MILES, MID_MILES, URGENT_DAYS, RELATED_LIMIT = 5, 15, 7, 6

# Share of the four-person limit by household size; poverty guideline of 2025.
SIZE_FACTORS = [0.7, 0.8, 0.9, 1.0, 1.08, 1.16, 1.24, 1.32]
POVERTY_BASE, POVERTY_STEP = 15650.0, 5500.0

# Area median income of a household of four.
MEDIAN_INCOME = {
    "santa clara county": 205500.0, "san mateo county": 210100.0, "san francisco county": 210100.0, "marin county": 210100.0,
    "alameda county": 162800.0, "contra costa county": 162800.0, "santa cruz county": 217500.0,
}

# Food benefit figures by first day in force (allotments of sizes 1 to 8, step beyond, deductions for sizes up to 3, 4, 5, more; shelter cap; minimum; guideline).
FOOD_YEARS = [
    ("2025-10-01", "Oct 2025 – Sep 2026", [298, 546, 785, 994, 1183, 1421, 1571, 1789], 218, [209, 223, 261, 299], 744, 24, 15650, 5500),
    ("2026-10-01", "Oct 2026 – Sep 2027", [306, 562, 808, 1023, 1217, 1463, 1616, 1841], 225, [217, 229, 268, 308], 769, 25, 15960, 5680),
]
EARNED_LIMIT = 32900

# Where each benefit is applied for, and the telephone.
BENEFIT_LINKS = {
    "calfresh": ("https://www.getcalfresh.org/", "1-877-847-3663"),
    "medi_cal": ("https://www.dhcs.ca.gov/services/medi-cal/Pages/DoYouQualifyForMedi-Cal.aspx", "1-800-541-5555"),
    "medi_cal_kids": ("https://www.dhcs.ca.gov/services/medi-cal/Pages/DoYouQualifyForMedi-Cal.aspx", "1-800-541-5555"),
    "care": ("https://www.pge.com/care", "1-866-743-2273"),
    "fera": ("https://www.pge.com/fera", "1-866-743-2273"),
    "wic": ("https://myfamily.wic.ca.gov/", "1-800-852-5770"),
    "school_meals": ("https://www.cde.ca.gov/ls/nu/sn/cauniversalmeals.asp", None),
    "caleitc": ("https://www.ftb.ca.gov/file/personal/credits/caleitc/index.html", None),
}

# City, county, latitude, longitude, other names, postcodes or their first three digits.
PLACES = [
    ("San Jose", "Santa Clara County", 37.3382, -121.8863, "SJ|San José", "951"),
    ("Santa Clara", "Santa Clara County", 37.3541, -121.9552, "", "95050 95051 95053 95054"),
    ("Sunnyvale", "Santa Clara County", 37.3688, -122.0363, "", "94085 94086 94087 94089"),
    ("Mountain View", "Santa Clara County", 37.3861, -122.0839, "Mtn View", "94040 94041 94043"),
    ("Los Altos", "Santa Clara County", 37.3852, -122.1141, "", "94022 94024"),
    ("Los Altos Hills", "Santa Clara County", 37.3797, -122.1375, "", ""),
    ("Palo Alto", "Santa Clara County", 37.4419, -122.143, "", "94301 94304 94306"),
    ("Stanford", "Santa Clara County", 37.4275, -122.1697, "", "94305 94309"),
    ("Cupertino", "Santa Clara County", 37.323, -122.0322, "", "95014"),
    ("Campbell", "Santa Clara County", 37.2872, -121.95, "", "95008"),
    ("Los Gatos", "Santa Clara County", 37.2358, -121.9624, "", "95030 95031 95032 95033"),
    ("Saratoga", "Santa Clara County", 37.2638, -122.023, "", "95070"),
    ("Milpitas", "Santa Clara County", 37.4323, -121.8996, "", "95035 95036"),
    ("Morgan Hill", "Santa Clara County", 37.1305, -121.6544, "", "95037 95038"),
    ("Gilroy", "Santa Clara County", 37.0058, -121.5683, "", "95020 95021"),
    ("East Palo Alto", "San Mateo County", 37.4688, -122.1411, "EPA", "94303"),
    ("Menlo Park", "San Mateo County", 37.453, -122.1817, "", "94025 94026"),
    ("Atherton", "San Mateo County", 37.4613, -122.1977, "", "94027"),
    ("Redwood City", "San Mateo County", 37.4852, -122.2364, "RWC", "94061 94062 94063 94064 94065"),
    ("San Carlos", "San Mateo County", 37.5072, -122.2605, "", "94070"),
    ("Belmont", "San Mateo County", 37.5202, -122.2758, "", "94002"),
    ("Foster City", "San Mateo County", 37.5585, -122.2711, "", "94404"),
    ("San Mateo", "San Mateo County", 37.563, -122.3255, "", "94401 94402 94403"),
    ("Burlingame", "San Mateo County", 37.5841, -122.3661, "", "94010"),
    ("Millbrae", "San Mateo County", 37.5985, -122.3872, "", "94030"),
    ("San Bruno", "San Mateo County", 37.6305, -122.4111, "", "94066"),
    ("South San Francisco", "San Mateo County", 37.6547, -122.4077, "South SF|South City|SSF", "94080"),
    ("Daly City", "San Mateo County", 37.6879, -122.4702, "", "94014 94015 94016"),
    ("Pacifica", "San Mateo County", 37.6138, -122.4869, "", "94044"),
    ("Half Moon Bay", "San Mateo County", 37.4636, -122.4286, "", "94019"),
    ("San Francisco", "San Francisco County", 37.7749, -122.4194, "SF|San Fran|Frisco", "941"),
    ("Oakland", "Alameda County", 37.8044, -122.2712, "", "946"),
    ("Berkeley", "Alameda County", 37.8716, -122.2727, "", "947"),
    ("Fremont", "Alameda County", 37.5485, -121.9886, "", "94536 94537 94538 94539 94555"),
    ("Hayward", "Alameda County", 37.6688, -122.0808, "", "94540 94541 94542 94543 94544 94545"),
    ("Union City", "Alameda County", 37.5934, -122.0439, "", "94587"),
    ("Newark", "Alameda County", 37.5297, -122.0402, "", "94560"),
    ("San Leandro", "Alameda County", 37.7249, -122.1561, "", "94577 94578 94579"),
    ("Alameda", "Alameda County", 37.7652, -122.2416, "", "94501 94502"),
    ("Santa Cruz", "Santa Cruz County", 36.9741, -122.0308, "", "950"),
]


def places(spark: SparkSession) -> DataFrame:
    rows = [(k, *p[:4], p[4].split("|") if p[4] else [], p[5].split()) for k, p in enumerate(PLACES)]
    return spark.createDataFrame(rows, "ord int, city string, county string, lat double, lng double, aliases array<string>, zips array<string>")


def median_income(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MEDIAN_INCOME.items()), "county_key string, ami double")


def food_years(spark: SparkSession) -> DataFrame:
    schema = "effective string, label string, allotment array<int>, step int, deduction array<int>, shelter_cap int, minimum int, fpl_base int, fpl_step int"
    return spark.createDataFrame(FOOD_YEARS, schema)
