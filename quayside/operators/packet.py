"""What to bring, whom to call and what to do first, as rows with message keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources import prose as P
from .explain import filled, labels, templates
from .messages import money

TOP = 4
# Kinds of documents and the words that name them, first match wins; their order on a list; documents of each benefit; questions of open factors.
PATTERNS = [
    ("notice", r"(?i)\b(?:eviction|notice to|pay or quit|3[- ]day|summons|unlawful detainer|court papers)\b"),
    ("rentOwed", r"(?i)\b(?:ledger|past[- ]due|rent owed|amount owed)\b"),
    ("lease", r"(?i)\b(?:lease|rental agreement)\b"),
    ("utilityBill", r"(?i)\b(?:utility|pg&?e|energy|electric|gas|water) (?:bill|statement|notice)|shut[- ]?off notice\b"),
    ("income", r"(?i)\b(?:income|pay ?stubs?|paychecks?|earnings|award letter|benefit(?:s)? letter|tax return|w-?2|1099|unemployment)\b"),
    ("dd214", r"(?i)\b(?:dd[- ]?214|discharge papers|military discharge)\b"),
    ("ssn", r"(?i)\b(?:social security (?:card|number)|ssn)\b"),
    ("birth", r"(?i)\bbirth certificates?\b"),
    ("insurance", r"(?i)\b(?:insurance card|medi-?cal card|medicare card|health (?:plan|insurance))\b"),
    ("bank", r"(?i)\bbank statements?\b"),
    ("address", r"(?i)\b(?:proof of (?:address|residen\w+)|residency|address)\b"),
    ("id", r"(?i)\b(?:photo id|\bid\b|identification|driver'?s licen[sc]e|passport|state id)\b"),
]
ORDER = ["notice", "id", "income", "lease", "rentOwed", "utilityBill", "pgeAccount", "address", "ssn", "birth", "dd214", "insurance", "bank"]
BENEFIT_DOCUMENTS = {"calfresh": ["id", "income", "lease", "utilityBill"], "medi_cal": ["id", "income", "address"], "medi_cal_kids": ["birth", "income", "address"], "care": ["pgeAccount"], "fera": ["pgeAccount"], "wic": ["id", "address", "income"]}
QUESTIONS = ["service_area", "income_limit", "housing_status", "eviction_notice", "children", "veteran", "other_conditions"]
CLOSING = ["docs", "time", "waitlist", "else"]
# Under which key the question of an open factor stands, and the fact that a housing status is.
QUESTION_KEYS = {"service_area": "area", "income_limit": "income", "housing_status": "housing", "eviction_notice": "notice", "children": "children", "veteran": "veteran", "other_conditions": "other"}
STATUS_FACTS = {"eviction_notice": "notice", "housed_at_risk": "behind", "unhoused": "unhoused"}


def document_key(raw: Column) -> Column:
    """The kind of a document; one that no pattern names stands for itself."""
    kind = F.lit(None).cast("string")
    for key, pattern in reversed(PATTERNS):
        kind = F.when(raw.rlike(pattern), key).otherwise(kind)
    return F.coalesce(kind, F.concat(F.lit("raw:"), F.lower(raw)))


def documents(sit: DataFrame, benefits: DataFrame, top: DataFrame) -> DataFrame:
    """(sit_id, key, pos, for_what, tip): one row for each document that the situation, benefits(sit_id, benefit_id, ord) or programmes top(sit_id, rank, name, required_documents) ask for, and who asks, in order."""
    c = F.col
    own = sit.select("sit_id", F.explode(F.filter(F.array(F.when(c("housing_status") == "eviction_notice", F.struct(F.lit("notice").alias("key"), F.lit("legal").alias("what"))), F.when(c("is_veteran"), F.struct(F.lit("dd214").alias("key"), F.lit("veteran").alias("what")))), lambda x: x.isNotNull())).alias("x"))
    own = own.select("sit_id", "x.key", "x.what", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("seq"))
    table = F.create_map(*(x for k, v in BENEFIT_DOCUMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    by_benefit = benefits.select("sit_id", "benefit_id", "ord", F.posexplode(table[c("benefit_id")]).alias("k", "key")).join(sit.select("sit_id", "housing_status"), "sit_id")
    by_benefit = by_benefit.filter((c("key") != "lease") | ~F.coalesce(c("housing_status") == "unhoused", F.lit(False))).select("sit_id", "key", c("benefit_id").alias("what"), F.struct(F.lit(1).alias("a"), c("ord").alias("b"), c("k").alias("c")).alias("seq"))
    by_programme = top.select("sit_id", "rank", "name", F.posexplode("required_documents").alias("k", "raw")).select("sit_id", document_key(c("raw")).alias("key"), c("name").alias("what"), F.struct(F.lit(2).alias("a"), c("rank").alias("b"), c("k").alias("c")).alias("seq"))
    asked = own.unionByName(by_benefit).unionByName(by_programme)
    each = asked.groupBy("sit_id", "key", "what").agg(F.min("seq").alias("seq"))
    rows = each.groupBy("sit_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "what"))), lambda x: x["what"]).alias("for_what"), F.min("seq").alias("seq"))
    place = F.array_position(F.array(*map(F.lit, ORDER)), c("key"))
    tip = F.when((c("key") == "address") & (c("housing_status") == "unhoused"), "unhoused").when((c("key") == "income") & (c("monthly_income") == 0), "none").when(c("key").isin("income", "id"), c("key"))
    return rows.withColumn("pos", F.when(place == 0, len(ORDER) + 1).otherwise(place).cast("int")).join(sit.select("sit_id", "housing_status", "monthly_income"), "sit_id").select("sit_id", "key", "pos", "for_what", tip.alias("tip"), "seq")


def calls(top: DataFrame) -> DataFrame:
    """(sit_id, rank, id, questions): what to ask each programme: its open factors in order, then what to ask always."""
    open_ = F.transform(F.filter("breakdown", lambda i: (i["status"] == "unverified") & i["factor"].isin(QUESTIONS)), lambda i: i["factor"])
    return top.select("sit_id", "rank", "id", F.concat(F.array_distinct(open_), F.array(*map(F.lit, CLOSING))).alias("questions"))


def facts_sentence(t: Column) -> Column:
    """What a person tells first, in the language of the texts t: place, household, income, housing, service. Unknown facts are left out; without any it is empty."""
    c = F.col
    said = lambda key, **places: filled(t[f"call.fact.{key}"], **places)
    place, size, income = F.coalesce("location.city", "location.county"), c("household_size"), c("monthly_income")
    housing = labels(STATUS_FACTS, c("housing_status"))
    parts = [
        F.when(place != "", said("place", place=place)),
        F.when(size == 1, said("alone")).when(size != 0, said("household", n=size)),
        F.when(income == 0, said("noIncome")).when(income.isNotNull(), said("income", amount=money(income))),
        F.when(housing.isNotNull(), F.element_at(t, F.concat(F.lit("call.fact."), housing))),
        F.when(c("is_veteran"), said("veteran")),
    ]
    return F.concat_ws(" ", *parts)


def scripts(sit: DataFrame, top: DataFrame) -> DataFrame:
    """(sit_id, rank, id, lang, opener, questions) for each programme of top(sit_id, rank, id, name, breakdown): how to begin a call and what to ask, in the language of sit(sit_id, lang, location, household_size, monthly_income, housing_status, is_veteran).

    Open factors come first, in the order of the breakdown, each text once; then what to ask always. An unknown place or
    household size is left empty in a question. A language without texts, and none, gets English ones. A programme without
    a breakdown has the closing questions; programmes of situations that sit hasn't got give no row.
    """
    c = F.col
    facts = ("location", "household_size", "monthly_income", "housing_status", "is_veteran")
    people = sit.select("sit_id", F.coalesce("lang", F.lit("en")).alias("lang"), *facts).join(F.broadcast(templates(sit.sparkSession)), c("lang") == c("t_lang"), "left")
    english = F.create_map(*(F.lit(x) for pair in P.ENGLISH.items() for x in pair))
    people = people.withColumn("_t", F.coalesce("t", english)).select("sit_id", "lang", "_t", facts_sentence(c("_t")).alias("_facts"), F.coalesce("location.city", "location.county", F.lit("")).alias("_place"), F.coalesce(c("household_size").cast("string"), F.lit("")).alias("_size"))
    rows = top.select("sit_id", "rank", "id", "name", "breakdown").join(people, "sit_id")

    def asked(t: Column) -> Column:
        open_ = F.filter(c("breakdown"), lambda b: (b["status"] == "unverified") & b["factor"].isin(list(QUESTION_KEYS)))
        own = F.transform(open_, lambda b: filled(F.element_at(t, F.concat(F.lit("call.q."), labels(QUESTION_KEYS, b["factor"]))), place=c("_place"), size=c("_size")))
        return F.concat(F.coalesce(F.array_distinct(own), F.array().cast("array<string>")), F.array(*(t[f"call.q.{k}"] for k in CLOSING)))

    lead = F.when(c("_facts") == "", "").otherwise(F.concat(F.lit(" "), "_facts"))
    opener = lambda t: F.trim(filled(t["call.opener"], program=F.coalesce("name", F.lit("")), facts=lead))
    said = let(c("_t"), lambda t: F.struct(opener(t).alias("opener"), asked(t).alias("questions")))
    return rows.withColumn("_said", said).select("sit_id", "rank", "id", "lang", "_said.opener", "_said.questions")


def steps(sit: DataFrame, benefits: DataFrame, top: DataFrame) -> DataFrame:
    """(sit_id, steps): array of struct(when, key) in order: safety and deadlines, the first call if housing is at risk, benefits, other calls, the folder."""
    c = F.col
    needs = F.coalesce("needs", F.array().cast("array<string>"))
    got = benefits.groupBy("sit_id").agg(F.collect_set("benefit_id").alias("got"))
    named = top.groupBy("sit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    d = sit.join(got, "sit_id", "left").join(named, "sit_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>"))).withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    step = lambda when, key: F.struct((when if isinstance(when, Column) else F.lit(when)).alias("when"), (key if isinstance(key, Column) else F.lit(key)).alias("key"))
    compact = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    has = lambda *ids: F.arrays_overlap("got", F.array(*map(F.lit, ids)))
    utility = F.array_contains(needs, "utility")
    urgent = compact(F.when(c("housing_status") == "eviction_notice", step("today", "eviction")), F.when(c("housing_status") == "unhoused", step("today", "unhoused")))
    food_when = F.when((c("monthly_income") == 0) | F.array_contains(needs, "food"), "today").otherwise("week")
    middle = compact(F.when(utility, step("today", "utility")), F.when(has("calfresh"), step(food_when, "calfresh")), F.when(has("medi_cal", "medi_cal_kids"), step("week", "medical")), F.when(has("care", "fera") & ~utility, step("week", "care")), F.when(has("wic"), step("week", "wic")))
    at_risk = F.coalesce(c("housing_status").isin("housed_at_risk", "eviction_notice", "unhoused"), F.lit(False))
    none = F.array().cast("array<struct<when:string,key:string>>")
    call = lambda when, i: F.struct(when.alias("when"), F.concat(F.lit("call:"), i).alias("key"))
    before = F.concat(urgent, middle)
    first_when = F.when(at_risk, "today").when(F.exists(before, lambda x: x["when"] == "today"), "week").otherwise("today")
    first = F.when(F.size("ids") > 0, F.array(call(first_when, c("ids")[0]))).otherwise(none)
    rest = F.transform(F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 1, F.lit(0))), lambda i: call(F.lit("week"), i))
    head = F.when(at_risk, F.concat(urgent, first, middle)).otherwise(F.concat(urgent, middle, first))
    return d.select("sit_id", F.concat(head, rest, F.array(step("next", "folder"))).alias("steps"))
