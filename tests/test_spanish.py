"""Spanish sentences; the sentences and what they say are fixed values."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quayside.functions import spanish as S
from quayside.functions import text as T
from quayside.sources.spanish import MARKERS, REWRITES


def in_order(text):
    """One rewrite after another over the whole text."""
    t = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not "\u0300" <= c <= "\u036f")
    for pattern, words in (r for rules in REWRITES for r in rules):
        t = re.sub(pattern, words.replace("$1", r"\1"), t)
    return t


def test_one_pass_a_list_equals_one_pass_a_rule(spark):
    rng = random.Random(12)
    # words of all patterns, so that phrases and parts of phrases meet in any order
    words = sorted({w for rules in REWRITES for p, _ in rules for w in re.findall(r"[a-z]{1,}", re.sub(r"\\[bd]|\{2\}", " ", p))}) + ["70", "20", ",", ".", "mí", "niños", "años", "MAMÁ"]
    phrases = ["mi mama soltera", "aviso de tres dias", "no tengo hijos", "no tengo donde dormir", "tengo 70 años", "recibo de la luz", "nos van a cortar la luz", "me pega", "no soy veterano", "un hijo", "debo la renta", "vivo en mi carro", "sin trabajo"]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(phrases) for _ in range(rng.randrange(1, 25))) for _ in range(3000)] + ["", "\u0001\u0002 renta"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4).select("k", S.to_english(F.col("t")).alias("e")).collect()
    bad = [(texts[r.k], r.e, in_order(texts[r.k])) for r in got if r.e != in_order(texts[r.k].replace("\u0001", "").replace("\u0002", ""))]
    assert not bad, bad[:3]


def test_language_by_the_share_of_markers(spark):
    texts = ["Necesito ayuda con la renta", "I live in San Jose with my son, rent is due", "con mi", "", None, "para " + "word " * 20, "hola"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", S.looks_spanish(F.col("t")).alias("s")).collect()
    share = lambda t: len(re.findall(MARKERS, t or "")) >= 2 and len(re.findall(MARKERS, t.lower())) / max(1, len(t.split())) >= 0.15
    assert [r.s for r in sorted(got)] == [share(t) for t in texts]


def test_sentences(spark):
    said = [
        "Vivo en San José con mi esposo y dos hijos. Me dieron un aviso de desalojo y gano 2000 dólares al mes.", "Necesito ayuda con la renta y comida. Somos una familia de 5.", "No tengo trabajo y nos van a cortar la luz", "vivo en mi carro, no tengo donde dormir",
        "Tengo 70 años, vivo sola y recibo 1100 del seguro social", "Gano 2400 dólares al mes y la renta es 2100.", "Pago 1800 de renta y gano 3000 al mes", "I live in San Jose with my son, rent is due",
    ]
    rows = sorted(T.parse(spark.createDataFrame(list(enumerate(said)), "key int, text string")).collect(), key=lambda r: r.key)
    assert (rows[0].city, rows[0].housing_status, rows[0].household_size, rows[0].monthly_income) == ("San Jose", "eviction_notice", 4, 2000) and {"rental_assistance", "legal"} <= set(rows[0].needs)
    assert (rows[1].household_size, rows[1].needs) == (5, ["rental_assistance", "food"])
    assert {"employment", "utility"} <= set(rows[2].needs) and rows[3].housing_status == "unhoused"
    assert (rows[4].monthly_income, rows[4].income_source, rows[4].household_size, rows[4].age) == (1100, "unearned", 1, 70)
    assert [r.monthly_housing_cost for r in rows[5:7]] == [2100, 1800] and rows[7].city == "San Jose"


def test_matches_are_seen_with_what_is_near(spark):
    text = "ab" * 50 + " x1 " + "no x2x3x4 tail " + "cd" * 50
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(T.hits(F.col("t"), r"x\d", 7, 5).alias("h")).collect()
    want = [(m.group(), text[max(0, m.start() - 7) : m.start()], text[m.end() : m.end() + 5]) for m in re.finditer(r"x\d", text)]
    assert [tuple(h) for h in got[0].h] == want and not got[1].h and not got[2].h
