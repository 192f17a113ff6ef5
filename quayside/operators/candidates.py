"""Pages to candidates for the catalogue: names, keys, descriptions and links as columns, and the merging of candidates that are one programme."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.relevance import category
from ..functions.rules import eligibility, evidence
from ..functions.text import let
from ..functions.urls import host, in_scope, path, scheme
from .dedup import checkpointed

# Endings that aren't part of a name, words that don't tell programmes apart, names too general to identify one.
NAME_ENDING = r"\s+-\s+(?:consumer|medicare services|state of california)\s*$"
NAME_FILLER = r"\b(?:program|programs|services?|service|page)\b"
GENERAL_NAME = r"^(?:(?:food|housing|rental|utility|health|mental health|legal|veteran|family|employment|disability|community|human|social|senior|aging) )?(?:assistance|benefits|help|resources|support|programs|services)(?: (?:and|for|of) .*)?$"
BOILERPLATE_START = r"^(?:state of california|california state government)"
# Pages that only lead to others, by name, by part of a name, by path.
NAVIGATION_NAME = r"^(?:how to apply|other resources?|partners?|contact us|home|welcome|about us|faq|frequently asked questions?|find services in my county|assistance and social programs|find assistance|programs? & services?|benefits? & services?|human services|local resources|program support|who is eligible|what is .+|applying for .+|.+ eligibility|.+ faq|become a volunteer|(?:housing|health|food|utility|rental|benefits|community|sacred heart) programs?|programs - .+|services|legal|community services)\??$"
NAVIGATION_PART = r"\b(?:outreach materials|success stories|social media toolkit|resource videos|citizenship guide|frequently asked questions?|faq)\b|\s-\sHow Do I\s*$"
NAVIGATION_PATH = r"/(?:job_fairs_and_workshops|social-media-toolkit|successstories|my_county)/"
NAVIGATION_SHORT = r"\b(?:outreach|partners?|other resources?)\b"
# Texts of links to applications and to programmes.
ACTION_LINK = r"\b(?:apply|application|enroll|enrollment|register|sign up|get help|request (?:help|assistance)|find (?:help|a service|a program)|contact|call)\b"
DIRECT_LINK = r"\b(?:apply now|request (?:help|assistance)|contact us|find help)\b"
APPLY_LINK = r"\b(?:apply|application|enroll|register)\b"
PROGRAM_LINK = r"\b(?:program|service|assistance|benefits?|support|resources?|help|apply|application)\b"
# A tax credit with a name and office of its own, and where it is described first-hand.
TAX_CREDIT, TAX_CREDIT_NAME, TAX_CREDIT_OFFICE = r"\b(?:earned income tax credit|caleitc)\b", "California Earned Income Tax Credit", "California Franchise Tax Board"
TAX_CREDIT_HOST, TAX_CREDIT_URL, GOVERNMENT_HOST = r"ftb\.ca\.gov$", "earned income tax credit|caleitc", r"(?:^|\.)ca\.gov$"
# Preambles of descriptions.
REFERRAL, DETAILS = "How To Find Services In My Area", "What Services Are Available"
# Answers of bot protection, its scripts, pages that need scripts, and their sizes.
CHALLENGE = r"request unsuccessful\.\s*incapsula incident id|<title>\s*(?:just a moment|attention required|access denied|verify you are human)|id=[\"']challenge-form[\"']"
CHALLENGE_SCRIPT, CHALLENGE_SIZE = r"_Incapsula_Resource|cf-chl-|captcha-delivery\.com", 15_000
NEEDS_SCRIPT, SHELL_SIZE = r"(?:enable|requires?|turn on)\s+(?:your\s+)?(?:java\s*script|javascript)|you need to enable javascript", 200
#: How many links of a page are kept, and how many places in order lie in one step of `group_candidates`.
LINKS, SPAN = 40, 1 << 16


def matches(c: Column, words: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){words}"), F.lit(False))


def squeeze(c: Column, most: int = 800) -> Column:
    """Runs of white space as one blank, none at the ends, at most so many characters; null as empty."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s ]+", " ")), 1, most)


def plain(c: Column) -> Column:
    """Letters a-z and digits in lower case, all else as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def accents() -> dict[str, str]:
    """The Latin letters up to U+024F and from U+1E00 that are a-z with marks, by that letter."""
    out: dict[str, str] = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        first, *marks = unicodedata.normalize("NFKD", chr(code).lower())
        if re.fullmatch("[a-z]", first) and marks and all(map(unicodedata.combining, marks)):
            out[first] = out.get(first, "") + chr(code)
    return out


def fold_accents(c: Column, mark: str = "") -> Column:
    """Latin letters with marks as their a-z letter, in lower case, followed by `mark`."""
    for letter, marked in accents().items():
        c = F.regexp_replace(c, f"[{marked}]", letter + mark)
    return c


def slug(name: Column) -> Column:
    """A name for urls: a-z, digits and hyphens, at most 72; an accent within a word divides it, as its decomposed form does."""
    s = F.regexp_replace(fold_accents(F.lower(F.coalesce(name, F.lit(""))), "-"), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 72)
    return F.when(s == "", "resource").otherwise(s)


def stable_id(name: Column, url: Column) -> Column:
    return F.concat(slug(name), F.lit("-"), F.substring(F.sha2(url, 256), 1, 10))


def name_key(name: Column) -> Column:
    """What tells a programme's name from others."""
    s = F.regexp_replace(F.lower(squeeze(name, 220)), f"(?i){NAME_ENDING}", "")
    return plain(F.regexp_replace(s, NAME_FILLER, " "))


def candidate_keys() -> list[Column]:
    """Keys of a candidate(name, organization, category, service_area, description), the strongest first: office with name, office with a telling description, a telling name alone. Null where there is no evidence."""
    c, sep = F.col, "\u001f"
    kind = F.coalesce("category", F.lit("uncategorized"))
    area = F.lower(F.array_join(F.sort_array(F.coalesce("service_area", F.array().cast("array<string>"))), "|"))
    office, name, text = F.lower(F.coalesce("organization", F.lit(""))), name_key(c("name")), plain(squeeze(c("description"), 900))
    telling = (F.length(text) >= 70) & ~text.rlike(BOILERPLATE_START)
    special = (F.length(name) >= 6) & ~name.rlike(GENERAL_NAME)
    return [F.concat_ws(sep, office, name, kind, area), F.when(telling, F.concat_ws(sep, office, kind, area, text)), F.when(special, F.concat_ws(sep, name, kind))]


def page_identity(title: Column, description: Column, excerpt: Column) -> Column:
    """A key of pages that show one programme under several urls: name with description, or with the excerpt where the description says little; null without evidence."""
    name = plain(F.regexp_replace(F.element_at(F.split(F.coalesce(title, F.lit("")), r"\s+\|\s+"), 1), r"(?i)\s+-\s+(?:consumer|state of california)\s*$", ""))
    meta = F.trim(F.coalesce(description, F.lit("")))
    weak = matches(meta, f"{BOILERPLATE_START}$") | (F.length(meta) < 70)
    text = plain(F.when(weak, F.substring(F.coalesce(excerpt, F.lit("")), 1, 900)).otherwise(meta))
    return F.when((F.length(name) >= 8) & (F.length(text) >= 70), F.concat_ws("\u001f", name, text))


def is_navigation(name: Column, description: Column, url: Column) -> Column:
    """Whether a page only leads to programmes."""
    base = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\s+-\s+(?:consumer|state of california)\s*$", ""))
    short = (F.length(F.trim(F.coalesce(description, F.lit("")))) < 80) & matches(name, NAVIGATION_SHORT)
    return matches(base, NAVIGATION_NAME) | matches(name, NAVIGATION_PART) | matches(path(url), NAVIGATION_PATH) | short


def long_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(squeeze(c)), "[^a-z0-9]+"), lambda w: F.length(w) > 3)


def application_link(title: Column, headings: Column, links: Column) -> Column:
    """The url of the first link to an application, else of the first other that offers action: outside menus, about the page's subject or asking to act at once. Null without one."""
    heads = F.array_join(F.slice(F.coalesce(headings, F.array().cast("array<string>")), 1, 2), " ")
    subject = long_words(F.concat_ws(" ", F.coalesce(title, F.lit("")), heads))
    usable = F.filter(links, lambda x: ~F.coalesce(x["navigation"], F.lit(False)) & matches(x["text"], ACTION_LINK) & (F.arrays_overlap(long_words(x["text"]), subject) | matches(x["text"], DIRECT_LINK)))
    first = lambda a: F.try_element_at(a, F.lit(1))["url"]
    return let(usable, lambda u: F.coalesce(first(F.filter(u, lambda x: matches(x["text"], APPLY_LINK))), first(u)))


def program_links(links: Column) -> Column:
    """The first 40 links outside menus whose text names help, or that a section leads elsewhere with."""
    found = F.filter(links, lambda x: ~F.coalesce(x["navigation"], F.lit(False)) & (matches(x["text"], PROGRAM_LINK) | F.coalesce(x["related"], F.lit(False))))
    return F.transform(F.slice(found, 1, LINKS), lambda x: F.struct(x["url"].alias("url"), squeeze(x["text"], 180).alias("text"), squeeze(x["context"], 600).alias("context"), F.coalesce(x["related"], F.lit(False)).alias("related")))


def focused(title: Column, headings: Column, text: Column) -> Column:
    """The text from the heading that names the page on; a menu's mention of it near the start is passed over, and so is a preamble that refers elsewhere."""
    short = F.regexp_replace(squeeze(F.element_at(F.split(F.coalesce(title, F.lit("")), r"\s+\|\s+"), 1), 180), r"(?i)\s+-\s+(?:consumer|medicare services|care options)\s*$", "")

    def names_page(h: Column, t: Column) -> Column:
        k = plain(squeeze(h, 900))
        return (k == t) | ((F.length(t) >= 12) & F.startswith(k, F.concat(t, F.lit(" "))) & (F.length(k) - F.length(t) <= 40))

    def from_heading(x: Column) -> Column:
        low = F.lower(x["text"])
        at = F.position(x["needle"], low)
        again = F.position(x["needle"], low, at + F.length(x["needle"]))
        start = F.when((at <= 250) & again.between(1, 1500), again).otherwise(at)
        return F.when((x["needle"] != "") & (at > 0), F.substr(x["text"], start)).otherwise(x["text"])

    def behind_preamble(t: Column) -> Column:
        refers, details = (F.regexp_instr(t, F.lit(rf"(?i)\b{p}\b")) for p in (REFERRAL, DETAILS))
        return F.when(refers.between(1, 250) & (details > refers) & (details <= 1200), F.trim(F.substr(t, details + len(DETAILS)))).otherwise(t)

    heading = let(plain(squeeze(short, 900)), lambda t: F.try_element_at(F.filter(headings, lambda h: names_page(h, t)), F.lit(1)))
    parts = F.struct(squeeze(text, 60_000).alias("text"), F.lower(squeeze(heading)).alias("needle"))
    return let(let(parts, from_heading), behind_preamble)


def best_description(title: Column, headings: Column, text: Column, excerpt: Column, description: Column) -> Column:
    """The first of focused text, excerpt and description with 100 characters or more, else the longest; empty if all are."""
    every = F.transform(F.array(focused(title, headings, text), excerpt, description), lambda x: squeeze(x, 900))
    long_ = lambda a: F.try_element_at(F.filter(a, lambda x: (F.length(x) >= 100)), F.lit(1))
    return let(every, lambda a: F.coalesce(long_(a), F.aggregate(a, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))))


def with_definitions(recorded: DataFrame, definitions: DataFrame) -> DataFrame:
    """Sources(source_id, ...) as recorded with their definitions, where a recorded value that isn't null wins. Columns that only one side has stay."""
    both = recorded.alias("r").join(definitions.alias("d"), "source_id", "left")
    mine, theirs = set(recorded.columns), set(definitions.columns)
    cols = [c for c in dict.fromkeys([*recorded.columns, *definitions.columns]) if c != "source_id"]
    pick = lambda c: F.coalesce(F.col(f"r.`{c}`"), F.col(f"d.`{c}`")) if c in mine & theirs else F.col(f"{'r' if c in mine else 'd'}.`{c}`")
    return both.select("source_id", *(pick(c).alias(c) for c in cols))


def owners(links: DataFrame, sources: DataFrame) -> DataFrame:
    """links(url, found_by, ...) with `owner`: the source that found the link if it is in its scope, else the first of sources(source_id, ord, origins, prefixes) whose scope it is in; null if none's."""
    s = sources.select(F.struct("source_id", "ord", "origins", "prefixes").alias("_s"), F.explode("origins").alias("_origin"))
    one = links.select("url", "found_by").distinct().withColumn("_origin", F.concat(scheme(F.col("url")), F.lit("://"), host(F.col("url"))))
    fit = one.join(s, "_origin").filter(in_scope(F.col("url"), F.col("_s.origins"), F.col("_s.prefixes")))
    order = F.struct(F.when(F.col("_s.source_id") == F.col("found_by"), 0).otherwise(1), "_s.ord")
    best = fit.groupBy("url", "found_by").agg(F.min_by("_s.source_id", order).alias("owner"))
    keys = best.withColumnsRenamed({"url": "_url", "found_by": "_by"})
    return links.join(keys, (F.col("url") == F.col("_url")) & F.col("found_by").eqNullSafe(F.col("_by")), "left").drop("_url", "_by")


def page_outcome(html: Column, text: Column, relevant: Column) -> Column:
    """What becomes of a fetched page: challenge, script_shell, irrelevant or candidate. Null html or text counts as empty."""
    h = F.coalesce(html, F.lit(""))
    challenge = matches(h, f"(?:{CHALLENGE})") | ((F.length(h) < CHALLENGE_SIZE) & matches(h, f"(?:{CHALLENGE_SCRIPT})"))
    shell = (F.length(F.coalesce(text, F.lit(""))) < SHELL_SIZE) & matches(h, f"(?:{NEEDS_SCRIPT})")
    return F.when(challenge, "challenge").when(shell, "script_shell").when(~F.coalesce(relevant, F.lit(False)), "irrelevant").otherwise("candidate")


def make_candidates(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """A candidate for each of pages(ord, source_id, url, canonical, title, headings, description, text, excerpt, links, phones, emails) that isn't navigation.

    sources(source_id, name, service_area, organization_from_title, skip_eligibility, category_by_path) describe where pages
    come from; a page of an unknown source has a null area and organisation. Pages without rows give a table without rows.
    """
    c = F.col
    s = sources.select("source_id", *(c(x).alias(f"_{x}") for x in ("name", "service_area", "organization_from_title", "skip_eligibility", "category_by_path")))
    home = F.coalesce("canonical", "url")
    raw = F.coalesce(*(F.when(x != "", x) for x in (squeeze(c("title"), 180), squeeze(F.try_element_at("headings", F.lit(1)), 180))), path(c("url")))
    named_by = F.concat_ws(" ", "url", "title", F.try_element_at("headings", F.lit(1)))
    named = pages.join(s, "source_id", "left").select(
        "ord", "url", "canonical", "title", "headings", "text", "excerpt", "links", "phones", "emails", "description", *(x for x in s.columns if x != "source_id"),
        F.when(matches(named_by, TAX_CREDIT), TAX_CREDIT_NAME).otherwise(squeeze(F.element_at(F.split(raw, r"\s+\|\s+"), 1), 180)).alias("_title"), home.alias("_home"),
        best_description(c("title"), c("headings"), c("text"), c("excerpt"), c("description")).alias("_about"),
    )
    whole = F.concat_ws(" ", "title", "excerpt", "text")
    curated = F.try_element_at("_category_by_path", F.regexp_replace(path(c("_home")), "/+$", ""))
    office = F.when(matches(whole, TAX_CREDIT), TAX_CREDIT_OFFICE).when(F.coalesce("_organization_from_title", F.lit(False)) & (c("_title") != ""), c("_title")).otherwise(c("_name"))
    rules = eligibility(evidence(c("title"), c("headings"), c("description"), c("excerpt"), c("text")))
    return named.filter(~is_navigation(c("_title"), c("_about"), c("url"))).select(
        "ord", stable_id(c("_title"), c("_home")).alias("id"), c("_title").alias("name"), office.alias("organization"), F.coalesce(curated, category(c("url"), c("_title"), c("_about"))).alias("category"),
        c("_about").alias("description"), F.array("_service_area").alias("service_area"), F.when(~F.coalesce("_skip_eligibility", F.lit(False)), rules).alias("eligibility"),
        F.coalesce(application_link(c("title"), c("headings"), c("links")), "url").alias("application_url"), c("url").alias("source_url"), c("canonical").alias("canonical_url"),
        F.try_element_at("phones", F.lit(1)).alias("phone"), F.try_element_at("emails", F.lit(1)).alias("email"), squeeze(F.coalesce(F.when(c("excerpt") != "", c("excerpt")), "text"), 1200).alias("excerpt"), program_links(c("links")).alias("linked"),
    )


def group_candidates(keys: DataFrame) -> DataFrame:
    """(ord, group) for keys(ord, k, key): candidates in order, each with its keys by strength k; group is the ord of the first of its group.

    A candidate joins the group of the latest one before it with its strongest key that any had, and all its keys then lead
    there, so a candidate that bridges two groups doesn't unite them. The latest holder of a key is known before any group is:
    it is the candidate's parent, and groups are the roots of that forest, found by doubling. Latest holders are looked up
    within spans of the order, then between spans, so that a key of very many candidates isn't one task's. Null keys mark nothing.
    """
    marks = checkpointed(keys.filter("key is not null").select("ord", "k", "key", F.floor(F.col("ord") / SPAN).alias("span")))
    within = Window.partitionBy("k", "key", "span").orderBy("ord")
    ends = marks.groupBy("k", "key", "span").agg(F.max("ord").alias("last"))
    earlier = ends.withColumn("before", F.lag("last").over(Window.partitionBy("k", "key").orderBy("span"))).drop("last")
    near = marks.withColumn("near", F.lag("ord").over(within))
    held = near.join(earlier, ["k", "key", "span"]).select("ord", "k", F.coalesce("near", "before").alias("parent")).filter("parent is not null")
    parents = held.groupBy("ord").agg(F.min_by("parent", "k").alias("group"))
    tree = checkpointed(keys.select("ord").distinct().join(parents, "ord", "left").select("ord", F.coalesce("group", "ord").alias("group")))
    while True:
        up = tree.select(F.col("ord").alias("group"), F.col("group").alias("up"))
        new = checkpointed(tree.join(up, "group").select("ord", "group", "up"))
        tree = new.select("ord", F.col("up").alias("group"))
        if not new.filter("up <> group").limit(1).count():
            return tree


def merge_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, links) of candidates(ord, name, organization, category, service_area, description, source_url, eligibility, linked, ...): one record for each group, with `n_merged`, and its linked programmes as (group, place, url, ...).

    The record of a group is that of its first candidate with eligibility, or of its first if none has; among those that
    qualify so, the latest first-hand one goes before the first government one, and this before the first. A linked url
    keeps the place where it was first seen and what was last seen of it.
    """
    c = F.col
    keyed = candidates.select("ord", F.posexplode(F.array(*candidate_keys())).alias("k", "key"))
    rules = F.coalesce(*(F.when(c(f"eligibility.{f}").isNotNull(), F.lit(True)) for f in candidates.schema["eligibility"].dataType.names), F.lit(False)) if candidates.schema["eligibility"].dataType.typeName() == "struct" else F.coalesce(c("eligibility"), F.lit(False)).cast("boolean")
    site = F.regexp_replace(host(c("source_url")), r":\d+$", "")
    first_hand = matches(site, TAX_CREDIT_HOST) & matches(c("source_url"), f"(?:{TAX_CREDIT_URL})")
    of = group_candidates(keyed)
    flags = candidates.select("ord", rules.alias("e"), first_hand.alias("p"), matches(site, GOVERNMENT_HOST).alias("g")).join(of, "ord")
    best = lambda ok: F.coalesce(F.max(F.when(ok & c("p"), c("ord"))), F.min(F.when(ok & c("g"), c("ord"))), F.min(F.when(ok, c("ord"))))
    chosen = flags.groupBy("group").agg(F.coalesce(best(c("e")), best(F.lit(True))).alias("ord"), F.count("*").alias("n_merged"))
    each = candidates.select("ord", F.posexplode("linked").alias("i", "l")).join(of, "ord").select("group", F.struct("ord", "i").alias("at"), "l")
    links = each.groupBy("group", "l.url").agg(F.min("at").alias("place"), F.max_by("l", "at").alias("l")).select("group", "place", "l.*")
    return candidates.join(chosen, "ord"), links
