"""What a page is about, whether it offers help, and the category of its programme, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.vocabulary import ACTIONS, CATEGORY_WORDS, DIRECT_SERVICES, HELP_SIGNALS, NAMED_PROGRAMS, PAGE_TYPES, SEEKERS, TOPICS
from .text import let
from .urls import path


# Why a page is kept or skipped.
KEPT, NO_TOPIC, NO_HELP = "Matches assistance topics and practical help or a named program.", "No supported assistance topic was found in the main page content.", "A topic is mentioned, but no practical help or named assistance program was found."
SKIPPED = "Skipped %s page; follow its program links instead."


def whole_words(words: str) -> str:
    """The pattern of any of the words, whole and in any case. Letters that none of them begins with are passed over by one look, before the limit of a word and the words themselves are tried."""
    starts, depth = {""}, 0
    for k, x in enumerate(words):
        if depth == 0 and (k == 0 or words[k - 1] == "|"):
            starts.add(re.sub(r"^(?:\(\?<!.*?\))+", "", words[k:])[:1])
        depth += (x == "(") - (x == ")")
    first = "".join(sorted(starts))
    return rf"(?i)(?=[{first}])\b(?:{words})\b" if re.fullmatch("[a-z]+", first) else rf"(?i)\b(?:{words})\b"


def first_match(text: Column, words: str) -> Column:
    """The first match in lower case, null without one."""
    return F.nullif(F.lower(F.regexp_extract(text, whole_words(words), 0)), F.lit(""))


def says(text: Column, words: str) -> Column:
    return F.coalesce(text.rlike(whole_words(words)), F.lit(False))


def relevance(url: Column, title: Column, description: Column, headings: Column, text: Column, links: Column) -> Column:
    """struct(score, relevant, topics, page_types, matched_terms, reason) of a page.

    A topic counts 4 in the title, 3 in a heading, 2 in the description, else 1 in the text; signs of help 2 each, a named
    programme 5, a direct service 4, a kind of page without help -4 each. A page is relevant if its title, headings or text
    have a topic and some help, and it is of no such kind; recruiting pages pass if they are for job seekers, news and
    statistics if they link to an application.
    """
    empty = F.lit("")
    heads = F.array_join(F.coalesce(headings, F.array().cast("array<string>")), "\n")
    fields = [(F.coalesce(title, empty), 4), (heads, 3), (F.coalesce(description, empty), 2), (F.coalesce(text, empty), 1)]
    identity = F.concat_ws("\n", F.coalesce(title, empty), F.coalesce(F.try_element_at(headings, F.lit(1)), empty))
    body = F.concat_ws("\n", F.coalesce(title, empty), heads, F.coalesce(text, empty))

    def of_topic(name: str, words: str, in_body: Column) -> Column:
        w = F.lit(0)
        for field, points in reversed(fields):
            w = F.when(says(field, words), points).otherwise(w)
        about = F.coalesce(description, empty)
        # no word goes over the end of a line, so what the body hasn't got is neither in title, headings nor text
        own = F.when(in_body, F.coalesce(*(first_match(field, words) for field, _ in fields))).otherwise(first_match(about, words))
        return F.struct(F.lit(name).alias("topic"), F.when(in_body, w).otherwise(F.when(says(about, words), 2).otherwise(0)).alias("w"), own.alias("term"), in_body.alias("in_body"))

    def read(whole: Column) -> Column:
        topic = lambda name, words: let(says(whole, words), lambda x: of_topic(name, words, x))
        term = lambda words: let(says(whole, words), lambda x: F.when(x, first_match(whole, words)))
        return F.struct(F.array(*(topic(*t) for t in TOPICS.items())).alias("topics"), F.array(*map(term, (*HELP_SIGNALS.values(), NAMED_PROGRAMS, DIRECT_SERVICES))).alias("help"))

    return let(let(body, read), lambda r: _judged(url, identity, description, text, links, r))


def _judged(url: Column, identity: Column, description: Column, text: Column, links: Column, r: Column) -> Column:
    """relevance() of what was found: struct(topics, help)."""
    empty, n = F.lit(""), len(HELP_SIGNALS)
    topics = F.filter(r["topics"], lambda x: x["w"] > 0)
    on_topic = F.exists(r["topics"], lambda x: x["in_body"])
    n_help = F.size(F.filter(F.slice(r["help"], 1, n), lambda x: x.isNotNull()))
    named, direct = F.get(r["help"], F.lit(n)).isNotNull(), F.get(r["help"], F.lit(n + 1)).isNotNull()
    terms = F.concat(F.transform(r["topics"], lambda x: x["term"]), r["help"])
    kinds = F.filter(F.array(*(F.when(says(identity, words) | F.coalesce(path(url).rlike(rf"(?i)/(?:{paths})(?:/|$)"), F.lit(False)), k) for k, (words, paths) in PAGE_TYPES.items())), lambda x: x.isNotNull())
    actionable = F.coalesce(F.exists(links, lambda x: ~F.coalesce(x["navigation"], F.lit(False)) & says(x["text"], ACTIONS)), F.lit(False))
    seekers = says(F.concat_ws("\n", identity, F.coalesce(description, empty), F.coalesce(text, empty)), SEEKERS)
    bar = F.filter(kinds, lambda k: F.when(k == "employer_recruitment", ~seekers).when(k.isin("news_or_archive", "research_or_statistics"), ~actionable).otherwise(True))
    barred, enough = F.size(bar) > 0, (n_help > 0) | named | direct
    reason = F.when(barred, F.format_string(SKIPPED, F.replace(F.try_element_at(bar, F.lit(1)), F.lit("_"), F.lit(" ")))).when(~on_topic, NO_TOPIC).when(~enough, NO_HELP).otherwise(KEPT)
    score = F.aggregate(topics, F.lit(0), lambda a, x: a + x["w"]) + n_help * 2 + named.cast("int") * 5 + direct.cast("int") * 4 - F.size(kinds) * 4
    return F.struct(
        score.alias("score"), (~barred & on_topic & enough).alias("relevant"), F.transform(topics, lambda x: x["topic"]).alias("topics"), kinds.alias("page_types"),
        F.array_distinct(F.array_compact(terms)).alias("matched_terms"), reason.alias("reason"),
    )


def category(url: Column, name: Column, description: Column) -> Column:
    """The category of a programme: by its title in the order of the list; a housing page about housing; else what its first 300 characters name first. Null if nothing does."""
    by_name = F.lit(None).cast("string")
    for c, words in reversed(CATEGORY_WORDS.items()):
        by_name = F.when(says(name, words), c).otherwise(by_name)
    intro = F.substring(F.coalesce(description, F.lit("")), 1, 300)
    housing = path(url).rlike("(?i)/housing-programs/") & says(F.substring(F.coalesce(description, F.lit("")), 1, 900), "housing|rental assistance|homelessness")
    at = F.array(*(F.struct(F.regexp_instr(intro, F.lit(rf"(?i)\b(?:{words})\b")).alias("at"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, (c, words) in enumerate(CATEGORY_WORDS.items())))
    first = F.array_min(F.filter(at, lambda x: x["at"] > 0))
    return F.coalesce(by_name, F.when(housing, "rental_assistance"), first["c"])
