"""From fetched pages to programmes: one reading of the pages, then errors, leads, duplicates, skipped pages and candidates from what was read."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.relevance import relevance
from ..functions.urls import normalize_url
from . import candidates as C
from .catalogue import leads as leads_of
from .dedup import checkpointed, first_seen
from .pages import extract_pages, page_keys, page_links

#: How far from a start page links are followed.
DEPTH = 4
# Types of content that are read, and names of what can go wrong with a page.
HTML_TYPES = r"(?i)text/html|application/xhtml\+xml"
HTTP, CHALLENGE, SCRIPT = "HTTP", "ACCESS_CHALLENGE", "JAVASCRIPT_REQUIRED"
UNSUPPORTED, SCRIPT_LEAD = "unsupported_content_type", "javascript_required"
REDIRECT, SAME_CONTENT, SAME_PROGRAM = "redirect", "same_content", "same_program_name_and_description"


class Curation:
    """outcomes(page_id, outcome, reason, of): kept, duplicate, irrelevant, error or lead, one row for each page; errors(page_id, url, code, status); leads(url, found_from, reason, kind, text); skipped(page_id, url, title, reason); records: the kept pages; candidates and links: merged programmes and where they lead; totals: one row.

    The pages are read at once; each result is made when it is first asked for, and then stays, so that who wants one
    doesn't wait for the others.
    """

    def __init__(self, read: DataFrame, counts: dict, sources: DataFrame, depth: int):
        self._read, self._counts, self._sources, self._depth = read, counts, sources, depth
        self._good = read.filter(F.col("code").isNull())

    @cached_property
    def _judged(self) -> DataFrame:
        return checkpointed(same_pages(self._good))

    @cached_property
    def outcomes(self) -> DataFrame:
        code = F.col("code")
        return self._judged.unionByName(self._read.filter(code.isNotNull()).select("page_id", F.when(code == UNSUPPORTED, "lead").otherwise("error").alias("outcome"), code.alias("reason"), F.lit(None).cast("long").alias("of")))

    @cached_property
    def errors(self) -> DataFrame:
        return self._read.filter(F.col("code").isin(HTTP, CHALLENGE, SCRIPT)).select("page_id", "url", "code", "status")

    @cached_property
    def leads(self) -> DataFrame:
        """Leads among the links of every page that was read, kept or not, and pages that can't be read."""
        c, code = F.col, F.col("code")
        once = first_fetched(self._good.select("page_id", "url", "source_id", "depth", "links")).filter("page_id = first")
        here = once.select("page_id", c("url").alias("found_from"), "source_id", "depth")
        links = page_links(once).drop("kind").join(here, "page_id").withColumnsRenamed({"source_id": "found_by"})
        owned = C.owners(links.withColumn("depth", c("depth") + 1), self._sources)
        pending = self._read.filter(code.isin(UNSUPPORTED, SCRIPT)).select(normalize_url(c("url")).alias("url"), F.lit(None).cast("string").alias("found_from"), F.when(code == SCRIPT, SCRIPT_LEAD).otherwise(UNSUPPORTED).alias("reason"), F.lit("page").alias("kind"), F.coalesce("title", F.lit("")).alias("text"))
        return checkpointed(leads_of(owned, self._depth).unionByName(pending.filter("url is not null").dropDuplicates(["url", "reason"])))

    @cached_property
    def records(self) -> DataFrame:
        return self._read.join(self._judged.filter("outcome = 'kept'").select("page_id"), "page_id", "left_semi")

    @cached_property
    def _merged(self) -> tuple[DataFrame, DataFrame]:
        c = F.col
        own = C.owners(self.records.select("page_id", normalize_url(c("url")).alias("url"), c("source_id").alias("found_by")), self._sources).select("page_id", "owner")
        named = self.records.join(own, "page_id").withColumn("source_id", F.coalesce("source_id", "owner")).withColumn("ord", c("page_id"))
        # one page of each canonical url and content
        home = F.array(F.concat(F.lit("c"), F.coalesce("canonical", "url")), F.concat(F.lit("t"), "content_hash"))
        once = first_seen(named.select(c("page_id").alias("id"), "ord", F.explode(home).alias("key"))).filter("kept").select(c("id").alias("page_id"))
        made = checkpointed(C.make_candidates(named.join(once, "page_id", "left_semi"), self._sources))
        merged, linked = C.merge_candidates(made)
        return checkpointed(merged), linked

    @property
    def candidates(self) -> DataFrame:
        return self._merged[0]

    @property
    def links(self) -> DataFrame:
        return self._merged[1]

    @cached_property
    def skipped(self) -> DataFrame:
        return self._good.join(self._judged.filter("outcome = 'irrelevant'").select("page_id"), "page_id", "left_semi").select("page_id", "url", "title", F.col("relevance.reason").alias("reason"))

    @cached_property
    def totals(self) -> DataFrame:
        n = {r[0]: r[1] for r in self._judged.groupBy("outcome").count().collect()}
        totals = self._counts | {"kept": n.get("kept", 0), "skipped": n.get("irrelevant", 0), "duplicates": n.get("duplicate", 0), "leads": self.leads.count(), "candidates": self.candidates.count(), "uncategorised": self.candidates.filter("category is null").count()}
        return self._read.sparkSession.createDataFrame([tuple(totals.values())], ", ".join(f"{k} long" for k in totals))


def read_once(pages: DataFrame, whole: bool = False) -> tuple[DataFrame, dict]:
    """(records, counts): pages(page_id, url, html, and as far as there are source_id, status, content_type, depth) read in one scan and written down, with `code` where a page can't be used and its relevance; and what the scan counted on its way."""
    c = F.col
    given = {"source_id": F.lit(None).cast("string"), "status": F.lit(200), "content_type": F.lit("text/html"), "depth": F.lit(0)}
    p = pages.select("page_id", "url", "html", *(c(k).cast(t) if k in pages.columns else v.cast(t).alias(k) for (k, v), t in zip(given.items(), ("string", "int", "string", "int"), strict=True)))
    # text counts as long here: what needs the text is told once it is read
    outcome = C.page_outcome(c("html"), F.lit("x" * C.SHELL_SIZE), F.lit(True))
    code = F.when(F.coalesce(c("status") != 200, F.lit(True)), HTTP).when(~F.coalesce(c("content_type").rlike(HTML_TYPES), F.lit(False)), UNSUPPORTED).when(outcome == "challenge", CHALLENGE)
    needs = C.page_outcome(c("html"), F.lit(""), F.lit(True)) == "script_shell"
    flagged = p.withColumns({"code": code, "needs_script": needs}).withColumn("html", F.when(c("code").isNull(), c("html")))
    read = extract_pages(flagged, ("source_id", "status", "depth", "code", "needs_script"), whole)
    read = read.withColumn("code", F.when(c("code").isNull() & c("needs_script") & (c("text_size") < C.SHELL_SIZE), SCRIPT).otherwise(c("code"))).drop("needs_script")
    read = read.withColumn("relevance", F.when(c("code").isNull(), relevance(c("url"), c("title"), c("description"), c("headings"), c("text"), c("links"))))

    seen = Observation(f"pages {uuid.uuid4().hex}")
    is_ = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    counted = read.observe(
        seen, F.count(F.lit(1)).alias("attempted"), is_(c("code").isNull() | (c("code") == SCRIPT)).alias("inspected"), is_(c("code").isin(HTTP, CHALLENGE, SCRIPT)).alias("errors"),
        is_(c("code") == UNSUPPORTED).alias("unsupported"), is_(c("truncated.text") | c("truncated.headings") | c("truncated.links")).alias("truncated"),
    )
    return checkpointed(counted), dict(seen.get)


def first_fetched(good: DataFrame) -> DataFrame:
    """good with `first`, the least page_id of its url; a page without a url in normal form is its own."""
    place = good.withColumn("_url", F.coalesce(normalize_url(F.col("url")), F.concat(F.lit("#"), F.col("page_id").cast("string"))))
    return place.join(place.groupBy("_url").agg(F.min("page_id").alias("first")), "_url").drop("_url")


def same_pages(good: DataFrame) -> DataFrame:
    """(page_id, outcome, reason, of) of usable records, in the order of page_id: a later page of one url is a duplicate; then, one that has the text or the name and description of a kept page before it; others are kept if relevant. What isn't kept marks nothing."""
    c = F.col
    placed = checkpointed(first_fetched(good.select("page_id", "url", "title", "description", "excerpt", "content_hash", "text_size", c("relevance.relevant").alias("relevant"))))
    again = placed.filter("page_id <> first").select("page_id", F.lit("duplicate").alias("outcome"), F.lit(REDIRECT).alias("reason"), c("first").alias("of"))
    rest = placed.filter("page_id = first")
    keys = checkpointed(page_keys(rest).join(rest.select(c("page_id").alias("id"), "relevant"), "id").filter("not startswith(coalesce(key, ''), 'u')"))
    seen = first_seen(keys.filter("relevant").select("id", "ord", "key"))
    kept = checkpointed(seen.filter("kept").select("id"))
    held = keys.join(kept, "id").filter("key is not null").select("key", c("id").alias("of"))
    lost = keys.join(kept, "id", "left_anti").join(held, "key").filter("of < id")
    best = lost.groupBy("id").agg(F.min_by(F.struct("of", "key"), F.struct(F.when(F.startswith("key", F.lit("t")), 0).otherwise(1), "of")).alias("b"))
    done = rest.select(c("page_id").alias("id"), "relevant").join(best, "id", "left").join(kept.withColumn("kept", F.lit(True)), "id", "left")
    outcome = F.when(c("kept"), "kept").when(c("b").isNotNull(), "duplicate").otherwise("irrelevant")
    reason = F.when(c("kept") | c("b").isNull(), F.lit(None)).when(F.startswith(c("b.key"), F.lit("t")), SAME_CONTENT).otherwise(SAME_PROGRAM)
    return again.unionByName(done.select(c("id").alias("page_id"), outcome.alias("outcome"), reason.alias("reason"), F.when(~F.coalesce("kept", F.lit(False)), c("b.of")).alias("of")))


def curate(pages: DataFrame, sources: DataFrame, depth: int = DEPTH, whole: bool = False) -> Curation:
    """Curates pages(page_id, url, html, ...) of sources(source_id, ord, name, origins, prefixes, service_area, organization_from_title, skip_eligibility, category_by_path).

    The pages are read once; all results come from what was written then. A page without a status counts as fetched, one
    without a source as of the source whose scope it is in. Pages without rows give empty results.
    whole: texts, links and headings of a page are read to their ends, as by extract_pages.
    """
    return Curation(*read_once(pages, whole), sources, depth)
