"""Registered queries on urls, pages and the promotion of candidates, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import pages as P
from ..operators import promote as R
from ..operators.dedup import first_seen
from ..sources.derived import CATALOGUE_SQL, catalogue, table


def derived_review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, overrides, previous) from the whole catalogue, with renamed, vanished, repeated and faulty records among them."""
    o, null = F.col("ord"), F.lit(None).cast("string")
    base = catalogue(spark, sf_dir).withColumns({
        "source_url": F.concat(F.lit("https://src.example.org/p/"), o.cast("string")), "canonical_url": null, "application_url": F.when(o % 37 == 5, "not a url").otherwise(F.concat(F.lit("https://apply.example.org/"), F.floor(o / 2).cast("string"))),
        "description": F.concat(F.lit("About "), "name"), "phone": null, "address": null, "last_verified": null,
    })
    previous = base.withColumn("source_url", F.concat(F.upper("source_url"), F.lit("/")))
    now = base.filter(o % 63 != 18).withColumns({"id": F.when(o % 45 == 9, F.concat("id", F.lit("n"))).otherwise(F.col("id")), "name": F.when(o % 31 == 7, " ").otherwise(F.col("name")), "category": F.when(o % 41 != 3, F.col("category"))})
    now = now.unionByName(now.filter(o % 29 == 11).withColumn("ord", o + 1_000_000_000))
    empty = {r: F.lit(None).cast(base.schema[r].dataType) for r in R.RULES}
    rules = F.when(o % 2 == 0, F.struct(*(F.lit(60.0).alias(r) if r == "max_ami_percent" else v.alias(r) for r, v in empty.items())))
    fields = {f: F.lit(None).cast(base.schema[f].dataType) for f in R.FIELDS} | {"response_time_days": F.when(o % 4 == 1, 2), "active": F.when(o % 36 == 0, F.lit(False))}
    shape = [F.when(o % 18 == 0, "2026-01-02").otherwise("2026-02-03").alias("reviewed_at"), F.when(o % 81 != 0, "kim").alias("reviewed_by"), (o % 27 == 0).alias("exclude"), F.when(o % 54 != 0, "closed").alias("exclude_reason"), F.lit(None).cast("boolean").alias("eligibility_verified"), rules.alias("rules"), *(v.alias(f) for f, v in fields.items())]
    reviewed = base.filter(o % 9 == 0).select("id", "ord", *shape)
    ghosts = base.filter(o % 90 == 0).select(F.concat(F.lit("ghost"), o.cast("string")).alias("id"), "ord", *shape).withColumn("exclude", F.lit(False))
    return now, reviewed.unionByName(ghosts), previous


def promote_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.promote(*derived_review(spark, sf_dir)).resources
    return r.select("id", "active", "response_time_days", "last_verified", "eligibility_verified", "max_ami_percent", "max_fpl_percent", "carried_forward")


def promote_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, reviewed, previous = derived_review(spark, sf_dir)
    return R.rekey(reviewed, now, previous)


def promote_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.promote(*derived_review(spark, sf_dir)).warnings.filter("kind <> 'shares application_url'")


def promote_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.promote(*derived_review(spark, sf_dir)).errors.groupBy("id", "error").agg(F.count("*").alias("n"))


def promote_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.promote(*derived_review(spark, sf_dir)).outcomes


def promote_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.promote(*derived_review(spark, sf_dir)).stats


def merge_candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    first, second = c.filter("ord % 2 = 0 or ord % 3 = 0"), c.filter("ord % 3 <> 1").withColumn("name", F.concat(F.lit("late "), "name"))
    return R.merge_candidate_sets([first, second.unionByName(second)]).select("id", "name", "file_ord")


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", U.normalize_url(F.col("url")).alias("normal"), U.url_key(F.col("url")).alias("key"))


def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with at least two pages are sources; English and, with a slash at the end, French paths are in scope."""
    p = table(spark, sf_dir, "pages").withColumn("host", U.host(F.col("url")))
    own = p.groupBy("host").agg(F.count("*").alias("n")).filter("n > 1")
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), F.col("host"))
    seen = p.join(own, "host", "left").withColumn("origins", F.when(F.col("n").isNotNull(), F.array(origin)).otherwise(F.array().cast("array<string>")))
    scope = U.in_scope(F.col("url"), F.col("origins"), F.array(F.lit("/EN"), F.lit("/fr/")))
    return seen.select("page_id", scope.alias("in_scope"), U.document_kind(F.col("url")).alias("kind"), U.crawl_trap(F.col("url")).alias("trap"))


def snapshot_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    text = F.col("page_id").cast("string")
    even = p.filter("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("page_id"))
    stored = even.select("url", F.when(F.col("page_id") % 16 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url")).alias("final_url"), F.concat(F.lit("stored"), text).alias("html"))
    status = F.when(F.col("page_id") % 4 == 0, 304).when(F.col("page_id") % 7 == 0, 500).otherwise(200)
    log = p.select("page_id", "url", F.col("url").alias("final_url"), status.alias("status"), F.concat(F.lit("new"), text).alias("html"))
    return P.refresh(stored, log).select("page_id", "reused", "html")


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.extract_pages(table(spark, sf_dir, "pages"))
    return r.select("page_id", "title", F.element_at("headings", 1).alias("heading"), F.col("anchors").alias("n_links"))


#: A page's own html, with telephone numbers in several forms and addresses at the end of its article.
_CONTACTS = """
SELECT page_id, url, replace(html, '</article>', concat('<p>Call (408) 555-', lpad(CAST(page_id % 10000 AS VARCHAR(9)), 4, '0'), CASE WHEN page_id % 3 = 0 THEN ' or 1-650-555-0199 ext. 7' ELSE '' END, ', <a href="tel:',
  CASE WHEN page_id % 2 = 0 THEN '+1408555' ELSE '+1209555' END, lpad(CAST(page_id % 10000 AS VARCHAR(9)), 4, '0'), '">phone</a>, <a href="mailto:a', CAST(page_id AS VARCHAR(20)), '@b.org?subject=x">mail</a>, c', CAST(page_id AS VARCHAR(20)), '@d.example.org.</p></article>')) AS html FROM pages
"""


def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.extract_pages(spark.sql(_CONTACTS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages")), whole=True)
    return r.select("page_id", F.array_join("phones", ",").alias("phones"), F.array_join("emails", ",").alias("emails"), F.length("text").alias("n_text"))


#: A page for each customer; an order links its customer's page to another one, the text by its priority.
_GRAPH = """
SELECT concat('https://s', CAST(o_custkey % 5 AS VARCHAR(9)), '.example.org/p/', CAST(o_custkey AS VARCHAR(20))) AS found_from, CAST(o_custkey AS BIGINT) AS a, CAST((o_orderkey * 7 + o_custkey) % 1500 + 1 AS BIGINT) AS b,
  concat('https://s', CAST(((o_orderkey * 7 + o_custkey) % 1500 + 1) % 5 AS VARCHAR(9)), '.example.org/p/', CAST((o_orderkey * 7 + o_custkey) % 1500 + 1 AS VARCHAR(20))) AS url,
  CASE o_orderkey % 4 WHEN 0 THEN 'Apply for housing' WHEN 1 THEN 'News' WHEN 2 THEN 'Programs' ELSE 'More' END AS text, o_orderkey % 9 = 0 AS navigation
FROM orders
"""


def link_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a round of fetching, from start pages on: every 100th customer's page is one."""
    links = spark.sql(_GRAPH.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    site = F.regexp_extract("url", "^https://(s[0-9]+)[.]", 1)
    seeds = links.filter("a % 100 = 1").select(F.col("found_from").alias("url")).distinct().withColumn("source", site)
    sources = spark.createDataFrame([(f"s{k}", 10 * k) for k in range(5)], "source string, priority int")
    found = P.frontier(links.withColumn("source", site), seeds, sources, depth=4)
    return P.fetch_list(found, per_source=50, total=10_000).select("source", "url", "depth", "score", "rank")


def page_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the order of their ids; a page goes if its url, title with text, or name with description was kept before."""
    keys = P.page_keys(P.extract_pages(table(spark, sf_dir, "pages")))
    return first_seen(keys).select(F.col("id").alias("page_id"), "kept", "of")


_REVIEW = f"""
c AS ({CATALOGUE_SQL}),
prev AS (SELECT *, 'https://src.example.org/p/' || ord AS src FROM c),
now AS (
  SELECT * REPLACE (CASE WHEN ord % 45 = 9 THEN id || 'n' ELSE id END AS id, CASE WHEN ord % 31 = 7 THEN ' ' ELSE name END AS name, CASE WHEN ord % 41 <> 3 THEN category_no END AS category_no), ord AS seq FROM prev WHERE ord % 63 <> 18),
cand AS (SELECT * FROM now UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq) FROM now WHERE ord % 29 = 11),
ov AS (
  SELECT id, ord, ord % 27 = 0 AS excl, CASE WHEN ord % 18 = 0 THEN '2026-01-02' ELSE '2026-02-03' END AS at_, ord % 81 <> 0 AS by_, ord % 54 <> 0 AS why, CASE WHEN ord % 4 = 1 THEN 2 END AS days, CASE WHEN ord % 36 = 0 THEN false END AS act, ord % 2 = 0 AS rules FROM c WHERE ord % 9 = 0
  UNION ALL SELECT 'ghost' || ord, ord, false, CASE WHEN ord % 18 = 0 THEN '2026-01-02' ELSE '2026-02-03' END, ord % 81 <> 0, ord % 54 <> 0, CASE WHEN ord % 4 = 1 THEN 2 END, CASE WHEN ord % 36 = 0 THEN false END, ord % 2 = 0 FROM c WHERE ord % 90 = 0),
rk AS (
  SELECT ov.id, (SELECT max(n.id) FROM now n WHERE n.src = p.src) AS new_id FROM ov LEFT JOIN prev p ON p.id = ov.id WHERE ov.id NOT IN (SELECT id FROM now)),
rv AS (SELECT ov.* REPLACE (coalesce(rk.new_id, ov.id) AS id) FROM ov LEFT JOIN rk ON rk.id = ov.id WHERE rk.id IS NULL OR rk.new_id IS NOT NULL),
carry AS (SELECT p.* FROM prev p JOIN rk USING (id) JOIN ov USING (id) WHERE new_id IS NULL AND NOT excl),
j AS (
  SELECT d.*, rv.id IS NOT NULL AS has, rv.excl, rv.at_, rv.days, rv.act, rv.rules,
    CASE WHEN category_no IS NULL THEN 'uncategorised' WHEN row_number() OVER (PARTITION BY d.id, category_no IS NULL ORDER BY seq) > 1 OR d.id IN (SELECT id FROM carry) THEN 'duplicate' WHEN coalesce(rv.excl, false) THEN 'excluded' ELSE 'promoted' END AS outcome
  FROM cand d LEFT JOIN rv USING (id)),
res AS (
  SELECT id, ord, name, coalesce(act, active) AS active, coalesce(days, response_time_days) AS response_time_days, at_ AS last_verified, CASE WHEN rules THEN true ELSE coalesce(eligibility_verified, false) END AS eligibility_verified,
    CASE WHEN rules THEN 60 ELSE max_ami_percent END AS max_ami_percent, CASE WHEN coalesce(rules, false) THEN NULL ELSE max_fpl_percent END AS max_fpl_percent, false AS carried_forward,
    coalesce(rules, false) OR max_ami_percent IS NOT NULL OR max_fpl_percent IS NOT NULL OR max_annual_income IS NOT NULL OR requires_eviction_notice IS NOT NULL OR requires_children IS NOT NULL OR requires_veteran IS NOT NULL OR status_any1 IS NOT NULL OR notes IS NOT NULL AS elig
  FROM j WHERE outcome = 'promoted'
  UNION ALL SELECT id, ord, name, active, response_time_days, NULL, eligibility_verified, max_ami_percent, max_fpl_percent, true,
    max_ami_percent IS NOT NULL OR max_fpl_percent IS NOT NULL OR max_annual_income IS NOT NULL OR requires_eviction_notice IS NOT NULL OR requires_children IS NOT NULL OR requires_veteran IS NOT NULL OR status_any1 IS NOT NULL OR notes IS NOT NULL FROM carry)"""

_NORMAL = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS t, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
n AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]+|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|$)'))), '&') AS kept FROM p)"""

_SQUEEZE = "trim(regexp_replace({}, '[[:space:]]+', ' ', 'g'))"


def decoded(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


#: DuckDB: what the article of a given page says: ends of blocks are blanks, other tags nothing.
SAID = _SQUEEZE.format(decoded(r"regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1|br|li|ul|div)>', ' ', 'g'), '<[^<>]*>', '', 'g')"))
TITLE = _SQUEEZE.format(decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)"))


def _plain(tag: str) -> str:
    """The text of the first such element, its entities read and its white space squeezed."""
    text = f"regexp_extract(html, '<{tag}>([^<]*)</{tag}>', 1)"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace({text}, '[[:space:]]+', ' ', 'g'))"


ORACLES = {
    "promote_overrides": f"WITH {_REVIEW} SELECT id, active, response_time_days, last_verified, eligibility_verified, max_ami_percent::DOUBLE AS max_ami_percent, max_fpl_percent::DOUBLE AS max_fpl_percent, carried_forward FROM res",
    "promote_rekey": f"WITH {_REVIEW} SELECT id, new_id FROM rk",
    "promote_carry": f"""WITH {_REVIEW} SELECT id, 're-keyed' AS kind, new_id AS other FROM rk WHERE new_id IS NOT NULL UNION ALL SELECT id, 'carried forward', NULL FROM carry
      UNION ALL SELECT id, 'ignored', NULL FROM rk JOIN ov USING (id) WHERE new_id IS NULL AND NOT excl AND id NOT IN (SELECT id FROM prev)""",
    "promote_errors": f"""WITH {_REVIEW}, e AS (
      SELECT id, 'name is required' AS error FROM res WHERE trim(name) = '' UNION ALL SELECT id, 'application_url is not a url' FROM res WHERE ord % 37 = 5
      UNION ALL SELECT id, 'duplicate id' FROM j WHERE outcome = 'duplicate' UNION ALL SELECT 'override ' || id, 'reviewed_at and reviewed_by are required' FROM ov WHERE NOT by_ UNION ALL SELECT 'override ' || id, 'exclude needs a reason' FROM ov WHERE excl AND NOT why)
      SELECT id, error, count(*) AS n FROM e GROUP BY 1, 2""",
    "promote_outcomes": f"WITH {_REVIEW} SELECT id, seq AS ord, outcome FROM j",
    "promote_stats": f"""WITH {_REVIEW} SELECT * FROM (SELECT count(*) AS candidates, count(*) FILTER (outcome = 'uncategorised') AS uncategorised, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'excluded') AS excluded FROM j),
      (SELECT count(*) AS promoted, count(*) FILTER (eligibility_verified) AS verified, count(*) FILTER (elig) AS with_eligibility, count(*) FILTER (elig AND NOT eligibility_verified) AS backfilled, count(*) FILTER (NOT active) AS inactive, count(*) FILTER (carried_forward) AS carried_forward FROM res),
      (SELECT count(new_id) AS rekeyed FROM rk)""",
    "merge_candidate_sets": f"WITH c AS ({CATALOGUE_SQL}) SELECT id, CASE WHEN ord % 2 = 0 OR ord % 3 = 0 THEN name ELSE 'late ' || name END AS name, CASE WHEN ord % 2 = 0 OR ord % 3 = 0 THEN 0 ELSE 1 END AS file_ord FROM c WHERE ord % 2 = 0 OR ord % 3 = 0 OR ord % 3 <> 1",
    "url_normalize": _NORMAL + r" SELECT page_id, s || '://' || h || CASE WHEN t = '' THEN '/' ELSE t END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS normal, regexp_replace(lower(trim(url)), '/+$', '') AS key FROM n",
    "url_scope": _NORMAL + r""", k AS (SELECT h, count(*) AS c FROM n GROUP BY 1) SELECT page_id, c > 1 AND (regexp_matches(lower(t), '^/en(/|$)') OR regexp_matches(lower(t), '^/fr(/|$)')) AS in_scope,
      CASE WHEN regexp_matches(lower(t), '\.(pdf|docx?|xlsx?|csv|rtf|odt)$') THEN 'document' ELSE 'page' END AS kind, regexp_matches(lower(t), '/(search|calendar|user|login|logout|cart)(/|$)') AS trap FROM n JOIN k USING (h)""",
    "snapshot_refresh": """WITH st AS (SELECT url, min(page_id) AS k FROM pages WHERE page_id % 2 = 0 GROUP BY 1)
      SELECT page_id, page_id % 4 = 0 AS reused, CASE WHEN page_id % 4 = 0 THEN 'stored' || k ELSE 'new' || page_id END AS html FROM pages LEFT JOIN st USING (url) WHERE (page_id % 4 = 0 AND k % 16 <> 0) OR (page_id % 4 <> 0 AND page_id % 7 <> 0)""",
    "page_contacts": rf"""WITH f AS ({_CONTACTS}), t AS (
        SELECT page_id, said, list_prepend(regexp_extract(html, 'href="tel:([^"]*)"', 1), regexp_extract_all(said, '(?i)(?:^|[^0-9])((?:\+?1[ .-]?)?\(?[2-9][0-9]{{2}}\)?[ .-]?[0-9]{{3}}[ .-][0-9]{{4}}(?:[[:space:]]*(?:ext\.?|x)[[:space:]]*[0-9]{{1,6}})?)(?:$|[^0-9])', 1)) AS ph,
          list_prepend('a' || page_id || '@b.org', regexp_extract_all(said, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b')) AS em
        FROM (SELECT page_id, html, {SAID} AS said FROM f)),
      d AS (SELECT *, list_transform(ph, lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS dg FROM t)
      SELECT page_id, array_to_string(list_filter(ph, lambda x, i: len(list_filter(dg[1 : i - 1], lambda y: ends_with(y, dg[i]))) = 0), ',') AS phones, array_to_string(list_filter(em, lambda x, i: list_position(em, x) = i), ',') AS emails, length(said) AS n_text FROM d""",
    "page_dupes": rf"""{_NORMAL.replace("WITH p", "WITH RECURSIVE p")},
      every AS (
        SELECT page_id, list_filter([CASE WHEN s <> '' THEN 'u' || s || '://' || h || CASE WHEN t = '' THEN '/' ELSE t END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END, CASE WHEN length(said) > 80 THEN 't' || title || chr(10) || said END,
          CASE WHEN length(name) >= 8 AND length(about) >= 70 THEN 'n' || name || chr(10) || about END], lambda x: x IS NOT NULL) AS keys
        FROM (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS name, trim(regexp_replace(lower(said[:900]), '[^a-z0-9]+', ' ', 'g')) AS about FROM (SELECT n.*, {TITLE} AS title, {SAID} AS said FROM n JOIN (SELECT page_id, html FROM pages) USING (page_id)))),
      -- a key that one page has decides nothing
      many AS (SELECT x FROM (SELECT unnest(keys) AS x FROM every) GROUP BY 1 HAVING count(*) > 1),
      k AS (SELECT row_number() OVER (ORDER BY page_id) AS i, page_id, coalesce(own, []) AS keys FROM every LEFT JOIN (SELECT page_id, list(x) AS own FROM (SELECT page_id, unnest(keys) AS x FROM every) JOIN many USING (x) GROUP BY 1) USING (page_id)),
      w AS (
        SELECT 0::BIGINT AS i, NULL::BIGINT AS page_id, NULL::BIGINT AS "of", MAP {{}}::MAP(VARCHAR, BIGINT) AS seen
        UNION ALL SELECT i, page_id, "of", CASE WHEN "of" = page_id THEN map_concat(seen, map_from_entries(list_transform(keys, lambda x: {{'k': x, 'v': page_id}}))) ELSE seen END
        FROM (SELECT k.i, k.page_id, keys, seen, coalesce(list_min(list_filter(list_transform(keys, lambda x: seen[x]), lambda x: x IS NOT NULL)), k.page_id) AS "of" FROM w JOIN k ON k.i = w.i + 1))
      SELECT page_id, "of" = page_id AS kept, "of" FROM w WHERE i > 0""",
    "link_frontier": f"""WITH RECURSIVE l AS ({_GRAPH}), d AS (SELECT DISTINCT a, 0 AS depth FROM l WHERE a % 100 = 1 UNION SELECT l.b, d.depth + 1 FROM d JOIN l ON l.a = d.a WHERE d.depth < 4),
      near AS (SELECT a, min(depth) AS depth FROM d GROUP BY 1),
      pri AS (SELECT b, url, depth + 1 AS depth, 10 * (b % 5) + 3 * (CASE WHEN navigation THEN -6 ELSE 2 END + CASE text WHEN 'Apply for housing' THEN 18 WHEN 'News' THEN -12 WHEN 'Programs' THEN 10 ELSE 0 END) - 4 * (depth + 1) AS score FROM l JOIN near USING (a) WHERE depth < 4
        UNION ALL SELECT DISTINCT a, found_from, 0, 100000 + 10 * (a % 5) + 3 * 2 FROM l WHERE a % 100 = 1),
      best AS (SELECT b, url, min_by(depth, (-score, depth)) AS depth, max(score) AS score FROM pri GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY b % 5 ORDER BY score DESC, url) AS rank FROM best)
      SELECT 's' || (b % 5) AS source, url, depth, score, rank FROM r WHERE rank <= 50""",
    "page_extract": f"SELECT page_id, {_plain('title')} AS title, {_plain('h1')} AS heading, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages",
}

QUERIES = {f.__name__: f for f in (promote_overrides, promote_rekey, promote_carry, promote_errors, promote_outcomes, promote_stats, merge_candidate_sets, url_normalize, url_scope, snapshot_refresh, page_extract, page_contacts, page_dupes, link_frontier)}
