"""Verdicts on urls by rules and by a tree of path templates for each host, with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, measured

#: A node with more children than BRANCH turns those below SHARE of its pages into one wildcard.
BRANCH, SHARE = 20, 0.02
#: Branches whose labels differ from their siblings' by fewer standard deviations are merged.
SIMILAR = 3.0
#: Weight of the overall purity in a template's, and the purity below which a template is rejected.
WEIGHT, LEAST = 10.0, 0.5

#: Different paths, some 200 bytes each, that may be broadcast to the pages.
FEW_PATHS = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, with A-Z in lower case; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule `host/path` that fits: the same host or a subdomain, and a path that starts with the rule's. Null without one."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def segments(path: Column) -> Column:
    """The segments of a path, numbers in them as `*`."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "*"), "/"), lambda s: s != "")


def template_tree(nodes: DataFrame) -> DataFrame:
    """nodes(host, segs, n, labelled, good) with `template`, level by level from the host down to the last segment of every path.

    At each level the children of a node are its segments. If they are many, the rare ones become `*`. Then a branch whose
    share of good labels lies close to that of all its siblings is merged with them into `+`; an end stays an end. Below a
    node without labels, or with labels of one kind only, no branch can differ, so that all its segments become `+` at once:
    levels are gone through only as deep as labels are mixed.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    rest = lambda level: F.concat("template", F.array_join(F.transform(F.slice("segs", level + 1, F.greatest(F.size("segs") - level, F.lit(0))), lambda _: F.lit("/+")), ""))
    done, t, level = [], nodes.withColumn("template", F.lit("")), 0
    while True:
        all_ = t.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "good")))
        t = t.join(measured(cut(all_)), ["host", "template"])
        open_ = (F.col("all_good") > 0) & (F.col("all_good") < F.col("all_labelled"))
        done.append(t.filter(~open_).select("host", "segs", "n", "labelled", "good", rest(level).alias("template")))
        t = cut(t.filter(open_).withColumn("seg", F.coalesce(F.try_element_at("segs", F.lit(level + 1)), F.lit(""))))
        if not t.limit(1).count():
            return cut(reduce(DataFrame.unionByName, done))
        child = t.groupBy("host", "template", "seg").agg(*sums, *(F.first(c).alias(c) for c in ("all_n", "all_labelled", "all_good")))
        branches = child.groupBy("host", "template").agg(F.count("*").alias("branches"))
        known = child.join(measured(cut(branches)), ["host", "template"])
        rare = (F.col("branches") > BRANCH) & (F.col("n") < SHARE * F.col("all_n")) & (F.col("seg") != "")
        known = known.withColumn("wide", F.when(rare, "*").otherwise(F.col("seg")))
        pooled = known.groupBy("host", "template", "wide").agg(F.sum("labelled").alias("own_labelled"), F.sum("good").alias("own_good"))
        known = known.join(pooled, ["host", "template", "wide"])
        p = F.col("all_good") / F.col("all_labelled")
        far = F.abs(F.col("own_good") - F.col("own_labelled") * p) >= SIMILAR * F.sqrt(F.col("own_labelled") * p * (1 - p))
        step = F.when((F.col("wide") == "") | far & (F.col("own_labelled") > 0), F.col("wide")).otherwise("+")
        steps = cut(known.select("host", "template", "seg", step.alias("step")))
        grown = F.when(F.col("step") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "step"))
        t = t.drop("all_n", "all_labelled", "all_good").join(measured(steps), ["host", "template", "seg"]).withColumn("template", grown).drop("seg", "step")
        t = cut(t)
        done.append(t.filter(F.size("segs") <= level).select("host", "segs", "n", "labelled", "good", "template"))
        t = t.filter(F.size("segs") > level)
        level += 1


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict) for every row of pages(page_id, url, ...), with labels(page_id, good).

    The longest rule that fits decides. Else a page is blocked if its template is rejected: if its share of good labels,
    smoothed towards that of all labels, lies below LEAST. Pages are summed into (host, segments) before anything else, so
    that one host with most pages costs no more than its different paths.

    A null url, or one without `://`, has an empty host and path. Several labels of a page all count, null ones don't.
    Without labels nothing is rejected. Repeated rows are judged, and counted, each. Other columns are ignored. An empty
    table gives an empty table.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("segs", segments(F.col("path")))
    own = labels.filter("good is not null").groupBy("page_id").agg(F.count("*").alias("labelled"), F.sum(F.col("good").cast("int")).alias("good"))
    n = seen.groupBy("host", "segs").agg(F.count("*").alias("n"))
    marked = seen.join(own, "page_id").groupBy("host", "segs").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    nodes = n.join(marked, ["host", "segs"], "left").select("host", "segs", "n", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("good", F.lit(0)).alias("good"))
    tree = template_tree(cut(nodes))
    every = tree.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("labelled")), F.lit(1.0)).alias("p")).first()[0]
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    purity = leaves.select("host", "template", ((F.col("good") + WEIGHT * every) / (F.col("labelled") + WEIGHT)).alias("purity"))
    found = cut(tree.select("host", "segs", "template").join(purity, ["host", "template"]))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < LEAST, "block").otherwise("allow")
    return seen.join(measured(found, FEW_PATHS), ["host", "segs"]).select("page_id", "host", "path", rule.alias("rule"), "template", "purity", F.coalesce(action, method).alias("verdict"))
