"""Repeated passages by overlapping three-line windows, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Consecutive lines in a window.
LINES = 3


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc, pos, h1, h2, width): each run of `lines` lines of docs(doc, text); a text with fewer lines is one window of all of them. Null and empty texts have none."""
    hashed = docs.filter("text <> ''").select("doc", F.split("text", "\n", -1).alias("lines")).select("doc", *(F.expr(f"transform(lines, x -> xxhash64({s}, x))").alias(f"l{s}") for s in (1, 2)), F.least(F.size("lines"), F.lit(lines)).alias("width"))
    starts = F.sequence(F.lit(0), F.size("l1") - F.col("width"))
    at = hashed.select("doc", "l1", "l2", "width", F.explode(starts).alias("pos"))
    return at.select("doc", "pos", *(F.xxhash64(F.slice(f"l{s}", F.col("pos") + 1, F.col("width"))).alias(f"h{s}") for s in (1, 2)), "width")


def repeated_runs(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc, runs): for each document of docs(doc, text), merged runs (first line, line after the last) covered by later occurrences of repeated windows.

    Windows are summed within tasks first. A window that a large part of all documents holds makes one row with its first
    place; the later join on it is split by Spark's handling of skewed joins.
    """
    w = windows(docs, lines)
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    later = w.join(first, ["h1", "h2"]).filter(F.struct("doc", "pos") != F.col("first")).select("doc", "pos", (F.col("pos") + F.col("width")).alias("stop"))
    spans = later.distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "stop"))).alias("spans"))
    # all spans of a document are equally wide and in order: a run starts and ends where neighbours don't touch
    starts = F.expr("filter(spans, (s, i) -> i = 0 or s.pos > spans[i - 1].stop)")
    stops = F.expr("filter(spans, (s, i) -> i = size(spans) - 1 or spans[i + 1].pos > s.stop)")
    return spans.select("doc", F.zip_with(starts, stops, lambda a, b: F.struct(a["pos"].alias("start"), b["stop"].alias("stop"))).alias("runs"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with `text` freed of later occurrences of repeated line windows; columns n_lines and n_removed are added.

    Lines end at a newline and are compared exactly. A window's first occurrence (smallest doc_id, then position) stays;
    the lines of its other occurrences, in other documents or the same one, go. Overlapping windows are merged, so a
    passage of any length above `lines` goes as a whole; single repeated lines stay. Every line that goes still stands at
    the first occurrence of its window, or of an earlier one there. A text left without lines becomes ''.

    Null texts stay null with 0 lines; empty texts stay empty. A null doc_id comes before all others. Rows of one doc_id are
    one document if their texts are equal, else several. Other columns pass through, whatever their names; columns called
    n_lines or n_removed are replaced. An empty table gives an empty table.
    """
    doc = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    rows = docs.select(F.struct("*").alias("row"), doc.alias("doc"), "text")
    runs = cut(repeated_runs(rows.select("doc", "text"), lines))
    # the fields are compared one by one, so that a null id meets itself
    same = F.col("doc.h").eqNullSafe(F.col("of.h")) & F.col("doc.id").eqNullSafe(F.col("of.id"))
    joined = rows.join(runs.withColumnRenamed("doc", "of"), same, "left").select("row", "text", "runs", F.split("text", "\n", -1).alias("lines"))
    # kept runs lie between the removed ones
    kept = F.expr("""
        flatten(transform(sequence(0, size(runs)), i -> slice(lines,
            if(i = 0, 0, runs[i - 1].stop) + 1,
            if(i = size(runs), size(lines), runs[i].start) - if(i = 0, 0, runs[i - 1].stop))))
    """)
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.coalesce(F.expr("aggregate(runs, 0, (n, r) -> n + r.stop - r.start)"), F.lit(0)).alias("n_removed"),
    )
