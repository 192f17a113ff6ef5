"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hmm_lm, importance, language_id, line_dedup, minhash, mixture, prefix_trie, quality, sharding, url_filter, vectors
from .common import crc_part, documents


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


def op2_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm_lm.score(documents(spark, sf_dir), crc_part(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_part(F.col("doc_id"), 5)
    out = language_id.identify(documents(spark, sf_dir), part != 0)
    return out.select("doc_id", F.coalesce(part == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "accepted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_part(F.col("doc_id"), 5)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), part != 0)
    return quality.rank(docs, model).select("doc_id", F.coalesce(part == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_bytes(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return out.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good) for pages whose url ends in the number of a labelled document; the majority of a document's labels counts, a tie for nothing."""
    number = F.expr(r"try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*/(?:[^?#]*/)?([0-9]+)[^/?#]*/?(?:[?#].*)?$', 1) as bigint)")
    votes = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("vote")).filter("vote <> 0.5")
    return pages.select("page_id", number.alias("doc_id")).filter("doc_id is not null").join(votes, "doc_id").select("page_id", (F.col("vote") > 0.5).alias("good"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = page_labels(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return url_filter.judge(pages, labels, RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode(documents(spark, sf_dir), path, decoded=True)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(documents(spark, sf_dir)).taken().select("doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB: lower-cased words of whole texts.
WORDS = """translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({WORDS}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, way.b FROM reach r JOIN way ON way.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP3_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
w AS (
  SELECT doc_id, pos, least(len(ls), 3) AS width, array_to_string(ls[pos + 1 : pos + least(len(ls), 3)], chr(10)) AS win
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - least(len(ls), 3) + 1)) AS pos FROM l)),
f AS (SELECT *, row_number() OVER (PARTITION BY win, width ORDER BY doc_id, pos) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + width)) AS line FROM f WHERE rn > 1),
kept AS (
  SELECT doc_id, string_agg(line_text, chr(10) ORDER BY line) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(ls) AS line_text, unnest(range(0, len(ls))) AS line FROM l) ANTI JOIN gone USING (doc_id, line) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  coalesce(g.n, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
"""

OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({WORDS}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex({WORDS}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS width, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (
  SELECT doc_id, i, width, array_to_string(ws[i : i + width - 1], ' ') AS win
  FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM d, widths WHERE len(ws) >= width)),
hit AS (SELECT doc_id, i, width, item_id FROM dw JOIN bw USING (width, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _op8_sql() -> str:
    u = url_filter
    host = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{u.UPPER}', '{u.LOWER}')"
    fits = [(v, r, *r.partition("/")) for v, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))]
    when = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{s}{p}') THEN '{r if what else v}'" for v, r, h, s, p in fits) + " END"
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, url, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
seen AS (SELECT page_id, url, host, path, list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda s: s <> '') AS segs FROM u),
votes AS (SELECT doc_id, avg(quality) AS vote FROM labels WHERE quality IN (0, 1) GROUP BY 1 HAVING avg(quality) <> 0.5),
marks AS (
  SELECT page_id, count(*) AS labelled, sum((vote > 0.5)::INT) AS good
  FROM (SELECT page_id, try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*/(?:[^?#]*/)?([0-9]+)[^/?#]*/?(?:[?#].*)?$', 1) AS BIGINT) AS doc_id FROM pages) JOIN votes USING (doc_id) GROUP BY 1),
t AS (
  SELECT 0 AS level, false AS ended, host, segs, count(*)::DOUBLE AS n, coalesce(sum(labelled), 0)::DOUBLE AS labelled, coalesce(sum(good), 0)::DOUBLE AS good, '' AS template
  FROM seen LEFT JOIN marks USING (page_id) GROUP BY host, segs
  UNION ALL
  SELECT level + 1, step = '', host, segs, n, labelled, good, CASE WHEN step = '' THEN template ELSE template || '/' || step END
  FROM (
    SELECT *, CASE WHEN wide = '' OR (abs(og - ol * p) >= {u.SIMILAR} * sqrt(ol * p * (1 - p)) AND ol > 0 AND p > 0 AND p < 1) THEN wide ELSE '+' END AS step
    FROM (
      SELECT *, sum(labelled) OVER v AS ol, sum(good) OVER v AS og, all_good / greatest(all_labelled, 1) AS p
      FROM (
        SELECT *, CASE WHEN branches > {u.BRANCH} AND own_n < {u.SHARE} * all_n AND seg <> '' THEN '*' ELSE seg END AS wide
        FROM (
          SELECT *, count(DISTINCT seg) OVER w AS branches, sum(n) OVER (PARTITION BY host, template, seg) AS own_n, sum(n) OVER w AS all_n,
            sum(labelled) OVER w AS all_labelled, sum(good) OVER w AS all_good
          FROM (SELECT *, coalesce(segs[level + 1], '') AS seg FROM t WHERE NOT ended) WINDOW w AS (PARTITION BY host, template)))
      WINDOW v AS (PARTITION BY host, template, wide)))),
tree AS (SELECT * FROM t WHERE ended),
prior AS (SELECT coalesce(sum(good) / nullif(sum(labelled), 0), 1.0) AS p FROM tree),
leaf AS (SELECT host, template, (sum(good) + {u.WEIGHT} * any_value(p)) / (sum(labelled) + {u.WEIGHT}) AS purity FROM tree, prior GROUP BY 1, 2)
SELECT page_id, host, path, {when(True)} AS rule, coalesce({when(False)}, CASE WHEN purity < {u.LEAST} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM seen JOIN tree USING (host, segs) JOIN leaf USING (host, template)
"""


OP8_SQL = _op8_sql()

OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1) n USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (vec_id)
"""


#: DuckDB: crc32 of strings, by the steps of its polynomial and the bytes in hexadecimal.
CRC_SQL = """
steps AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
crcs AS (
  SELECT x, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS crc
  FROM (SELECT x, list_transform(range(1, len(h) + 1, 2), lambda k: (instr('0123456789ABCDEF', h[k]) * 16 + instr('0123456789ABCDEF', h[k + 1]) - 17)::BIGINT) AS bytes FROM (SELECT x, hex(encode(x)) AS h FROM crc_of)), steps)
"""

OP12_SQL = rf"""
WITH RECURSIVE c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc_of AS (SELECT conv_id::VARCHAR AS x FROM c),
{CRC_SQL},
h AS (SELECT conv_id, crc % 4 AS h FROM c JOIN crcs ON x = conv_id::VARCHAR),
o AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
r AS (
  SELECT h.conv_id, 0 AS part, pos, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND pos <= h
  UNION ALL SELECT h.conv_id, 1, pos, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND pos > h),
s AS (SELECT c.conv_id, coalesce(any_value(turns), []) AS turns FROM c LEFT JOIN (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY part, pos) AS turns FROM r GROUP BY 1) USING (conv_id) GROUP BY 1),
words AS (SELECT sha256(strlen(role) || ':' || role || text) AS t, len(list_filter(string_split_regex(any_value(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM o GROUP BY 1),
m AS (SELECT conv_id, d, turns[1 : d] AS key, d = len(turns) AS here FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (here), '')) AS ends_sha256
  FROM m GROUP BY key, d),
v AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children, (n_convs - 1) * coalesce(words, 0) AS own
  FROM n LEFT JOIN (SELECT key, conv_id FROM n) p ON n.d > 0 AND p.key = n.key[1 : n.d - 1]
  LEFT JOIN (SELECT key[1 : d - 1] AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY 1) k ON k.key = n.key
  LEFT JOIN words ON t = n.key[n.d]),
below AS (SELECT key[1 : up] AS key, sum(own) AS saved, sum((n_children = 0)::INT) AS leaves FROM (SELECT key, own, n_children, unnest(range(0, d + 1)) AS up FROM v) GROUP BY 1)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM v JOIN below USING (key)
"""

OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({WORDS}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT list_filter(string_split_regex({WORDS}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY 1, 2),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY 1),
crc_of AS (SELECT w AS x FROM dw UNION SELECT w FROM bw),
{CRC_SQL},
s AS (SELECT crc % 10000 AS k, sum(n) AS s FROM dw JOIN crcs ON x = w GROUP BY 1),
t AS (SELECT crc % 10000 AS k, sum(n) AS t FROM bw JOIN crcs ON x = w GROUP BY 1),
g AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT k FROM s UNION SELECT k FROM t) LEFT JOIN s USING (k) LEFT JOIN t USING (k), (SELECT coalesce(sum(s), 0) AS all_s FROM s), (SELECT coalesce(sum(t), 0) AS all_t FROM t)),
w AS (SELECT r, sum(n * gain) AS total FROM dw JOIN crcs ON x = w JOIN g ON k = crc % 10000 GROUP BY 1),
f AS (SELECT d.r, doc_id, coalesce(len(ws), 0)::BIGINT AS n, coalesce(total, 0)::BIGINT AS total, sha256('2024:' || doc_id::VARCHAR) AS h FROM d LEFT JOIN w USING (r)),
z AS (
  SELECT r, doc_id, n, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', h[i]) - 1)::BIGINT), lambda x, y: 16 * x + y) AS h
  FROM f),
y AS (SELECT r, doc_id, n, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM z),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, weight, n) AS place, 10 * count(*) OVER () // 100 AS most FROM y WHERE n >= 20 AND score IS NOT NULL)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM y LEFT JOIN ranked USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline, "op1_minhash": op1_minhash, "op2_hmm_lm": op2_hmm_lm, "op3_line_dedup": op3_line_dedup, "op4_language_id": op4_language_id, "op5_quality": op5_quality, "op6_sharding": op6_sharding, "op7_decontaminate": op7_decontaminate, "op8_url_filter": op8_url_filter, "op9_bpe": op9_bpe, "op10_vectors": op10_vectors, "op11_mixture": op11_mixture, "op12_prefix_trie": op12_prefix_trie, "op13_importance": op13_importance}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op3_line_dedup": OP3_SQL, "op7_decontaminate": OP7_SQL, "op8_url_filter": OP8_SQL, "op10_vectors": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_importance": OP13_SQL}
