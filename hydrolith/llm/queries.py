"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.llm import chaining, decontaminate, html_extract, line_dedup, mixing, quality, secret_scan, simhash, sparse_suffix, topk
from hydrolith.llm.common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.shared_passages(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows, 20)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(read(spark, sf_dir, "documents")))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(read(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_line_dedup, op3_substring_dedup, op4_decontamination, op5_top_k, op6_secret_scan, op7_suffix_array, op8_mixing, op9_html_extraction, op10_quality_classifier)
    return {f.__name__: f for f in found}


OP2 = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(len(l))) AS i FROM d),
n AS (SELECT doc_id, i, l[i + 1] AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM p WHERE trim(l[i + 1], ' ') <> ''),
w AS (SELECT a.doc_id, a.j, a.i AS i1, b.i AS i2, a.x AS x1, b.x AS x2 FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.j = a.j + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY x1, x2 ORDER BY doc_id, j) AS k FROM w),
g AS (SELECT doc_id, i1 AS i FROM r WHERE k > 1 UNION SELECT doc_id, i2 FROM r WHERE k > 1),
c AS (SELECT p.doc_id, string_agg(l[p.i + 1], chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS text,
             count(*) FILTER (WHERE trim(l[p.i + 1], ' ') <> '') AS n_lines, count(g.i) AS n_deleted
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_deleted::BIGINT AS n_deleted, coalesce(text, '') AS text FROM c
"""

OP4 = """
WITH a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
q AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark, a),
qs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM q WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM qs GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(translate(text, u, l), '[^\\x20\\x09-\\x0D]+') AS w FROM documents, a),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM qs)))
SELECT doc_id, item_id, count(*) AS n_found, n_shingles, count(*)::DOUBLE / n_shingles AS containment
FROM ds JOIN qs USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20
"""

OP8 = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  -ln((('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
    / coalesce(0.1 + length(regexp_replace(text, '[^\\pL \\n]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.1) AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS ratio FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, ratio) FROM v WHERE level <= ratio)) AS target FROM v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / t.source_size) AS epochs,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (epochs * size + CASE WHEN start + size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op4_decontamination": OP4, "op5_top_k": OP5, "op8_mixing": OP8}
