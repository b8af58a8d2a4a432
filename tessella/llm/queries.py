"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, chunks, clusters, codes, decontam, knn, mixing, quality, simhash, substrings, tokencount, toxicity, urls
from tessella.llm.common import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(read(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), model_file=spark.conf.get("spark.tessella.tokenizer", tokencount.MODEL))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(read(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.groups(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _cluster_sql(rounds: int = 3) -> str:
    """Every round as two tables: a<i>, each vector's nearest centroid, and c<i + 1>, the new ones."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT r, min({{'d': (list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT, 'e': e}}) AS m
  FROM ok CROSS JOIN c{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT m.e AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN ok USING (r) CROSS JOIN range(1, 65) AS g(i) GROUP BY 1, 2),
n{i} AS (SELECT e, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY i) AS c FROM s{i} GROUP BY e),
c{i + 1} AS (SELECT c{i}.e, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (e))""")
    return f"""
WITH ok AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS e, v AS c FROM ok QUALIFY e < 16),
{(", " + chr(10)).join(steps)},
found AS (SELECT vec_id, m.e AS cluster, m.d AS distance FROM a{rounds} JOIN ok USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string([x::BIGINT for x in c], ',')) AS centroid_sha256
FROM found JOIN c{rounds} ON e = cluster"""


def _code_sql(rounds: int = 4) -> str:
    """Every round as two tables: a<i>, each part's nearest entry, and b<i + 1>, the new codebooks."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p, min({{'d': (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT, 'e': e}}) AS m
  FROM parts JOIN b{i} USING (p) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT p, m.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN parts USING (r, p) CROSS JOIN range(1, 17) AS g(i) GROUP BY 1, 2, 3),
n{i} AS (SELECT p, e, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY i) AS c FROM s{i} GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.e, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (p, e))""")
    return f"""
WITH ok AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, p, v[16 * p + 1:16 * p + 16] AS x FROM ok CROSS JOIN range(4) AS g(p)),
b0 AS (SELECT p, r::INTEGER AS e, x AS c FROM parts WHERE r < 256),
{(", " + chr(10)).join(steps)},
found AS (SELECT r, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string([x::BIGINT for x in c], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label
FROM found JOIN ok USING (r) CROSS JOIN books"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_suffix_array_dedup, op3_benchmark_decontamination, op4_simhash_near_dedup, op5_toxicity, op6_chat_formatting,
        op7_token_counts, op8_exact_top_k, op9_mixing, op10_quality_classifier,
        op11_centroid_clustering, op12_exact_dedup, op13_vector_codes, pipeline,
    )
}

ORACLE = {
    "op3_benchmark_decontamination": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
items AS (
  SELECT item_id, w, least(10, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
doc_windows AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT k FROM items))),
hits AS (SELECT r, i, k, item_id FROM doc_windows JOIN item_windows USING (k, gram)),
hit_words AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(0, k)) AS j FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS named FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)""",
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|'
                || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
         / coalesce(greatest(0.1::DOUBLE, 1.0 - 4.0::DOUBLE * (length(text) - length(translate(text, '!#$%&*|', ''))) / greatest(length(text), 1)), 0.1::DOUBLE) AS key
  FROM documents),
sums AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM sums),
targets AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
budgets AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM targets)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size
          - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END)::BIGINT AS taken,
       s.source
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source""",
    "op6_chat_formatting": r"""
WITH talks AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS turns,
         string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id),
alike AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(text) AS text FROM talks GROUP BY turns)
SELECT a.conv_id, len(a.turns)::BIGINT AS n_turns, a.n_copies, a.text FROM alike a
WHERE NOT EXISTS (SELECT 1 FROM alike b WHERE len(b.turns) > len(a.turns) AND b.turns[1:len(a.turns)] = a.turns)""",
    "op8_exact_top_k": """
WITH ok AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::BIGINT AS score
  FROM ok q JOIN ok c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op11_centroid_clustering": _cluster_sql(),
    "op12_exact_dedup": r"""
WITH plain AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
placed AS (
  SELECT doc_id, t, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
  FROM plain WINDOW w AS (PARTITION BY t ORDER BY length(text) DESC, doc_id NULLS LAST, text))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM placed""",
    "op13_vector_codes": _code_sql(),
}
