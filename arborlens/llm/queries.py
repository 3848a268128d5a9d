"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversation_repair import damage, repair_report
from .filter_audit import audit_filters
from .hnsw_dedup import near_duplicates
from .language import identify
from .mixing import mix_sources
from .ngram_join import jaccard_join
from .packing import pack_documents
from .pivot_search import top_k
from .pseudo_likelihood import BRANCH, score
from .quality import score_quality
from .substring_dedup import remove_repeats
from .token_files import token_file_digest
from .toxicity import score_toxicity


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("keep", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), branch=BRANCH)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_pivot_table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_hnsw_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pivot_table_search": op2_pivot_table_search,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_masked_pseudo_likelihood": op5_masked_pseudo_likelihood,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_token_files": op8_token_files,
    "op9_hnsw_near_duplicates": op9_hnsw_near_duplicates,
    "op10_mix_sources": op10_mix_sources,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op2_pivot_table_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM g),
e AS (SELECT doc_id, unnest(grams) AS gram FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * p.k >= 80 * (a.n + b.n - p.k)),
s AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS start, doc_id AS seen FROM n UNION SELECT r.start, s.y FROM r JOIN s ON r.seen = s.x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id FROM n JOIN (SELECT start, min(seen) AS component_id FROM r GROUP BY 1) m ON m.start = n.doc_id
""",
    "op10_mix_sources": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS full_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM t),
f AS (SELECT *, coalesce(sum(source_size) OVER s, 0) AS c, coalesce(sum(weight) OVER s, 0) AS v FROM w
      WINDOW s AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5::DOUBLE AS total, sum(weight) AS weights FROM w),
l AS (SELECT max((a.total - CAST(f.c AS DOUBLE) * 2.0::DOUBLE) / CAST(a.weights - f.v AS DOUBLE)) AS level FROM f, a),
r AS (SELECT f.source, f.source_size, least(f.full_size, l.level * f.weight) AS target FROM f, l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target / source_size * 1000000000) AS BIGINT) ELSE 0 END AS rate,
      ('0x' || substr(md5('mix' || coalesce(source, '')), 1, 8))::BIGINT % 1000000000 AS start FROM r),
k AS (SELECT d.*, u.source_size, u.target, u.rate, u.start, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS n
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, ((start + n * rate) // 1000000000 - (start + (n - 1) * rate) // 1000000000) * size AS taken FROM k
""",
    "op12_filter_audit": """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x)
        JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, '[' || filter_order[1:step - 1] || '_]' AS before FROM o, range(1, 6) r(step)),
g AS (SELECT c.part, s.filter_order, s.step, s.x,
        sum(CASE WHEN contains(fails, x) OR regexp_matches(fails, before) THEN 0 ELSE n END) AS kept,
        sum(CASE WHEN contains(fails, x) AND NOT regexp_matches(fails, before) THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN contains(fails, x) AND regexp_matches(fails, before) THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN contains(fails, x) AND NOT regexp_matches(fails, before) THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN contains(fails, x) AND NOT regexp_matches(fails, before) THEN toxic ELSE 0 END) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g
""",
    "op13_substring_dedup": """
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT uid, unnest(range(1, len(words) - 33)) AS pos, words FROM d WHERE len(words) >= 35),
h AS (SELECT uid, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS h FROM s),
r AS (SELECT uid, pos FROM (SELECT uid, pos, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
w AS (SELECT uid, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM d),
k AS (SELECT w.uid, w.pos, w.word, max(r.pos) OVER (PARTITION BY w.uid ORDER BY w.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NULL AS kept FROM w LEFT JOIN r ON r.uid = w.uid AND r.pos = w.pos),
t AS (SELECT uid, count(*) AS n, count(*) FILTER (NOT kept) AS gone, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (kept), '') AS body FROM k GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN t USING (uid)
""",
}
