"""The contract queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, exact, language, lines, mixing, negatives, neighbours, quality, search, simhash, suffixes, tokens, toxicity
from flowloom.session import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("doc.text", F.lit("")).cast("binary"), 256)
    return kept.select("doc.doc_id", "found.n_lines", "found.n_dropped", digest.alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), every=20)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), every=100, label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_simhash_near_dedup, op2_toxicity, op3_decontamination, op4_token_counts, op5_exact_dedup, op6_mixing, op7_language_id, op8_quality, op9_line_dedup, op10_suffix_dedup]
    ops += [op11_ranked_search, op12_nearest_neighbours, op13_hard_negatives]
    return {op.__name__: op for op in ops}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP6 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents
), k AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4) AS class,
    substr(m, 1, 1) || translate(substr(m, 2, 1), '0123456789abcdef', '0000111122223333') AS block FROM d
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, {mixing.MOST} * source_size AS cap, {mixing.MOST} * source_size / weight AS ratio FROM s
), g AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos,
    ({mixing.SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM f WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT arg_min(level, pos) AS level FROM g WHERE level <= ratio),
t AS (SELECT source, source_size, least(cap, coalesce(l.level * weight, cap)) AS target FROM g, l),
r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY k.source ORDER BY class, block, k.doc_id NULLS LAST, size) AS pos
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), c AS (SELECT *, (floor(pos * rate + {mixing.offset()}::DOUBLE) - floor((pos - 1) * rate + {mixing.offset()}::DOUBLE))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, copies * size AS taken, copies FROM c
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT r, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*) AS n, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS kept FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = k.key) GROUP BY r)
SELECT doc_id, len(a)::BIGINT AS n_lines, (len(a) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (r)
"""


OP11 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")} AS term FROM documents),
d AS (SELECT doc_id, r, count(*) AS n FROM t GROUP BY doc_id, r),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
i AS (SELECT DISTINCT item_id, {_LOWER.format("unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")} AS term FROM benchmark),
f AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term, n_docs),
s AS (
  SELECT item_id, d.doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), a GROUP BY item_id, d.doc_id, r
), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {search.BEST}
"""

OP13 = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS asked, b.vec_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = asked
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}
), n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE label <> asked AND {negatives.LEAST} * positive_score <= 100 * score AND 100 * score <= {negatives.MOST} * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5, "op6_mixing": OP6, "op9_line_dedup": OP9, "op11_ranked_search": OP11, "op13_hard_negatives": OP13}
