"""Queries over the given tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, langid, lines, mixing, packing, quality, repeats, resampling, simhash, squares, url_filter, vectors
from .common import Scratch, table

def every_20th() -> Column:
    return F.col("vec_id") % 20 == 0


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"), every_20th())


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark), vocabulary())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("doc_id").cast("long"), "held_out", "score", "predicted")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark))


def op5_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_top_k(table(spark, sf_dir, "embeddings"), every_20th())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), Scratch(spark))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.near_groups(table(spark, sf_dir, "documents"), Scratch(spark))
    return g.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its lines, the numbers (from 0) of those removed, and how many."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.expr("size(split(coalesce(text, ''), '\n'))").alias("n_lines"))
    later = lines.later_lines(table(spark, sf_dir, "documents"), Scratch(spark)).select(F.col("doc_id").alias("l_doc"), F.col("th").alias("l_th"), "later")
    x = docs.join(later, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("th") == F.col("l_th")), "left")
    removed = F.coalesce("later", F.array().cast("array<bigint>"))
    return x.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(table(spark, sf_dir, "documents"), Scratch(spark))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), Scratch(spark))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's texts: every document's weight and score, and the rank of the drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all their orders, for each source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of up to 2,048 tokens of the byte-level vocabulary."""
    import public_tokenizers

    return squares.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_top_k, op2_best_fit_packing, op3_quality_classifier, op4_source_mix, op5_near_neighbours, op6_url_filter, op7_simhash_near_dedup, op8_line_dedup, op9_repeated_strings, op10_language_id, op11_target_resampling, op12_filter_audit, op13_online_packing)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op4_source_mix": r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 3.0 * source_size AS cap FROM s),
 l AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(CAST(cap AS DOUBLE)) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW up AS (ORDER BY cap / w, source NULLS LAST)),
 t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT max(level) FROM l)) AS target FROM l),
 x AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5) AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, key, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(budget / source_size) * size + least(size, greatest(0, budget - floor(budget / source_size) * source_size - before)) END AS BIGINT) AS taken FROM x""",
    # the given pages hold no redirects or canonical links, so no alias takes another's block
    "op6_url_filter": """WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, p, v)),
 m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op11_target_resampling": r"""WITH RECURSIVE k(i, c) AS (SELECT 0, [x::UBIGINT for x in range(256)] UNION ALL SELECT i + 1, [CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END for x in c] FROM k WHERE i < 8),
 crc AS (SELECT c FROM k WHERE i = 8),
 texts AS (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
 d AS (SELECT side, doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
 w AS (SELECT side, n, unnest(words) AS word FROM d),
 v AS (SELECT DISTINCT word, hex(word) AS h FROM w),
 b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, [CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS UBIGINT) for i in range(len(h) // 2)]),
   lambda a, x: xor(crc.c[CAST(xor(a & 255, x) AS INTEGER) + 1], a >> 8)), 4294967295::UBIGINT) % 10000 AS bucket FROM v, crc),
 c AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM w JOIN b USING (word) GROUP BY bucket),
 z AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM c),
 g AS (SELECT word, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain FROM b JOIN c USING (bucket), z),
 m AS (SELECT n, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM w JOIN g USING (word) WHERE side = 's' GROUP BY n),
 x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (n) WHERE side = 's'),
 y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS r, count(*) FILTER (n_features >= 20) OVER () AS fit FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= fit * 10 // 100 THEN r END AS rank FROM r""",
    "op12_filter_audit": r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 f AS (SELECT t.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
   coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM t LEFT JOIN (SELECT doc_id AS l_doc, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l_doc = doc_id),
 p AS (SELECT * FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS p1), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS p2), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS p3), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS p4), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS p5)
   WHERE len(list_distinct([p1, p2, p3, p4, p5])) = 5),
 o AS (SELECT p1 || p2 || p3 || p4 || p5 AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM p),
 q AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failing,
   count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
 x AS (SELECT *, len(translate(failing, substr(filter_order, 1, step - 1), '')) = len(failing) AS there, contains(failing, substr(filter_order, step, 1)) AS hit,
   len(translate(failing, substr(filter_order, 1, step), '')) = len(failing) AS stays FROM q, o),
 s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, coalesce(sum(n) FILTER (stays), 0) AS kept, coalesce(sum(n) FILTER (there AND hit), 0) AS removed, coalesce(sum(n) FILTER (hit AND NOT there), 0) AS redundant,
   coalesce(sum(n) FILTER (failing = substr(filter_order, step, 1)), 0) AS unique_fails, coalesce(sum(good) FILTER (there AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (there AND hit), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s""",
}
