"""The registered query of every operator here, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from agro_jobs.llm import byte_bpe, fingerprint_index, icws, kd_shards, mixing, nn_descent, pii_tagger, quality_pu, spelling, term_search, toxic_segments, url_filter, winnow
from agro_jobs.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "finish")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_pu.score(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_segments.score(docs, *toxic_segments.fit(docs, table(spark, sf_dir, "labels")))


def op7_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_tagger.digests(pii_tagger.find(docs, pii_tagger.fit(docs)))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicates(table(spark, sf_dir, "documents"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op13_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {"op1_url_filter": op1_url_filter, "op2_mix_sources": op2_mix_sources, "op3_kd_shards": op3_kd_shards, "op5_substring_dedup": op5_substring_dedup, "op4_quality_pu": op4_quality_pu, "op6_toxic_segments": op6_toxic_segments, "op7_pii_tagger": op7_pii_tagger, "op8_winnowing": op8_winnowing, "op9_minhash_near_dedup": op9_minhash_near_dedup, "op10_nn_descent": op10_nn_descent, "op11_spelling_variants": op11_spelling_variants, "op12_byte_bpe": op12_byte_bpe, "op13_term_search": op13_term_search}
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('17:' || coalesce(len(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(len(source) || ':' || source, '-') || coalesce(len(text) || ':' || text, '-')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(greatest(words_left, 0) / weight_left) OVER () * weight) AS target FROM l),
q AS (SELECT row_number() OVER () AS r, doc_id, key, size, d.source, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, unnest([0, 1]) AS turn FROM q WHERE size > 0 AND target > 0),
j AS (SELECT *, unnest(range(0, (size + 15) // 16)) AS j FROM k),
p AS (SELECT r, key, turn, j, least(16, size - 16 * j) AS words, (turn * source_size + served - size + least((j + 1) * 16, size)) / target AS v FROM j),
o AS (SELECT r, words, sum(words) OVER (ORDER BY v, key, turn, j ROWS UNBOUNDED PRECEDING) - words AS before FROM p),
c AS (SELECT r, CAST(sum(greatest(0, least(words, (SELECT floor(sum(target) + 1e-6) FROM t) - before))) AS BIGINT) AS taken FROM o GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, source, CASE WHEN target > 0 THEN served / target END AS finish FROM q LEFT JOIN c USING (r)
""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, k, array_to_string(w[k:k+34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d)),
dup AS (SELECT r, k FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)),
cov AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM dup),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
""",
    "op8_winnowing": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[k:k+n-1], ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, k, array_to_string(w[k:k+n-1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
hit AS (SELECT r, k, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS k FROM r WHERE len(run) >= 5 GROUP BY 1, 2),
x AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM u),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(hx), 2), lambda i: [CAST('0x' || hx[i:i+1] AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS h FROM x),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM c) WHERE len(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
s AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM s a JOIN s b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT s.word, w.word FROM s JOIN w ON s.rest = w.word UNION SELECT w.word, s.word FROM s JOIN w ON s.rest = w.word),
g AS (SELECT a AS word, count(*) AS n_near, arg_min(b, struct_pack(m := -w.n, b := b)) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = b GROUP BY 1),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM w LEFT JOIN g ON g.word = w.word),
t AS (SELECT word, word AS tip, 0 AS steps FROM f UNION ALL SELECT t.word, f.form, steps + 1 FROM t JOIN f ON f.word = t.tip WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(tip, steps) AS root FROM t GROUP BY 1) USING (word)
""",
    "op13_term_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
al AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
we AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, al GROUP BY term, n_docs),
dm AS (SELECT r, doc_id, 100 - 90 + ((90 * len(w) * n_docs) // n_terms) AS m FROM d, al WHERE len(w) > 0),
sc AS (SELECT item_id, r, doc_id, CAST(sum(we.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM tf JOIN it USING (term) JOIN we USING (term) JOIN dm USING (r) GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rk WHERE rank <= 10
""",
}
