"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, decontamination, html_text, lm_score, near_dedup, packing, pii, quality, topk, toxicity, vector_codes, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.round_trip(spark, table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_topk": op2_topk,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_lm_score": op7_lm_score,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_alignment": op12_alignment,
    "op13_quality": op13_quality,
}


def _decontamination_sql() -> str:
    """No seeds: every diagonal of every document and item on which enough tokens agree, and its best window."""
    s, words = decontamination.Settings(), "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS h FROM documents),
b AS (SELECT row_number() OVER () AS j, * FROM (SELECT DISTINCT item_id, {words} AS h FROM benchmark)),
dp AS (SELECT k, doc_id, unnest(h) AS token, generate_subscripts(h, 1) AS pos FROM d),
bp AS (SELECT j, item_id, len(h) AS n, least({s.window}, len(h)) AS wide, unnest(h) AS token, generate_subscripts(h, 1) AS pos FROM b WHERE len(h) >= {decontamination.SHORT}),
diagonals AS (SELECT k, j, doc_id, item_id, n, wide, list(bp.pos) AS same FROM dp JOIN bp USING (token) GROUP BY k, j, doc_id, item_id, n, wide, dp.pos - bp.pos HAVING count(*) >= ceil(wide * {s.agree})),
best AS (SELECT doc_id, item_id, wide, list_max(list_transform(range(1, n - wide + 2), lambda i: len(list_filter(same, lambda p: p >= i AND p < i + wide)))) AS agreed FROM diagonals)
SELECT doc_id, item_id, max(agreed)::INTEGER AS agreed FROM best WHERE agreed >= ceil(wide * {s.agree}) GROUP BY doc_id, item_id"""


def _vector_codes_sql() -> str:
    """Every round from nothing: each component against each entry's, summed by part."""
    s = vector_codes.Settings()
    nearest = "SELECT rid, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT x.rid, x.p, b.e, sum((x.x - b.x) * (x.x - b.x))::BIGINT AS d FROM x JOIN books{n} b USING (p, i) GROUP BY x.rid, x.p, b.e) GROUP BY rid, p"
    rounds = [
        f"""near{n} AS MATERIALIZED ({nearest.format(n=n)}),
means{n} AS (SELECT p, m.e AS e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM x JOIN near{n} USING (rid, p) GROUP BY p, m.e, i),
books{n + 1} AS MATERIALIZED (SELECT p, e, i, coalesce(means{n}.x, books{n}.x) AS x FROM books{n} LEFT JOIN means{n} USING (p, e, i))"""
        for n in range(s.rounds)
    ]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({s.scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT rid, unnest(q) AS x, generate_subscripts(q, 1) - 1 AS o, len(q) // {s.parts} AS w FROM v),
x AS MATERIALIZED (SELECT rid, o // w AS p, o % w AS i, x FROM c),
books0 AS MATERIALIZED (SELECT p, rid - 1 AS e, i, x FROM x WHERE rid <= {s.entries}),
{",".join(rounds)},
last AS MATERIALIZED ({nearest.format(n=s.rounds)}),
coded AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM last GROUP BY rid),
sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM books{s.rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (rid), sha"""


def _quality_sql() -> str:
    """Traits by windows of whole words, votes, and the rounds of estimation one after another."""
    s, rules, k = quality.Settings(), quality.RULES, len(quality.RULES)
    blank, quoted = "\\x20\\x09-\\x0D", lambda t: t.replace("'", "''")
    stop = "[.!?。؟।][\"'')\\]”»]*(?:[" + blank + "]|\\z)"
    bounded = lambda x: f"least(greatest({x}, {s.least}), {1 - s.least})"
    start = [[min(math.log(s.start_on_good[0] / s.start_on_bad[0]), 0.0), math.log(s.start_on_good[1] / s.start_on_bad[1]), max(math.log(s.start_on_good[2] / s.start_on_bad[2]), 0.0)]] * k
    odds = f"ln(good / (1 - good)) + list_sum(list_transform(range(1, {k + 1}), lambda j: w[j][v[j] + 2]))"
    rounds = [
        f"""rated{n} AS MATERIALIZED (SELECT v, n, 1 / (1 + exp(-({odds}))) AS p FROM patterns, model{n}),
sums{n} AS (SELECT j, vote, coalesce(sum(n * p) FILTER (v[j] = vote), 0) AS g, coalesce(sum(n * (1 - p)) FILTER (v[j] = vote), 0) AS b, sum(n * p) AS gs, sum(n * (1 - p)) AS bs
  FROM rated{n}, range(1, {k + 1}) AS r(j), (VALUES (-1), (0), (1)) AS o(vote) GROUP BY j, vote),
chances{n} AS (SELECT j, vote, ln({bounded(f"(g + {s.least}) / (gs + {3 * s.least})")} / {bounded(f"(b + {s.least}) / (bs + {3 * s.least})")}) AS l FROM sums{n}),
ruled{n} AS (SELECT j, list(CASE vote WHEN -1 THEN least(l, 0) WHEN 1 THEN greatest(l, 0) ELSE l END ORDER BY vote) AS l FROM chances{n} GROUP BY j),
model{n + 1} AS MATERIALIZED (SELECT (SELECT {bounded("sum(n * p) / sum(n)")} FROM rated{n}) AS good, (SELECT list(l ORDER BY j) FROM ruled{n}) AS w)"""
        for n in range(s.rounds)
    ]
    cast = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN n_words > 0 AND ({r.good}) THEN 1 ELSE 0 END" for r in rules)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED (SELECT k, doc_id, t, regexp_extract_all(t, '[^{blank}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blank}]')) AS lines FROM d),
g AS MATERIALIZED (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
again AS (SELECT k, count(DISTINCT i + o) AS n FROM g JOIN (SELECT k, g FROM g GROUP BY k, g HAVING count(*) > 1) USING (k, g), range(3) AS r(o) GROUP BY k),
traits AS MATERIALIZED (SELECT s.k, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[{blank}]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(list_distinct(w))::BIGINT AS n_different, len(list_filter(w, lambda x: regexp_matches(x, '{quoted(quality.PLAIN)}'))) AS n_plain,
  len(regexp_extract_all(t, '{stop}')) AS n_stops, coalesce(again.n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN again ON again.k = s.k),
voted AS MATERIALIZED (SELECT *, [{cast}] AS v FROM traits),
patterns AS MATERIALIZED (SELECT v, count(*) AS n FROM voted GROUP BY v),
model0 AS (SELECT {s.start_good}::DOUBLE AS good, {start}::DOUBLE[][] AS w),
{", ".join(rounds)},
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({odds}))) AS p FROM voted, model{s.rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {s.keep_from} AS kept FROM judged"""


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _vector_codes_sql(),
    "op13_quality": _quality_sql(),
    "op2_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op8_decontamination": _decontamination_sql(),
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
bits AS (SELECT *, array_to_string(list_transform(string_split(sha, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS b,
  min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(b, 5 * i + j + 1, 1)::INTEGER * (1 << (4 - j)::INTEGER)))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM bits""",
}
