"""The opN queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, html, langid, mixing, packing, phrases, secrets, sharding, simhash, substrings, tokens, topk

#: Place of the public tokenizers' files; the package public_tokenizers knows it.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_read(spark, sf_dir, "documents"), secrets.new_ledger(spark))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_sharding, op2_html_extraction, op3_language_id, op4_exact_topk, op5_token_counts, op6_best_fit_packing, op7_secret_scan, op8_mixing, op9_nearest_neighbours, op10_simhash_near_dedup, op11_vector_codes, op12_phrase_mining, op13_substring_dedup]
    return {f.__name__: f for f in own}


_MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), digests AS (
  SELECT *, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR) AS digest FROM sizes
), sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM sizes GROUP BY source
), weighed AS (
  SELECT source, s, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sources
), ranked AS (
  -- sources in the order in which rising budgets fill them: those before r are full
  SELECT *, coalesce(sum(2.0 * s) OVER before, 0) AS full_before, sum(w) OVER onward AS w_onward,
    row_number() OVER (ORDER BY 2.0 * s / w, source IS NULL, source) AS r, 1.5 * sum(s) OVER () AS total
  FROM weighed
  WINDOW before AS (ORDER BY 2.0 * s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    onward AS (ORDER BY 2.0 * s / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT coalesce(arg_min((total - full_before) / w_onward, r) FILTER (WHERE (total - full_before) / w_onward * w <= 2.0 * s), 0) AS per FROM ranked
), budgets AS (
  SELECT source, s, least(2.0 * s, w * per)::DOUBLE AS target FROM weighed, level
), placed AS (
  SELECT d.doc_id, d.source, d.size, b.s AS source_size, b.target, floor(b.target + 1e-6)::BIGINT AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM digests d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN goal // source_size * size + least(size, greatest(0, goal % source_size - start)) ELSE 0 END)::BIGINT AS taken, source
FROM placed
"""


_CODES_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS part FROM kept, range(16) AS t(p)
), firsts AS (
  SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept ORDER BY vec_id NULLS LAST, v LIMIT 64
), book0 AS (
  SELECT p, e, part AS entry FROM parts JOIN firsts USING (r)
), near0 AS (
  SELECT r, p, any_value(part) AS part, min({'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS b
  FROM parts JOIN book0 USING (p) GROUP BY r, p
), mean0 AS (
  SELECT p, e, list(total // n ORDER BY k) AS entry
  FROM (SELECT p, b.e AS e, k, sum(part[k])::BIGINT AS s, count(*) AS n, (s - ((s % n) + n) % n) AS total FROM near0, range(1, 1000) AS t(k) WHERE k <= len(part) GROUP BY p, b.e, k)
  GROUP BY p, e
), book1 AS (
  SELECT p, e, coalesce(mean0.entry, book0.entry) AS entry FROM book0 LEFT JOIN mean0 USING (p, e)
), near1 AS (
  SELECT r, p, any_value(part) AS part, min({'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS b
  FROM parts JOIN book1 USING (p) GROUP BY r, p
), mean1 AS (
  SELECT p, e, list(total // n ORDER BY k) AS entry
  FROM (SELECT p, b.e AS e, k, sum(part[k])::BIGINT AS s, count(*) AS n, (s - ((s % n) + n) % n) AS total FROM near1, range(1, 1000) AS t(k) WHERE k <= len(part) GROUP BY p, b.e, k)
  GROUP BY p, e
), book2 AS (
  SELECT p, e, coalesce(mean1.entry, book1.entry) AS entry FROM book1 LEFT JOIN mean1 USING (p, e)
), near2 AS (
  SELECT r, p, min({'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS b
  FROM parts JOIN book2 USING (p) GROUP BY r, p
), coded AS (
  SELECT r, string_agg(format('{:02x}', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM near2 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


_PHRASES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM pieces
), grams AS (
  SELECT lang, w[s : s + m - 1] AS g, count(*)::BIGINT AS f FROM starts, range(1, 5) AS t(m) WHERE s + m - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE len(g) = 1 GROUP BY lang
), candidates AS (
  SELECT lang, g, f AS a FROM grams WHERE len(g) > 1 AND f >= 30
), longer AS (
  SELECT lang, sub AS g, max(a) AS most
  FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda s: g[s : s + m - 1])))) AS sub FROM candidates WHERE len(g) > 2)
  GROUP BY lang, sub
), left_ AS (
  SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, g) WHERE NOT coalesce(100 * most >= 80 * a, false)
), cuts AS (
  SELECT lang, c.g AS g, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM left_) c JOIN grams x USING (lang) JOIN grams y USING (lang) WHERE x.g = c.g[1:k] AND y.g = c.g[k + 1 :]
), best AS (
  SELECT lang, g, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS b FROM cuts GROUP BY lang, g, a
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, b.l AS l, b.r AS r, b.score AS score, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


_SUBSTRINGS_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), windows AS (
  SELECT r, doc_id, s, hash(array_to_string(w[s : s + 12], ' ')) AS h, md5(array_to_string(w[s : s + 12], ' ')) AS m
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words WHERE len(w) >= 13)
), repeats AS (
  SELECT r, s FROM windows JOIN (SELECT h, m, min(doc_id) AS first FROM windows GROUP BY h, m) USING (h, m) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 13)) AS k FROM repeats
), removed AS (
  SELECT r, list(k) AS ks FROM gone GROUP BY r
), kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY k) AS text
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words) AS words ANTI JOIN gone USING (r, k) GROUP BY words.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """What is within SQL; the tests hold the other queries against brute force."""
    return {"op8_mixing": _MIX_SQL, "op11_vector_codes": _CODES_SQL, "op12_phrase_mining": _PHRASES_SQL, "op13_substring_dedup": _SUBSTRINGS_SQL}
