"""``opN_<name>`` queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import ann, decontamination, filter_audit, hard_negatives, language_id, minhash, packing, quality, reputation, sharding, suffix_dedup, token_output, warc
from codeloom.session import table


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 equal shards, under the ``key`` law. It binds shard to doc_id alone, so equal texts with
    different ids are not held together."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    out = sharding.shard(docs, "doc_id", [1.0] * 8, carry, grown=[1.0] * 9)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by rule, else by its host's posterior; outcomes are the labels of the documents of that id."""
    out = reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad, count(*) AS n
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
c AS (SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, coalesce(sum(n), 0)::DOUBLE AS n FROM p LEFT JOIN o USING (page_id) GROUP BY 1),
b AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts FROM c),
h AS (SELECT host, bad, n, CASE WHEN array_to_string(parts[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') THEN 2 ELSE 1 END AS w, parts FROM b),
hosts AS (SELECT host, bad, n, array_to_string(list_slice(parts, -w - 1, -1), '.') AS domain, array_to_string(list_slice(parts, -w, -1), '.') AS suffix FROM h),
g AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM hosts),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, any_value(m) AS m FROM hosts, g GROUP BY 1),
sk AS (SELECT 1 / (CASE WHEN b > 0 THEN least(0.5, greatest(0.001, (s - a) / b)) ELSE 0.5 END) - 1 AS k FROM
  (SELECT sum((bad - n * m) * (bad / n - m)) AS s, sum(m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS b FROM s0 WHERE n > 0)),
s1 AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s0, sk),
d0 AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n, any_value(m) AS m FROM hosts JOIN s1 USING (suffix) GROUP BY 1, 2),
dk AS (SELECT 1 / (CASE WHEN b > 0 THEN least(0.5, greatest(0.001, (s - a) / b)) ELSE 0.5 END) - 1 AS k FROM
  (SELECT sum((bad - n * m) * (bad / n - m)) AS s, sum(m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS b FROM d0 WHERE n > 0)),
d1 AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM d0, dk),
h0 AS (SELECT host, bad, n, m FROM hosts JOIN d1 USING (domain)),
hk AS (SELECT 1 / (CASE WHEN b > 0 THEN least(0.5, greatest(0.001, (s - a) / b)) ELSE 0.5 END) - 1 AS k FROM
  (SELECT sum((bad - n * m) * (bad / n - m)) AS s, sum(m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS b FROM h0 WHERE n > 0)),
h1 AS (SELECT host, (bad + k * m) / (n + k) AS mean, n + k AS size FROM h0, hk),
h2 AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS bound FROM h1),
r AS (SELECT p.*, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound > 0.4 THEN 'block' ELSE 'allow' END AS verdict FROM r LEFT JOIN h2 ON r.host = h2.host
"""


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to a content-addressed archive and read back from it."""
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to FROM q
"""

def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(spark, docs)
    out = language_id.predict(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    out = decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, p, p + l - 1), ' ') AS g FROM
  (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, l, p, array_to_string(list_slice(w, p, p + l - 1), ' ') AS g FROM
  (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
h AS (SELECT rid, p, dw.l, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.l = iw.l),
c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + l)) AS x FROM h) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens in shared sequences."""
    pieces = packing.encode_pieces(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.pack(spark, pieces)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of being junk and toxic, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(spark, docs, table(spark, sf_dir, "labels"))
    return quality.score(spark, docs.select("doc_id", "text"), model).select("doc_id", "p_junk", "p_toxic", "kept")


def op8_wavelet_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to wavelet-matrix shards and read back from them."""
    shards = token_output.write_shards(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.read_documents(spark, shards)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents over sets of 4-word shingles."""
    return minhash.classes(spark, table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that a document of a smaller id holds."""
    out = suffix_dedup.dedup(spark, table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of hard negatives of every hundredth row; the label of every seventh is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
r AS (SELECT row_number() OVER (ORDER BY id, label, q) AS n, * FROM v),
s AS (SELECT a.n AS an, a.id AS anchor_id, a.label AS anchor_label, b.n AS bn, b.id, b.label, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.n <> b.n),
p AS (SELECT an, anchor_id, anchor_label, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY an ORDER BY score DESC, id) AS nth
  FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.an, nth ORDER BY score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.an = p.an AND s.label <> p.anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.an, nth ORDER BY score DESC, s.id) <= 10
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents: what each removes at each step of every order, by source."""
    return filter_audit.audit(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(f, b)),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS o, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT o, step, o[step] AS f, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, o, step, f, coalesce(sum(n) FILTER (mask & (before | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & b > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & b > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & b > 0 AND mask & before = 0), 0) AS toxic_lost FROM c, s GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""


QUERIES = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_host_reputation": op2_host_reputation,
    "op4_rendezvous_sharding": op4_rendezvous_sharding,
    "op3_language_id": op3_language_id,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_wavelet_token_output": op8_wavelet_token_output,
    "op9_warc_archive": op9_warc_archive,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}
#: The rest, op4 included (DuckDB has no CRC-32), is tested against brute force in tests/llm.
ORACLES = {"op2_host_reputation": OP2_SQL, "op5_benchmark_decontamination": OP5_SQL, "op9_warc_archive": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_filter_audit": OP13_SQL}
