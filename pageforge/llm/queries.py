"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm import decontaminate, mixing, names, packing, pii, quality, quantize, secrets, simhash, token_store, topk, toxicity, warc
from pageforge.llm.common import new_path, table


@functools.cache
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = "filter(pii, x -> x.kind IN ('email', 'ip', 'card', 'phone'))"
    counts = [F.expr(f"CAST(size(filter(pii, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.BASE]
    scores = F.expr("array_join(transform(pii, x -> CAST(CAST(x.score AS DECIMAL(3, 2)) AS STRING)), ',')")
    return found.select(
        "own.doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed("pii").alias("spans"), scores.alias("scores")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measured(table(spark, sf_dir, "documents"))
    return quality.score_measured(found, quality.learn(quality.training(found, table(spark, sf_dir, "labels"))))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_store.token_index(spark, path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), "refers_to",
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 20 = 0"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.shares(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op12_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.compress(table(spark, sf_dir, "embeddings"))


def op13_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = table(spark, sf_dir, "vendors").select(F.col("vendor_id").alias("id"), names.misspelt(F.col("name"), F.col("vendor_id")).alias("name"))
    clients = table(spark, sf_dir, "clients").select(F.col("client_id").alias("id"), "name")
    found = names.join_counts(vendors, clients, most=1)
    return found.select(
        F.col("id").alias("vendor_id"), "distance", F.col("n").alias("n_clients"), F.col("first").alias("first_client_id"), F.col("crc").alias("clients_crc")
    )


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_pii, op3_quality, op4_packing, op5_simhash, op6_token_store, op7_warc, op8_secrets, op9_toxicity, op10_topk, op11_mixing,
    op12_quantize, op13_name_join,
)}

#: crc32 of a number's digits, a bit at a time.
_CRC = (
    "xor(list_reduce(list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(substr({0}::VARCHAR, i, 1))::BIGINT), lambda c, x: "
    "list_reduce(range(8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(c, x)), 4294967295::BIGINT), 4294967295::BIGINT)"
)


def _lloyd(rounds: int) -> str:
    """Codebooks after each round; the last assignment is `final`."""
    near = ("SELECT p.vec_id, p.part, min(list_sum(list_transform(range(1, 5), lambda i: (p.v[i] - b.c[i]) * (p.v[i] - b.c[i])))::BIGINT * 64 + b.entry) AS m"
            " FROM parts p JOIN {0} b ON p.part = b.part GROUP BY p.vec_id, p.part")
    steps = []
    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED ({near.format(f'book{k}')}),
sum{k} AS (SELECT part, m % 64 AS entry, count(*) AS n, sum(v[1]) AS s1, sum(v[2]) AS s2, sum(v[3]) AS s3, sum(v[4]) AS s4 FROM a{k} JOIN parts USING (vec_id, part) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, CASE WHEN n IS NULL THEN b.c ELSE list_transform([s1, s2, s3, s4], lambda s: CAST(floor(s::DOUBLE / n) AS BIGINT)) END AS c
 FROM book{k} b LEFT JOIN sum{k} s ON s.part = b.part AND s.entry = b.entry)""")
    return ",\n".join([*steps, f"final AS MATERIALIZED ({near.format(f'book{rounds}')})"])


ORACLE_SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS origin FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> origin THEN origin END AS refers_to FROM r""",
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_quantize": f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[4 * part + 1 : 4 * part + 4] AS v FROM v, (SELECT unnest(range(16)) AS part)),
book0 AS (SELECT part, entry, parts.v AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64) USING (vec_id)),
{_lloyd(2)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error
  FROM final JOIN v USING (vec_id) GROUP BY vec_id, label),
labels_ AS (SELECT label AS l, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded JOIN labels_ ON label IS NOT DISTINCT FROM l""",
    "op13_name_join": f"""
WITH h AS (SELECT vendor_id, name AS s, {_CRC.format('vendor_id')} AS h FROM vendors WHERE name <> ''),
a AS (SELECT vendor_id, CASE WHEN h % 2 = 0 AND length(s) >= 2 THEN left(s, p) || substr(s, p + 2, 1) || substr(s, p + 1, 1) || substr(s, p + 3) ELSE s END AS a
  FROM (SELECT *, CAST(h % greatest(length(s) - 1, 1) AS BIGINT) AS p FROM h)),
c AS MATERIALIZED (SELECT name AS b, count(*) AS n, min(client_id) AS f, sum({_CRC.format('client_id')}) AS crc FROM clients WHERE name <> '' GROUP BY name),
p AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS k FROM a JOIN c ON abs(length(a) - length(b)) <= 1),
d AS (SELECT *, CASE WHEN a = b THEN 0 WHEN substr(a, k + 2) = substr(b, k + 2) OR substr(a, k + 2) = substr(b, k + 1) OR substr(a, k + 1) = substr(b, k + 2)
  OR (substr(a, k + 1, 1) = substr(b, k + 2, 1) AND substr(a, k + 2, 1) = substr(b, k + 1, 1) AND substr(a, k + 3) = substr(b, k + 3)) THEN 1 END AS distance FROM p)
SELECT vendor_id, distance, CAST(sum(n) AS BIGINT) AS n_clients, min(f) AS first_client_id, CAST(sum(crc) AS BIGINT) AS clients_crc
FROM d WHERE distance IS NOT NULL GROUP BY vendor_id, distance""",
}
