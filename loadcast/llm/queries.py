"""The registered queries of these operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm import centroids, chat, codebooks, imatch, langid, mixing, neighbours, packing, pii, quality, simhash, toxicity, warc
from loadcast.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
#: Where the key of pseudonyms is read from; without it a published one stands in, which hides nothing from who knows it.
PII_SETTING, PII_KEY = "spark.loadcast.pseudonym.key", "loadcast-pseudonyms"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_SETTING, None) or PII_KEY


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "languages")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select(F.col("id").alias("doc_id"), digits, "component_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(own)))


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = langid.held_out(folds=5, fold=0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~apart))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", apart.alias("held_out"), "score", "predicted")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of the pages: each page is a full response, and was asked for again later. Every seventh
    later answer names another version, and every eleventh has no validator."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    later = F.col("page_id") * 10 + 5 + 10 * (F.col("page_id") * 7919 % 1000)
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    weak = F.when(F.col("page_id") % 7 == 0, F.lit('W/"other"')).otherwise(F.concat(F.lit("W/"), tag))
    size = F.length("html").cast("string")
    first = F.create_map(F.lit("etag"), tag, F.lit("content-length"), size, F.lit("cache-control"), F.lit("max-age=60"))
    again = F.create_map(F.lit("etag"), weak, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=3600"))
    again = F.when(F.col("page_id") % 11 == 0, F.map_filter(again, lambda k, _: k != "etag")).otherwise(again)
    responses = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("time"), F.lit("response").alias("kind"), first.alias("headers"), F.col("html").alias("payload"))
    revisits = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("time"), F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return responses.unionByName(revisits)


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(spark, sf_dir))
    header = [F.try_element_at("headers", F.lit(h)).alias(h.replace("-", "_")) for h in ("etag", "cache-control", "content-length")]
    return found.select("record_id", "url_key", "time", "state", "response_id", *header, F.md5("payload").alias("payload_md5"))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark), found_col="replaced")


def op9_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.curriculum(docs)
    place = F.get("positions", F.lit(0)).alias("position")
    columns = mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), place
    )
    return columns.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.edited_pairs(docs, imatch.lexicon(docs)).withColumnRenamed("id", "doc_id")


def op11_active_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.quantise(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    found = codebooks.with_label_errors(coded)
    return found.select(F.col("id").alias("vec_id"), codebooks.code_text("code").alias("code"), "error", "label_error", digest)


def op12_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, centres = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(clustered, centres).withColumnRenamed("id", "vec_id")


def op13_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(~langid.held_out()))
    found = quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (
    op1_language_mixture,
    op2_simhash_near_dedup,
    op3_chat_formatting,
    op4_projection_forest,
    op5_toxicity_string_kernel,
    op6_revisit_resolution,
    op7_feistel_pseudonyms,
    op8_best_fit_packing,
    op9_curriculum_mixing,
    op10_imatch_fingerprints,
    op11_active_codebooks,
    op12_drift_clusters,
    op13_neighbour_quality,
)}
REVISITS = r"""
WITH parts AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain FROM pages
), split AS (
  SELECT page_id, html, regexp_extract(plain, '^[^/?]*') AS host, substr(plain, length(regexp_extract(plain, '^[^/?]*')) + 1) AS rest FROM parts
), keyed AS (
  SELECT page_id, html, '"' || substr(md5(html), 1, 16) || '"' AS tag,
    regexp_replace(regexp_replace(lower(host), '^www[0-9]*\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') AS page,
    array_to_string(list_sort(list_filter(string_split(regexp_replace(rest, '^[^?]*\??', ''), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sid)(=|$)'))), '&') AS query
  FROM split
), urls AS (
  SELECT page_id, html, tag, page || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM keyed
), asked AS (
  SELECT 2 * page_id + 1 AS record_id, url_key, page_id * 10 + 5 + 10 * (page_id * 7919 % 1000) AS time,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'W/"other"' ELSE 'W/' || tag END AS etag
  FROM urls
), found AS (
  SELECT a.*, r.page_id, r.html, r.tag FROM asked a ASOF LEFT JOIN (SELECT *, page_id * 10 AS at FROM urls) r
    ON a.url_key = r.url_key AND a.time > r.at
), judged AS (
  SELECT *, CASE WHEN page_id IS NULL THEN 'no_response' WHEN etag IS NULL THEN 'no_validator'
    WHEN regexp_replace(etag, '^W/', '') = tag THEN 'resolved' ELSE 'changed' END AS state FROM found
)
SELECT record_id, url_key, time, state, 2 * page_id AS response_id, etag, 'max-age=3600' AS cache_control,
  CASE WHEN state = 'resolved' THEN CAST(length(html) AS VARCHAR) ELSE '0' END AS content_length,
  CASE WHEN state = 'resolved' THEN md5(html) END AS payload_md5
FROM judged
"""



def _complete(vector: str) -> str:
    return f"{vector} IS NOT NULL AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _floor_mean(total: str, n: str) -> str:
    """Floor division of integers, also of negative ones."""
    return f"(({total}) - (({total}) % ({n}) + ({n})) % ({n})) // ({n})"


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Lloyd's rounds with every entry compared, one common table expression after the other."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, len(embedding) // {parts} AS w,
          list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_complete("embedding")})""",
        f"""part AS MATERIALIZED (SELECT r, p, list_slice(v, CAST(p * w + 1 AS BIGINT), CAST((p + 1) * w AS BIGINT)) AS x FROM kept, range({parts}) AS t(p))""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM part WHERE r <= {entries})",
    ]
    distance = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for n in range(rounds + 1):
        steps.append(
            f"""near{n} AS MATERIALIZED (SELECT r, p, min(b).d AS d, min(b).e AS e FROM (
              SELECT a.r, a.p, {{'d': CAST({distance} AS BIGINT), 'e': b.e}} AS b FROM part a JOIN book{n} b ON a.p = b.p) GROUP BY r, p)"""
        )
        if n < rounds:
            steps.append(
                f"""book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN (
                  SELECT p, e, list({_floor_mean("s", "n")} ORDER BY i) AS x FROM (
                    SELECT a.p, c.e, i, sum(a.x[i])::BIGINT AS s, count(*) AS n FROM part a JOIN near{n} c ON a.r = c.r AND a.p = c.p, range(1, len(a.x) + 1) AS u(i) GROUP BY ALL)
                  GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
            )
    steps.append(
        f"""coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)"""
    )
    steps.append(
        f"""digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})"""
    )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


def _clusters_sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Lloyd's rounds with every distance, one common table expression after the other."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id) AS r,
          list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = {width} AND {_complete("embedding")})""",
        f"centre0 AS MATERIALIZED (SELECT r - 1 AS c, v FROM kept WHERE r <= {k})",
    ]
    distance = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for n in range(rounds + 1):
        steps.append(
            f"""near{n} AS MATERIALIZED (SELECT r, min(b).d AS d, min(b).c AS c FROM (
              SELECT a.r, {{'d': CAST({distance} AS BIGINT), 'c': b.c}} AS b FROM kept a, centre{n} b) GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""centre{n + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.v, b.v) AS v FROM centre{n} b LEFT JOIN (
                  SELECT c, list({_floor_mean("s", "n")} ORDER BY i) AS v FROM (
                    SELECT g.c, i, sum(a.v[i])::BIGINT AS s, count(*) AS n FROM kept a JOIN near{n} g ON a.r = g.r, range(1, {width + 1}) AS u(i) GROUP BY ALL)
                  GROUP BY c) m ON b.c = m.c)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM kept JOIN near{rounds} USING (r) JOIN centre{rounds} z USING (c)"""


SQL: dict[str, str] = {
    "op6_revisit_resolution": REVISITS,
    "op11_active_codebooks": _codes_sql(),
    "op12_drift_clusters": _clusters_sql(),
}
