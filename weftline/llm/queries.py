"""The numbered queries: each operator over its whole table, as the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import embed_dedup, fim, hard_negatives, html_text, licences, mixing, ngrams, packing, quality, substrings, token_files, topk, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=80)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"), window=35)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(*mixing.mix(table(spark, sf_dir, "documents")))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.with_restored(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, "vec_id % 100 = 0")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {
    "op1_best_fit_packing": op1,
    "op2_ngram_jaccard_join": op2,
    "op3_substring_dedup": op3,
    "op4_html_extraction": op4,
    "op5_embedding_near_dedup": op5,
    "op6_exact_top_k": op6,
    "op7_license_scan": op7,
    "op8_url_filter": op8,
    "op9_source_mixing": op9,
    "op10_quality_classifier": op10,
    "op11_fill_in_middle": op11,
    "op12_hard_negatives": op12,
    "op13_token_id_files": op13,
}

#: op1-op5, op7's fuzzy labels, op10: SQL can't express the method's rows; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op6_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id AS query_id, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM v WHERE vec_id % 100 = 0),
        c AS (SELECT vec_id, unnest(t) AS x, generate_subscripts(t, 1) AS k FROM v),
        s AS (SELECT query_id, vec_id, CAST(sum(w * x) AS BIGINT) AS score FROM q JOIN c USING (k) WHERE query_id <> vec_id GROUP BY ALL),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_url_filter": r"""
        WITH RECURSIVE p AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
                lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        n AS (SELECT *, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '^((?s:.*?))://', 1)) || '://' || host || regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) END AS node FROM p),
        tags AS (SELECT node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?i)<link\b[^>]*>')) AS t FROM n),
        links AS (SELECT DISTINCT node AS a, regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>#]+)', 1) AS b FROM tags WHERE regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical')),
        two_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a, b FROM two_way UNION SELECT r.a, w.b FROM reach r JOIN two_way w ON r.b = w.a),
        nodes AS (SELECT node, host, path FROM n UNION SELECT b, lower(regexp_extract(b, '://([^/?#]*)', 1)), regexp_extract(b, '://[^/?#]*([^?#]*)', 1) FROM links),
        rules(kind, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fit AS (SELECT node, arg_max(h || q, length(h || q)) AS rule, arg_max(kind, length(h || q)) AS kind FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY node),
        spread AS (SELECT r.a AS node FROM reach r JOIN fit f ON f.node = r.b GROUP BY r.a HAVING bool_or(f.kind = 'block') AND NOT bool_or(f.kind = 'allow'))
        SELECT page_id, n.host, n.path, f.rule, coalesce(f.kind, CASE WHEN s.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
        FROM n LEFT JOIN fit f ON f.node = n.node LEFT JOIN spread s ON s.node = n.node""",
    "op9_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        s AS (SELECT source, sum(size) AS source_size, list_value(3, 1, 2)[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
        f AS (SELECT *, CAST(source_size AS DOUBLE) / w AS ratio FROM s),
        c AS (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS each,
            coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f),
        k AS (SELECT arg_min(each, used) AS factor FROM c WHERE each * w <= 2.0 * source_size),
        t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(least(2.0 * source_size, factor * w) AS DOUBLE) AS target, CAST(floor(least(2.0 * source_size, factor * w) + 0.5) AS BIGINT) AS quota FROM c, k),
        o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
        SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size)) AS BIGINT) AS taken
        FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source""",
    "op11_fill_in_middle": r"""
        WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
        d AS (SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM h),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM p""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.t, c.t), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND (c.vec_id <> a.vec_id OR c.label <> a.label)),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
