"""The corpus queries, each over whole tables, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spreadloom.llm import audit, bpe, decontaminate, exactdedup, langid, licenses, minhash, quality, ranking, runindex, sharding, substring, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 24)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    settings = langid.Settings()
    net = langid.train(langid.sample(docs.where(~langid.held_out()), settings), settings)
    return langid.predict(docs.select("doc_id", "text").withColumn("held_out", langid.held_out()), net, ("doc_id", "held_out"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.without_repeats(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_language_id, op3_bpe, op4_decontamination, op5_html_extraction, op6_near_dedup, op7_exact_dedup, op8_quality, op9_substring_dedup, op10_license_scan,
        op11_suffix_array_dedup, op12_lexical_search, op13_filter_audit,
    )
}

ORACLE = {
    "op11_suffix_array_dedup": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        win AS (SELECT doc_id, s, md5(b[s:s + 399]) AS t FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS s FROM d WHERE octet_length(b) >= 400)),
        again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY t) AS k FROM win) WHERE k > 1),
        reach AS (SELECT doc_id, s, max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM again),
        spans AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS z, row_number() OVER (PARTITION BY doc_id ORDER BY min(s)) AS k FROM (SELECT *, sum((p IS NULL OR s > p + 400)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM reach) GROUP BY doc_id, g),
        cuts AS (SELECT doc_id, list(struct_pack(a, z) ORDER BY k) AS c FROM spans GROUP BY 1),
        kept AS (
            SELECT doc_id, b, coalesce(c, []) AS c,
                CASE WHEN c IS NULL THEN hex(b) ELSE array_to_string(list_concat([hex(b[1:c[1].a - 1])], [hex(b[c[i].z:(CASE WHEN i < len(c) THEN c[i + 1].a - 1 ELSE octet_length(b) END)]) FOR i IN range(1, len(c) + 1)]), '') END AS h
            FROM d LEFT JOIN cuts USING (doc_id)
        )
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, octet_length(b)::BIGINT - length(h) // 2 AS n_removed, len(c)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept
    """,
    "op12_lexical_search": r"""
        WITH low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        d AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM low WHERE len(w) > 0),
        total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
        wt AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, nn),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM q JOIN tf USING (t) JOIN wt USING (t), total GROUP BY ALL)
        SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 50
    """,
    "op13_filter_audit": r"""
        WITH f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        fails AS (
            SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
                CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fs
            FROM words LEFT JOIN labels USING (doc_id)
        ),
        sets AS (SELECT part, good, toxic, fs, count(*) AS n FROM fails GROUP BY ALL),
        steps AS (SELECT *, filter_order[step] AS f FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
        judged AS (
            SELECT part, filter_order, step, f, good, toxic, n, contains(fs, f) AS hit, fs = f AS alone,
                len(list_filter(string_split(fs, ''), lambda x: position(x IN filter_order) < step)) = 0 OR fs = '' AS here
            FROM sets, steps
        ),
        sums AS (
            SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (here AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND hit), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (hit AND NOT here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
                coalesce(sum(n) FILTER (here AND hit AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (here AND hit AND toxic), 0)::BIGINT AS toxic_lost
            FROM judged GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM sums
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, s, hash(array_to_string(w[s:s + 19], ' ')) AS h, md5(array_to_string(w[s:s + 19], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
        later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h, t ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
        kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op4_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), iw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s:s + 9], ' ') AS t
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM iw WHERE len(w) > 0)
        ), dwin AS (
            SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS t
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
        ), hit AS (SELECT doc_id, item_id, s, m FROM dwin JOIN win USING (m, t)
        ), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY 1
        ), items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
