"""One query for each operator of this package, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import language_id, toxicity
from tracewell.llm.collocations import collocations
from tracewell.llm.decontamination import decontaminate
from tracewell.llm.exact_search import top_k
from tracewell.llm.lexical_search import build_index, search
from tracewell.llm.packing import pack
from tracewell.llm.revisits import resolve
from tracewell.llm.sampling import fold
from tracewell.llm.sentencepiece_bpe import encode_decode
from tracewell.llm.sharding import shuffled, write_shards
from tracewell.llm.simhash import hex_fingerprint, simhash_components
from tracewell.llm.store import discard, new_path
from tracewell.llm.syncmers import fingerprints_and_edits
from tracewell.llm.substring_dedup import substring_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a crawl: each is fetched in the order of page_id and asked for again a thousand pages later; its tag is a digest of its content, which every
    third second request gets wrong. One row a page: what its second request resolves to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("tag"))
    first = F.create_map(F.lit("etag"), F.col("tag"), F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string"))
    again = F.create_map(F.lit("etag"), F.when(F.col("page_id") % 3 == 0, "other").otherwise(F.concat(F.lit("W/"), "tag")), F.lit("content-type"), F.lit("none"), F.lit("date"), (F.col("page_id") + 1000).cast("string"))
    visits = F.array(
        F.struct(F.lit("response").alias("kind"), (F.col("page_id") * 2).alias("fetched"), first.alias("headers")),
        F.struct(F.lit("revisit").alias("kind"), (F.col("page_id") * 2 + 2001).alias("fetched"), again.alias("headers")),
    )
    found = resolve(pages.select(F.col("page_id").alias("record_id"), "url", F.explode(visits).alias("v")).select("record_id", "url", "v.*"))
    return found.select(F.col("record_id").alias("page_id"), "canonical_url", "resolved_id", "status", *[F.col("headers")[h].alias(h.replace("-", "_")) for h in ("etag", "content-type", "date")])


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Labels of the rows of three folds of four; character counts of all documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    known = docs.select("doc_id", "text").where(fold(docs["doc_id"], 4) != 2).join(labels, "doc_id")
    return toxicity.fit(known, docs)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return found.select("doc_id", (fold(found["doc_id"], 4) == 2).alias("held_out"), "score", "predicted")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts go through both passes and into the shards; what is returned is read from those."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 8).cast("long").alias("size")
    sharded, path = shuffled(documents(spark, sf_dir).select("doc_id", "text", size), "size"), new_path(spark, "shards")
    write_shards(sharded, path)
    found = spark.read.schema(sharded.schema).parquet(path)
    return found.select("doc_id", size, F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(fold(docs["doc_id"], 3) != 1))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(found["doc_id"], 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_and_edits(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(documents(spark, sf_dir))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    discard(index.blocks)  # the answers are written
    return found


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir)).drop("words", "cut")


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op4_substring_dedup": op4_substring_dedup,
    "op1_sharding": op1_sharding,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op5_syncmer_fingerprints": op5_syncmer_fingerprints,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_toxicity": op8_toxicity,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op11_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        c AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
        p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
        q AS (SELECT i, item_id, unnest(w) AS t FROM b),
        f AS (SELECT t, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY t, N),
        s AS (SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * N) // L)))) AS BIGINT) AS score
            FROM q JOIN p USING (t) JOIN f USING (t) JOIN d USING (r), c GROUP BY i, item_id, r, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
    """,
    "op12_collocations": r"""
        WITH p AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
        g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, g, array_to_string(g, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, k, g),
        n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
        u AS (SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1:]),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM u) WHERE o = 1),
        x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(g[:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(g[2:], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
            FROM b LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a) JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op13_benchmark_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS x
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
        g AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
        h AS (SELECT DISTINCT r, p, i.n, item_id FROM g JOIN i ON g.x = i.x AND g.n = i.n),
        a AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
        s AS (SELECT r, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM h WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN a USING (r) LEFT JOIN s USING (r)
    """,
    "op7_warc_revisits": r"""
        WITH r AS (SELECT page_id, md5(coalesce(html, '')) AS tag, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
        q AS (SELECT page_id, tag, rest, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS kept FROM r),
        c AS (SELECT page_id, tag, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
            || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM q),
        p AS (SELECT a.page_id, a.url, CASE WHEN a.page_id % 3 = 0 THEN 'other' ELSE 'W/' || a.tag END AS mine, b.page_id AS id, b.tag AS theirs, row_number() OVER (PARTITION BY a.page_id ORDER BY b.page_id DESC NULLS LAST) AS n
            FROM c a LEFT JOIN c b ON a.url = b.url AND b.page_id * 2 < a.page_id * 2 + 2001),
        s AS (SELECT *, CASE WHEN url IS NULL THEN 'no url' WHEN id IS NULL THEN 'no earlier response' WHEN replace(mine, 'W/', '') = theirs THEN 'resolved' ELSE 'validator mismatch' END AS status FROM p WHERE n = 1)
        SELECT page_id, url AS canonical_url, CASE WHEN status = 'resolved' THEN id END AS resolved_id, status, mine AS etag, CASE WHEN status = 'resolved' THEN 'text/html' ELSE 'none' END AS content_type,
            CAST(page_id + 1000 AS VARCHAR) AS date FROM s
    """,
    "op9_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5
    """,
}
