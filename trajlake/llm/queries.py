"""The registered queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, media, mixing, near_dedup, packing, quality, secrets, suffix_dedup, toxicity, warc
from .common import LOWER, UPPER, load


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, stored as PNG, read back: see media.media_features. Null texts are empty; each row has its result."""
    return media.media_features(media.media_column(load(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, then looked up by its URL and id through the two-level index. Null html is empty; a null URL has the empty key."""
    pages = load(spark, sf_dir, "pages")
    return warc.look_up(warc.archive(spark, pages), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of every text. Null texts have none, and a null max_score."""
    found = secrets.scan(load(spark, sf_dir, "documents"), secrets.default_forest(spark))
    real = F.filter("findings", lambda x: x["secret"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(real).cast("long").alias("n_secrets"),
        F.array_sort(F.transform(real, lambda x: F.sha2(x["candidate"], 256))).alias("secret_sha256"),
        F.array_max(F.transform("findings", lambda x: x["score"])).alias("max_score"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of similar documents on two-word shingles. Null and empty texts are linked with nothing."""
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), words=2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every text as a repeat of 100 bytes or more. Null texts are empty."""
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents")).drop("spans")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of sequences of 2048 ids. Null texts hold the end id only."""
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every text. Null texts are scored as empty ones."""
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_on(docs, load(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every text. Null texts are judged as empty ones."""
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_on(docs, load(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts. Null texts are empty ones."""
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("_text", 256)})


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Null texts have size 0, a null source comes last."""
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_media, op2_warc, op3_secrets, op4_near_dedup, op5_suffix_dedup, op6_packing, op7_quality, op8_toxicity, op9_exact_dedup, op10_mixing)}

ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     g AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d.h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, true AS valid
FROM d LEFT JOIN g ON d.h = g.h""",
    "op4_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS x FROM w),
     n AS (SELECT doc_id, len(x)::BIGINT AS n FROM s),
     t AS (SELECT doc_id, n, unnest(x) AS x FROM s JOIN n USING (doc_id)),
     l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept
FROM n JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) ON doc_id = d""",
    "op5_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM b),
     g AS (SELECT doc_id, n, k, substring(h, 2 * k + 1, 2246) AS c FROM (SELECT *, unnest(range(0, n - 99, 1024)) AS k FROM n)),
     w AS (SELECT doc_id, k + i AS i, md5(substring(c, 2 * i + 1, 200)) AS x FROM (SELECT *, unnest(range(0, least(1024, n - 99 - k))) AS i FROM g)),
     r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
     j AS (SELECT doc_id, i, (i - lag(i, 1, -101) OVER (PARTITION BY doc_id ORDER BY i) > 100)::INT AS starts FROM r),
     s AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM j),
     z AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM s GROUP BY doc_id, span),
     y AS (SELECT z.*, h, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM z JOIN n USING (doc_id)),
     k AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substring(any_value(h), 2 * max(hi) + 1) AS kept FROM y GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)""",
    "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
}
