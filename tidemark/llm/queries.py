"""The operators applied to the tables, with production parameters, and SQL for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.audio import align, render
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.language import predict_language, train_language
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pii import pii_digest
from tidemark.llm.secrets import scanned_digest
from tidemark.llm.storage import Scratch
from tidemark.llm.tokens import count_tokens
from tidemark.llm.topk import exact_top_k
from tidemark.llm.trie import grafted, in_order, trie_nodes, turn_ids
from tidemark.llm.urls import filter_urls, sample_entries
from tidemark.llm.warc import plan_records, read_archives, write_archives
from tidemark.llm.whitening import whiten


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item of which a window matches."""
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the figures of its source."""
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no fetch times and there are no lists, so both follow a rule of ids and hosts."""
    pages = _read(spark, sf_dir, "pages")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 400).cast("int")))
    found = filter_urls(captures, sample_entries(pages))
    return found.select("page_id", "fetched", F.concat_ws(",", "lists").alias("lists"), F.concat_ws(",", "keys").alias("keys"), (F.size("lists") > 0).alias("blocked"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back, a row for each record."""
    path = f"{Scratch(spark, 'warc').path}/archives"
    write_archives(plan_records(_read(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    return read_archives(spark, path).select(
        F.expr("try_cast(substring(record_id, 9) as long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(substring(refers_to, 9) as long)").alias("refers_to"), "error",
    )


def op5_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of all embeddings; every 20th id is held against all of them, at offsets with three votes."""
    return align(render(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "audio", votes=3)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; n_markov counts those that the models add."""
    return scanned_digest(_read(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree in 90 % or more."""
    return jaccard_components(_read(spark, sf_dir, "documents"), k=3, threshold=(90, 100))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32 is not 1 modulo 3, and predicts for all rows."""
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = train_language(docs.where("not held_out"))
    return predict_language(docs, model, keep=["doc_id", "held_out"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; n_context counts what bootstrapping adds."""
    return pii_digest(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of each of its lines."""
    return count_tokens(_read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on up to 16 whitened components; null and odd vectors as ``whiten`` says."""
    return whiten(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th id against all other rows; odd vectors as ``exact_top_k`` says."""
    return exact_top_k(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun as the first of its five; nulls and ties as ``prefix_trie`` says."""
    turns = Scratch(spark, "turns").table(in_order(turn_ids(_read(spark, sf_dir, "conversations"))), "turns")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return trie_nodes(*grafted(turns)).select(*names)


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_source_mixing, op3_url_filter, op4_warc_zstd, op5_audio_fingerprint, op6_secret_scan, op7_ngram_jaccard, op8_language_id, op9_pii, op10_token_counts,
    op11_whitening, op12_exact_top_k, op13_prefix_trie,
)}
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '\.?(:[0-9]*)?$', '')"
ORACLE_SQL: dict[str, str] = {
    # the entries here are of hosts and their parents, so keys with paths need not be asked
    "op3_url_filter": rf"""WITH p AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 400 AS INT) AS DATE) AS fetched, {_HOST} AS host FROM pages),
 k AS (SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]*\.', '')]) AS key FROM p), r AS (SELECT key, CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) AS c FROM k WHERE key <> ''),
 e AS (SELECT key, c, ['ads', 'spam', 'malware'][c % 7 + 1] AS list, DATE '2024-01-01' + CAST(c % 300 AS INT) AS d FROM r WHERE c % 7 < 3),
 iv AS (SELECT list, key, d AS since, CASE WHEN c % 2 = 0 THEN d + 60 END AS until FROM e UNION ALL SELECT list, key, d + 90, NULL FROM e WHERE c % 6 = 0),
 a AS (SELECT page_id, fetched, unnest([array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)]) AS key FROM p),
 h AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM a JOIN iv USING (key) WHERE since <= fetched AND (until IS NULL OR fetched < until) GROUP BY 1)
 SELECT page_id, fetched, coalesce(lists, '') AS lists, coalesce(keys, '') AS keys, lists IS NOT NULL AS blocked FROM p LEFT JOIN h USING (page_id)""",
    "op4_warc_zstd": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper, sha1(h) || '00' AS s FROM p)
 SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(s, (5 * i) // 4 + 1, 3) AS BIGINT) >> (7 - (5 * i) % 4)) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
 CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM x""",
    "op7_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
 r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, c.m AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY 1) c USING (doc_id)""",
    "op12_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_prefix_trie": """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda p, i: CASE WHEN p % 2 = 1 THEN xor(p // 2, 3988292384) ELSE p // 2 END))) % 9 AS h FROM t),
 r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT c.conv_id, pos - h + least(h, coalesce(n, 0)), role, text FROM c JOIN t USING (conv_id) LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1) b USING (base) WHERE pos > h),
 p AS (SELECT conv_id, 0 AS depth, '' AS path, CAST(0 AS BIGINT) AS bytes, FROM c UNION ALL
  SELECT conv_id, pos, string_agg(sha256(concat(strlen(role), ':', role, text)), ',') OVER (PARTITION BY conv_id ORDER BY pos), strlen(text) FROM r),
 z AS (SELECT conv_id, max(depth) AS z FROM p GROUP BY 1),
 m AS (SELECT p.conv_id AS member, depth, min(p.conv_id) OVER w AS conv_id, count(*) OVER w AS n_convs, bytes, z FROM p JOIN z USING (conv_id) WINDOW w AS (PARTITION BY depth, path)),
 n AS (SELECT m.conv_id, m.depth, any_value(n_convs) AS n_convs, any_value(bytes) * (any_value(n_convs) - 1) AS own, bool_and(z = m.depth) AS leaf, coalesce(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) FILTER (z = m.depth), '') AS ends FROM m GROUP BY 1, 2),
 u AS (SELECT a.conv_id, a.depth, CAST(sum(own) AS BIGINT) AS saved_tokens, CAST(count(*) FILTER (leaf) AS BIGINT) AS n_leaves FROM m a JOIN n ON n.conv_id = a.member AND n.depth >= a.depth GROUP BY 1, 2),
 k AS (SELECT b.conv_id, n.depth - 1 AS depth, count(*) AS n_children FROM n JOIN m b ON b.member = n.conv_id AND b.depth = n.depth - 1 GROUP BY 1, 2)
 SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
 FROM n JOIN u USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth) LEFT JOIN m b ON b.member = n.conv_id AND b.depth = n.depth - 1""",
}
