"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelark.llm.bpe import bpe_round_trip
from framelark.llm.exact_dedup import exact_dedup
from framelark.llm.lattice_dedup import lattice_near_dedup
from framelark.llm.line_dedup import line_dedup
from framelark.llm.mixing import mix_sources
from framelark.llm.ngram_join import ngram_jaccard
from framelark.llm.packing import pack_documents
from framelark.llm.quality import classify_quality
from framelark.llm.shipping import shipped
from framelark.llm.suffix_dedup import suffix_dedup
from framelark.llm.token_alignment import alignment_report
from framelark.llm.url_filter import url_filter
from framelark.llm.vector_codes import compress_vectors
from framelark.llm.warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query(
    "op1_warc_salvage",
    """
    WITH p AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
      FROM pages
    ), g AS (
      SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN g USING (payload_digest)
    """,
)
def op1(spark, sf):
    archives = write_warc(read(spark, sf, "pages"))
    return read_warc(archives, with_payload=False).filter("gap_reason IS NULL").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_ngram_jaccard")
def op2(spark, sf):
    return ngram_jaccard(read(spark, sf, "documents"), words=3, threshold=(90, 100))


@query("op3_suffix_dedup")
def op3(spark, sf):
    return suffix_dedup(read(spark, sf, "documents"), window=50).drop("kept")


@query("op4_line_dedup")
def op4(spark, sf):
    return line_dedup(read(spark, sf, "documents"), min_lines=2, long_bytes=50, whole_copies=True).drop("kept")


@query("op5_bpe")
def op5(spark, sf):
    return bpe_round_trip(read(spark, sf, "documents"), vocabulary_path())


@query(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
           count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    """,
)
def op6(spark, sf):
    return exact_dedup(read(spark, sf, "documents"), keep="max")


#: Fixed values of the query's contract: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op7_url_filter",
    r"""
    WITH cut AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
      SELECT page_id,
             coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM cut
    ), rules(r_host, r_path, r_verdict) AS (
      VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
             ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    ), best AS (
      SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
             arg_max(r_verdict, length(r_host || r_path)) AS verdict
      FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
      GROUP BY page_id
    )
    SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN best USING (page_id)
    """,
)
def op7(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(read(spark, sf, "pages"), rules)


@query("op8_lattice_near_dedup")
def op8(spark, sf):
    return lattice_near_dedup(read(spark, sf, "embeddings"), threshold=0.93)


@query("op9_best_fit_packing")
def op9(spark, sf):
    return pack_documents(read(spark, sf, "documents"), vocabulary_path())


@query("op10_quality_classifier")
def op10(spark, sf):
    return classify_quality(read(spark, sf, "documents"), read(spark, sf, "labels"), threshold=0.3)


@query(
    "op11_source_mixing",
    r"""
    WITH sized AS (
      SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
    ), sources AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source NULLS LAST) AS place
      FROM sized GROUP BY 1
    ), weighted AS (
      SELECT *, [3, 1, 2][CAST((place - 1) % 3 AS INT) + 1] AS weight FROM sources
    ), filling AS (
      SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             sum(source_size) OVER o AS sizes_upto, sum(weight) OVER o AS weights_upto
      FROM weighted WINDOW o AS (ORDER BY source_size / weight, place ROWS UNBOUNDED PRECEDING)
    ), capping AS (
      SELECT *, (150 * total - 200 * (sizes_upto - source_size)) * weight >= 200 * source_size * (weights - weights_upto + weight) AS capped
      FROM filling
    ), targets AS (
      SELECT source, source_size, place,
             CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
                  ELSE CAST(150 * total - 200 * coalesce(sum(source_size) FILTER (capped) OVER (), 0) AS DOUBLE) * weight
                       / CAST(100 * sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target,
             greatest(1, ceil(source_size / 1048576), ceil(n_rows / 65536)) AS shards
      FROM capping
    ), dealt AS (
      SELECT doc_id, size, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, t.*,
             CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % CAST(shards AS BIGINT) AS shard
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    ), shards AS (
      SELECT source, place, target, source_size, shard, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / 32) AS BIGINT) AS blocks
      FROM dealt GROUP BY 1, 2, 3, 4, 5
    ), wanted AS (
      SELECT place, sum(blocks) AS all_blocks, coalesce(target * sum(blocks) / nullif(CAST(source_size AS DOUBLE), 0), 0) AS want
      FROM shards GROUP BY place, target, source_size
    ), source_offers AS (
      SELECT place, row_number() OVER (ORDER BY want / (2 * k - 1) DESC, place) AS seat
      FROM (SELECT place, want, unnest(range(1, CAST(2 * all_blocks AS BIGINT) + 1)) AS k FROM wanted)
    ), source_quotas AS (
      SELECT place, count(*) AS quota FROM source_offers
      WHERE seat <= (SELECT round(sum(CAST(want AS DECIMAL(38, 6)))) FROM wanted) GROUP BY 1
    ), shard_offers AS (
      SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY CAST(blocks AS DOUBLE) / (2 * k - 1) DESC, shard) AS seat
      FROM (SELECT place, shard, blocks, unnest(range(1, 2 * blocks + 1)) AS k FROM shards)
    ), shard_quotas AS (
      SELECT place, shard, count(*) AS quota FROM shard_offers JOIN source_quotas USING (place) WHERE seat <= quota GROUP BY 1, 2
    ), runs AS (
      SELECT place, shard, words, blocks, coalesce(quota, 0) // greatest(blocks, 1) AS copies, coalesce(quota, 0) % greatest(blocks, 1) AS extra,
             CAST('0x' || substr(md5('11:' || coalesce('=' || source, '') || ':' || shard), 1, 8) AS BIGINT) % greatest(blocks, 1) AS first
      FROM shards LEFT JOIN shard_quotas USING (place, shard)
    ), bounds AS (
      SELECT place, shard, copies, first * words // greatest(blocks, 1) AS lo,
             least(first + extra, blocks) * words // greatest(blocks, 1) AS hi,
             greatest(first + extra - blocks, 0) * words // greatest(blocks, 1) AS wrap
      FROM runs
    ), rows_placed AS (
      SELECT *, CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM dealt
    )
    SELECT doc_id, size, source_size, target,
           CAST(copies * size + greatest(least(e, hi) - greatest(e - size, lo), 0) + greatest(least(e, wrap) - (e - size), 0) AS BIGINT) AS taken
    FROM rows_placed JOIN bounds USING (place, shard)
    """,
)
def op11(spark, sf):
    return mix_sources(read(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_token_alignment")
def op12(spark, sf):
    return alignment_report(read(spark, sf, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))


@query("op13_vector_codes")
def op13(spark, sf):
    return compress_vectors(read(spark, sf, "embeddings"))
