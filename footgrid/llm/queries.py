"""Queries of this subpackage for ``__spark_entry__.py``: name to function of
``(spark, sf_dir)``, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from footgrid.llm import conversation_trie, embedding_tiles, line_crf, media_source, nbsvm_toxicity, pii_boost, prefix_bpe, simhash_bits, sos_packing, suffix_dedup, token_counts, warc_index, weighted_lloyd


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside strings of 400 bytes that repeat."""
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back through their index."""
    return warc_index.archived(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and line-label verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    return line_crf.line_quality(docs, line_crf.trained(docs, _table(spark, sf_dir, "labels")))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their round trip, as digests."""
    return prefix_bpe.id_digests(_table(spark, sf_dir, "documents"))


def op6_sos_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return sos_packing.packed(_table(spark, sf_dir, "documents"))


def op7_media_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media members and read back by the data source."""
    return media_source.stored_features(_table(spark, sf_dir, "documents"))


def op8_nbsvm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return nbsvm_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii_boost.personal_data(_table(spark, sf_dir, "documents"))


def op10_simhash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_bits.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_tiles.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op12_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector."""
    return weighted_lloyd.clusters(_table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc_index": op2_warc_index,
    "op3_token_counts": op3_token_counts,
    "op4_line_crf": op4_line_crf,
    "op5_prefix_bpe": op5_prefix_bpe,
    "op6_sos_packing": op6_sos_packing,
    "op7_media_source": op7_media_source,
    "op8_nbsvm_toxicity": op8_nbsvm_toxicity,
    "op9_pii_boost": op9_pii_boost,
    "op10_simhash_bits": op10_simhash_bits,
    "op11_embedding_tiles": op11_embedding_tiles,
    "op12_weighted_lloyd": op12_weighted_lloyd,
    "op13_conversation_trie": op13_conversation_trie,
}

_KEPT = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_sql(rounds: int = 3) -> str:
    """SQL of op12's contract: centroids ``c0`` to ``c3``, assignments ``a0`` to ``a3``."""
    out = f"""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND {_KEPT}),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM q ORDER BY sha256('1:' || vec_id) LIMIT 16),"""
    for i in range(rounds + 1):
        out += f"""
        d{i} AS (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q CROSS JOIN c{i}),
        a{i} AS (SELECT vec_id, v, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),"""
        if i < rounds:
            out += f"""
        x{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY c, i),
        m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM x{i} GROUP BY c),
        c{i + 1} AS (SELECT c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c)),"""
    return out.rstrip(",") + f"""
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


#: CRC-32 of the decimal conv_id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
          lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda x: CAST(0 AS UBIGINT))), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

#: The others are not expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_index": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN strlen(h) >= 100 AND least <> page_id THEN least END AS refers_to FROM p""",
    "op11_embedding_tiles": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND {_KEPT} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, p.y FROM reach JOIN p ON p.x = reach.r),
        n AS (SELECT x AS vec_id, count(*) AS n_links FROM p GROUP BY x), c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op12_weighted_lloyd": _lloyd_sql(),
    "op13_conversation_trie": f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list(t ORDER BY pos) AS ts, {_CRC} % 4 AS h FROM t GROUP BY conv_id),
        r AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.ts, 1, o.h), []), list_slice(o.ts, o.h + 1, len(o.ts))) AS ts FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
        e AS (SELECT conv_id, ts, len(ts) AS size, unnest(range(0, len(ts) + 1)) AS d FROM r),
        n AS (SELECT list_slice(ts, 1, d) AS p, d, any_value(ts[d].x) AS x, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM e GROUP BY ALL),
        k AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p, d)),
        u AS (SELECT p, d, n_children, (n_convs - 1) * len(regexp_extract_all(coalesce(x, ''), '[^\\x20\\x09-\\x0D]+')) AS saved, unnest(range(0, d + 1)) AS i FROM f),
        s AS (SELECT list_slice(p, 1, i) AS p, i AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL)
        SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM f JOIN s USING (p, d) LEFT JOIN n up ON up.d = f.d - 1 AND up.p = list_slice(f.p, 1, f.d - 1)""",
}
