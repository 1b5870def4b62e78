"""The registered queries of the training-data operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embeddings import embedding_links
from .packing import best_fit_packing
from .periodic_runs import periodic_runs, with_repeats
from .personal_data import KINDS, examples, personal_data
from .prefix_trie import prefix_trie
from .sentence_pieces import sampled_digests
from .sharding import histogram_shards
from .simhash import simhash_components
from .substring import remove_repeats
from .token_binary import token_matrices
from .topk import scaled, voronoi_topk
from .toxicity import judge_toxicity
from .url_filters import filter_urls

#: verdict, host, path
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk(scaled(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("p_low_quality", 4).alias("p_low_quality"), F.round("p_toxic", 4).alias("p_toxic"), "toxic")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_matrices(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rows.select("sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "segment_ends", "position_resets", "doc_ids", "pieces", "starts")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are of the patterns' spans; spans has the field's besides."""
    found = personal_data(table(spark, sf_dir, "documents"), examples(spark))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *map(counted, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with up to five turns of the first of its hundred, in place of as many of its own."""
    return prefix_trie(table(spark, sf_dir, "conversations"), lambda c: (c - c % 100, F.crc32(c.cast("string")) % 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk_search": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
                  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op13_prefix_trie": """
            WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
            own AS (SELECT c, list(m ORDER BY i) AS v FROM t GROUP BY c),
            h AS (SELECT c, v, c - c % 100 AS hc, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 6 AS h FROM own),
            made AS (SELECT h.c, list_concat(coalesce(g.v[1:h.h], []), h.v[h.h + 1:]) AS v FROM h LEFT JOIN own g ON g.c = h.hc),
            d AS (SELECT c, v, len(v) AS n, unnest(range(len(v) + 1)) AS d FROM made),
            p AS (SELECT c, n, d, CAST(v[1:d] AS VARCHAR) AS k, CASE WHEN d > 0 THEN CAST(v[1:d - 1] AS VARCHAR) END AS pk, CASE WHEN d > 0 THEN length(v[d].x) ELSE 0 END AS chars FROM d),
            g AS (SELECT k, any_value(pk) AS pk, any_value(d) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY k, d),
            kids AS (SELECT pk AS k, count(*) AS n_children FROM g WHERE pk IS NOT NULL GROUP BY pk),
            node AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (k)),
            below AS (SELECT DISTINCT a.k, b.k AS sub FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d),
            sums AS (SELECT below.k, count(*) FILTER (n.n_children = 0) AS n_leaves, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens FROM below JOIN node n ON n.k = below.sub GROUP BY below.k)
            SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, node.n_children, n_leaves, saved_tokens, node.ends_sha256 FROM node JOIN sums ON sums.k = node.k LEFT JOIN node up ON up.k = node.pk""",
    }
