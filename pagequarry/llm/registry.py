"""The queries of the operators, each over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, debruijn, embeddings, merkle, mixing, ngram_join, personal, pivots, quality, secrets, sharding, toxicity, vector_codes
from .common import documents, table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(documents(spark, sf_dir)))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_next(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.deduplicated(documents(spark, sf_dir))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.with_inertia(*pivots.clusters(table(spark, sf_dir, "embeddings")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.personal_spans(documents(spark, sf_dir), personal.fit(personal.labelled_table(spark))))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_error(*vector_codes.encode(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_balanced_shards": op5_balanced_shards,
    "op6_source_mix": op6_source_mix,
    "op7_merkle_fingerprints": op7_merkle_fingerprints,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_personal_data": op12_personal_data,
    "op13_vector_codes": op13_vector_codes,
}
#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {
    "op6_source_mix": mixing.mix_sql(),
    "op9_embedding_near_dedup": embeddings.cosine_sql(),
    "op11_centroid_clusters": pivots.clusters_sql(),
    "op13_vector_codes": vector_codes.codes_sql(),
}
