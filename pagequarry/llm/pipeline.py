"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, mixing, ngram_join, quality, secrets
from .common import checked_broadcast, documents, fresh, saved, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier, fitted on the labelled documents, scores below its threshold.

    Keeps all documents if no labelled rows of both classes were there to learn from. A null text is scored as an
    empty one; repeated rows share their fate; an empty table stays empty; further columns, of any name, stay.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of the n-gram join: that of the least id, ids before none, then of the least text digest.

    Rows are told apart by id and text, so neither a repeated nor a missing id drops or keeps another text; of rows
    that are equal in both, the one whose other columns have the least hash stays. Texts without words (null, empty)
    are in no class and stay, with each of their rows. An empty table stays empty; further columns, of any name, stay.
    """
    kind = docs.schema["doc_id"].dataType
    own, ident, row, rank = fresh(docs, "_own", "_ident", "_row", "_rank")
    id_ = F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"))
    found = saved(ngram_join.classes(docs.select(id_.alias("doc_id"), "text")))
    gone = saved(found.where("doc_id <> component_id").select(F.col("doc_id").alias(ident)).distinct())
    kept = docs.withColumn(own, id_).join(checked_broadcast(gone), F.col(own) == F.col(ident), "left_anti")
    repeated = saved(found.where("n_shingles > 0 and doc_id = component_id").groupBy(F.col("doc_id").alias(ident)).count().where("count > 1").select(ident))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    few, again = checked_broadcast(repeated), F.col(own) == F.col(ident)
    others = F.xxhash64(*[f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)])
    some = kept.join(few, again, "left_semi").select(own, F.struct(*docs.columns).alias(row), others.alias(rank))
    once = some.groupBy(own).agg(F.min_by(row, rank).alias(row)).select(f"{row}.*")
    return kept.join(few, again, "left_anti").select(*docs.columns).unionByName(once)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts and counts their characters anew.

    A null text stays null and keeps its count; texts without secrets, empty ones among them, stay as they are. Every
    row stays, repeated ones too; an empty table stays empty; further columns, of any name, stay.
    """
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents never, once or twice, so that the sources' words come to their targets.

    Documents without words (null, empty, blank) have nothing to take and go. A null source is one of its own. Rows
    that repeat an id share its hash, so they are taken or left together, each as often. An empty table stays empty;
    further columns, of any name, stay.
    """
    return mixing.mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of tokens, their ids, and the digest of the text that these decode to.

    A null text counts as empty: no tokens. Every row gives one, repeated ones too; an empty table gives none; further
    columns are left out.
    """
    return bpe.encode(docs, keep=("doc_id", "lang", "source"), check=True)


def run(stages: list, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i < len(stages) - 1:
            docs = written(docs)
    return docs
