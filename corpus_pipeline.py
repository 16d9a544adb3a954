"""Corpus pipeline: documents through language ID, near and substring de-duplication, decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents (the
last one adds what the mix took); ``run`` writes each stage's result as Parquet into the shared checkpoint folder
and reads it back as the next stage's documents.

Defined cases, beyond those of the operators: rows that repeat id and text are copies, of which near
de-duplication keeps one; rows that share an id but not the text are documents of their own; n_chars follows a
text that a stage cuts; extra columns travel along; an empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm import langid
from roadtrace.llm.common import stored, table, text_key
from roadtrace.llm.decontaminate import contaminated_words
from roadtrace.llm.mixing import copies, mix
from roadtrace.llm.simhash import near_duplicates
from roadtrace.llm.substring_dedup import cut_repeats

#: Language ID rejects documents without a letter and those whose language has less than this posterior.
LEAST_SCORE = 0.5


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars (if it has one) made to follow the text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def _rest(docs: DataFrame) -> Column:
    """All columns but the text, which travels once, as one column ``doc`` (so no name can clash)."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")


def _unpacked(docs: DataFrame) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: those predicted ``und`` or below ``LEAST_SCORE`` go."""
    scored = langid.predict(docs.select(_rest(docs), "text"), langid.train(docs), keep=["doc", "text"])
    kept = scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*_unpacked(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the least (id, text key) of the component."""
    found = near_duplicates(docs.select("doc_id", "text"), shingle=3, radius=2)
    kept = (found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("_none"), F.coalesce("id", F.lit(0)).alias("_id"),
                                                     F.col("key").alias("_key"))).alias("least")).select("least.*"))
    named = docs.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
                              "_key": text_key(F.col("text"))})
    # rows that repeat id and text are copies, too; they meet in the same partition as the join's
    return (named.join(kept, ["_none", "_id", "_key"]).dropDuplicates(["_none", "_id", "_key"])
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 20 words or more that start earlier; a document that loses all its words goes."""
    out = cut_repeats(docs.select(_rest(docs), "doc_id", "text"), window=20, leave_clean=True)
    out = out.where((F.size("spans") == 0) | (F.col("text") != ""))
    return _with_text(out.select(*_unpacked(docs)), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 10 words of a benchmark item go."""
    found = contaminated_words(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    bad = found.where("n_hit > 0").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes: the columns of documents, size, source_size, target, epoch and taken."""
    out = copies(mix(docs, weights=(5, 2, 1), share=1.5, max_epochs=2))
    like = out.drop("size", "source_size", "target", "epochs", "epoch", "taken")
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in like.columns],
                      "size", "source_size", "target", "epoch", "taken")


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("substring_dedup", substring_dedup),
          ("decontaminate", decontaminate), ("mix_sources", mix_sources)]

#: Language posteriors and XXH64 fingerprints can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
