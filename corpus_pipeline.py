"""A corpus pipeline of five stages over the training-data operators, each written as a table and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posolog.llm.bpe import recode
from posolog.llm.common import quoted, small, table, unused, written
from posolog.llm.decontaminate import ADDED, find_matches, judged
from posolog.llm.jaccard_join import near_components
from posolog.llm.line_dedup import dedup_lines
from posolog.llm.quality import fit, score_quality

#: Near copies share so large a part of their shingles of so many words; op10's own values bind only its query.
NEAR_WORDS, NEAR_THRESHOLD = 5, (80, 100)
#: Broadcast the ids of copies only up to so many.
BROADCAST_IDS = 500_000


def _keeping(docs: DataFrame, added: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that work() leaves of docs, with docs' columns; those that are named as one of `added` are put aside
    meanwhile."""
    aside = dict(zip(named := [c for c in docs.columns if c.lower() in added], unused(docs, *named), strict=True))
    return work(docs.withColumnsRenamed(aside)).select(*[quoted(aside.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality votes reach the threshold; repeated rows are judged alike, an empty table stays empty."""
    votes = fit(docs, table(spark, sf_dir, "labels"))
    return _keeping(docs, ("score", "predicted"), lambda d: score_quality(d, votes).filter("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated lines; one of which nothing is left goes. Null and blank texts
    stay; rows equal in id and text come out alike. n_chars, where it is there, counts what is left."""

    def work(d: DataFrame) -> DataFrame:
        cut = dedup_lines(d).filter("n_removed = 0 OR text IS NULL OR trim(text) <> ''")
        if "n_chars" in d.columns:
            cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(d.schema["n_chars"].dataType))
        return cut

    return _keeping(docs, ("n_lines", "n_removed"), work)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; rows with a null id stay.

    Where ids are repeated, rows are told apart by id and text: of texts with one id that of the smallest hash counts as
    the first, and of rows equal in both one stays. Texts without words are nobody's copies and stay.
    """
    repeated = not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
    own = unused(docs, "place")[0]
    place = F.struct("doc_id", F.xxhash64("text").alias("key")) if repeated else F.col("doc_id")
    placed = docs.withColumn(own, F.when(F.col("doc_id").isNotNull(), place))
    found = near_components(placed, own, words=NEAR_WORDS, threshold=NEAR_THRESHOLD)
    copies = written(found.filter(F.col(own) != F.col("component_id")).select(own).distinct(), "copies")
    kept = placed.join(small(copies, copies.count(), BROADCAST_IDS), own, "left_anti")
    if repeated:
        single = F.col(own).isNotNull() & F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
        kept = kept.filter(single).dropDuplicates([own]).union(kept.filter(~single))
    return kept.select(*[quoted(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; without items all stay."""
    return _keeping(docs, (*ADDED, "contaminated"), lambda d: judged(find_matches(d, table(spark, sf_dir, "benchmark"))).filter("NOT contaminated"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text that they decode to."""
    coded = recode(docs.select("doc_id", "text"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]

#: Votes and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
