"""Builds a factor table of all pairs from rows that give each drug's amount for one unit of an anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of anchors.
ANCHORS = {"OLZ": "olanzapine", "RIS": "risperidone", "CPZ": "chlorpromazine"}


def build_factors(rows: DataFrame) -> DataFrame:
    """Factors from rows (row_no, method_id, source_drug, target_drug, factor), sorted by their key.

    The code in a method's first row names its anchor; methods of unknown codes are left out. The anchor weighs 1 unless
    a row says otherwise; of several rows of a drug the last counts; null factors don't. Zero weights give null factors,
    which are left out.
    """
    rows = rows.filter(F.col("method_id").isNotNull())
    codes = F.create_map(*[F.lit(x) for kv in ANCHORS.items() for x in kv])
    first = rows.groupBy("method_id").agg(F.min_by(F.trim("source_drug"), "row_no").alias("_code")).withColumn("drug", F.try_element_at(codes, "_code")).filter("drug IS NOT NULL")
    given = rows.filter(F.col("factor").isNotNull()).join(F.broadcast(first.select("method_id")), "method_id", "left_semi").select("method_id", F.trim("target_drug").alias("drug"), F.col("factor").cast("double").alias("w"), F.col("row_no").cast("long").alias("row_no"))
    anchored = first.select("method_id", "drug", F.lit(1.0).alias("w"), F.lit(-1).cast("long").alias("row_no"))
    weights = given.unionByName(anchored).groupBy("method_id", "drug").agg(F.max_by("w", "row_no").alias("w"))
    source = weights.select("method_id", F.col("drug").alias("source_drug"), F.col("w").alias("_s"))
    target = weights.select("method_id", F.col("drug").alias("target_drug"), F.col("w").alias("_t"))
    pairs = source.join(target, "method_id").select("method_id", "source_drug", "target_drug", F.try_divide("_t", "_s").alias("factor"))
    return pairs.filter("factor IS NOT NULL").orderBy("method_id", "source_drug", "target_drug")
