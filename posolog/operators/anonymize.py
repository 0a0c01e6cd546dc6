"""Pseudonyms in the order in which patients first appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posolog.functions.text import strip


def patient_map(rows: DataFrame, patient_col: str = "patient", order: tuple[str, ...] = ("sheet_idx", "row_index")) -> DataFrame:
    """Rows (patient_key, label): PATIENT_00001 and so on by first appearance over all rows; empty keys have none.

    Only distinct keys are numbered. They are dealt by ranges of their first place and numbered within each range, on
    from the counts of the ranges before it, so that no task has them all.
    """
    key = strip(F.col(patient_col).cast("string"))
    first = rows.select(key.alias("patient_key"), F.struct(*order).alias("_at")).filter("patient_key <> ''").groupBy("patient_key").agg(F.min("_at").alias("_at"))
    ranged = first.repartitionByRange("_at").withColumn("_range", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("_at", "patient_key")))
    sizes = ranged.groupBy("_range").agg(F.max("_n").alias("_size"), F.min("_at").alias("_begin"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    return ranged.join(F.broadcast(before), "_range").select("patient_key", F.format_string("PATIENT_%05d", F.col("_before") + F.col("_n")).alias("label"))


def anonymize(rows: DataFrame, mapping: DataFrame, patient_col: str = "patient") -> DataFrame:
    """rows with patient_col replaced by its label; empty and unknown ones become empty."""
    keyed = rows.withColumn("_key", strip(F.col(patient_col).cast("string")))
    return keyed.join(mapping, F.col("_key") == F.col("patient_key"), "left").withColumn(patient_col, F.coalesce("label", F.lit(""))).drop("_key", "patient_key", "label")
