"""The parse and convert plan over streams: stateless up to windowed totals with a watermark."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.functions.text import cell_text, split_medications
from posolog.operators.convert import convert_all
from posolog.operators.parse import parse_stateless


def parse_stream(texts: DataFrame, text_col: str = "medication", methods: str | Iterable[str] = "ALL") -> DataFrame:
    """Every medication of a stream of texts, parsed and converted; factors are a static broadcast side."""
    each = texts.withColumn("_meds", split_medications(cell_text(F.col(text_col)))).select("*", F.posexplode("_meds").alias("item_pos", "_med")).drop("_meds")
    return convert_all(parse_stateless(each.drop(text_col).withColumnRenamed("_med", text_col), text_col), methods)


def totals(converted: DataFrame, time_col: str = "ts", key_col: str = "patient_id", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Summed equivalents of each key and method in windows of event time; rows later than the watermark are dropped."""
    timed = converted.filter("equivalent_dose_mg IS NOT NULL").withWatermark(time_col, late)
    sums = timed.groupBy(F.window(time_col, window), key_col, "method").agg(F.sum("equivalent_dose_mg").alias("equivalent_dose_mg"), F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("window_start"), key_col, "method", "equivalent_dose_mg", "n")
