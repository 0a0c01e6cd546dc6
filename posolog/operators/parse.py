"""A prescription's drug, dose and frequency, or the first error that stands against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.functions import dose as D
from posolog.functions import frequency as Q
from posolog.functions.numbers import rounded
from posolog.functions.text import normalize_text, strip
from posolog.operators.match import alias_compact, alias_exact, alias_nearest, compact_query, match_drugs
from posolog.plans.dims import ASSUMED_WARNING

#: What parse_matched() adds.
PARSED = ("dose_mg", "frequency", "frequency_per_day", "daily_dose_mg", "warning", "needs_review", "error")


def parse_matched(df: DataFrame, text_col: str = "original") -> DataFrame:
    """Adds PARSED to rows with drug and match_type. error is a code or null; with an error all else is null.

    Errors in order: EMPTY, UNKNOWN_DRUG, NO_DOSE, MULTI_DOSE, BAD_QUANTITY, BAD_DOSE, PRN, LAI_OR_WEEKLY,
    BAD_INTERVAL, BAD_TIMES, BAD_REGIMEN, FREQ_CONFLICT.
    """
    text = F.col(text_col)
    step = df.withColumns({"_doses": D.doses(text), "_quantity": D.quantity(text), "_found": Q.frequencies(text)})
    one = F.get("_doses", F.lit(0))
    amount = D.to_mg(one) * F.coalesce("_quantity", F.lit(1.0))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    step = step.withColumn("_mg", amount)
    error = (
        F.when(text.isNull() | (text == ""), "EMPTY")
        .when(F.col("drug").isNull(), "UNKNOWN_DRUG")
        .when(F.size("_doses") == 0, "NO_DOSE")
        .when(F.size("_doses") > 1, "MULTI_DOSE")
        .when(F.col("_quantity").isNotNull() & ~(finite(F.col("_quantity")) & (F.col("_quantity") > 0)), "BAD_QUANTITY")
        .when(~(finite(F.col("_mg")) & (F.col("_mg") > 0)), "BAD_DOSE")
        .when(Q.is_prn(text), "PRN")
        .when(Q.is_lai(text), "LAI_OR_WEEKLY")
        .when(Q.bad_interval(text), "BAD_INTERVAL")
        .when(Q.bad_times(text), "BAD_TIMES")
        .when(Q.bad_regimen(text), "BAD_REGIMEN")
        .when(Q.conflict(F.col("_found")), "FREQ_CONFLICT")
    )
    step = step.withColumn("error", error).withColumn("_first", F.get("_found", F.lit(0)))
    good = lambda c: F.when(F.col("error").isNull(), c)
    per_day = F.coalesce("_first.per_day", F.lit(1.0))
    warning = F.when(F.size("_found") == 0, ASSUMED_WARNING).otherwise("")
    return step.withColumns(
        {
            "dose_mg": good(rounded(F.col("_mg"), 6)),
            "frequency": good(F.coalesce("_first.label", F.lit(Q.ASSUMED))),
            "frequency_per_day": good(per_day),
            "daily_dose_mg": good(rounded(F.col("_mg") * per_day, 6)),
            "warning": good(warning),
            "needs_review": F.col("error").isNotNull() | (F.col("match_type") != "exact") | (F.size("_found") == 0),
            "drug": good(F.col("drug")),
            "match_type": good(F.col("match_type")),
            "match_score": good(F.col("match_score")),
        }
    ).drop("_doses", "_quantity", "_found", "_mg", "_first")


def parse_rx(df: DataFrame, text_col: str = "medication") -> DataFrame:
    """Adds original (the stripped text), drug, match_type, match_score and PARSED to every row."""
    return parse_matched(match_drugs(df.withColumn("original", strip(F.coalesce(F.col(text_col), F.lit(""))))))


def parse_stateless(df: DataFrame, text_col: str = "medication") -> DataFrame:
    """As parse_rx, without the join on distinct names: fit for streams, dearer where many names are unresolved."""
    normal = normalize_text(F.col("original"))
    named = df.withColumn("original", strip(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_normal", normal)
    named = named.withColumn("_drug", F.coalesce(alias_exact(F.col("_normal")), alias_compact(compact_query(F.col("_normal")))))
    named = named.withColumn("_near", F.when(F.col("_drug").isNull(), alias_nearest(compact_query(F.col("_normal")))))
    matched = named.withColumns(
        {
            "drug": F.coalesce("_drug", "_near.drug"),
            "match_type": F.when(F.col("_drug").isNotNull(), "exact").when(F.col("_near").isNotNull(), "fuzzy"),
            "match_score": F.when(F.col("_drug").isNotNull(), 100.0).otherwise(F.col("_near.score")),
        }
    )
    return parse_matched(matched.drop("_normal", "_drug", "_near"))
