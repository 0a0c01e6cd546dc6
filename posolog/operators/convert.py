"""Daily doses as equivalents of a target drug."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.functions.numbers import rounded
from posolog.plans.dims import ED95_HALOPERIDOL, METHOD_WARNINGS, METHODS, WEIGHTS, dim_factor, factor_rows, weight_rows


def targets(method: str) -> list[str]:
    """A method's drugs, sorted."""
    return sorted(d for m, d, _ in weight_rows() if m == method.strip().upper())


def checked(method: str, target: str | None = None) -> tuple[str, str]:
    """Method and target in their plain forms; ValueError for one that is not there."""
    method = method.strip().upper()
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    target = (target or WEIGHTS[method][1]).strip().casefold()
    if target not in targets(method):
        raise ValueError(f"no target of {method}: {target}")
    return method, target


def selected(methods: str | Iterable[str] = "ALL") -> list[str]:
    """Methods as given, or all in order."""
    asked = [methods] if isinstance(methods, str) else list(methods)
    return list(METHODS) if [m.strip().upper() or "ALL" for m in asked] == ["ALL"] else [checked(m)[0] for m in asked]


def method_warning(method: Column, source: Column | None = None, target: Column | None = None) -> Column:
    """A method's standing warning, with a sentence more where ED95 meets haloperidol."""
    name = F.upper(F.trim(method))
    table = F.create_map(*[F.lit(x) for kv in METHOD_WARNINGS.items() for x in kv])
    drugs = [F.coalesce(F.lower(c), F.lit("")) == "haloperidol" for c in (source, target) if c is not None]
    meets = drugs[0] | drugs[-1] if drugs else F.lit(False)
    return F.concat(F.coalesce(F.try_element_at(table, name), F.lit("")), F.when((name == "ED95") & meets, ED95_HALOPERIDOL).otherwise(""))


def convert_all(parsed: DataFrame, methods: str | Iterable[str] = "ALL") -> DataFrame:
    """A row for every row with a drug and every selected method: method, method_pos, target_drug, factor and
    equivalent_dose_mg (rounded to 4), the last two null where the method has no factor for the drug."""
    chosen = selected(methods)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("method_pos"), F.lit(m).alias("method"), F.lit(WEIGHTS[m][1]).alias("target_drug")) for k, m in enumerate(chosen)]))
    factors = dim_factor(parsed.sparkSession).toDF("_m", "_s", "_t", "factor")
    rows = parsed.filter(F.col("drug").isNotNull()).select("*", each.alias("_each")).select("*", "_each.*").drop("_each")
    joined = rows.join(F.broadcast(factors), (F.col("method") == F.col("_m")) & (F.col("drug") == F.col("_s")) & (F.col("target_drug") == F.col("_t")), "left").drop("_m", "_s", "_t")
    return joined.withColumn("equivalent_dose_mg", rounded(F.col("daily_dose_mg") * F.col("factor"), 4))


def convert_one(df: DataFrame, method: str = "CMD", target: str | None = None, drug_col: str = "drug", dose_col: str = "daily_dose") -> DataFrame:
    """Adds factor, equivalent (unrounded) and error: BAD_DOSE, NO_CONVERSION or null. Any text may stand for a dose."""
    method, target = checked(method, target)
    factors = dim_factor(df.sparkSession).filter((F.col("method_id") == method) & (F.col("target_drug") == target)).select(F.col("source_drug").alias("_s"), "factor")
    dose = F.col(dose_col).cast("string").try_cast("double")
    good = dose.isNotNull() & ~F.isnan(dose) & (dose > 0) & (dose != float("inf"))
    joined = df.join(F.broadcast(factors), F.lower(F.trim(drug_col)) == F.col("_s"), "left").drop("_s")
    error = F.when(~good, "BAD_DOSE").when(F.col("factor").isNull(), "NO_CONVERSION")
    return joined.withColumn("error", error).withColumn("equivalent", F.when(F.col("error").isNull(), dose * F.col("factor")))


def duplicate_factors(factors: DataFrame) -> DataFrame:
    """Keys of a factor table that stand more than once."""
    return factors.groupBy("method_id", "source_drug", "target_drug").agg(F.count("*").alias("n")).filter("n > 1")


if len({(m, s, t) for m, s, t, _ in factor_rows()}) != len(factor_rows()):
    raise ValueError("the factor table has a key twice")
