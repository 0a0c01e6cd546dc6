"""Doses and quantities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posolog.functions.text import DOSE, plain_forms

#: Fixed value: the pattern of a quantity.
QUANTITY = r"(?iuU)\s((?:\d+(?:\.\d+)?|\.\d+))\s*(?:t|tabs?|tablets?|caps?|capsules?|정|캡슐)\b"


def number(c: Column) -> Column:
    """The text as a number, null if it is none."""
    return F.expr("null").cast("double") if c is None else plain_forms(c).try_cast("double")


def doses(c: Column) -> Column:
    """All doses of a text: array of (value, unit) with the unit in lower case and plain letters."""
    units = F.regexp_extract_all(c, F.lit(DOSE), F.lit(2))
    values = F.regexp_extract_all(c, F.lit(DOSE), F.lit(1))
    return F.zip_with(values, units, lambda v, u: F.struct(number(v).alias("value"), F.lower(plain_forms(u)).alias("unit")))


def to_mg(dose: Column) -> Column:
    """Milligrams of a (value, unit)."""
    return F.when(dose["unit"].isin("mcg", "ug", "μg"), dose["value"] / 1000.0).when(dose["unit"] == "g", dose["value"] * 1000.0).otherwise(dose["value"])


def quantity(c: Column) -> Column:
    """The first count of tablets or capsules, null without one."""
    return number(F.nullif(F.regexp_extract(c, QUANTITY, 1), F.lit("")))


def has_dose(c: Column) -> Column:
    return c.rlike(DOSE)
