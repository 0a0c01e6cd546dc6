"""How often a day: keywords, hourly intervals, times a day, regimens; and what can't be told from a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, labels and times a day, in the order in which they are tried.
KEYWORDS = (
    (r"\b(?:qid|four\s+times?\s+(?:a\s+)?day|4\s*times?\s+(?:a\s+)?day|(?:하루|1일)\s*4\s*회)\b", "QID", 4.0),
    (r"\b(?:tid|three\s+times?\s+(?:a\s+)?day|3\s*times?\s+(?:a\s+)?day|(?:하루|1일)\s*3\s*회)\b", "TID", 3.0),
    (r"\b(?:bid|twice\s+(?:a\s+)?day|two\s+times?\s+(?:a\s+)?day|2\s*times?\s+(?:a\s+)?day|(?:하루|1일)\s*2\s*회)\b", "BID", 2.0),
    (r"\b(?:qod|every\s+other\s+day)\b", "QOD", 0.5),
    (r"\b(?:qhs|hs)\b", "QHS", 1.0),
    (r"\bqam\b", "QAM", 1.0),
    (r"\b(?:qd|od|daily|once\s+(?:a\s+)?day|every\s+day|(?:하루|1일)\s*1\s*회|매일)\b|(?:mg|mcg|ug|μg|㎍|㎎|g)\s*/\s*(?:day|d)\b", "QD", 1.0),
    (r"\b(?:weekly|once\s+(?:a\s+)?week)\b", "WEEKLY", 1.0 / 7.0),
)
# Patterns of intervals, times a day, regimens, and of what is not converted; labels.
HOURLY = r"\bq\s*(\d{1,2})\s*h\b|\bevery\s+(\d{1,2})\s+hours?\b"
TIMES = r"\b(\d{1,2})\s*times?\s+(?:a\s+)?day\b|(\d{1,2})\s*회\s*/\s*(?:일|day)\b"
REGIMEN = r"(?<![\d.])([0-9](?:\s*-\s*[0-9]){2,3})(?![\d.])"
PRN = r"\b(?:prn|as\s+needed|필요시)\b"
LAI = r"\b(?:lai|depot|injection|injectable|intramuscular|subcutaneous|im|iv|sc|weekly|monthly|q\d+\s*(?:w|wk|week|mo|month)s?|every\s+\d+\s*(?:weeks?|months?))\b|주사|데포|매주|매월"
LABELS = {1.0: "QD", 2.0: "BID", 3.0: "TID", 4.0: "QID"}
ASSUMED = "ASSUMED_QD"

FLAGS = "(?iuU)"


def _label(per_day: Column, otherwise: Column) -> Column:
    out = F.when(per_day == 1.0, "QD")
    for n in (2.0, 3.0, 4.0):
        out = out.when(per_day == n, LABELS[n])
    return out.otherwise(otherwise)


def _either(c: Column, pattern: str) -> Column:
    """The first match's first group, or else its second, as a whole number; null without a match."""
    one, two = (F.nullif(F.regexp_extract(c, FLAGS + pattern, k), F.lit("")) for k in (1, 2))
    return F.coalesce(one, two).try_cast("int")


def hours(c: Column) -> Column:
    return _either(c, HOURLY)


def times(c: Column) -> Column:
    return _either(c, TIMES)


def regimen(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, FLAGS + REGIMEN, 1), F.lit(""))


def regimen_total(c: Column) -> Column:
    parts = F.split(F.regexp_replace(regimen(c), r"(?U)\s", ""), "-")
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.coalesce(p.try_cast("int"), F.lit(0)))


def bad_interval(c: Column) -> Column:
    h = hours(c)
    return h.isNotNull() & ((h <= 0) | (h > 24) | F.coalesce(F.try_mod(F.lit(24), h) != 0, F.lit(True)))


def bad_times(c: Column) -> Column:
    n = times(c)
    return n.isNotNull() & ((n <= 0) | (n > 24))


def bad_regimen(c: Column) -> Column:
    return regimen(c).isNotNull() & (regimen_total(c) <= 0)


def frequencies(c: Column) -> Column:
    """All readings of a text in order, without repeats: array of (label, per_day). Meant for texts without bad ones."""
    found = [F.when(c.rlike(FLAGS + pattern), F.struct(F.lit(label).alias("label"), F.lit(n).alias("per_day"))) for pattern, label, n in KEYWORDS]
    h, t, total = hours(c), times(c), regimen_total(c)
    every = F.try_divide(F.lit(24.0), h)
    found.append(F.when(h.isNotNull(), F.struct(_label(every, F.concat(F.lit("Q"), h.cast("string"), F.lit("H"))).alias("label"), every.alias("per_day"))))
    found.append(F.when(t.isNotNull(), F.struct(_label(t.cast("double"), F.concat(t.cast("string"), F.lit("X_DAY"))).alias("label"), t.cast("double").alias("per_day"))))
    found.append(F.when(regimen(c).isNotNull(), F.struct(_label(total.cast("double"), F.replace(regimen(c), F.lit(" "), F.lit(""))).alias("label"), total.cast("double").alias("per_day"))))
    return F.array_distinct(F.filter(F.array(*found), lambda f: f.isNotNull()))


def conflict(found: Column) -> Column:
    """Whether readings have different labels."""
    return F.size(F.array_distinct(F.transform(found, lambda f: f["label"]))) > 1


def is_prn(c: Column) -> Column:
    return c.rlike(FLAGS + PRN)


def is_lai(c: Column) -> Column:
    return c.rlike(FLAGS + LAI)
