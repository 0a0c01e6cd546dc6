"""The batch plan: sheets in, detailed, audit and error tables out."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posolog.functions.dose import has_dose
from posolog.functions.numbers import rounded
from posolog.functions.text import cell_text, formula_guard, split_medications, strip
from posolog.operators.anonymize import anonymize, patient_map
from posolog.operators.convert import convert_all, method_warning, selected
from posolog.operators.detect import Roles, detect_columns
from posolog.operators.parse import parse_rx
from posolog.plans.dims import MESSAGES, NO_TEXT
from posolog.sources.work import stored

# Columns of the three tables.
DETAILED = ["sheet", "source_row", "medication_column", "patient", "original", "drug", "dose_mg", "frequency", "daily_dose_mg", "method", "target_drug", "equivalent_dose_mg", "warning", "match_type", "match_score", "needs_review", "method_warning"]
AUDIT = ["sheet", "source_row", "medication_column", "patient", "original", "parsed", "match_type", "match_score", "status", "unavailable_methods"]
ERRORS = ["sheet", "source_row", "medication_column", "patient", "original", "error"]
_PLACE = ["sheet", "sheet_idx", "row_index", "source_row", "medication_column", "patient"]
# Fixed value: a unit in a header.
_HEADER_UNIT = re.compile(r"(?:^|[_\s(])(mcg|ug|μg|㎍|mg|㎎|g)(?:$|[_\s)])")


class Sheet(NamedTuple):
    """Rows with row_index (from 0, in order) and text columns; header_row is the header's place."""

    name: str
    rows: DataFrame
    header_row: int = 0
    roles: Roles | None = None


class Report(NamedTuple):
    detailed: DataFrame
    audit: DataFrame
    errors: DataFrame


def compose(drug: Column, dose: Column, unit: Column, frequency: Column, dose_header: str) -> Column:
    """One text of a row's drug, dose and unit, and frequency; empty parts are left out.

    An empty unit is taken from the dose's header; a header of daily doses makes the frequency QD. Else a whole number
    is so many times a day and 0.5 every other day, after `.0` is cut out of the text.
    """
    name = dose_header.casefold()
    found = _HEADER_UNIT.search(name)
    unit = F.when(unit == "", found.group(1) if found else "").otherwise(unit)
    if any(w in name for w in ("daily", "일일", "1일")):
        frequency = F.lit("QD")
    else:
        text = F.replace(frequency, F.lit(".0"), F.lit(""))
        count = F.when(text.rlike(r"^(?U)\d+$"), F.regexp_replace(text, "^0+(?=.)", ""))
        often = F.create_map(*[F.lit(x) for kv in {"1": "QD", "2": "BID", "3": "TID", "4": "QID"}.items() for x in kv])
        frequency = F.when(text == "0.5", "QOD").when(count.isNotNull(), F.coalesce(F.try_element_at(often, count), F.concat(count, F.lit(" times a day")))).otherwise(frequency)
    parts = F.array(drug, F.when(dose != "", F.concat(dose, unit)).otherwise(""), frequency)
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def _items(sheet: Sheet, index: int, roles: Roles) -> DataFrame:
    """Rows of _PLACE with medications (array), raw cell and whether a separate dose stands against several drugs."""
    cell = lambda name: cell_text(F.col(f"`{name}`")) if name else F.lit("")
    raw = cell(roles.medication)
    rows = sheet.rows.select(
        F.lit(sheet.name).alias("sheet"), F.lit(index).alias("sheet_idx"), "row_index",
        (F.col("row_index") + sheet.header_row + 2).cast("long").alias("source_row"), F.lit(roles.medication).alias("medication_column"),
        (F.col(f"`{roles.patient}`").cast("string") if roles.patient else F.lit("")).alias("patient"), raw.alias("raw"), split_medications(raw).alias("meds"),
        cell(roles.dose).alias("_dose"), cell(roles.unit).alias("_unit"), cell(roles.frequency).alias("_frequency"),
    )
    apart = (F.size("meds") > 0) & ~F.exists("meds", has_dose) if roles.dose else F.lit(False)
    single = compose(F.get("meds", F.lit(0)), F.col("_dose"), F.col("_unit"), F.col("_frequency"), roles.dose or "")
    return rows.withColumn("split_dose", apart & (F.size("meds") > 1)).withColumn("meds", F.when(apart & (F.size("meds") == 1), F.array(single)).otherwise(F.col("meds"))).drop("_dose", "_unit", "_frequency")


def items(sheets: Iterable[Sheet]) -> tuple[DataFrame | None, list[str]]:
    """The rows of all sheets, pseudonyms in place, and the names of sheets without a medication column."""
    whole, missing = None, []
    for k, sheet in enumerate(sheets):
        roles = sheet.roles or detect_columns(sheet.rows)
        if roles.medication is None:
            missing.append(sheet.name)
            continue
        rows = _items(sheet, k, roles)
        whole = rows if whole is None else whole.unionByName(rows)
    return (None if whole is None else anonymize(whole, patient_map(whole))), missing


def explode_items(rows: DataFrame) -> DataFrame:
    """A row for each medication with its place in the cell; empty cells have none."""
    return rows.filter("NOT split_dose").select(*_PLACE, F.posexplode("meds").alias("item_pos", "medication"))


def run_batch(sheets: Iterable[Sheet], methods: str | Iterable[str] = "ALL", messages: bool = True) -> Report:
    """The three tables, without order; errors as messages or as codes. Items are parsed once, into a scratch table.

    A medication with no factor in any selected method is an error; one with some is in the audit with the others named.
    """
    sheets, chosen = list(sheets), selected(methods)
    rows, missing = items(sheets)
    spark = sheets[0].rows.sparkSession
    none = spark.createDataFrame([(name, None, "", "", "", "NO_MED_COLUMN") for name in missing], "sheet string, source_row bigint, medication_column string, patient string, original string, error string")
    if rows is None:
        empty = spark.createDataFrame([], "sheet string")
        return Report(empty.select(*[F.lit(None).alias(c) for c in DETAILED]), empty.select(*[F.lit(None).alias(c) for c in AUDIT]), _told(none, messages))
    parsed = stored(parse_rx(explode_items(rows)).drop("medication"))
    values = convert_all(parsed, chosen)
    detailed = values.filter("factor IS NOT NULL").select(
        *[rounded(F.col(c), 1).alias(c) if c == "match_score" else method_warning(F.col("method"), F.col("drug"), F.col("target_drug")).alias(c) if c == "method_warning" else F.col(c) for c in DETAILED]
    )
    key = [*_PLACE, "item_pos", "original", "drug", "match_type", "match_score", "needs_review"]
    lacking = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("factor").isNull(), F.struct("method_pos", "method")))), lambda x: x["method"]), ", ")
    judged = values.groupBy(*key).agg(F.count("factor").alias("_n"), lacking.alias("unavailable_methods"))
    status = F.when(F.col("needs_review"), "review").otherwise("converted")
    audit = judged.filter("_n > 0").select("sheet", "source_row", "medication_column", "patient", "original", F.col("drug").alias("parsed"), "match_type", rounded(F.col("match_score"), 1).alias("match_score"), status.alias("status"), "unavailable_methods")
    failed = parsed.filter("error IS NOT NULL").select(*ERRORS, F.lit(None).cast("string").alias("drug"))
    unconverted = judged.filter("_n = 0").withColumn("error", F.lit("NO_CONVERSION")).select(*ERRORS, "drug")
    several = rows.filter("split_dose").withColumn("error", F.lit("MULTI_DRUG_SPLIT_DOSE")).withColumn("original", F.col("raw")).select(*ERRORS, F.lit(None).cast("string").alias("drug"))
    errors = failed.unionByName(unconverted).unionByName(several).unionByName(none.withColumn("drug", F.lit(None).cast("string")))
    return Report(detailed, audit, _told(errors, messages).select(*ERRORS))


def _told(errors: DataFrame, messages: bool) -> DataFrame:
    if not messages:
        return errors
    table = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    drug = F.coalesce("drug", F.lit("")) if "drug" in errors.columns else F.lit("")
    return errors.withColumn("error", F.replace(F.try_element_at(table, "error"), F.lit("{drug}"), drug))


def guarded(table: DataFrame) -> DataFrame:
    """All text columns safe for a spreadsheet."""
    return table.select(*[formula_guard(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in table.schema.fields])


def api_parse(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """A row for each medication of a text: id, item_pos, ok, the parsed fields, and conversions, an array of
    (method, target, value) that names every method, with an empty target and no value where it has no factor."""
    each = df.select(id_col, F.posexplode(split_medications(cell_text(F.col(text_col)))).alias("item_pos", "medication"))
    parsed = parse_rx(each).drop("medication")
    fields = ["original", "drug", "dose_mg", "frequency", "frequency_per_day", "daily_dose_mg", "warning", "match_type", "match_score", "needs_review", "error"]
    values = convert_all(parsed)
    value = F.struct("method", F.when(F.col("factor").isNull(), "").otherwise(F.col("target_drug")).alias("target"), F.col("equivalent_dose_mg").alias("value"))
    good = values.groupBy(id_col, "item_pos", *fields).agg(F.array_sort(F.collect_list(value)).alias("conversions"))
    bad = parsed.filter("error IS NOT NULL").select(id_col, "item_pos", *fields, F.lit(None).cast(good.schema["conversions"].dataType).alias("conversions"))
    return good.unionByName(bad).withColumn("ok", F.col("error").isNull())


#: Fields of a reply's item, in order.
_SHOWN = ["ok", "original", "drug", "dose_mg", "frequency", "frequency_per_day", "daily_dose_mg", "warning", "match_type", "match_score", "needs_review"]


def api_json(df: DataFrame, body_col: str = "body", id_col: str = "id") -> DataFrame:
    """Rows (id, reply): JSON requests {"text": ..} answered as JSON {"items": [..]}; bodies that are no such request, or
    have a blank text, as {"error": ..}. Items are in the order of the text and those with an error show it."""
    asked = df.select(id_col, strip(F.coalesce(F.from_json(F.col(body_col).cast("string"), "text string")["text"], F.lit(""))).alias("text"))
    table = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    items_ = api_parse(asked, "text", id_col)
    good = F.struct(*[F.col(c) for c in _SHOWN], "conversions")
    bad = F.struct("ok", "original", F.try_element_at(table, "error").alias("error"), F.lit(True).alias("needs_review"))
    shown = items_.select(id_col, "item_pos", F.when(F.col("ok"), F.to_json(good, {"ignoreNullFields": "false"})).otherwise(F.to_json(bad)).alias("item"))
    replies = shown.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("item_pos", "item"))).alias("items"))
    listed = F.concat(F.lit('{"items":['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}"))
    none = F.when(F.col("text") == "", F.to_json(F.struct(F.lit(NO_TEXT).alias("error")))).otherwise('{"items":[]}')
    return asked.join(replies, id_col, "left").select(id_col, F.coalesce(listed, none).alias("reply"))
