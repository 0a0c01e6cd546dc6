"""The registered queries of the dose engine; `oracle` has the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posolog.functions import dose as D
from posolog.functions import frequency as Q
from posolog.functions import text as T
from posolog.functions.numbers import rounded
from posolog.operators import convert as C
from posolog.operators import detect as H
from posolog.operators import match as M
from posolog.operators.anonymize import anonymize, patient_map
from posolog.operators.factors import build_factors
from posolog.operators.parse import parse_rx
from posolog.plans import dims
from posolog.plans.batch import Sheet, api_parse, compose, guarded, items, run_batch
from posolog.plans.fixtures import free_sheet, prescriptions, split_sheet
from posolog.sources.tables import read_cells, read_csv, sample

Query = Callable[[SparkSession, str], DataFrame]

#: Names of headers that the detection queries score.
HEADERS = ("patient_id", "drug_id", "medication", "Prescribed Drug", "daily_dose_mg", "dose unit", "unit", "frequency", "rx", "name", "subject number", "notes", "dosage", "medicine strength", "freq")
FREE_ROLES = H.Roles("patient_id", "medication")
SPLIT_ROLES = H.Roles("patient_id", "drug", "dose_mg", "unit", "frequency")
PARSED = ["drug", "dose_mg", "frequency", "frequency_per_day", "daily_dose_mg", "match_type", "match_score", "needs_review"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily chlorpromazine equivalents of each patient under each method that has them."""
    values = C.convert_all(parse_rx(prescriptions(spark, sf_dir))).filter("equivalent_dose_mg IS NOT NULL AND target_drug = 'chlorpromazine'")
    return values.groupBy("patient_id", "method").agg(F.round(F.sum(F.col("equivalent_dose_mg").cast("decimal(38,4)")).cast("double"), 4).alias("cpz_mg_per_day"), F.count("*").alias("n_prescriptions"))


def _of_text(**columns: Callable[[Column], Column]) -> Query:
    """Expressions of the whole text of every prescription."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prescriptions(spark, sf_dir).select("rx_id", *[make(F.col("medication")).alias(name) for name, make in columns.items()])

    return query


def _joined_frequencies(c: Column) -> Column:
    return F.array_join(F.transform(Q.frequencies(c), lambda f: F.concat_ws("=", f["label"], F.round(f["per_day"], 6).cast("string"))), "|")


def _labels(c: Column) -> Column:
    bad = Q.bad_interval(c) | Q.bad_times(c) | Q.bad_regimen(c)
    return F.when(~bad, F.array_join(F.transform(Q.frequencies(c), lambda f: f["label"]), "|"))


def _sheets(spark: SparkSession, sf_dir: str) -> list[Sheet]:
    notes = spark.createDataFrame([(0, "nothing here")], "row_index bigint, notes string")
    return [Sheet("free", free_sheet(spark, sf_dir), 0, FREE_ROLES), Sheet("split", split_sheet(spark, sf_dir), 2, SPLIT_ROLES), Sheet("notes", notes, 0, H.Roles())]


def _factor_rows(spark: SparkSession) -> DataFrame:
    """Rows as a source workbook has them: anchor codes, a null, a repeated drug and a method of an unknown anchor."""
    code = {v: k for k, v in (("OLZ", "olanzapine"), ("RIS", "risperidone"), ("CPZ", "chlorpromazine"))}
    rows = [(m, code[dims.WEIGHTS[m][0]], d, w) for m, d, w in dims.weight_rows() if d != dims.WEIGHTS[m][0]]
    rows += [("MED", "OLZ", "sertindole", 9.9), ("MED", "OLZ", "sertindole", 1.6), ("DDD", "OLZ", "nothing", None), ("XXX", "HAL", "clozapine", 2.0)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_no int, method_id string, source_drug string, target_drug string, factor double")


def _matches(expression: Callable[[Column], Column], name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prescriptions(spark, sf_dir).select("rx_id", expression(T.normalize_text(F.col("medication"))).alias(name))

    return query


def alias_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match_drugs(prescriptions(spark, sf_dir), "medication").filter("match_type = 'fuzzy'")
    return found.select("rx_id", "drug", rounded(F.col("match_score"), 6).alias("match_score"))


def convert_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    names = F.array(*[F.lit(d) for d in [" Risperidone", "olanzapine", "perphenazine", "clozapine ", "nothing"]])
    doses = F.when(F.col("o_orderkey") % 7 == 0, "x").when(F.col("o_orderkey") % 11 == 0, "-3").when(F.col("o_orderkey") % 13 == 0, "0").otherwise((F.col("o_orderkey") % 40).cast("string"))
    rows = lines.select("o_orderkey", F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("drug"), doses.alias("daily_dose"))
    return C.convert_one(rows, "CMD").select("o_orderkey", "drug", "daily_dose", rounded(F.col("equivalent"), 4).alias("equivalent"), "error")


def api(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = free_sheet(spark, sf_dir).select(F.col("row_index").alias("id"), F.col("medication").alias("text"))
    shown = F.array_join(F.transform("conversions", lambda c: F.concat_ws(":", c["method"], c["target"], F.coalesce(F.round(c["value"] * 10000).cast("bigint").cast("string"), F.lit("")))), "|")
    return api_parse(texts).select("id", "item_pos", "ok", "original", "drug", "daily_dose_mg", "needs_review", "error", shown.alias("conversions"))


def anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prescriptions(spark, sf_dir).select("rx_id", F.when(F.col("rx_id") % 37 == 0, " ").otherwise(F.col("patient_id")).alias("patient"))
    return anonymize(rows, patient_map(rows, order=("rx_id",)))


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_sheet(spark, sf_dir)
    cells = [T.cell_text(F.col(c)) for c in ("drug", "dose_mg", "unit", "frequency")]
    return rows.select("row_index", compose(*cells, "dose_mg").alias("by_frequency"), compose(*cells, "Daily dose (mg)").alias("by_day"))


def err_multi_drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batch(_sheets(spark, sf_dir), messages=False).errors.filter("error = 'MULTI_DRUG_SPLIT_DOSE'")


def err_no_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_batch(_sheets(spark, sf_dir), messages=True).errors.filter("sheet = 'notes'")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(_sheets(spark, sf_dir))[0].select("sheet", "row_index", "source_row")


def _header_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, h) for k, h in enumerate(HEADERS)], "pos int, header string")


def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.content_scores(split_sheet(spark, sf_dir).withColumn("free", F.concat_ws(" ", "drug", F.concat("dose_mg", F.lit("mg")))), ["drug", "dose_mg", "unit", "frequency", "free"])


def detect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, sheet in (("free", free_sheet(spark, sf_dir)), ("split", split_sheet(spark, sf_dir))):
        r = H.detect_columns(sheet)
        out.append((name, r.patient, r.medication, r.dose, r.unit, r.frequency))
    return spark.createDataFrame(out, "sheet string, patient string, medication string, dose string, unit string, frequency string")


def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, ["Report", None, ""]), (1, ["patient_id", "medication", "drug"]), (2, ["Unnamed: 0", "x", "rx"]), (3, [])], "row int, cells array<string>")
    return H.header_scores(rows).select("row", rounded(F.col("header_score"), 6).alias("header_score"))


def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from posolog.sources.sinks import save
    from posolog.sources.tables import SAMPLE
    from posolog.sources.work import scratch

    path = f"{scratch(spark)}/sample.csv"
    save(spark, "\n".join(";".join(r) for r in [SAMPLE[0], *SAMPLE[1], ("환자3", "리스페달 ", "NA", "mg", "BID"), ("환자4", '"리스페달 2mg BID\n아빌리파이 15mg QD"', "", "", "")]).encode("cp949"), path)
    return read_csv(spark, path).rows


def src_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    from posolog.sources.sinks import save, workbook
    from posolog.sources.work import scratch

    path = f"{scratch(spark)}/sample.xlsx"
    save(spark, workbook([("Input", sample(spark)), ("Info", dims.method_info(spark))]), path)
    return read_cells(spark, path)


def legacy_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doses by drug as they are written, times that drug's factor; unmatched drugs keep a null."""
    db = spark.createDataFrame([("Risperdal", 97.25), ("Zyprexa", 38.9), ("haloperidol", 55.5)], "` Drug` string, `CPZ_factor ` double")
    db = db.toDF(*[c.strip() for c in db.columns])
    rows = prescriptions(spark, sf_dir).select("rx_id", F.col("name").alias("Drug"), (F.col("rx_id") % 20).cast("double").alias("Dose"))
    return rows.join(F.broadcast(db), "Drug", "left").withColumn("AP_Equivalent", F.col("Dose") * F.col("CPZ_factor"))


def llm_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and frequencies of a reply in their plain forms."""
    often = F.upper(T.strip(F.col("freq")))
    return prescriptions(spark, sf_dir).select("rx_id", T.strip(F.lower("name")).alias("drug"), F.when(often.isin("HS"), "QHS").otherwise(often).alias("frequency"))


def _report(table: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(run_batch(_sheets(spark, sf_dir), messages=False), table)

    return query


QUERIES: dict[str, Query] = {
    "flagship_daily_cpz_by_patient": flagship,
    "dim_alias": lambda s, d: dims.dim_alias(s),
    "dim_factor": lambda s, d: dims.dim_factor(s),
    "build_factors": lambda s, d: build_factors(_factor_rows(s)),
    "methods": lambda s, d: dims.dim_factor(s).select(F.col("method_id").alias("method")).distinct().orderBy("method"),
    "method_targets": lambda s, d: dims.dim_factor(s).select("method_id", "target_drug").distinct().orderBy("method_id", "target_drug"),
    "method_info": lambda s, d: dims.method_info(s),
    "factor_reciprocal": lambda s, d: dims.dim_factor(s).alias("a").join(dims.dim_factor(s).alias("b"), (F.col("a.method_id") == F.col("b.method_id")) & (F.col("a.source_drug") == F.col("b.target_drug")) & (F.col("a.target_drug") == F.col("b.source_drug"))).select("a.method_id", "a.source_drug", "a.target_drug", (F.abs(F.col("a.factor") * F.col("b.factor") - 1) < 2e-6).alias("reciprocal")),
    "factor_duplicates": lambda s, d: C.duplicate_factors(dims.dim_factor(s)),
    "cell_text": _of_text(cell=lambda c: T.cell_text(F.when(F.col("rx_id") % 5 == 0, " NaN ").when(F.col("rx_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("\t "), c, F.lit(" \n"))))),
    "split_medications": _of_text(items=lambda c: F.array_join(T.split_medications(F.concat(c, F.lit(";; a+b ,\n"), c)), "|")),
    "normalize_text": _of_text(normal=T.normalize_text),
    "compact_text": _of_text(compact=T.compact_text),
    "drug_only_text": _of_text(drug_only=lambda c: T.drug_only(T.normalize_text(c))),
    "dose_extract": _of_text(doses=lambda c: F.array_join(F.transform(D.doses(c), lambda x: F.concat_ws(" ", F.round(x["value"] * 1000).cast("bigint").cast("string"), x["unit"])), "|")),
    "dose_count": _of_text(n_doses=lambda c: F.size(D.doses(c)).cast("long")),
    "dose_mg": _of_text(mg=lambda c: rounded(D.to_mg(F.get(D.doses(c), F.lit(0))), 6)),
    "quantity": _of_text(quantity=D.quantity),
    "frequency": _of_text(labels=_labels),
    "freq_hourly": _of_text(hours=lambda c: Q.hours(c), bad_interval=Q.bad_interval),
    "freq_times": _of_text(times=lambda c: Q.times(c), bad_times=Q.bad_times),
    "freq_regimen": _of_text(regimen=Q.regimen, total=lambda c: F.when(Q.regimen(c).isNotNull(), Q.regimen_total(c)).cast("long"), bad_regimen=Q.bad_regimen),
    "freq_conflict": _of_text(conflict=lambda c: Q.conflict(Q.frequencies(F.when(~(Q.bad_interval(c) | Q.bad_times(c) | Q.bad_regimen(c)), c).otherwise("")))),
    "reject_prn": _of_text(prn=Q.is_prn),
    "reject_lai": _of_text(lai=Q.is_lai),
    "alias_exact": _matches(M.alias_exact, "drug"),
    "alias_compact": _matches(lambda n: M.alias_compact(M.compact_query(n)), "drug"),
    "alias_fuzzy": alias_fuzzy,
    "parse_rx": lambda s, d: parse_rx(prescriptions(s, d)).select("rx_id", *[rounded(F.col(c), 6).alias(c) if c in ("match_score", "frequency_per_day") else c for c in PARSED]),
    "parse_errors": lambda s, d: parse_rx(prescriptions(s, d)).groupBy(F.coalesce("error", F.lit("OK")).alias("error")).agg(F.count("*").alias("n")),
    "convert_one": convert_one,
    "convert_all": lambda s, d: C.convert_all(parse_rx(prescriptions(s, d))).select("rx_id", "drug", "method", "target_drug", "equivalent_dose_mg"),
    "no_conversion": lambda s, d: C.convert_all(parse_rx(prescriptions(s, d)), ["CPZ_FGA"]).filter("factor IS NULL").select("rx_id", "drug", "method"),
    "method_warning": lambda s, d: dims.dim_factor(s).select("method_id", "source_drug", "target_drug", C.method_warning(F.col("method_id"), F.col("source_drug"), F.col("target_drug")).alias("warning")),
    "api_parse": api,
    "anonymize": anonymized,
    "source_row": source_rows,
    "compose_structured": composed,
    "err_multi_drug": err_multi_drug,
    "err_no_column": err_no_column,
    "out_detailed": _report("detailed"),
    "out_audit": _report("audit"),
    "out_errors": _report("errors"),
    "formula_guard": lambda s, d: guarded(prescriptions(s, d).select("rx_id", F.concat(F.get(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", " =", "a")]), (F.col("rx_id") % 6).cast("int")), F.col("medication")).alias("guarded"))),
    "name_score": lambda s, d: _header_frame(s).select("pos", "header", *[H.name_score(F.col("header"), w).alias(n) for n, w in (("medication", H.MEDICATION), ("dose", H.DOSE), ("unit", H.UNIT), ("frequency", H.FREQUENCY))]),
    "patient_score": lambda s, d: _header_frame(s).select("pos", "header", H.patient_score(F.col("header")).alias("score")),
    "content_score": content_score,
    "detect_columns": detect_columns,
    "header_score": header_score,
    "src_csv": src_csv,
    "src_xlsx": src_xlsx,
    "sample": lambda s, d: sample(s),
    "legacy_equiv": legacy_equiv,
    "llm_normalize": llm_normalize,
}
