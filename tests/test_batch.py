"""Sheets in, tables out: detection, pseudonyms, composition, files, workbooks, streams."""

import json

import pytest
from pyspark.sql import functions as F

from posolog.operators.anonymize import patient_map
from posolog.operators.detect import Roles, detect_columns, header_scores
from posolog.plans.batch import Sheet, api_json, api_parse, run_batch
from posolog.plans.dims import dim_factor
from posolog.sources.sinks import report_workbook, save, workbook, write_factors, write_report
from posolog.sources.tables import charset, check_name, delimiter, read_csv, read_sheets, read_xlsx, sample
from posolog.streaming.stream import parse_stream, totals


def sheet(spark, name, columns, rows, **more):
    return Sheet(name, spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_index bigint, " + ", ".join(f"`{c}` string" for c in columns)), **more)


def one(spark, columns, row):
    return run_batch([sheet(spark, "Sheet1", columns, [row])], messages=False)


@pytest.mark.parametrize(
    ("columns", "row", "daily"),
    [
        (["환자번호", "약물명", "용량", "단위", "복용빈도"], ("P01", "리스페달", "2", "mg", "2"), 4.0),
        (["환자번호", "약물명", "용량", "단위", "복용빈도"], ("P01", "리스페달", "2", "mg", "0.5"), 1.0),
        (["patient_id", "drug", "daily_dose_mg"], ("P01", "risperidone", "4"), 4.0),
        (["patient_id", "drug", "daily_dose_mg", "frequency"], ("P01", "risperidone", "4", "2"), 4.0),
        (["환자ID", "제품명", "1회용량", "용량단위", "일일횟수"], ("K01", "리스페달", "2", "mg", "2"), 4.0),
        (["patient_id", "drug", "dose", "unit", "frequency"], ("P01", "Risperdal", "2.0", "mg", "3.0"), 6.0),
    ],
)
def test_structured(spark, columns, row, daily):
    out = one(spark, columns, row)
    assert {r.daily_dose_mg for r in out.detailed.collect()} == {daily} and out.errors.isEmpty()


def test_zero_times_and_several_drugs(spark):
    columns = ["patient_id", "drug", "dose", "unit", "frequency"]
    assert one(spark, columns, ("P", "Risperdal", "2", "mg", "0")).errors.first().error == "BAD_TIMES"
    r = one(spark, columns, ("P", "Risperdal; Abilify", "2", "mg", "1")).errors.first()
    assert (r.error, r.original, r.source_row, r.patient) == ("MULTI_DRUG_SPLIT_DOSE", "Risperdal; Abilify", 2, "PATIENT_00001")
    out = one(spark, columns, ("P", "Risperdal 1mg QD; Abilify 5mg QD", "2", "mg", "1"))
    assert out.errors.isEmpty() and out.audit.count() == 2


def test_sheets(spark):
    a = sheet(spark, "A", ["patient_id", "medication"], [("P02", "@Risperdal 2mg BID"), (" P01 ", "lithium 600mg"), ("", "fluphenazine 5mg QD"), ("P02", None), (None, "nan")])
    b = sheet(spark, "B", ["patient_id", "medication"], [("1", "Risperdal 2mg BID, Abilify 5mg"), ("P01", "x 5mg")], header_row=2)
    c = sheet(spark, "C", ["설명"], [("nothing",)])
    out = run_batch([a, b, c])
    labels = {(r.sheet, r.source_row): r.patient for r in out.audit.unionByName(out.errors.withColumns({"parsed": F.lit(""), "match_type": F.lit(""), "match_score": F.lit(0.0), "status": F.lit(""), "unavailable_methods": F.lit("")}).drop("error")).collect()}
    assert labels == {("A", 2): "PATIENT_00001", ("A", 3): "PATIENT_00002", ("A", 4): "", ("B", 4): "PATIENT_00003", ("B", 5): "PATIENT_00002", ("C", None): ""}
    audit = {(r.sheet, r.source_row, r.parsed): (r.status, r.unavailable_methods) for r in out.audit.collect()}
    assert audit["A", 2, "risperidone"] == ("converted", "CPZ_FGA")
    assert audit["B", 4, "aripiprazole"] == ("review", "CPZ_FGA")
    assert audit["A", 4, "fluphenazine"] == ("converted", "CMD, DDD, ED95, MED")
    assert out.detailed.filter("sheet = 'A' AND source_row = 2").count() == 4
    only = run_batch([a], ["MED"], messages=False)
    assert [(r.original, r.error) for r in only.errors.orderBy("source_row").collect()] == [("lithium 600mg", "UNKNOWN_DRUG"), ("fluphenazine 5mg QD", "NO_CONVERSION")]
    with pytest.raises(ValueError):
        run_batch([a], "XXX")
    assert run_batch([c]).detailed.isEmpty() and run_batch([c]).errors.count() == 1


def test_roles(spark):
    s = sheet(spark, "S", ["drug_id", "medication"], [("D001", "Risperdal 2mg BID")])
    assert detect_columns(s.rows) == Roles(None, "medication", None, None, None)
    t = sheet(spark, "S", ["notes", "x", "patient"], [("Risperdal 2mg BID", "b", "c")])
    assert detect_columns(t.rows) == Roles("patient", "notes", None, None, None)
    scored = header_scores(spark.createDataFrame([(0, []), (1, ["a", None, "drug"])], "row int, cells array<string>")).orderBy("row").collect()
    assert [r.header_score for r in scored] == [-1, pytest.approx(2 / 3 + 3)]


def test_many_patients(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_index"), F.lit(0).alias("sheet_idx"), F.concat(F.lit("p"), (F.col("id") * 7 % 1500).cast("string")).alias("patient")).repartition(7)
    out = {r.patient_key: r.label for r in patient_map(rows).collect()}
    seen = list(dict.fromkeys(f"p{k * 7 % 1500}" for k in range(2000)))
    assert out == {p: f"PATIENT_{n:05d}" for n, p in enumerate(seen, 1)}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("환자번호,처방내역\nA-001,리스페달 2mg BID\n\nNA,아빌리파이 15mg QD\n".encode("cp949"))
    got = read_csv(spark, f"{tmp_path}/a.csv")
    assert [tuple(r) for r in got.rows.orderBy("row_index").collect()] == [("A-001", "리스페달 2mg BID", 0), (None, "아빌리파이 15mg QD", 1)]
    (tmp_path / "b.CSV").write_bytes("﻿patient_id;medication\r\n1;Risperdal 2mg\r\n".encode())
    assert read_sheets(spark, f"{tmp_path}/b.CSV")[0].rows.columns == ["patient_id", "medication", "row_index"]
    assert charset("é".encode()) == "UTF-8" and delimiter('"a,b";c') == ";" and delimiter("x") == ","
    for name in (None, "x", "x.txt"):
        with pytest.raises(ValueError):
            check_name(name)
    with pytest.raises(ValueError):
        charset(b"\xff\xff\xff")


def test_csv_charset_is_that_of_the_whole_file(spark, tmp_path):
    late = b"patient_id,medication\n" + b"P1,Risperdal 2mg BID\n" * 60000
    assert len(late) > 1 << 20
    (tmp_path / "late.csv").write_bytes(late + "P2,리스페달 2mg BID\n".encode("cp949"))
    assert [r.medication for r in read_csv(spark, f"{tmp_path}/late.csv").rows.filter("patient_id = 'P2'").collect()] == ["리스페달 2mg BID"]
    (tmp_path / "utf.csv").write_bytes(late + "P2,리스페달 2mg BID\n".encode())
    assert [r.medication for r in read_csv(spark, f"{tmp_path}/utf.csv").rows.filter("patient_id = 'P2'").collect()] == ["리스페달 2mg BID"]
    (tmp_path / "none.csv").write_bytes(late + b"P2,\xff\xff\xff\n")
    with pytest.raises(ValueError):
        read_csv(spark, f"{tmp_path}/none.csv")


def test_csv_cells_with_line_feeds(spark, tmp_path):
    body = 'patient_id,medication,note\nP1,"Risperdal 2mg BID\nAbilify 15mg QD","said ""yes"",\nthen no"\n\n   \nP2,Abilify 5mg QD,5" x\n'
    want = [("P1", "Risperdal 2mg BID\nAbilify 15mg QD", 'said "yes",\nthen no', 0), ("P2", "Abilify 5mg QD", '5" x', 1)]
    for name, data in (("u.csv", body.encode("utf-8-sig")), ("r.csv", body.replace("\n", "\r\n").encode()), ("k.csv", body.replace("said", "말").encode("cp949"))):
        (tmp_path / name).write_bytes(data)
        got = read_csv(spark, f"{tmp_path}/{name}").rows
        assert got.columns == ["patient_id", "medication", "note", "row_index"]
        assert [tuple(x.replace("말", "said") if isinstance(x, str) else x for x in r) for r in got.orderBy("row_index").collect()] == want
    (tmp_path / "h.csv").write_bytes('"patient\nid, own";"medication"\nP1;"a, ""b"""\n'.encode())
    got = read_csv(spark, f"{tmp_path}/h.csv").rows
    assert got.columns == ["patient\nid, own", "medication", "row_index"] and [tuple(r) for r in got.collect()] == [("P1", 'a, "b"', 0)]


def test_workbooks(spark, tmp_path):
    save(spark, workbook([("입력", sample(spark))]), f"file://{tmp_path}/s.xlsx")
    got = read_xlsx(spark, f"{tmp_path}/s.xlsx")
    assert [s.name for s in got] == ["입력"] and [tuple(r) for r in got[0].rows.orderBy("row_index").collect()] == [(0, "P001", "Risperdal", "2", "mg", "BID"), (1, "P002", "Abilify", "15", "mg", "QD")]
    report = run_batch(got)
    save(spark, report_workbook(report), f"file://{tmp_path}/r.xlsx")
    again = read_xlsx(spark, f"{tmp_path}/r.xlsx")
    assert [s.name for s in again] == ["Detailed", "AuditTrail", "Errors", "MethodInfo"] and again[0].rows.count() == report.detailed.count()
    save(spark, workbook([(f"s{k}", sample(spark)) for k in range(6)]), f"file://{tmp_path}/six.xlsx")
    with pytest.raises(ValueError):
        read_xlsx(spark, f"{tmp_path}/six.xlsx")
    write_report(report, f"{tmp_path}/out", "csv")
    assert spark.read.csv(f"{tmp_path}/out/detailed", header=True).count() == report.detailed.count()


def test_sheets_as_people_have_them(spark, tmp_path):
    """An empty sheet, one that begins late, cells beyond the first rows' width, and a file that is no workbook."""
    empty = spark.createDataFrame([], "` ` string").select()
    late = spark.createDataFrame([(None, None)] * 6 + [("patient_id", "medication"), ("P1", "Risperdal 2mg BID")], "a string, b string")
    save(spark, workbook([("In", sample(spark)), ("Late", late), ("Empty", empty)]), f"file://{tmp_path}/w.xlsx")
    got = read_xlsx(spark, f"{tmp_path}/w.xlsx")
    assert [s.name for s in got] == ["In", "Late", "Empty"] and len(got[1].rows.columns) == 3 and got[2].rows.columns == ["row_index"]
    (tmp_path / "bad.xlsx").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        read_xlsx(spark, f"{tmp_path}/bad.xlsx")
    (tmp_path / "twice.csv").write_text("patient_id,medication,medication,\nP1,a,b,c\n")
    assert read_csv(spark, f"{tmp_path}/twice.csv").rows.columns == ["patient_id", "medication", "medication.1", "Unnamed: 3", "row_index"]


def test_json(spark):
    asked = [(1, '{"text": "Risperdal 2mg BID, lithium 600mg"}'), (2, '{"text": "  "}'), (3, "no json"), (4, None), (5, '{"text": ";"}')]
    out = {r.id: json.loads(r.reply) for r in api_json(spark.createDataFrame(asked, "id int, body string")).collect()}
    good, bad = out[1]["items"]
    assert (good["ok"], good["drug"], good["daily_dose_mg"], good["conversions"][0]) == (True, "risperidone", 4.0, {"method": "CMD", "target": "chlorpromazine", "value": 389.0})
    assert good["conversions"][1] == {"method": "CPZ_FGA", "target": "", "value": None}
    assert (bad["ok"], bad["original"], bad["needs_review"]) == (False, "lithium 600mg", True) and bad["error"]
    assert all(list(out[k]) == ["error"] for k in (2, 3, 4)) and out[5] == {"items": []}


def test_factor_file(spark, tmp_path):
    write_factors(dim_factor(spark), f"{tmp_path}/f")
    rows = [(r.method_id, r.source_drug, r.target_drug) for r in spark.read.csv(f"{tmp_path}/f", header=True).collect()]
    assert len(rows) == 675 and rows == sorted(rows)


def test_offset_header(spark, tmp_path):
    rows = spark.createDataFrame([("", None), ("환자번호", "약물정보"), ("P01", "Risperdal 2㎎ BID")], "`기관 보고서` string, ` ` string")
    save(spark, workbook([("처방", rows)]), f"file://{tmp_path}/o.xlsx")
    got = read_xlsx(spark, f"{tmp_path}/o.xlsx")[0]
    assert got.header_row == 2
    r = run_batch([got]).detailed.first()
    assert (r.source_row, r.daily_dose_mg) == (4, 4.0)


def test_api(spark):
    out = api_parse(spark.createDataFrame([(1, "Risperdal 2mg BID, lithium 600mg"), (2, ""), (3, None)], "id int, text string")).orderBy("item_pos").collect()
    assert [(r.ok, r.error) for r in out] == [(True, None), (False, "UNKNOWN_DRUG")]
    assert [(c.method, c.target, c.value) for c in out[0].conversions][:2] == [("CMD", "chlorpromazine", 389.0), ("CPZ_FGA", "", None)]


def test_stream(spark, tmp_path):
    rows = [("p1", "2024-01-01 10:00:00", "Risperdal 2mg BID; x"), ("p1", "2024-01-01 12:00:00", "Risperdal 2mg QD"), ("p2", "2024-01-05 10:00:00", "Abilify 5mg QD")]
    spark.createDataFrame(rows, "patient_id string, ts string, medication string").selectExpr("patient_id", "timestamp(ts) AS ts", "medication").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("patient_id string, ts timestamp, medication string").parquet(f"{tmp_path}/in")
    query = totals(parse_stream(stream, methods=["CMD"])).writeStream.format("memory").queryName("sums").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.patient_id, r.method, r.equivalent_dose_mg, r.n) for r in spark.table("sums").collect()] == [("p1", "CMD", 583.5, 2)]
