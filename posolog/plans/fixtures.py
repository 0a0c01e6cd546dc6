"""Prescriptions derived from the events table by arithmetic: the same SQL text runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: rx_id, patient_id, name, dose, freq and the whole text.
PARTS = """
SELECT e.event_id AS rx_id, concat('P', cast(e.user_id AS varchar(20))) AS patient_id, nm.name, ds.dose, fq.freq,
  trim(concat(nm.name, ' ', ds.dose, ' ', fq.freq)) AS medication
FROM {events} e
JOIN (VALUES (0,'Risperdal'),(1,'Abilify'),(2,'Seroquel'),(3,'Zyprexa'),(4,'haloperidol'),(5,'RISP*ERDAL'),(6,'seroqual'),
  (7,'lithium'),(8,'Rexulti'),(9,'perphenazine'),(10,'clozapine'),(11,'Invega')) AS nm(i, name) ON nm.i = e.event_id % 12
JOIN (VALUES (0,'2mg'),(1,'.5mg'),(2,'500mcg'),(3,'0.01g'),(4,'15 mg'),(5,''),(6,'1mg 2mg'),(7,'4mg/day'),(8,'25mg 2T')) AS ds(i, dose)
  ON ds.i = cast(floor(e.event_id / 12) AS bigint) % 9
JOIN (VALUES (0,'BID'),(1,'QD'),(2,''),(3,'q12h'),(4,'1-0-1'),(5,'PRN'),(6,'BID TID'),(7,'QHS'),(8,'IM monthly'),
  (9,'5 times a day'),(10,'QOD'),(11,'q5h'),(12,'0-0-0'),(13,'30 times a day')) AS fq(i, freq)
  ON fq.i = cast(floor(e.event_id / 108) AS bigint) % 14
"""

#: A sheet of free text; every tenth cell holds two medications, every 33rd is empty.
FREE_SHEET = """
SELECT cast(floor(rx_id / 2) AS bigint) AS row_index, patient_id,
  CASE WHEN rx_id % 66 = 0 THEN ' none ' WHEN rx_id % 20 = 0 THEN concat(medication, '; ', name, ' 5mg BID') ELSE medication END AS medication
FROM ({parts}) p WHERE rx_id % 2 = 0
"""

#: A sheet with drug, dose, unit and frequency in columns of their own.
SPLIT_SHEET = """
SELECT cast(floor(rx_id / 2) AS bigint) AS row_index, CASE WHEN rx_id % 101 = 1 THEN '' ELSE patient_id END AS patient_id,
  CASE WHEN rx_id % 50 = 1 THEN concat(name, ', Abilify') ELSE name END AS drug,
  CASE rx_id % 8 WHEN 1 THEN '2' WHEN 3 THEN '0.5' WHEN 5 THEN '' ELSE '10.0' END AS dose_mg,
  CASE rx_id % 6 WHEN 1 THEN 'mg' WHEN 3 THEN '' ELSE 'mcg' END AS unit,
  CASE rx_id % 14 WHEN 1 THEN '2' WHEN 3 THEN '1.0' WHEN 5 THEN '0.5' WHEN 7 THEN 'BID' WHEN 9 THEN '' WHEN 11 THEN '5' ELSE '0' END AS frequency
FROM ({parts}) p WHERE rx_id % 2 = 1
"""


def prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PARTS, events=spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id"))


def free_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FREE_SHEET.replace("({parts})", "{parts}"), parts=prescriptions(spark, sf_dir))


def split_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPLIT_SHEET.replace("({parts})", "{parts}"), parts=prescriptions(spark, sf_dir))


def duck(sql: str) -> str:
    """The text for DuckDB, where the table is a view."""
    return sql.replace("{parts}", PARTS).replace("{events}", "events")
