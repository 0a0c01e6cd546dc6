"""Delimited text and workbooks as DataFrames of text columns."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posolog.operators.detect import header_scores
from posolog.plans.batch import Sheet
from posolog.sources.work import stored

# Extensions, the most sheets of a workbook, the rows that may be a header, delimiters, texts for nothing.
EXTENSIONS = ("csv", "xls", "xlsx")
MAX_SHEETS = 5
HEADER_ROWS = 5
DELIMITERS = ",;\t|"
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SNIFFED = 1 << 20


def check_name(name: str | None) -> str:
    """The extension of a file that can be read; ValueError otherwise."""
    if not name:
        raise ValueError("no file")
    end = name.rsplit(".", 1)[1].lower() if "." in name else ""
    if end not in EXTENSIONS:
        raise ValueError(f"unsupported file type: {name}")
    return end


def _prefix(spark: SparkSession, path: str, size: int = SNIFFED) -> bytes:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def charset(prefix: bytes) -> str:
    """UTF-8 if the bytes are (a sign may be cut at their end), else Korean MS949, else ValueError."""
    for name, java in (("utf-8", "UTF-8"), ("cp949", "MS949")):
        for cut in range(4):
            try:
                prefix[: len(prefix) - cut].decode(name)
                return java
            except UnicodeDecodeError:
                if len(prefix) < SNIFFED:
                    break
    raise ValueError("the text is in no known encoding")


def _whole_charset(spark: SparkSession, path: str, prefix: bytes) -> str:
    """The charset of all of a file's lines, found by a distributed scan; the prefix alone rules UTF-8 out but not in."""
    kind = charset(prefix)
    if kind == "UTF-8" and spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty():
        return kind
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    lines = spark.read.csv(path, schema="value string", encoding="MS949", sep="\x01", quote="")
    if not lines.filter(F.col("value").contains("\ufffd")).isEmpty():  # what MS949 can't decode becomes this sign, which it doesn't have
        raise ValueError("the text is in no known encoding")
    return "MS949"


def delimiter(line: str) -> str:
    """The delimiter that a header line has most often outside quotes; a comma for a single column."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(DELIMITERS, key=lambda d: (bare.count(d), d == ","))


def header_record(text: str) -> str:
    """The first record of a text; its quoted cells may hold line feeds."""
    line = text.split("\n", 1)[0]
    return re.match(r'(?:"[^"]*"|[^"\n])*', text).group() if line.count('"') % 2 else line


def _broken_cells(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether any line opens a quoted cell that it doesn't close, found by a distributed scan of lines."""
    d = re.escape(sep)
    closed = F.regexp_replace("value", rf'(?<=^|{d})"[^"]*+(?:""[^"]*+)*+"(?={d}|$)', "")
    return not spark.read.text(path).filter(F.instr("value", '"') > 0).filter(closed.rlike(rf'(?:^|{d}|^\uFEFF)"')).isEmpty()


def numbered(df: DataFrame, column: str = "row_index") -> DataFrame:
    """Adds the rows' numbers from 0 in the order of the file: one count for each part of it, no shuffle of rows."""
    marked = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id(), "_start": F.input_file_block_start()})
    parts = marked.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_start").alias("_begin"))
    earlier = Window.orderBy("_begin", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = marked.join(F.broadcast(before), "_part")  # a row for each task of the scan
    return placed.withColumn(column, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], column)


def unique_names(cells: list[str | None]) -> list[str]:
    """A header's names: unnamed cells by their place, repeated names with a number behind."""
    names, seen = [], {}
    for k, c in enumerate(cells):
        base = c or f"Unnamed: {k}"
        seen[base] = seen.get(base, -1) + 1
        names.append(f"{base}.{seen[base]}" if seen[base] else base)
    return names


def read_csv(spark: SparkSession, path: str) -> Sheet:
    """A delimited file with a header as one sheet: text columns, texts for nothing as null, blank lines left out.

    Quoted cells may hold line feeds; a file that has such cells is read by one task, all others in parts.
    """
    check_name(path)
    prefix = _prefix(spark, path)
    kind = _whole_charset(spark, path, prefix)
    first = prefix.decode("utf-8-sig" if kind == "UTF-8" else "cp949", "replace").lstrip("\r\n")
    sep = delimiter(header_record(first))
    broken = _broken_cells(spark, path, sep)
    rows = spark.read.csv(path, header=True, inferSchema=False, encoding=kind, sep=sep, multiLine=broken, quote='"', escape='"')
    if broken and len(rows.columns) > 1:  # lines of blanks, which reading by parts leaves out
        head, *others = [F.col(f"`{c}`") for c in rows.columns]
        rows = rows.filter(head.isNull() | (F.trim(head) != "") | F.coalesce(*others, F.lit(None).cast("string")).isNotNull())
    names = unique_names(next(csv.reader(io.StringIO(header_record(first)), delimiter=sep), []))
    if len(names) == len(rows.columns):
        rows = rows.toDF(*names)
    clean = rows.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TEXTS), F.col(f"`{c}`")).alias(c) for c in rows.columns])
    return Sheet("Sheet1", numbered(clean))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, its place, row, cells) of an .xlsx file, a row -1 before each sheet's; whole numbers come without a point."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            yield sheet.get("name"), k, -1, []
            for at, row in enumerate(ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row")):
                cells: list[str | None] = []
                for j, c in enumerate(row):
                    place = _column(c.get("r")) if c.get("r") else j
                    cells += [None] * (place + 1 - len(cells))
                    kind, v = c.get("t"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is None or v.text is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(v.text)]
                    else:
                        text = v.text[:-2] if kind in (None, "n") and re.fullmatch(r"-?\d+\.0", v.text) else v.text
                    cells[place] = text
                yield sheet.get("name"), k, int(row.get("r") or at + 1) - 1, cells


def _marked_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows (sheet, sheet_idx, row, cells, error) of a workbook. Each sheet has a row -1 without cells; a file that is no
    workbook has a row with an error alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                try:
                    rows = [(*r, None) for r in workbook_rows(data)]
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as error:
                    rows = [(None, None, None, None, f"no workbook: {error}")]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string())
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["sheet", "sheet_idx", "row", "cells", "error"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sheet string, sheet_idx int, row bigint, cells array<string>, error string")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows (sheet, sheet_idx, row, cells) of a workbook, in long form as sheets differ in their columns."""
    return _marked_cells(spark, path).filter("row >= 0").drop("error")


def read_xlsx(spark: SparkSession, path: str) -> list[Sheet]:
    """A workbook's sheets, empty ones too, as wide as their widest rows. Each header is the best of the first
    HEADER_ROWS rows, blank ones among them, the first of equally good ones. ValueError for more than MAX_SHEETS sheets
    and for a file that is no workbook."""
    check_name(path)
    cells = stored(_marked_cells(spark, path))
    broken = cells.filter("error IS NOT NULL").first()
    if broken:
        raise ValueError(broken["error"])
    sheets = cells.groupBy("sheet_idx", "sheet").agg(F.max(F.size("cells")).alias("width")).orderBy("sheet_idx").collect()
    if len(sheets) > MAX_SHEETS:
        raise ValueError(f"more than {MAX_SHEETS} sheets")
    out = []
    for k, name, width in sheets:
        own = cells.filter(F.col("sheet_idx") == k).drop("sheet", "sheet_idx", "error")
        first = spark.range(HEADER_ROWS).toDF("row").join(own.filter("row >= 0"), "row", "left")
        padded = first.select("row", F.transform(F.sequence(F.lit(0), F.lit(max(width - 1, 0))), lambda j: F.get("cells", j)).alias("cells"))
        at, head, _ = header_scores(padded).orderBy(F.desc("header_score"), "row").first()
        names = unique_names(head if width > 0 else [])
        fields = [F.when(~F.get("cells", F.lit(j)).isin(*NA_TEXTS), F.get("cells", F.lit(j))).alias(n) for j, n in enumerate(names)]
        out.append(Sheet(name, own.filter(F.col("row") > at).select((F.col("row") - at - 1).alias("row_index"), *fields), at))
    return out


def read_sheets(spark: SparkSession, path: str) -> list[Sheet]:
    """The sheets of a file by its extension."""
    end = check_name(path)
    if end == "xls":
        raise ValueError("old binary workbooks are not read; save as .xlsx")
    return [read_csv(spark, path)] if end == "csv" else read_xlsx(spark, path)


#: The sample workbook.
SAMPLE = (("patient_id", "drug", "dose", "unit", "frequency"), [("P001", "Risperdal", "2", "mg", "BID"), ("P002", "Abilify", "15", "mg", "QD")])


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE[1], ", ".join(f"{c} string" for c in SAMPLE[0]))
