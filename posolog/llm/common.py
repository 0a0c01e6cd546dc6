"""What the operators of this subpackage share: input tables, the shared folder, written intermediates."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of texts that a Python worker takes up at once, whatever the session's batches are.
PIECE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in parts of up to `limit` bytes of a text or binary column, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, limit + (ends[begin - 1] if begin else 0), "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """A text column's values as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


#: What a worker keeps from one task to the next, by the operator that owns it: a function that lets go of it.
KEPT: dict[str, Callable[[], None]] = {}

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(work: Work, owner: str = "") -> Work:
    """work, which gives back to the machine what memory it has freed at its end: workers stay for the next stage.

    At its begin a worker lets go of what other operators have kept in it.
    """

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [k for k in KEPT if k != owner]:
            KEPT.pop(other)()
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that very name, whatever signs are in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def shape(fields: list[tuple[str, str]]) -> str:
    """A schema of (name, type)."""
    return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in fields)


def mapped(df: DataFrame, source: str, made: list[tuple[str, str]], work: Callable[[pa.Array], list[pa.Array]], limit: int = PIECE_BYTES, owner: str = "") -> DataFrame:
    """df with further columns `made` (name, type), which work() makes of pieces of the text or binary column `source`.

    Columns of the made names are replaced; all others stay, whatever their names. The source goes to Python once.
    """
    names = {name.lower() for name, _ in made}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    plain = df.schema[source].dataType.simpleString() in ("string", "binary")
    own = [quoted(f.name) for f in kept]
    if plain and source in [f.name for f in kept]:
        at = [f.name for f in kept].index(source)
    else:
        at = len(kept)
        own.append((quoted(source) if plain else quoted(source).cast("string")).alias(unused(df, "source")[0]))
    out = [f.name for f in kept] + [name for name, _ in made]

    @functools.partial(released, owner=owner)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at, limit):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *work(batch.column(at))], out)

    return df.select(*own).mapInArrow(run, shape([*((f.name, f.dataType.simpleString()) for f in kept), *made]))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="posolog-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/posolog/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def shipped(spark: SparkSession, name: str, data: Iterable[bytes]) -> str:
    """Puts a file into the shared folder, unless it is there, and has every executor fetch it; returns its name, which
    is to tell its contents. SparkFiles.get(name) is where an executor has it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/posolog/{name}")
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        part = where.suffix(f".{uuid.uuid4().hex}")
        stream = store.create(part, True)
        for chunk in data:
            stream.write(bytearray(chunk))
        stream.close()
        store.rename(part, where)
    spark.sparkContext.addFile(where.toString())
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, gives the planner true sizes."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of what is now in the table
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within limit, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, LOWER_FROM, LOWER_TO)


def ascii_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, in order; null has none."""
    cuts = "".join(chr(c) for r in (range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)) for c in r)
    flat = F.translate(F.coalesce(text, F.lit("")), cuts + LOWER_FROM, " " * len(cuts) + LOWER_TO)
    return F.array_remove(F.split(flat, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
