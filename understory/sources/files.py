"""File sources and sinks: typed reads, missing values as null, provenance beside what is written."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks missing values in many files; in Spark it would rank above all numbers and spoil means."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table from Parquet, CSV (with header), JSON lines or ORC, with an explicit schema where given and NaN as null."""
    reader = spark.read.options(**({"header": True} | options if kind == "csv" else options))
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.format(kind).load(path))


def require(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in its order; an error names those that are missing or of another type."""
    wanted = T.StructType.fromDDL(schema)
    have = dict(df.dtypes)
    bad = [f"{f.name} {f.dataType.simpleString()} (have {have.get(f.name)})" for f in wanted if have.get(f.name) != f.dataType.simpleString()]
    if bad:
        raise ValueError("columns differ: " + ", ".join(bad))
    return df.select([f.name for f in wanted])


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Fails, when run, if a key repeats; adds no shuffle beyond one by the key."""
    n = F.expr(f"count(*) over (partition by {', '.join(keys)})")
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key")).cast("boolean")).otherwise(True)).drop("_n")


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write(df: DataFrame, path: str, kind: str = "parquet", source: str | None = None, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> str:
    """Write a table and, beside it, ``<path>.provenance.json`` with source, time, columns and rows as counted by the write itself."""
    from pyspark.sql import Observation

    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = out.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    note = {"source": source, "written_utc": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "row_count": seen.get["rows"], "columns": dict(df.dtypes)}
    write_text(df.sparkSession, path.rstrip("/") + ".provenance.json", json.dumps(note, indent=1))
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _filesystem(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...], skipped: tuple[str, ...] = ()) -> DataFrame:
    """(path, length) of files under a root by suffix; folders in ``skipped`` are left out. Contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    for d in skipped:
        keep = keep & ~F.col("path").contains(f"/{d}/")
    return df.where(keep)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that driver and executors share; a temporary one only where ``spark.checkpoint.dir`` is unset and they are one process."""
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="understory-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settings(path: str, required: tuple[str, ...] = ()) -> dict:
    """A TOML or JSON settings file of the driver, with its required keys."""
    import pathlib
    import tomllib

    raw = pathlib.Path(path).read_text()
    got = json.loads(raw) if path.endswith(".json") else tomllib.loads(raw)
    if missing := [k for k in required if k not in got]:
        raise KeyError(f"{path} lacks {', '.join(missing)}")
    return got


def confined(root: str, *parts: str) -> str:
    """A path under ``root``; parts that lead out of it are an error."""
    import os

    at = os.path.normpath("/".join([root.rstrip("/"), *parts]))
    if not at.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{'/'.join(parts)} leads out of {root}")
    return at


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of the files under a root, hashed on the executors."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return got.select("path", "length", F.sha2("content", 256).alias("sha256"))


def checked(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose provenance note exists and states its rows and columns rightly."""
    note = json.loads(read_text(spark, path.rstrip("/") + ".provenance.json"))
    if missing := [k for k in ("source", "written_utc", "row_count", "columns") if k not in note]:
        raise ValueError(f"provenance lacks {', '.join(missing)}")
    df = spark.read.parquet(path)
    if dict(df.dtypes) != note["columns"] or df.count() != note["row_count"]:
        raise ValueError("table and provenance differ")
    return df
