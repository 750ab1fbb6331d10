"""Table and file sources/sinks.

Listings are metadata only; content is read by executors.  Fingerprints hash
whole files, block by block, inside a ``mapInPandas`` task.
"""
from __future__ import annotations

import fnmatch
import hashlib
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.labels import label_from_filename

BLOCK = 4 * 1024 * 1024          # bytes read at a time
CAPTURE_FILES = ("pcap", "pcapng", "cap")


def list_parts(path: str, extension: str = ".csv") -> list[str]:
    """Sorted part files of a folder (local or cluster URI); none is an error."""
    from netlens.sources.fs import list_files
    if "*" in path:                                  # a pattern in the last part of the path
        folder, pattern = path.rsplit("/", 1)
        parts = [p for p in list_files(folder, ("",)) if fnmatch.fnmatch(p.rsplit("/", 1)[-1], pattern)]
    else:
        parts = list_files(path, (extension,))
    if not parts:
        raise FileNotFoundError(f"No CSV parts found in {path}")
    return parts


def read_parts(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               columns: list[str] | None = None, fmt: str = "csv") -> DataFrame:
    """Multi-part CSV (or parquet) scan with an explicit schema (S1, S3); a
    column list is a projection that reaches the scan (S2)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", False)
        df = r.csv(list_parts(path))
    return df.select(*columns) if columns else df


def read_features(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Feature files; ``label``/``source`` default from the file name."""
    df = read_parts(spark, path, schema)
    fname = F.col("_metadata.file_name")
    label = F.coalesce(F.col("label"), label_from_filename(fname)) if "label" in df.columns \
        else label_from_filename(fname)
    source = F.coalesce(F.col("source"), fname) if "source" in df.columns else fname
    return df.withColumns({"label": label, "source": source})


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Parquet sink (S3)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report table as one CSV with header (S12); reports are per-class sized."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_if_present(read):
    """The DataFrame of ``read()``, or None where its path does not exist yet; any
    other failure (permissions, network, format) is raised."""
    from pyspark.errors import AnalysisException
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_by_label(df: DataFrame, path: str, label: str = "label", spread: int = 16,
                   also: list[str] | None = None) -> None:
    """Per-class tables in one pass, one folder per label.

    Rows are spread over ``spread`` tasks per label (row-hash salt), so a
    label holding a third of all rows is still written in parallel.  Without
    ``also`` the whole table is rebuilt.  ``also`` names columns that split a
    label further (a capture's fingerprint): only the folders that ``df`` has
    rows for are replaced, so adding captures leaves the others in place and a
    repeated run replaces its own output.
    """
    salt = F.abs(F.xxhash64(*[F.col(c) for c in df.columns])) % spread
    by = [label, *(also or [])]
    w = df.repartition(*[F.col(c) for c in by], salt).sortWithinPartitions(*by).write.mode("overwrite")
    if also:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy(*by).parquet(path)


def fingerprint_file(path: str, size: int) -> str:
    """md5 over the size text and the whole content, read in blocks of 4 MiB.

    ``path`` may be a local path or a cluster URI (read through pyarrow.fs).
    """
    from netlens.sources.fs import open_input
    h = hashlib.md5(str(size).encode())
    with open_input(path) as fh:
        while block := fh.read(BLOCK):
            h.update(block)
    return h.hexdigest()[:16]


def file_inventory(spark: SparkSession, path: str, pattern: str = "*.{" + ",".join(CAPTURE_FILES) + "}") -> DataFrame:
    """path, file, size, modified and content fingerprint of every capture.

    Listing via the binaryFile source without its content column (metadata
    only); fingerprints are computed by executors.
    """
    meta = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
                 .select(F.col("path"), F.col("length").alias("size"),
                         F.col("modificationTime").alias("modified")))

    def fp(it):
        for pdf in it:
            pdf["fp"] = [fingerprint_file(p, int(s)) for p, s in zip(pdf["path"], pdf["size"])]
            yield pdf

    out = meta.mapInPandas(fp, "path string, size long, modified timestamp, fp string")
    return out.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))


def read_manifest(spark: SparkSession, path: str, inventory: DataFrame):
    """Capture manifest (file, label) joined to the inventory.

    Returns (matched rows with inventory columns, manifest rows whose file is
    missing).
    """
    man = spark.read.option("header", True).csv(path).select("file", "label")
    joined = man.join(inventory, "file", "left")
    return joined.filter(F.col("path").isNotNull()), joined.filter(F.col("path").isNull()) \
        .select("file", "label")


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def save_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """Metrics as a one-row table."""
    spark.createDataFrame(pd.DataFrame([metrics])).write.mode("overwrite").json(path)
