"""Helpers the training-data operators share.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``
(parquet, one fresh folder per table), so a lost executor only costs the tasks
that were running and nothing is read from a machine-local disk.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.session import ensure_checkpoint_dir

#: A word: a run of anything but the six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and keeps later passes cheap."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of the key as text, modulo m (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m


def words(text: Column) -> Column:
    """The words of a text in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def slices(batches, rows: int = 256):
    """Arrow batches in small pieces, so that few rows at a time are Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
