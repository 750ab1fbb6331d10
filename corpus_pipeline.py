"""Corpus pipeline: documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows to the shared folder and hands them to the next one, so a
lost executor or a failed stage costs no earlier stage.  All but the last stage
return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import bpe, mixing, pii, quality, simhash
from netlens.llm.common import materialize, table
from netlens.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.select("doc_id", "text", "lang", "source",
                     F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit leave the kept ones."""
    return _documents(quality.apply(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id (none counts
    as the largest).  Rows are told apart by a row number of their own, so rows that
    share a doc_id, or have none, are compared like any others."""
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = simhash.cluster(numbered.select(F.col("_row").alias("doc_id"), "text"))
    member = materialize(groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    stay = (numbered.select("_row", "doc_id").join(member, "_row").groupBy("_group").agg(first.alias("first"))
                    .select("first._row"))
    # one bit a row number: texts stay where they lie while the bits fit Spark's broadcast limit
    bucket, place = F.bitmap_bucket_number("_row"), F.bitmap_bit_position("_row")
    bits = materialize(stay.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits")), "stay")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return _documents(numbered.withColumn("_bucket", bucket).join(bits, "_bucket")
                              .where(F.getbit(byte, (place % 8).cast("int")) == 1))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; every document stays."""
    clean = pii.redact_column(docs.select(*COLUMNS))
    return _documents(clean)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn pieces: a document as often as the mix takes it."""
    return _documents(mixing.deal(mixing.mix(docs.select(*COLUMNS))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row and the digest of what they decode to.  The ids are
    written first, so that a task has one Python worker at a time."""
    path = vocabulary()
    both = bpe.decode(materialize(bpe.encode(docs, path), "ids"), path)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.col("text"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: XXH64 fingerprints, BK-tree links and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
