"""End-to-end batch jobs built from the operators (the survey's lifecycles).

* :func:`captures_to_alerts` - capture files -> windows -> features ->
  gate + classifier -> alert rows appended to a sink (3.1, replay mode);
* :func:`training_table` - labelled CSV parts -> class counts -> plan ->
  hash sample -> sampled table and plan report written out (3.2);
* :func:`capture_verdicts` - scored windows per capture + signature events
  -> one verdict per capture (3.3);
* :func:`session_table` - capture folder -> per-label window tables, every
  capture content once, cached fingerprints skipped (3.4).

Each job is a few DataFrame steps; nothing is gathered on the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.features import engineer
from netlens.functions.labels import assert_known, label_from_filename
from netlens.operators import alerts as AL
from netlens.operators import sampling as SA
from netlens.operators.gate import Gate
from netlens.operators.models import score_two_stage
from netlens.operators.windows import windows_from_packets
from netlens.session import cut_lineage
from netlens.schema import DOWNSAMPLE_THRESHOLD, PER_CLASS_CAP, RANDOM_SEED
from netlens.sources import files as FS
from netlens.sources.pcap import decoded_packets

WINDOW_KEY = ["source", "chunk_id", "window_id"]


def scored_windows(spark: SparkSession, captures: str, gate: Gate, model,
                   max_packets: int | None = None) -> DataFrame:
    """Capture files -> engineered window rows with gate score and class."""
    pk = decoded_packets(spark, captures, max_packets=max_packets)
    eng = engineer(windows_from_packets(pk), keep=WINDOW_KEY)
    return score_two_stage(eng, gate, model).withColumns({
        "attack_type": F.col("y_pred"),
        "capture": F.col("source")})


def captures_to_alerts(spark: SparkSession, captures: str, gate: Gate, model, sink: str,
                       fmt: str = "csv") -> DataFrame:
    """Score captures and append their attack windows as alert rows (3.1).

    The alert time is the processing time, as in replay scoring; the window
    key is kept next to it.  Returns the alert rows written.
    """
    s = scored_windows(spark, captures, gate, model)
    det = AL.to_detail(s)
    alerts = AL.only_alerts(det).select(
        F.current_timestamp().cast("timestamp_ntz").alias("ts"), "label",
        F.col("source"), *[c for c in WINDOW_KEY if c != "source"])
    AL.write_alerts(alerts.select("ts", "label", "source"), sink, fmt)
    return alerts


def training_table(spark: SparkSession, parts: str, schema, out: str, features: list[str],
                   key: str, label: str = "label", threshold: int = DOWNSAMPLE_THRESHOLD,
                   cap: int = PER_CLASS_CAP, seed: int = RANDOM_SEED,
                   report: str | None = None) -> DataFrame:
    """Labelled CSV parts -> sampled training table (3.2).

    Pass 1 counts classes over the label column only (column pruning to the
    scan); unknown labels fail the job; pass 2 draws the hash sample and
    writes it as parquet; the class plan goes to ``report`` as CSV.
    """
    rows = FS.read_parts(spark, parts, schema)
    assert_known(rows.select(label), label)
    counts = SA.class_counts(rows.select(label), label)
    plan = SA.class_plan(counts, label, threshold, cap)
    if report:
        FS.write_report(plan, report)
    table = SA.sample_table(rows, key, features, label, threshold, cap, seed, shuffle=True)
    table.write.mode("overwrite").parquet(out)
    return plan


def capture_verdicts(scored: DataFrame, events: DataFrame, min_rate: float | None = None,
                     max_severity: int = 2) -> DataFrame:
    """One verdict per capture from scored windows and signature events (3.3)."""
    det = AL.to_detail(scored)
    return AL.verdicts(det, AL.filter_events(events, max_severity), min_rate=min_rate)


def session_table(spark: SparkSession, captures: str, out: str, manifest: str | None = None,
                  max_packets: int | None = None) -> DataFrame:
    """Capture folder -> per-label window tables, each content once (3.4).

    File inventory with content fingerprints (S14) -> label from the file
    name, unlabelled files dropped (P20) -> first file per fingerprint (W8)
    -> files whose fingerprint is already in the manifest skipped (J7) ->
    windows of the remaining captures (S5, W1-W6, A3) with ``source`` ->
    ``out``/label=.../fp=... (S13).  A run replaces only the folders of the
    captures it reads, so earlier captures stay and a repeated run writes the
    same rows; the manifest comes last, so a run that broke off is done again.
    Returns the new manifest rows (fp, file, label, rows); duplicate window
    rows are kept.
    """
    inv = FS.file_inventory(spark, captures).withColumn("label", label_from_filename("file"))
    files = SA.first_per_fingerprint(inv.filter(F.col("label").isNotNull()), "fp", "path")
    seen = FS.read_if_present(lambda: spark.read.parquet(manifest)) if manifest else None
    if seen is not None:
        files = SA.new_files(files, seen)
    # one row per capture file; the reader needs the paths to plan its tasks
    files = cut_lineage(files.select("path", F.col("file").alias("source"), "label", "fp"))
    paths = sorted(r["path"] for r in files.select("path").collect())
    if not paths:
        return spark.createDataFrame([], "fp string, file string, label string, rows long")
    pk = decoded_packets(spark, paths, max_packets=max_packets)
    # computed once (reliable checkpoint): the window rows feed the per-label
    # write and the manifest, and the returned rows must not re-read the
    # manifest they are appended to
    win = cut_lineage(windows_from_packets(pk).join(files.drop("path"), "source"))
    FS.write_by_label(win, out, also=["fp"])
    counts = win.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"))
    new = cut_lineage(files.join(counts, "fp", "left").select(
        "fp", F.col("source").alias("file"), "label", F.coalesce("rows", F.lit(0).cast("long")).alias("rows")))
    if manifest is not None:
        new.write.mode("append").parquet(manifest)
    return new
