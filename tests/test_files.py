"""Readers and sinks: CSV parts, feature files, inventory, manifest, reports, models."""
import os

import pytest
from pyspark.sql import functions as F


def test_read_parts_and_projection(spark, tmp_dir):
    from netlens.sources.files import list_parts, read_parts
    with pytest.raises(FileNotFoundError):
        list_parts(tmp_dir)
    for i in range(3):
        with open(f"{tmp_dir}/part{i}.csv", "w") as fh:
            fh.write("a,label\n" + "".join(f"{j},L{i}\n" for j in range(5)))
    df = read_parts(spark, tmp_dir, "a int, label string", columns=["label"])
    assert df.columns == ["label"] and df.count() == 15


def test_read_features_defaults_label_from_name(spark, tmp_dir):
    from netlens.sources.files import read_features
    os.makedirs(f"{tmp_dir}/feat")
    with open(f"{tmp_dir}/feat/DDoS-SYN_Flood2.csv", "w") as fh:
        fh.write("Rate,label\n1.0,\n2.0,XSS\n")
    got = {r["Rate"]: (r["label"], r["source"])
           for r in read_features(spark, f"{tmp_dir}/feat", "Rate double, label string").collect()}
    assert got[1.0] == ("DDoS-SYN_Flood", "DDoS-SYN_Flood2.csv") and got[2.0][0] == "XSS"


def test_inventory_fingerprint_and_manifest(spark, tmp_dir):
    from netlens.operators.sampling import first_per_fingerprint, new_files
    from netlens.sources.files import file_inventory, fingerprint_file, read_manifest
    os.makedirs(f"{tmp_dir}/caps")
    for name, body in (("a.pcap", b"x" * 100), ("b.pcap", b"x" * 100), ("c.cap", b"y" * 5_000_000)):
        with open(f"{tmp_dir}/caps/{name}", "wb") as fh:
            fh.write(body)
    inv = file_inventory(spark, f"{tmp_dir}/caps")
    rows = {r["file"]: r for r in inv.collect()}
    assert set(rows) == {"a.pcap", "b.pcap", "c.cap"}
    assert rows["a.pcap"]["fp"] == rows["b.pcap"]["fp"] != rows["c.cap"]["fp"]
    assert rows["c.cap"]["fp"] == fingerprint_file(f"{tmp_dir}/caps/c.cap", 5_000_000)
    firsts = {r["file"] for r in first_per_fingerprint(inv, "fp", "path").collect()}
    assert firsts == {"a.pcap", "c.cap"}
    # equal length, another byte in the middle: another capture
    with open(f"{tmp_dir}/caps/d.cap", "wb") as fh:
        fh.write(b"y" * 2_500_000 + b"z" + b"y" * 2_499_999)
    assert fingerprint_file(f"{tmp_dir}/caps/d.cap", 5_000_000) != rows["c.cap"]["fp"]
    os.remove(f"{tmp_dir}/caps/d.cap")
    man = inv.filter(F.col("file") == "c.cap").select("fp")
    assert {r["file"] for r in new_files(inv, man).collect()} == {"a.pcap", "b.pcap"}
    with open(f"{tmp_dir}/manifest.csv", "w") as fh:
        fh.write("file,label\na.pcap,XSS\nzzz.pcap,DDoS-SYN_Flood\n")
    matched, missing = read_manifest(spark, f"{tmp_dir}/manifest.csv", inv)
    assert [r["file"] for r in matched.collect()] == ["a.pcap"]
    assert [r["file"] for r in missing.collect()] == ["zzz.pcap"]


def test_reports_and_by_label(spark, tmp_dir):
    from netlens.sources.files import write_by_label, write_report
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "label string, x int")
    write_report(df, f"{tmp_dir}/rep")
    assert spark.read.option("header", True).csv(f"{tmp_dir}/rep").count() == 3
    write_by_label(df, f"{tmp_dir}/by")
    assert {d for d in os.listdir(f"{tmp_dir}/by") if d.startswith("label=")} == {"label=A", "label=B"}


def test_model_roundtrip(spark, tmp_dir):
    from netlens.operators.models import fit_tree, predict
    from netlens.sources.files import load_model, save_model
    df = spark.createDataFrame([(float(i), "a" if i < 10 else "b") for i in range(20)],
                               "x double, label string")
    m = fit_tree(df, ["x"], "label", depth=3, leaf=1)
    save_model(m, f"{tmp_dir}/m")
    p = predict(load_model(f"{tmp_dir}/m"), df)
    assert p.filter(F.col("y_pred") == F.col("label")).count() == 20
