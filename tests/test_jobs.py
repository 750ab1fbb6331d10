"""End-to-end jobs on small inputs (3.1, 3.2, 3.3)."""
from pyspark.sql import functions as F


def test_captures_to_alerts_and_verdicts(spark, tmp_dir):
    import os
    from tests.test_pcap import FRAMES, write_pcap
    from netlens.functions.features import feature_list
    from netlens.operators.gate import fit_gate
    from netlens.operators.models import fit_tree
    from netlens.plans.jobs import capture_verdicts, captures_to_alerts, scored_windows
    from netlens.plans.queries import model_windows
    train = model_windows(spark, "/root/testdata/sf0.001")
    feats = feature_list("all")
    gate = fit_gate(train.filter(F.col("label") == "BenignTraffic"), feats, "id", trees=20)
    tree = fit_tree(train.filter(F.col("label") != "BenignTraffic"), feats)
    os.makedirs(f"{tmp_dir}/caps")
    write_pcap(f"{tmp_dir}/caps/x.pcap", FRAMES * 5)
    alerts = captures_to_alerts(spark, f"{tmp_dir}/caps", gate, tree, f"{tmp_dir}/alerts")
    written = spark.read.option("header", True).csv(f"{tmp_dir}/alerts")
    assert written.count() == alerts.count()
    events = spark.createDataFrame(
        [("alert", "x.pcap", "LOCAL XSS script tag in request", 1)],
        "event_type string, capture string, signature string, severity long")
    v = capture_verdicts(scored_windows(spark, f"{tmp_dir}/caps", gate, tree), events).first()
    assert v["capture"] == "x.pcap" and v["dpi_detected"] and v["detected"]
    assert v["final_label"] == "DPI: LOCAL XSS script tag in request"


def test_training_table(spark, tmp_dir):
    import os
    from netlens.plans.jobs import training_table
    os.makedirs(f"{tmp_dir}/parts")
    labels = ["DDoS-SYN_Flood"] * 60 + ["XSS"] * 10 + ["BenignTraffic"] * 30
    with open(f"{tmp_dir}/parts/p0.csv", "w") as fh:
        fh.write("id,Rate,label\n" + "".join(f"{i},{i * 0.5},{l}\n" for i, l in enumerate(labels)))
    plan = training_table(spark, f"{tmp_dir}/parts", "id long, Rate double, label string",
                          f"{tmp_dir}/out", ["Rate"], "id", threshold=50, cap=20,
                          report=f"{tmp_dir}/plan")
    got = {r["label"]: (r["target"], r["downsampled"]) for r in plan.collect()}
    assert got["DDoS-SYN_Flood"] == (20, True) and got["XSS"] == (10, False)
    t = spark.read.parquet(f"{tmp_dir}/out")
    assert set(t.columns) >= {"id", "label_34", "label_8", "label_binary", "Rate"}
    assert t.filter("label_34 = 'XSS'").count() == 10
    assert spark.read.option("header", True).csv(f"{tmp_dir}/plan").count() == 3


def test_session_table(spark, tmp_dir):
    import os
    from tests.test_pcap import FRAMES, write_pcap
    from netlens.plans.jobs import session_table
    os.makedirs(f"{tmp_dir}/caps")
    write_pcap(f"{tmp_dir}/caps/DDoS-SYN_Flood1.pcap", FRAMES * 3)
    write_pcap(f"{tmp_dir}/caps/DDoS-SYN_Flood2.pcap", FRAMES * 3)     # same content
    write_pcap(f"{tmp_dir}/caps/benign_office.pcap", FRAMES * 2)
    write_pcap(f"{tmp_dir}/caps/mystery.pcap", FRAMES)                  # no label
    new = {r["file"]: (r["label"], r["rows"]) for r in
           session_table(spark, f"{tmp_dir}/caps", f"{tmp_dir}/out", f"{tmp_dir}/manifest").collect()}
    assert new == {"DDoS-SYN_Flood1.pcap": ("DDoS-SYN_Flood", 2),
                   "benign_office.pcap": ("BenignTraffic", 2)}
    labels = {d for d in os.listdir(f"{tmp_dir}/out") if d.startswith("label=")}
    assert labels == {"label=DDoS-SYN_Flood", "label=BenignTraffic"}
    stored = lambda: sorted((r["label"], r["fp"], r["source"], r["window_id"]) for r in
                            spark.read.parquet(f"{tmp_dir}/out").collect())
    first = stored()
    assert len(first) == 4
    # a second run finds every fingerprint in the manifest and adds nothing
    again = session_table(spark, f"{tmp_dir}/caps", f"{tmp_dir}/out", f"{tmp_dir}/manifest")
    assert again.count() == 0 and stored() == first
    # a further capture joins the earlier ones, in the same folder and in a label of its own
    write_pcap(f"{tmp_dir}/caps/DDoS-SYN_Flood3.pcap", FRAMES * 4)
    write_pcap(f"{tmp_dir}/caps/XSS.pcap", FRAMES * 5)
    third = session_table(spark, f"{tmp_dir}/caps", f"{tmp_dir}/out", f"{tmp_dir}/manifest")
    assert {r["file"] for r in third.collect()} == {"DDoS-SYN_Flood3.pcap", "XSS.pcap"}
    assert set(first) < set(stored()) and {x[0] for x in stored()} == {"DDoS-SYN_Flood", "BenignTraffic", "XSS"}
    # without a manifest the same rows are written again, not added
    everything = stored()
    session_table(spark, f"{tmp_dir}/caps", f"{tmp_dir}/out")
    assert stored() == everything
    assert spark.read.parquet(f"{tmp_dir}/manifest").count() == 4


def test_label_from_filename_in_a_filter(spark):
    """The label expression normalises the name once and compiles under a filter."""
    from netlens.functions.labels import label_from_filename
    df = spark.createDataFrame([("/a/DDoS-SYN_Flood12.pcap",), ("x/Benign_office.cap",), ("mystery.pcap",), ("123.pcap",)], "p string")
    out = df.withColumn("l", label_from_filename("p")).filter("l is not null")
    assert sorted(r["l"] for r in out.collect()) == ["BenignTraffic", "DDoS-SYN_Flood"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 8
