import pyspark.sql.functions as F
import pytest

from netlens.schema import BENIGN_LABEL, SCHEMES


@pytest.mark.parametrize("scheme,n_attack", [("flood_merged", 18), ("proto_flood_merged", 28),
                                             ("final_merged", 26), ("deploy_merged", 24)])
def test_merge_scheme_sizes(scheme, n_attack):
    targets = {v for k, v in SCHEMES[scheme].items() if k != BENIGN_LABEL}
    assert len(targets) == n_attack


def test_category_and_binary(spark):
    from netlens.functions.labels import label_scheme
    df = spark.createDataFrame([("DDoS-SYN_Flood",), ("BenignTraffic",), ("XSS",)], "label string")
    got = {r["label"]: (r["c"], r["b"], r["m"]) for r in df.select(
        "label", label_scheme("label", "category").alias("c"),
        label_scheme("label", "binary").alias("b"),
        label_scheme("label", "category_merged").alias("m")).collect()}
    assert got["DDoS-SYN_Flood"] == ("DDoS", "Attack", "Flood")
    assert got["BenignTraffic"] == ("Benign", "Benign", "Benign")
    assert got["XSS"] == ("Web", "Attack", "Web")


def test_unknown_label_raises(spark):
    from netlens.functions.labels import label_scheme
    df = spark.createDataFrame([("NotAClass",)], "label string")
    with pytest.raises(Exception):
        df.select(label_scheme("label", "category")).collect()
    assert df.select(label_scheme("label", "category", on_unknown="null").alias("c")).first()[0] is None


def test_label_from_filename(spark):
    from netlens.functions.labels import label_from_filename
    names = {
        "/x/DDoS-SYN_Flood3.pcap": "DDoS-SYN_Flood",
        "benign_capture_01.pcap": BENIGN_LABEL,
        "MITM-ArpSpoofing12.cap": "MITM-ArpSpoofing",
        "sqlinjection.pcap": "SqlInjection",
        "portscan_lab.pcap": None,
        "12345.pcap": None,
        "ddos-udp-flood-extra.pcap": "DDoS-UDP_Flood",
    }
    df = spark.createDataFrame([(k,) for k in names], "f string")
    got = {r["f"]: r["l"] for r in df.select("f", label_from_filename("f").alias("l")).collect()}
    assert got["/x/DDoS-SYN_Flood3.pcap"] == "DDoS-SYN_Flood"
    assert got["benign_capture_01.pcap"] == BENIGN_LABEL
    assert got["MITM-ArpSpoofing12.cap"] == "MITM-ArpSpoofing"
    assert got["sqlinjection.pcap"] == "SqlInjection"
    assert got["12345.pcap"] is None
    assert got["ddos-udp-flood-extra.pcap"] == "DDoS-UDP_Flood"


def test_every_granularity_is_fitted(spark):
    """M4: 34 classes, 8, 6, binary, 18, 28, 26 and 24 + benign."""
    from netlens.functions.labels import SCHEME_NAMES
    from netlens.plans.queries import q_granularities
    got = {r["scheme"] for r in q_granularities(spark, "/root/testdata/sf0.001").select("scheme").distinct().collect()}
    assert got == {"class", *SCHEME_NAMES} and len(got) == 8
