"""Signature events, alerts, verdicts and dashboard views (S7, S10, S11,
P21-P27, A21-A28, J11, T4-T6, U5).

Every view is an aggregation over the alert/event tables; nothing is
gathered per capture into one task.  Lists (first five signatures) are
built from an already-ranked, bounded set.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.columns import epoch_micros, from_epoch_micros
from netlens.sources.files import read_if_present
from netlens.schema import BENIGN_LABEL

EVENT_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("capture", T.StringType()),
    T.StructField("alert", T.StructType([
        T.StructField("signature", T.StringType()),
        T.StructField("severity", T.LongType())])),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
])

# FIXED VALUE: label text of an alert event without a signature.
DEFAULT_SIGNATURE = "Suricata alert"

# FIXED VALUES: engine-noise substrings dropped by the signature filter.
NOISE = ["invalid checksum", "STREAM", "Applayer", "unable to match",
         "gzip decompression", "FRAG", "decompression failed"]

# FIXED VALUES: signature-category prefixes disabled for a small device.
DISABLED_PREFIXES = ["ET INFO", "ET HUNTING", "ET DYN_DNS", "ET PHISHING", "ET ADWARE_PUP",
                     "ET USER_AGENTS", "ET GAMES", "ET P2P", "ET TOR", "ET FILE_SHARING",
                     "GPL NETBIOS"]

# FIXED VALUES: local payload rules (sid, message, target, pattern kind, pattern).
COMMAND_PATTERN = r"(;|\||`|\$\()\s*(cat|wget|curl|nc|sh|bash|chmod|busybox)\b"
RULES = [
    (1000001, "LOCAL SQLi UNION SELECT in URI"),
    (1000002, "LOCAL SQLi tautology ' OR 1=1"),
    (1000003, "LOCAL XSS script tag in request"),
    (1000004, "LOCAL OS Command Injection in URI"),
    (1000005, "LOCAL Mirai-style wget+chmod dropper"),
    (1000006, "LOCAL Telnet to IoT device (policy)"),
    (1000007, "LOCAL Telnet default-cred attempt (root)"),
]


# ------------------------------------------------------------- events
def parse_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON text lines -> event columns; blank and malformed lines dropped."""
    ev = lines.select(F.from_json(F.col(col), EVENT_SCHEMA,
                                  {"mode": "PERMISSIVE"}).alias("e"), *[
        c for c in lines.columns if c != col])
    return (ev.filter(F.col("e.event_type").isNotNull())
              .select(*[c for c in lines.columns if c != col],
                      F.col("e.event_type").alias("event_type"),
                      F.col("e.timestamp").alias("timestamp"),
                      F.col("e.src_ip").alias("src_ip"), F.col("e.dest_ip").alias("dest_ip"),
                      F.col("e.capture").alias("capture"),
                      F.col("e.alert.signature").alias("signature"),
                      F.col("e.alert.severity").alias("severity")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event-log files (one JSON object per line) -> parsed events.

    Invalid UTF-8 is replaced by the text reader; files are split across
    tasks like any text input.
    """
    return parse_events(spark.read.text(path))


def filter_events(ev: DataFrame, max_severity: int = 2) -> DataFrame:
    """Real attack signatures (P21): alerts with severity (default 3) <= max and
    no engine-noise substring."""
    noise = None
    for n in NOISE:
        c = F.col("signature").contains(n)
        noise = c if noise is None else (noise | c)
    return ev.filter((F.col("event_type") == "alert")
                     & (F.coalesce(F.col("severity"), F.lit(3)) <= max_severity)
                     & ~F.coalesce(noise, F.lit(False)))


def drop_categories(ev: DataFrame, prefixes=DISABLED_PREFIXES, col: str = "signature") -> DataFrame:
    """Drop whole signature categories by message prefix."""
    pat = "^(" + "|".join(p.replace(" ", "\\s") for p in prefixes) + ")"
    return ev.filter(~F.coalesce(F.col(col).rlike(pat), F.lit(False)))


def event_time(ts_text) -> Column:
    """Event time text -> local wall time without zone (P23): first 19 chars, T -> space."""
    t = F.col(ts_text) if isinstance(ts_text, str) else ts_text
    return F.try_to_timestamp(F.replace(F.substring(t, 1, 19), F.lit("T"), F.lit(" ")),
                              F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def events_to_alerts(ev: DataFrame) -> DataFrame:
    """Event -> alert row (P22): ``DPI: <sig>[ (sev n)]`` and ``src->dst``."""
    sev = F.col("severity")
    label = F.concat(F.lit("DPI: "), F.coalesce(F.col("signature"), F.lit(DEFAULT_SIGNATURE)),
                     F.when(sev.isNotNull() & (sev != 0),
                            F.concat(F.lit(" (sev "), sev.cast("string"), F.lit(")")))
                      .otherwise(F.lit("")))
    return ev.filter(F.col("event_type") == "alert").select(
        event_time("timestamp").alias("ts"), label.alias("label"),
        F.concat(F.coalesce("src_ip", F.lit("?")), F.lit("->"),
                 F.coalesce("dest_ip", F.lit("?"))).alias("source"))


# ------------------------------------------------------- scored rows
def to_detail(scored: DataFrame, is_anomaly: str = "is_anomaly",
              attack: str = "attack_type") -> DataFrame:
    """0/1 anomaly flag, attack type and final label per scored row."""
    return scored.withColumns({
        "is_anomaly_i": F.col(is_anomaly).cast("int"),
        "label": F.when(F.col(is_anomaly), F.col(attack)).otherwise(F.lit(BENIGN_LABEL))})


def only_alerts(detail: DataFrame) -> DataFrame:
    """Attack-only rows."""
    return detail.filter(F.col("label") != BENIGN_LABEL)


def ml_alerts(detail: DataFrame, source: str = "capture") -> DataFrame:
    """Behavioural alerts in the shared alert schema (event time kept)."""
    return only_alerts(detail).select(F.col("ts").cast("timestamp_ntz").alias("ts"),
                                      F.col("label"), F.col(source).alias("source"))


def union_alerts(*alerts: DataFrame) -> DataFrame:
    """Alerts from both engines in one table."""
    out = alerts[0].select("ts", "label", "source")
    for a in alerts[1:]:
        out = out.unionByName(a.select("ts", "label", "source"))
    return out


# ------------------------------------------------------------ rules (P25)
def normalized_uri(uri) -> Column:
    """lower(url-decoded uri); a bad escape keeps the raw text."""
    u = F.col(uri) if isinstance(uri, str) else uri
    return F.lower(F.coalesce(F.try_url_decode(u), u))


def match_rules(requests: DataFrame, uri: str = "uri", body: str = "body",
                dport: str = "dport", proto: str = "proto", key: str = "request_id") -> DataFrame:
    """One alert row per (request, matching rule) (P25).

    Each rule is a Column predicate; matches are gathered per request into
    an array of at most 7 rule ids and exploded: no join against the rule
    table, so the request table is scanned once.
    """
    u = normalized_uri(uri)
    b = F.lower(F.col(body))
    tcp23 = (F.col(proto) == 6) & (F.col(dport) == 23)
    preds = [
        u.rlike("(?s)union.*select"),
        u.contains("or 1=1"),
        u.contains("<script"),
        u.rlike("(?i)" + COMMAND_PATTERN),
        b.contains("wget") & b.contains("chmod"),
        tcp23,
        tcp23 & F.substring(b, 1, 64).contains("root"),
    ]
    sids = F.array_compact(F.array(*[F.when(p, F.lit(sid)) for p, (sid, _) in zip(preds, RULES)]))
    msg = F.create_map(*[x for sid, m in RULES for x in (F.lit(sid), F.lit(m))])
    return (requests.select(F.col(key), F.explode(sids).alias("sid"))
                    .withColumn("msg", F.element_at(msg, F.col("sid"))))


# ------------------------------------------------------- histograms
def label_histogram(df: DataFrame, by: str | None = None, label: str = "label") -> DataFrame:
    """Label counts, share of the group, and whether the label is a flood."""
    keys = [by] if by else []
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return c.withColumns({"share": F.col("n") / F.sum("n").over(w),
                          "is_flood": F.lower(F.col(label)).contains("flood")})


def top_labels(df: DataFrame, by: str, n: int = 6, label: str = "label") -> DataFrame:
    """Top ``n`` labels per group by count, name ascending on ties (T5)."""
    c = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), F.col(label))
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def dominant(df: DataFrame, by: str, col: str) -> DataFrame:
    """Most frequent value per group, smallest on a tie."""
    t = top_labels(df, by, 1, col)
    return t.select(by, F.col(col).alias(f"top_{col}"), F.col("n").alias(f"top_{col}_n"))


# ----------------------------------------------------- verdicts
def verdicts(detail: DataFrame, events: DataFrame, capture: str = "capture",
             min_rate: float | None = None, top_sigs: int = 5) -> DataFrame:
    """One verdict per capture from scored rows and filtered signature events.

    ``min_rate=None``: behavioural detection if any row is anomalous (A24);
    a number: if at least that share of rows is (A23, 0.10).  Captures
    without signature events count as none (J11, left join).
    """
    d = detail.groupBy(capture).agg(
        F.count(F.lit(1)).alias("flows"),
        F.avg(F.col("is_anomaly").cast("double")).alias("ml_rate"))
    ml_top = dominant(detail.filter(F.col("is_anomaly")), capture, "attack_type")
    sig_n = events.groupBy(capture, "signature").agg(F.count(F.lit(1)).alias("n"))
    w_top = Window.partitionBy(capture).orderBy(F.col("n").desc(), F.col("signature"))
    w_name = Window.partitionBy(capture).orderBy(F.col("signature"))
    s = sig_n.withColumns({"_rt": F.row_number().over(w_top),
                           "_rn": F.row_number().over(w_name)})
    dpi = s.groupBy(capture).agg(
        F.sum("n").alias("dpi_alerts"),
        F.max(F.when(F.col("_rt") == 1, F.col("signature"))).alias("top_sig"),
        F.sort_array(F.collect_list(F.when(F.col("_rn") <= top_sigs, F.col("signature"))))
         .alias("dpi_sigs"))
    v = d.join(ml_top, capture, "left").join(dpi, capture, "left")
    ml_hit = (F.col("ml_rate") > 0) if min_rate is None else (F.col("ml_rate") >= min_rate)
    dpi_hit = F.coalesce(F.col("dpi_alerts"), F.lit(0)) > 0
    return v.select(
        capture, "flows", "ml_rate",
        ml_hit.alias("ml_detected"),
        F.when(F.col("ml_rate") > 0, F.col("top_attack_type"))
         .otherwise(F.lit(BENIGN_LABEL)).alias("ml_label"),
        F.coalesce(F.col("dpi_alerts"), F.lit(0)).alias("dpi_alerts"),
        dpi_hit.alias("dpi_detected"),
        F.coalesce(F.col("dpi_sigs"), F.array().cast("array<string>")).alias("dpi_sigs"),
        (ml_hit | dpi_hit).alias("detected"),
        F.when(dpi_hit, F.concat(F.lit("DPI: "), F.col("top_sig")))
         .when(ml_hit, F.col("top_attack_type")).otherwise(F.lit(BENIGN_LABEL)).alias("final_label"),
        F.when(ml_hit & dpi_hit, "both").when(ml_hit, "ML").when(dpi_hit, "DPI")
         .otherwise("none").alias("caught_by"))


def detection_rollup(v: DataFrame, web_labels: list[str], capture: str = "capture") -> DataFrame:
    """Detected share over attack captures, web captures, and benign false positives."""
    atk = F.col(capture) != BENIGN_LABEL
    web = F.col(capture).isin(*web_labels)
    return v.agg(
        F.count_if(atk & F.col("detected")).alias("attacks_detected"),
        F.count_if(atk).alias("attacks"),
        F.count_if(web & F.col("detected")).alias("web_detected"),
        F.count_if(web).alias("web"),
        F.max(F.when(~atk, F.col("detected"))).alias("benign_false_positive"))


# ------------------------------------------------------ dashboard
def dashboard_kpis(alerts: DataFrame, now: str) -> DataFrame:
    """Total alerts, distinct labels, alerts in the last minute, last alert time."""
    n = F.to_timestamp_ntz(F.lit(now))
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("label").alias("labels"),
        F.count_if(F.col("ts") > n - F.expr("INTERVAL 1 MINUTE")).alias("last_minute"),
        F.max("ts").alias("last_alert"))


def timeline(alerts: DataFrame, seconds: int = 10, start=None, end=None) -> DataFrame:
    """Alerts per fixed bin, empty bins as 0.

    Bin counts are one aggregation; the bin range is generated with
    ``spark.range`` from the two bounds (two scalars on the driver), so the
    bin table is distributed and joined, not built in one task.  ``start`` and
    ``end`` (datetimes, end exclusive) bound the range, so that a stray time
    stamp does not decide the size of the result; without them the alerts' own
    first and last bin do.
    """
    spark = alerts.sparkSession
    width = seconds * 1_000_000
    b = F.floor(epoch_micros("ts") / F.lit(width)).cast("long")
    inside = F.col("ts").isNotNull()
    if start is not None:
        inside &= F.col("ts") >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        inside &= F.col("ts") < F.lit(end).cast("timestamp_ntz")
    counts = alerts.filter(inside).groupBy(b.alias("bin")) \
        .agg(F.count(F.lit(1)).alias("alerts"))
    lo, hi = counts.agg(F.min("bin"), F.max("bin")).first()
    if lo is None:
        return counts.select("bin", F.lit(None).cast("timestamp_ntz").alias("bin_start"), "alerts")
    bins = spark.range(lo, hi + 1).withColumnRenamed("id", "bin")
    return (bins.join(counts, "bin", "left")
                .select("bin",
                        from_epoch_micros(F.col("bin") * width).alias("bin_start"),
                        F.coalesce(F.col("alerts"), F.lit(0)).alias("alerts")))


def recent(alerts: DataFrame, n: int = 100) -> DataFrame:
    """Latest ``n`` alerts, unknown times last (T4)."""
    return alerts.orderBy(F.col("ts").desc_nulls_last(), F.col("label"), F.col("source")).limit(n)


def first_signatures(events: DataFrame, by: str, n: int = 5) -> DataFrame:
    """First ``n`` distinct signatures per group, sorted."""
    d = events.select(by, "signature").distinct()
    w = Window.partitionBy(by).orderBy("signature")
    return (d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
             .groupBy(by).agg(F.sort_array(F.collect_list("signature")).alias("signatures")))


# --------------------------------------------------------- files
def write_alerts(alerts: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append alerts (S10): header written per file, schema fixed."""
    w = alerts.select("ts", "label", "source").write.mode("append")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant alert read (S11): a missing folder gives an empty table,
    missing columns become "", an unparsable ``ts`` becomes NULL."""
    raw = read_if_present(lambda: spark.read.option("header", True).csv(path))
    if raw is None:
        return spark.createDataFrame([], ALERT_SCHEMA)
    cols = {c: (F.col(c) if c in raw.columns else F.lit("")) for c in ("ts", "label", "source")}
    return raw.select(
        F.try_to_timestamp(cols["ts"].cast("string"), F.lit("yyyy-MM-dd HH:mm:ss"))
         .cast("timestamp_ntz").alias("ts"),
        cols["label"].cast("string").alias("label"),
        cols["source"].cast("string").alias("source"))
