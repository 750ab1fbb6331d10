"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame
over the whole driver tables.  Names follow the operator ids of the
inventory; the matching DuckDB text lives in :mod:`netlens.plans.oracle_sql`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.features import engineer
from netlens.operators.windows import windows_from_packets
from netlens.plans.oracle_sql import FIXTURE_CHUNK_BYTES, UNSTABLE_ENG, UNSTABLE_RAW
from netlens.sources.derived import packets_from_events, table


def round_cols(df: DataFrame, cols, places: int = 6) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.round(F.col(c), places).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def fixture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def fixture_windows(spark: SparkSession, sf_dir: str, directional: str = "both") -> DataFrame:
    return windows_from_packets(fixture_packets(spark, sf_dir),
                                chunk_bytes=FIXTURE_CHUNK_BYTES, directional=directional)


def q_window_summary(spark, sf_dir):
    return round_cols(fixture_windows(spark, sf_dir), UNSTABLE_RAW)


def q_engineered(spark, sf_dir):
    # rate columns are rounded before engineering so that both engines feed
    # identical inputs into rate * iat and the rate ratios
    w = round_cols(fixture_windows(spark, sf_dir), UNSTABLE_RAW)
    w = engineer(w, keep=["source", "chunk_id", "window_id"])
    return round_cols(w, UNSTABLE_ENG)


# ---------------------------------------------------------------- labels
from netlens.functions.labels import SCHEME_NAMES, label_scheme, unknown_labels  # noqa: E402
from netlens.operators import evaluate as EV  # noqa: E402
from netlens.operators import sampling as SA  # noqa: E402
from netlens.sources.derived import labelled_events, predicted_event_type  # noqa: E402

# Fixture parameters (scaled-down sampling policy for the driver tables).
FIX_THRESHOLD = 320
FIX_CAP = 200
FIX_TEST_TOTAL = 2000
SEED = 42


def lev(spark, sf_dir):
    return labelled_events(table(spark, sf_dir, "events"))


def q_label_schemes(spark, sf_dir):
    e = lev(spark, sf_dir)
    return e.select("event_id", "label", *[label_scheme("label", s).alias(s) for s in SCHEME_NAMES])


def q_unknown_labels(spark, sf_dir):
    """Labels of every 11th user misspelt: those have no taxonomy entry."""
    odd = F.col("user_id") % 11 == 0
    return unknown_labels(lev(spark, sf_dir).withColumn("label", F.when(odd, F.concat("label", F.lit("-typo"))).otherwise(F.col("label"))))


def q_class_counts(spark, sf_dir):
    return SA.class_counts(lev(spark, sf_dir))


def q_class_plan(spark, sf_dir):
    return SA.class_plan(SA.class_counts(lev(spark, sf_dir)), threshold=FIX_THRESHOLD, cap=FIX_CAP)


def _sample(spark, sf_dir):
    e = lev(spark, sf_dir)
    plan = SA.class_plan(SA.class_counts(e), threshold=FIX_THRESHOLD, cap=FIX_CAP)
    return SA.sample_by_plan(e, plan, "event_id", seed=SEED)


def q_hash_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("event_id", "label", "source")


def q_sample_n(spark, sf_dir):
    return SA.sample_n(lev(spark, sf_dir), 500, "event_id", SEED).select("event_id", "label")


def q_sample_frac(spark, sf_dir):
    return SA.sample_frac(lev(spark, sf_dir), 0.25, "event_id", ["label"], SEED) \
        .select("event_id", "label")


def q_class_quota(spark, sf_dir):
    return SA.sample_n(lev(spark, sf_dir), 100, "event_id", SEED, by=["label"]) \
        .select("event_id", "label")


def q_stratified_split(spark, sf_dir):
    return SA.stratified_split(lev(spark, sf_dir), "label", 0.8, "event_id", SEED) \
        .select("event_id", "label", "is_train")


def q_onsite_split(spark, sf_dir):
    e = lev(spark, sf_dir).filter(F.col("label") == "BenignTraffic")
    return SA.stratified_split(e, "source", 0.8, "event_id", SEED, col="is_train") \
        .select("event_id", "source", "is_train")


FEATURE_KEY = ["ts", "user_id", "event_type", "value"]


def q_exclude_seen(spark, sf_dir):
    e = lev(spark, sf_dir)
    return SA.exclude_seen(e, _sample(spark, sf_dir), FEATURE_KEY).select("event_id", "label")


def q_realistic_sample(spark, sf_dir):
    e = lev(spark, sf_dir)
    counts = SA.class_counts(e)
    samp = _sample(spark, sf_dir)
    held = SA.stratified_split(samp, "label", 0.8, "event_id", SEED).filter(~F.col("is_train")) \
        .drop("is_train")
    out = SA.realistic_sample(e, samp, held, counts, "event_id", FEATURE_KEY,
                              test_total=FIX_TEST_TOTAL, threshold=FIX_THRESHOLD, cap=FIX_CAP,
                              seed=SEED)
    return out.select("event_id", "label")


def q_held_out_sessions(spark, sf_dir):
    e = lev(spark, sf_dir).withColumn("cls", F.col("event_type"))
    return SA.held_out_sessions(e, "cls")


def q_sessions_per_class(spark, sf_dir):
    return SA.sessions_per_class(lev(spark, sf_dir))


def q_replicate(spark, sf_dir):
    return SA.replicate(table(spark, sf_dir, "labels"), 3).select("doc_id", "rep")


def _doc_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id"),
                    F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"),
                    F.substring(F.md5(F.col("text")), 1, 16).alias("fp"))


def q_first_per_fingerprint(spark, sf_dir):
    return SA.first_per_fingerprint(_doc_files(spark, sf_dir)).select("fp", "doc_id")


def q_new_files(spark, sf_dir):
    f = _doc_files(spark, sf_dir)
    manifest = f.filter(SA.hash_unit("doc_id", 7) < 0.5)
    return SA.new_files(f, manifest).select("doc_id", "fp")


# ---------------------------------------------------------------- evaluation
def predictions(spark, sf_dir):
    """events: truth = event_type, prediction = event type number k % 5."""
    e = lev(spark, sf_dir)
    return e.withColumns({"y_true": F.col("event_type"),
                          "y_pred": predicted_event_type(F.col("k")),
                          "y_pred_b": predicted_event_type(F.floor(F.col("k") / 5).cast("int"))})


def q_confusion(spark, sf_dir):
    return EV.confusion(predictions(spark, sf_dir))


def q_classification_report(spark, sf_dir):
    return EV.classification_report(EV.confusion(predictions(spark, sf_dir)))


def q_scalar_metrics(spark, sf_dir):
    return EV.scalar_metrics(EV.confusion(predictions(spark, sf_dir)))


def q_binary_metrics(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return EV.scalar_metrics(EV.confusion(lab, "quality", "toxic"))


def _held_out_conf(spark, sf_dir):
    p = SA.stratified_split(predictions(spark, sf_dir), "y_true", 0.8, "event_id", SEED)
    return EV.confusion(p.filter(~F.col("is_train")))


def _priors(spark, sf_dir):
    return SA.class_counts(predictions(spark, sf_dir), "y_true").withColumnRenamed("y_true", "label")


def q_reweighted_metrics(spark, sf_dir):
    return EV.reweighted(_held_out_conf(spark, sf_dir), _priors(spark, sf_dir))[1]


def q_weakest_classes(spark, sf_dir):
    per = EV.reweighted(_held_out_conf(spark, sf_dir), _priors(spark, sf_dir))[0]
    return EV.rank(per, "f1", n=8, ascending=True, tie="class")


def _gap(spark, sf_dir):
    p = SA.mark_held_out(predictions(spark, sf_dir), "y_true", "source")
    within = EV.recall_by_class(p.filter(~F.col("is_held_out")))
    cross = EV.recall_by_class(p.filter(F.col("is_held_out")))
    return EV.session_gap(within, cross)


def q_recall_by_class(spark, sf_dir):
    return EV.recall_by_class(predictions(spark, sf_dir))


def q_session_gap(spark, sf_dir):
    return _gap(spark, sf_dir)


def q_gap_summary(spark, sf_dir):
    return EV.gap_summary(_gap(spark, sf_dir))


def q_support_vs_f1(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return EV.support_vs_f1(SA.class_counts(p, "y_true").withColumnRenamed("y_true", "label"),
                            EV.per_class(EV.confusion(p)))


def q_report_delta(spark, sf_dir):
    p = predictions(spark, sf_dir)
    a = EV.per_class(EV.confusion(p))
    b = EV.per_class(EV.confusion(p, "y_true", "y_pred_b"))
    return EV.report_delta(a, b)


def q_best_config(spark, sf_dir):
    """Best of the two predictors by macro-F1, first on ties (T7 over A17 rows)."""
    p = predictions(spark, sf_dir)
    a = EV.scalar_metrics(EV.confusion(p)).withColumn("config", F.lit(0))
    b = EV.scalar_metrics(EV.confusion(p, "y_true", "y_pred_b")).withColumn("config", F.lit(1))
    return EV.best_by(a.unionByName(b), "f1_macro", "config").select("config", "f1_macro")


def q_end_to_end_rates(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return EV.end_to_end_rates(p, benign="view")


def q_gate_rates(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumns({
        "is_benign": F.col("event_type") == "view",
        "flagged": F.col("k") % 3 == 0})
    return EV.gate_rates(p, by="source")


# ---------------------------------------------------------------- alerts
from netlens.operators import alerts as AL  # noqa: E402
from netlens.schema import WEB_CLASSES  # noqa: E402
from netlens.sources.derived import alert_json_lines, http_requests, scored_windows  # noqa: E402

DASHBOARD_NOW = "2024-01-15 12:00:00"


def parsed_events(spark, sf_dir):
    return AL.parse_events(alert_json_lines(table(spark, sf_dir, "events")))


def filtered_events(spark, sf_dir):
    return AL.filter_events(parsed_events(spark, sf_dir))


def detail(spark, sf_dir):
    return AL.to_detail(scored_windows(table(spark, sf_dir, "events")))


def all_alerts(spark, sf_dir):
    return AL.union_alerts(AL.ml_alerts(detail(spark, sf_dir)),
                           AL.events_to_alerts(parsed_events(spark, sf_dir)))


def q_read_events(spark, sf_dir):
    return parsed_events(spark, sf_dir)


def q_filter_events(spark, sf_dir):
    return filtered_events(spark, sf_dir).select("line_no", "capture", "signature", "severity")


def q_events_to_alerts(spark, sf_dir):
    return AL.events_to_alerts(parsed_events(spark, sf_dir))


def q_drop_categories(spark, sf_dir):
    ev = parsed_events(spark, sf_dir).filter(F.col("event_type") == "alert")
    return AL.drop_categories(ev).select("line_no", "signature")


def q_uri_rules(spark, sf_dir):
    return AL.match_rules(http_requests(table(spark, sf_dir, "pages")))


def q_scored_detail(spark, sf_dir):
    return detail(spark, sf_dir).select("window_id", "is_anomaly_i", "attack_type", "label")


def q_label_histogram(spark, sf_dir):
    return AL.label_histogram(detail(spark, sf_dir), by="capture")


def q_top_labels(spark, sf_dir):
    return AL.top_labels(detail(spark, sf_dir), "capture", 6)


def q_dominant_signature(spark, sf_dir):
    return AL.dominant(filtered_events(spark, sf_dir), "capture", "signature")


def _verdicts(spark, sf_dir, min_rate):
    v = AL.verdicts(detail(spark, sf_dir), filtered_events(spark, sf_dir), min_rate=min_rate)
    return v.withColumn("dpi_sigs", F.array_join("dpi_sigs", "|"))


def q_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir, None)


def q_capture_detection(spark, sf_dir):
    return _verdicts(spark, sf_dir, 0.10)


def q_detection_rollup(spark, sf_dir):
    v = AL.verdicts(detail(spark, sf_dir), filtered_events(spark, sf_dir), min_rate=0.10)
    return AL.detection_rollup(v, WEB_CLASSES)


def q_alerts_per_label(spark, sf_dir):
    return all_alerts(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def q_dashboard_kpis(spark, sf_dir):
    return AL.dashboard_kpis(all_alerts(spark, sf_dir), DASHBOARD_NOW)


def q_timeline(spark, sf_dir):
    return AL.timeline(all_alerts(spark, sf_dir), 10)


def q_recent(spark, sf_dir):
    return AL.recent(all_alerts(spark, sf_dir), 100)


def q_first_signatures(spark, sf_dir):
    s = AL.first_signatures(filtered_events(spark, sf_dir), "capture", 5)
    return s.withColumn("signatures", F.array_join("signatures", "|"))


# ---------------------------------------------------------------- packets
from netlens.functions.decode import packet_features, protocol_name  # noqa: E402
from netlens.operators import flows as FL  # noqa: E402
from netlens.operators import windows as WN  # noqa: E402
from netlens.operators.chunks import with_exact_chunk  # noqa: E402


def chunked_packets(spark, sf_dir):
    return FL.with_chunk(fixture_packets(spark, sf_dir), FIXTURE_CHUNK_BYTES)


def packet_rows(spark, sf_dir):
    return WN.packet_rows(fixture_packets(spark, sf_dir), FIXTURE_CHUNK_BYTES)


def q_chunk_ids(spark, sf_dir):
    return chunked_packets(spark, sf_dir).select("source", "packet_no", "chunk_id")


def q_exact_chunk_ids(spark, sf_dir):
    p = with_exact_chunk(fixture_packets(spark, sf_dir), FIXTURE_CHUNK_BYTES)
    return p.select("source", "packet_no", "chunk_id")


def q_window_ids(spark, sf_dir):
    return packet_rows(spark, sf_dir).select("source", "packet_no", "chunk_id", "window_id")


def q_flow_state(spark, sf_dir):
    r = packet_rows(spark, sf_dir).select(
        "source", "packet_no", "chunk_id", *FL.FLOW_KEY, "dur_us", "iat_ns", "is_fwd",
        "fwd_n", "bwd_n", "cum_bytes", "rate", "srate", "drate")
    return round_cols(r, ["rate", "srate", "drate"])


def q_capture_iat(spark, sf_dir):
    p = FL.capture_iat(chunked_packets(spark, sf_dir))
    return p.select("source", "packet_no", "capture_iat")


def q_flow_info(spark, sf_dir):
    return FL.flow_info(chunked_packets(spark, sf_dir))


def q_flow_directions(spark, sf_dir):
    return FL.flow_directions(chunked_packets(spark, sf_dir))


def q_host_counts(spark, sf_dir):
    return FL.host_counts(chunked_packets(spark, sf_dir))


def q_protocol_counts(spark, sf_dir):
    return FL.protocol_counts(chunked_packets(spark, sf_dir))


def q_privileged_connections(spark, sf_dir):
    return FL.privileged_connections(chunked_packets(spark, sf_dir))


def q_protocol_names(spark, sf_dir):
    p = fixture_packets(spark, sf_dir)
    return p.groupBy(protocol_name("proto").alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


def q_app_flags(spark, sf_dir):
    """Per-capture counts of every per-packet flag."""
    p = packet_features(fixture_packets(spark, sf_dir))
    flags = ["fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number",
             "ack_flag_number", "ece_flag_number", "cwr_flag_number", "urg_count",
             "http", "https", "dns", "telnet", "smtp", "ssh", "irc", "tcp", "udp", "dhcp",
             "arp", "icmp", "ipv", "llc", "mqtt", "coap"]
    return p.groupBy("source").agg(*[F.sum(c).alias(c) for c in flags])


def q_size_summary(spark, sf_dir):
    return WN.size_summary(packet_rows(spark, sf_dir))


def q_window_split(spark, sf_dir):
    w = WN.window_summary(packet_rows(spark, sf_dir), directional="split")
    return round_cols(w.select(*WN.WINDOW_KEY, "magnitue", "radius", "covariance", "variance",
                               "weight"), ["magnitue", "radius", "covariance", "variance"])


def q_two_stream(spark, sf_dir):
    return round_cols(WN.two_stream_stats(packet_rows(spark, sf_dir)),
                      ["mean_in", "mean_out", "pearson", "covariance", "variance_ratio"])


# ---------------------------------------------------------- feature stats
from netlens.functions.features import feature_list, select_features  # noqa: E402
from netlens.operators import prune as PR  # noqa: E402


def engineered_windows(spark, sf_dir):
    w = round_cols(fixture_windows(spark, sf_dir), UNSTABLE_RAW)
    return engineer(w, keep=["source", "chunk_id", "window_id"])


def q_port_agnostic(spark, sf_dir):
    return round_cols(select_features(engineered_windows(spark, sf_dir), "port_agnostic",
                                      keep=["source", "chunk_id", "window_id"]), UNSTABLE_ENG)


def q_near_constant(spark, sf_dir):
    return PR.near_constant(engineered_windows(spark, sf_dir), feature_list("all")) \
        .select("feature", "keep")


def q_correlated(spark, sf_dir):
    e = engineered_windows(spark, sf_dir).withColumn(
        "wkey", F.concat_ws(":", "source", "chunk_id", "window_id"))
    keep = [r["feature"] for r in PR.near_constant(e, feature_list("all"))
            .filter("keep").select("feature").collect()]          # at most 73 names
    return PR.correlated(e, keep, key="wkey")


def q_scale_stats(spark, sf_dir):
    return round_cols(PR.scale_stats(engineered_windows(spark, sf_dir), feature_list("all")),
                      ["mean", "std"])


def q_class_weights(spark, sf_dir):
    return round_cols(PR.class_weights(lev(spark, sf_dir)), ["weight"], 9)


def q_deauth_label(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("cap"), (F.col("user_id") % 4).cast("string")).alias("file"),
        (F.col("event_type") == "error").alias("is_deauth"))
    return PR.deauth_label(e, "file", "is_deauth", threshold=500)


def q_window_v1(spark, sf_dir):
    w = WN.window_summary_v1(fixture_packets(spark, sf_dir), FIXTURE_CHUNK_BYTES)
    return round_cols(w, ["iat"])


# ---------------------------------------------------------------- models
from netlens.operators import gate as GT  # noqa: E402
from netlens.operators import models as MD  # noqa: E402


def model_windows(spark, sf_dir):
    """Engineered window rows with a behaviour label and a string key ``id``."""
    e = engineered_windows(spark, sf_dir)
    label = (F.when(F.col("arp") >= 0.5, "MITM-ArpSpoofing")
              .when(F.col("protocol_type") == 17, "DDoS-UDP_Flood")
              .when(F.col("protocol_type") == 1, "DDoS-ICMP_Flood")
              .when(F.col("syn_count") >= 3, "DDoS-SYN_Flood")
              .when(F.col("avg") < 250, "BenignTraffic")
              .otherwise("DDoS-TCP_Flood"))
    return e.withColumns({"label": label,
                          "id": F.concat_ws(":", "source", "chunk_id", "window_id")})


MODEL_FEATURES = feature_list("all")


def _split(spark, sf_dir):
    from netlens.session import cut_lineage
    return cut_lineage(SA.stratified_split(model_windows(spark, sf_dir), "label", 0.8, "id"))


def q_tree_report(spark, sf_dir):
    s = _split(spark, sf_dir)
    m = MD.fit_tree(s.filter("is_train"), MODEL_FEATURES, depth=30, leaf=5)
    p = MD.predict(m, s.filter(~F.col("is_train")))
    return EV.classification_report(EV.confusion(p, "label", "y_pred"))


def q_config_search(spark, sf_dir):
    s = _split(spark, sf_dir)
    rows, _ = MD.search_tree(s.filter("is_train").drop("is_train"), MODEL_FEATURES,
                             configs=[dict(depth=30, leaf=2), dict(depth=30, leaf=5),
                                      dict(depth=30, leaf=2, balanced=True)])
    return rows


def q_forest(spark, sf_dir):
    s = _split(spark, sf_dir)
    m, seconds = MD.timed(MD.fit_forest, s.filter("is_train"), MODEL_FEATURES, trees=20, depth=12)
    return MD.evaluate(m, s.filter(~F.col("is_train"))).withColumns(
        {"model": F.lit("forest"), "fit_seconds": F.lit(seconds)})


def q_importance(spark, sf_dir):
    s = _split(spark, sf_dir)
    m = MD.fit_tree(s.filter("is_train"), MODEL_FEATURES)
    return MD.importance(m, MODEL_FEATURES, 15)


def embedding_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label",
                    (F.col("label") == 0).alias("is_benign"),
                    F.concat(F.lit("net"), (F.col("vec_id") % 2).cast("string")).alias("source"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


EMB = [f"e{i}" for i in range(64)]


def _embedding_gate(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    return rows, GT.fit_gate(rows.filter("is_benign"), EMB, "vec_id", trees=50)


def q_gate_scores(spark, sf_dir):
    rows, g = _embedding_gate(spark, sf_dir)
    return GT.score_gate(rows, g).select("vec_id", "label", "anomaly_score", "is_anomaly")


def q_gate_threshold(spark, sf_dir):
    rows, g = _embedding_gate(spark, sf_dir)
    return spark.createDataFrame([(g.threshold, len(g.nodes), int(g.nodes["tree"].nunique()))],
                                 "threshold double, nodes long, trees long")


#: a small fixed forest: (tree, node, feature, threshold, left, right, size, depth)
FIXED_FOREST = [(0, 0, 0, 0.0, 1, 2, 131, 0), (0, 1, -1, 0.0, -1, -1, 100, 1), (0, 2, 1, 0.05, 3, 4, 31, 1),
                (0, 3, -1, 0.0, -1, -1, 1, 2), (0, 4, -1, 0.0, -1, -1, 30, 2),
                (1, 0, 2, -0.02, 1, 2, 62, 0), (1, 1, -1, 0.0, -1, -1, 2, 1), (1, 2, -1, 0.0, -1, -1, 60, 1)]


def q_fixed_gate(spark, sf_dir):
    """Gate scoring (M6, M8's first step) through a fixed node table, replayed in SQL."""
    import pandas as pd
    nodes = pd.DataFrame(FIXED_FOREST, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    g = GT.Gate(EMB[:3], {c: (0.0, 1.0) for c in EMB[:3]}, nodes, 256, 0.55, log=False, trees=2)
    s = GT.score_gate(embedding_rows(spark, sf_dir), g)
    return s.select("vec_id", F.round("anomaly_score", 9).alias("anomaly_score"), "is_anomaly")


def q_label_index(spark, sf_dir):
    return MD.label_index(lev(spark, sf_dir))


def q_session_supports(spark, sf_dir):
    return MD.session_supports(lev(spark, sf_dir).select("event_id", "label", "source"), key="event_id")


def q_augmented_counts(spark, sf_dir):
    """Training rows per class after augmentation from capture cap0."""
    from netlens.session import cut_lineage
    e = lev(spark, sf_dir).select("event_id", "label", "source")
    s = cut_lineage(SA.stratified_split(e.filter(F.col("source") != "cap0"), "label", 0.8, "event_id"))
    rows = MD.augment(s.filter("is_train").drop("is_train"), e.filter(F.col("source") == "cap0"), key="event_id",
                      cap=50, reps=3, test=s.filter(~F.col("is_train")))
    return SA.class_counts(rows)


def _window_gate_model(spark, sf_dir):
    s = _split(spark, sf_dir)
    train = s.filter("is_train")
    g = GT.fit_gate(train.filter(F.col("label") == "BenignTraffic"), MODEL_FEATURES, "id")
    m = MD.fit_tree(train.filter(F.col("label") != "BenignTraffic"), MODEL_FEATURES)
    return s, g, m


def q_two_stage(spark, sf_dir):
    s, g, m = _window_gate_model(spark, sf_dir)
    return MD.score_two_stage(s.filter(~F.col("is_train")), g, m) \
        .select("id", "label", "anomaly_score", "is_anomaly", "label_pred")


def q_leave_session_out(spark, sf_dir):
    return MD.leave_session_out(model_windows(spark, sf_dir), MODEL_FEATURES)[0]


def q_gate_scenarios(spark, sf_dir):
    return MD.gate_scenarios(embedding_rows(spark, sf_dir), EMB, "vec_id", trees=200)


def q_benign_holdout(spark, sf_dir):
    return MD.benign_holdout(model_windows(spark, sf_dir), MODEL_FEATURES)


def q_augmented(spark, sf_dir):
    """Capture cap0 augments the training side; the other captures are split."""
    from netlens.session import cut_lineage
    w = cut_lineage(model_windows(spark, sf_dir))
    s = cut_lineage(SA.stratified_split(w.filter(F.col("source") != "cap0"), "label", 0.8, "id"))
    train, test = s.filter("is_train").drop("is_train"), s.filter(~F.col("is_train"))
    m = MD.fit_tree(MD.augment(train, w.filter(F.col("source") == "cap0"), cap=6000, reps=3, test=test),
                    MODEL_FEATURES)
    return MD.evaluate(m, test)


def q_end_to_end_eval(spark, sf_dir):
    s, g, m = _window_gate_model(spark, sf_dir)
    return MD.evaluate_end_to_end(s.filter(~F.col("is_train")).drop("is_train"), g, m,
                                per_class=100)


# ------------------------------------------------------------ more coverage
from netlens.functions.decode import decode_frames  # noqa: E402
from netlens.functions.labels import join_taxonomy, label_from_filename  # noqa: E402
from netlens.sources.derived import frames_from_packets  # noqa: E402


def q_frame_decode(spark, sf_dir):
    """Whole-table byte decode (P1, P2): frames built from packet columns decode back."""
    d = decode_frames(frames_from_packets(fixture_packets(spark, sf_dir)))
    return d.select("source", "packet_no", "keep", "is_arp", "proto", "ttl", "sip", "sport",
                    "dip", "dport", "tcp_flags", "frame_len")


def capture_names(spark, sf_dir):
    """Capture file names from class names: case changes, separators and digits."""
    e = lev(spark, sf_dir).select("event_id", "label", "user_id")
    v = F.col("event_id") % 4
    base = (F.when(v == 0, F.lower("label")).when(v == 1, F.upper("label"))
             .when(v == 2, F.regexp_replace("label", "-", "_")).otherwise(F.col("label")))
    name = F.concat(F.lit("caps/"), base, F.when(v == 3, F.lit("-")).otherwise(F.lit("")),
                    (F.col("user_id") % 13).cast("string"),
                    F.when(F.col("event_id") % 5 == 0, F.lit(".cap")).otherwise(F.lit(".pcap")))
    return e.select("event_id", "label", name.alias("file"))


def q_label_from_filename(spark, sf_dir):
    f = capture_names(spark, sf_dir)
    return f.select("event_id", "file", label_from_filename("file").alias("derived"))


def q_taxonomy_join(spark, sf_dir):
    return join_taxonomy(lev(spark, sf_dir)).groupBy("category", "binary") \
        .agg(F.count(F.lit(1)).alias("n"))


def q_signed_log(spark, sf_dir):
    from netlens.functions.columns import signed_log
    e = engineered_windows(spark, sf_dir)
    cols = ["rate", "iat", "header_length", "size_cv", "rate_iat_consistency"]
    return round_cols(e.select("source", "chunk_id", "window_id",
                               *[signed_log(c).alias(c) for c in cols]), cols)


def q_rank_models(spark, sf_dir):
    """Two predictors ranked by macro-F1."""
    from pyspark.sql import Window
    p = predictions(spark, sf_dir)
    a = EV.scalar_metrics(EV.confusion(p)).withColumn("model", F.lit("k_mod_5"))
    b = EV.scalar_metrics(EV.confusion(p, "y_true", "y_pred_b")).withColumn("model", F.lit("k_div_5"))
    r = a.unionByName(b).select("model", "f1_macro")
    return round_cols(r.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("f1_macro").desc(), "model"))), ["f1_macro"], 9)


def q_granularities(spark, sf_dir):
    """One tree per label granularity (M4): the 34 classes and every scheme over them."""
    s = _split(spark, sf_dir)
    out = None
    for scheme in ("class", *SCHEME_NAMES):
        t = s.withColumn("lab", F.col("label") if scheme == "class" else label_scheme("label", scheme))
        m = MD.fit_tree(t.filter("is_train"), MODEL_FEATURES, "lab")
        r = MD.evaluate(m, t.filter(~F.col("is_train")), "lab").withColumn("scheme", F.lit(scheme))
        out = r if out is None else out.unionByName(r)
    return out


def q_recalibrated_gate(spark, sf_dir):
    """Gate refit on one network's benign rows (M7) next to the original."""
    rows, g = _embedding_gate(spark, sf_dir)
    g2 = GT.recalibrate(g, rows.filter("is_benign").filter(F.col("source") == "net0"), "vec_id")
    return spark.createDataFrame([("all_networks", g.threshold), ("net0", g2.threshold)],
                                 "gate string, threshold double")


def q_sample_table(spark, sf_dir):
    # a ratio that is +inf when k % 7 = 0: the sampler stores it as NULL
    e = lev(spark, sf_dir).withColumn(
        "ratio", F.when(F.col("k") % 7 == 0, F.lit(float("inf")))
                  .otherwise(F.col("value") / (F.col("k") % 7)))
    return SA.sample_table(e, "event_id", ["value", "ratio"], threshold=FIX_THRESHOLD,
                           cap=FIX_CAP, shuffle=True).select(
        "event_id", "label_34", "label_8", "label_binary",
        F.col("value").cast("double").alias("value"), F.col("ratio").cast("double").alias("ratio"))


def q_timeline_by_label(spark, sf_dir):
    """Batch twin of the streaming dashboard timeline (ST6)."""
    from netlens.streaming.streams import timeline_by_label
    t = timeline_by_label(all_alerts(spark, sf_dir))
    return t.select(F.col("bin.start").cast("timestamp_ntz").alias("bin_start"), "label", "alerts")


FIX_MAX_PACKETS = 1500   # fixture parameter: records per capture (the reference uses 150,000)


def q_max_packets(spark, sf_dir):
    """Windows of the first records of every capture (P8): per chunk, the
    packets and windows that remain."""
    w = WN.windows_from_packets(fixture_packets(spark, sf_dir), FIXTURE_CHUNK_BYTES,
                                max_packets=FIX_MAX_PACKETS)
    return w.groupBy("source", "chunk_id").agg(
        F.sum("number").cast("long").alias("packets"), F.count(F.lit(1)).alias("windows"),
        F.sum("tot_sum").cast("long").alias("bytes"))


# ------------------------------------------------- exact quantiles, networks
QUANTILES = [0.0, 0.05, 0.5, 0.9, 0.95, 0.999, 1.0]


def q_exact_quantiles(spark, sf_dir):
    """Exact quantiles of the fixed gate's scores and of the events' values."""
    from netlens.operators.quantiles import exact_quantiles
    scores = exact_quantiles(q_fixed_gate(spark, sf_dir), "anomaly_score", QUANTILES)
    values = exact_quantiles(table(spark, sf_dir, "events"), "value", QUANTILES)
    return spark.createDataFrame(list(zip(QUANTILES, scores, values)), "q double, score double, value double") \
                .select("q", F.round("score", 9).alias("score"), F.round("value", 9).alias("value"))


HOME_NET = ["10.0.0.0/24"]
#: nested networks over the packets' addresses (name, cidr)
NETWORKS = [("all", "0.0.0.0/0"), ("site", "10.0.0.0/8"), ("home", "10.0.0.0/24"), ("servers", "10.0.1.0/24"),
            ("web", "10.0.1.4/30"), ("camera", "10.0.0.3")]
#: (sid, direction, destination network, protocol, destination port)
NETWORK_RULES = [(1, "inbound", "10.0.0.0/24", 6, None), (2, "outbound", "10.0.1.4/30", None, None),
                 (3, "any", "10.0.0.3/32", None, None), (4, "outbound", "10.0.0.0/8", 6, 23),
                 (5, "internal", "0.0.0.0/0", None, None)]


def q_network_rules(spark, sf_dir):
    from netlens.operators import networks as NW
    rules = spark.createDataFrame(NETWORK_RULES, "sid int, direction string, dst_net string, proto int, dport int")
    return NW.match_network_rules(fixture_packets(spark, sf_dir), rules, HOME_NET, ["source", "packet_no"])


def q_longest_network(spark, sf_dir):
    from netlens.operators import networks as NW
    nets = spark.createDataFrame(NETWORKS, "network string, cidr string")
    packets = fixture_packets(spark, sf_dir).select("source", "packet_no", "dip")
    return NW.longest_match(packets, "dip", nets, ["source", "packet_no"])
