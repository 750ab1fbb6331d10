"""Registry: query name -> Spark builder, and name -> DuckDB oracle text."""
from __future__ import annotations

from netlens.plans import oracle_sql as O
from netlens.plans import queries as Q

QUERIES = {
    "a03_window_summary": Q.q_window_summary,
    "p09_engineered_features": Q.q_engineered,
    # labels
    "p13_label_schemes": Q.q_label_schemes,
    "j15_unknown_labels": Q.q_unknown_labels,
    "a01_class_counts": Q.q_class_counts,
    "a02_class_plan": Q.q_class_plan,
    # sampling
    "sa01_hash_sample": Q.q_hash_sample,
    "sa02_sample_n": Q.q_sample_n,
    "sa03_sample_frac": Q.q_sample_frac,
    "w09_class_quota": Q.q_class_quota,
    "w10_stratified_split": Q.q_stratified_split,
    "sa06_onsite_split": Q.q_onsite_split,
    "j04_exclude_seen": Q.q_exclude_seen,
    "sa05_realistic_sample": Q.q_realistic_sample,
    "w11_held_out_sessions": Q.q_held_out_sessions,
    "a34_sessions_per_class": Q.q_sessions_per_class,
    "u02_replicate": Q.q_replicate,
    "w08_first_per_fingerprint": Q.q_first_per_fingerprint,
    "j07_new_files": Q.q_new_files,
    # evaluation
    "a15_confusion": Q.q_confusion,
    "a16_classification_report": Q.q_classification_report,
    "a17_scalar_metrics": Q.q_scalar_metrics,
    "a17_binary_metrics": Q.q_binary_metrics,
    "a18_reweighted_metrics": Q.q_reweighted_metrics,
    "t02_weakest_classes": Q.q_weakest_classes,
    "a19_recall_by_class": Q.q_recall_by_class,
    "j09_session_gap": Q.q_session_gap,
    "a20_gap_summary": Q.q_gap_summary,
    "j08_support_vs_f1": Q.q_support_vs_f1,
    "j10_report_delta": Q.q_report_delta,
    "t07_best_config": Q.q_best_config,
    "a36_end_to_end_rates": Q.q_end_to_end_rates,
    "a35_gate_rates": Q.q_gate_rates,
    # alerts
    "s07_read_events": Q.q_read_events,
    "p21_filter_events": Q.q_filter_events,
    "p22_events_to_alerts": Q.q_events_to_alerts,
    "p26_drop_categories": Q.q_drop_categories,
    "p25_uri_rules": Q.q_uri_rules,
    "p27_scored_detail": Q.q_scored_detail,
    "a21_label_histogram": Q.q_label_histogram,
    "t05_top_labels": Q.q_top_labels,
    "a22_dominant_signature": Q.q_dominant_signature,
    "a24_verdicts": Q.q_verdicts,
    "a23_capture_detection": Q.q_capture_detection,
    "a25_detection_rollup": Q.q_detection_rollup,
    "a27_alerts_per_label": Q.q_alerts_per_label,
    "a26_dashboard_kpis": Q.q_dashboard_kpis,
    "a28_timeline": Q.q_timeline,
    "t04_recent": Q.q_recent,
    "t06_first_signatures": Q.q_first_signatures,
    # packets, flows, windows
    "w02_chunk_ids": Q.q_chunk_ids,
    "w02_exact_chunk_ids": Q.q_exact_chunk_ids,
    "w01_window_ids": Q.q_window_ids,
    "w03_flow_state": Q.q_flow_state,
    "w07_capture_iat": Q.q_capture_iat,
    "a09_flow_info": Q.q_flow_info,
    "a10_flow_directions": Q.q_flow_directions,
    "a11_host_counts": Q.q_host_counts,
    "a12_protocol_counts": Q.q_protocol_counts,
    "a13_privileged_connections": Q.q_privileged_connections,
    "p07_protocol_names": Q.q_protocol_names,
    "p03_packet_flags": Q.q_app_flags,
    "a08_size_summary": Q.q_size_summary,
    "a06_window_split": Q.q_window_split,
    "a07_two_stream": Q.q_two_stream,
    # feature statistics
    "p11_port_agnostic": Q.q_port_agnostic,
    "a29_near_constant": Q.q_near_constant,
    "a30_correlated": Q.q_correlated,
    "a31_scale_stats": Q.q_scale_stats,
    "a33_class_weights": Q.q_class_weights,
    "a37_deauth_label": Q.q_deauth_label,
    "a14_window_v1": Q.q_window_v1,
    # models (rows-only checks: fitted models have no SQL twin)
    "m01_tree_report": Q.q_tree_report,
    "m03_config_search": Q.q_config_search,
    "m05_forest": Q.q_forest,
    "a38_importance": Q.q_importance,
    "m06_gate_scores": Q.q_gate_scores,
    "a32_gate_threshold": Q.q_gate_threshold,
    "m08_two_stage": Q.q_two_stage,
    "m10_leave_session_out": Q.q_leave_session_out,
    "m11_gate_scenarios": Q.q_gate_scenarios,
    "m12_benign_holdout": Q.q_benign_holdout,
    "m13_augmented": Q.q_augmented,
    "m14_end_to_end_eval": Q.q_end_to_end_eval,
    "m04_granularities": Q.q_granularities,
    "m07_recalibrated_gate": Q.q_recalibrated_gate,
    # what can be checked of them row by row
    "m06_fixed_gate": Q.q_fixed_gate,
    "m02_label_index": Q.q_label_index,
    "m10_session_supports": Q.q_session_supports,
    "m13_augmented_counts": Q.q_augmented_counts,
    # more operators with oracles
    "p02_frame_decode": Q.q_frame_decode,
    "p20_label_from_filename": Q.q_label_from_filename,
    "j01_taxonomy_join": Q.q_taxonomy_join,
    "p12_signed_log": Q.q_signed_log,
    "t01_rank_models": Q.q_rank_models,
    "sa01_sample_table": Q.q_sample_table,
    "st06_timeline_by_label": Q.q_timeline_by_label,
    "p08_max_packets": Q.q_max_packets,
    "a32_exact_quantiles": Q.q_exact_quantiles,
    "p25_network_rules": Q.q_network_rules,
    "p25_longest_network": Q.q_longest_network,
}

# report queries compare their averaged doubles rounded to 9 places
for _name, _cols in O.ROUND9.items():
    QUERIES[_name] = (lambda f, c: (lambda spark, sf: Q.round_cols(f(spark, sf), c, 9)))(
        QUERIES[_name], _cols)

ORACLE = {
    "a03_window_summary": O.window_summary_sql(),
    "p09_engineered_features": O.engineered_sql(),
    **O.ORACLE_LABELS,
    **O.ORACLE_EVAL,
    **O.ORACLE_ALERTS,
    **O.ORACLE_PACKETS,
    **O.ORACLE_STATS,
    **O.ORACLE_MORE,
}
