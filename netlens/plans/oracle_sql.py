"""Independent DuckDB SQL for every SQL-expressible registered query.

Written by hand as plain SQL over the driver tables (pre-registered views),
not generated from the Spark plans; shared pieces are CTE text.
"""
from __future__ import annotations

from netlens.schema import CLASSES_ALPHA, ENG, RAW, V1

FIXTURE_CHUNK_BYTES = 100_000
WINDOW = 10

# Columns whose values come from unordered floating-point sums or from
# transcendental functions: compared after rounding to 6 places.
UNSTABLE_RAW = {"rate", "srate", "drate"}
UNSTABLE_ENG = {"log_rate", "log_iat"}


def _list(vals) -> str:
    return ", ".join(f"'{v}'" for v in vals)


PACKETS_CTE = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
pk0 AS (
  SELECT 'cap' || CAST(user_id % 4 AS VARCHAR) AS source,
         event_id AS packet_no,
         epoch_us(ts) AS ts_us,
         CASE event_type WHEN 'click' THEN 6 WHEN 'purchase' THEN 6 WHEN 'view' THEN 17
                         WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS proto,
         k, user_id, event_type, value
  FROM ev
),
pk1 AS (
  SELECT *,
         CASE WHEN proto = 0 THEN 1 ELSE 0 END AS is_arp,
         CASE WHEN proto = 0 THEN 0 WHEN k % 2 = 0 THEN 64 ELSE 128 END AS ttl,
         '10.0.0.' || CAST(user_id % 16 AS VARCHAR) AS a_ip,
         '10.0.1.' || CAST(k % 8 AS VARCHAR) AS b_ip,
         CAST(CASE WHEN proto IN (6, 17) THEN 1024 + user_id % 8 ELSE 0 END AS INTEGER) AS a_port,
         CAST(CASE WHEN proto IN (6, 17) THEN
              CASE k % 8 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 23
                         WHEN 4 THEN 25 WHEN 5 THEN 22 WHEN 6 THEN 21 ELSE 9999 END
              ELSE 0 END AS INTEGER) AS b_port,
         CASE WHEN proto = 6 THEN (k * 37) % 256 ELSE 0 END AS tcp_flags,
         54 + CAST(floor(value) AS BIGINT) % 1447 AS frame_len
  FROM pk0
),
packets AS (
  SELECT source, packet_no, ts_us, is_arp, proto, ttl,
         CASE WHEN k % 3 = 0 THEN b_ip ELSE a_ip END AS sip,
         CASE WHEN k % 3 = 0 THEN b_port ELSE a_port END AS sport,
         CASE WHEN k % 3 = 0 THEN a_ip ELSE b_ip END AS dip,
         CASE WHEN k % 3 = 0 THEN a_port ELSE b_port END AS dport,
         tcp_flags, frame_len, event_type, user_id, k
  FROM pk1
),
chunked AS (
  SELECT *,
         CAST(floor(sum(frame_len) OVER (PARTITION BY source ORDER BY packet_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / {float(FIXTURE_CHUNK_BYTES)}) AS BIGINT)
           AS chunk_id
  FROM packets
)"""

PACKET_FEATURES_CTE = """
feat AS (
  SELECT *,
    CASE WHEN is_arp = 1 THEN 0 ELSE proto END AS protocol_type,
    CASE WHEN is_arp = 1 THEN 0 ELSE ttl END AS duration,
    CASE WHEN tcp = 1 AND (tcp_flags & 1) <> 0 THEN 1 ELSE 0 END AS fin_flag_number,
    CASE WHEN tcp = 1 AND (tcp_flags & 2) <> 0 THEN 1 ELSE 0 END AS syn_flag_number,
    CASE WHEN tcp = 1 AND (tcp_flags & 4) <> 0 THEN 1 ELSE 0 END AS rst_flag_number,
    CASE WHEN tcp = 1 AND (tcp_flags & 8) <> 0 THEN 1 ELSE 0 END AS psh_flag_number,
    CASE WHEN tcp = 1 AND (tcp_flags & 16) <> 0 THEN 1 ELSE 0 END AS ack_flag_number,
    CASE WHEN tcp = 1 AND (tcp_flags & 64) <> 0 THEN 1 ELSE 0 END AS ece_flag_number,
    CASE WHEN tcp = 1 AND (tcp_flags & 128) <> 0 THEN 1 ELSE 0 END AS cwr_flag_number,
    CASE WHEN tcp = 1 AND (tcp_flags & 16) <> 0 THEN 1 ELSE 0 END AS ack_count,
    CASE WHEN tcp = 1 AND (tcp_flags & 2) <> 0 THEN 1 ELSE 0 END AS syn_count,
    CASE WHEN tcp = 1 AND (tcp_flags & 1) <> 0 THEN 1 ELSE 0 END AS fin_count,
    CASE WHEN tcp = 1 AND (tcp_flags & 32) <> 0 THEN 1 ELSE 0 END AS urg_count,
    CASE WHEN tcp = 1 AND (tcp_flags & 4) <> 0 THEN 1 ELSE 0 END AS rst_count,
    CASE WHEN tcp = 1 AND (sport = 80 OR dport = 80) THEN 1 ELSE 0 END AS http,
    CASE WHEN tcp = 1 AND (sport = 443 OR dport = 443) THEN 1 ELSE 0 END AS https,
    CASE WHEN udp = 1 AND (sport = 53 OR dport = 53) THEN 1 ELSE 0 END AS dns,
    CASE WHEN tcp = 1 AND (sport = 23 OR dport = 23) THEN 1 ELSE 0 END AS telnet,
    CASE WHEN (tcp = 1 OR udp = 1) AND (sport = 25 OR dport = 25) THEN 1 ELSE 0 END AS smtp,
    CASE WHEN tcp = 1 AND (sport = 22 OR dport = 22) THEN 1 ELSE 0 END AS ssh,
    CASE WHEN tcp = 1 AND (sport = 21 OR dport = 21) THEN 1 ELSE 0 END AS irc,
    CASE WHEN udp = 1 AND ((sport = 67 AND dport = 68) OR (sport = 68 AND dport = 67))
         THEN 1 ELSE 0 END AS dhcp,
    is_arp AS arp,
    CASE WHEN is_arp = 0 AND proto = 1 THEN 1 ELSE 0 END AS icmp,
    1 - is_arp AS ipv,
    1 AS llc
  FROM (SELECT *,
               CASE WHEN is_arp = 0 AND proto = 6 THEN 1 ELSE 0 END AS tcp,
               CASE WHEN is_arp = 0 AND proto = 17 THEN 1 ELSE 0 END AS udp
        FROM chunked)
)"""

FLOW_CTE = """
keyed AS (
  SELECT *,
    CASE WHEN sip < dip OR (sip = dip AND sport <= dport) THEN sip ELSE dip END AS lo_ip,
    CASE WHEN sip < dip OR (sip = dip AND sport <= dport) THEN sport ELSE dport END AS lo_port,
    CASE WHEN sip < dip OR (sip = dip AND sport <= dport) THEN dip ELSE sip END AS hi_ip,
    CASE WHEN sip < dip OR (sip = dip AND sport <= dport) THEN dport ELSE sport END AS hi_port,
    (row_number() OVER (PARTITION BY source, chunk_id ORDER BY packet_no) - 1) // {w} AS window_id
  FROM feat
),
fs1 AS (
  SELECT *,
    ts_us - first_value(ts_us) OVER wf AS dur_us,
    coalesce((ts_us - lag(ts_us) OVER wf) * 1000, 0) AS iat_ns,
    CASE WHEN sip = first_value(sip) OVER wf AND sport = first_value(sport) OVER wf
          AND dip = first_value(dip) OVER wf AND dport = first_value(dport) OVER wf
         THEN 1 ELSE 0 END AS is_fwd,
    sum(frame_len) OVER wf AS cum_bytes
  FROM keyed
  WINDOW wf AS (PARTITION BY source, chunk_id, lo_ip, lo_port, hi_ip, hi_port ORDER BY packet_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
fs2 AS (
  SELECT *,
    sum(is_fwd) OVER wf AS fwd_n,
    sum(1 - is_fwd) OVER wf AS bwd_n
  FROM fs1
  WINDOW wf AS (PARTITION BY source, chunk_id, lo_ip, lo_port, hi_ip, hi_port ORDER BY packet_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
flowrows AS (
  SELECT *,
    dur_us / 1e6 AS flow_duration,
    CASE WHEN dur_us > 0 THEN (fwd_n + bwd_n) / (dur_us / 1e6) ELSE 0.0 END AS rate,
    CASE WHEN dur_us > 0 THEN fwd_n / (dur_us / 1e6) ELSE 0.0 END AS srate,
    CASE WHEN dur_us > 0 THEN bwd_n / (dur_us / 1e6) ELSE 0.0 END AS drate
  FROM fs2
)""".format(w=WINDOW)

_MEAN_INT = (["duration"]
             + [f"{f}_flag_number" for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")]
             + ["http", "https", "dns", "telnet", "smtp", "ssh", "irc",
                "tcp", "udp", "dhcp", "arp", "icmp", "ipv", "llc"])
_SUMS = ["ack_count", "syn_count", "fin_count", "urg_count", "rst_count"]

WINDOWS_CTE = """
pmode AS (
  SELECT source, chunk_id, window_id, protocol_type FROM (
    SELECT source, chunk_id, window_id, protocol_type,
           row_number() OVER (PARTITION BY source, chunk_id, window_id
                              ORDER BY count(*) DESC, protocol_type) AS rn
    FROM flowrows GROUP BY source, chunk_id, window_id, protocol_type) t
  WHERE rn = 1
),
wagg AS (
  SELECT source, chunk_id, window_id,
    sum(cum_bytes) / count(*) AS header_length,
    sum(dur_us) / count(*) / 1e6 AS flow_duration,
    avg(rate) AS rate, avg(srate) AS srate, avg(drate) AS drate,
    sum(iat_ns) / count(*) AS iat,
    sum(frame_len) AS tot_sum, min(frame_len) AS min, max(frame_len) AS max,
    sum(frame_len) / count(*) AS avg,
    sqrt((count(*) * sum(frame_len * frame_len) - sum(frame_len) * sum(frame_len))
         / (count(*) * count(*))) AS std,
    sum(frame_len) / count(*) AS tot_size,
    count(*) AS number,
    sqrt(2 * sum(frame_len) / count(*)) AS magnitue,
    sqrt(2 * ((count(*) * sum(frame_len * frame_len) - sum(frame_len) * sum(frame_len))
              / (count(*) * count(*)))) AS radius,
    (count(*) * sum(frame_len * frame_len) - sum(frame_len) * sum(frame_len))
         / (count(*) * count(*)) AS covariance,
    CASE WHEN max(frame_len) > min(frame_len) THEN 1.0 ELSE 0.0 END AS variance,
    count(*) * count(*) AS weight,
    """ + ",\n    ".join([f"sum({c}) / count(*) AS {c}" for c in _MEAN_INT]
                         + [f"sum({c}) AS {c}" for c in _SUMS]) + """
  FROM flowrows
  GROUP BY source, chunk_id, window_id
),
windows AS (
  SELECT w.source, w.chunk_id, w.window_id,
    """ + ",\n    ".join(f"CAST({'m.' if c == 'protocol_type' else 'w.'}{c} AS DOUBLE) AS {c}"
                         for c in RAW) + """
  FROM wagg w JOIN pmode m USING (source, chunk_id, window_id)
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _r(c: str, unstable: set) -> str:
    return f"round({c}, 6) AS {c}" if c in unstable else c


def window_summary_sql() -> str:
    return (with_ctes(PACKETS_CTE, PACKET_FEATURES_CTE, FLOW_CTE, WINDOWS_CTE)
            + "\nSELECT source, chunk_id, window_id, "
            + ", ".join(_r(c, UNSTABLE_RAW) for c in RAW) + " FROM windows")


ENGINEERED_SQL = {
    "flag_number_sum": "fin_flag_number + syn_flag_number + rst_flag_number + psh_flag_number"
                       " + ack_flag_number + ece_flag_number + cwr_flag_number",
    "flag_count_sum": "ack_count + syn_count + fin_count + urg_count + rst_count",
    "syn_ack_ratio": "syn_count / (ack_count + 1e-6)",
    "rst_ratio": "rst_count / (ack_count + syn_count + fin_count + urg_count + rst_count + 1e-6)",
    "fin_ratio": "fin_count / (ack_count + syn_count + fin_count + urg_count + rst_count + 1e-6)",
    "urg_ratio": "urg_count / (ack_count + syn_count + fin_count + urg_count + rst_count + 1e-6)",
    "syn_no_ack": "syn_flag_number * (1.0 - ack_flag_number)",
    "rst_fin_combo": "rst_flag_number * fin_flag_number",
    "log_rate": "ln(1 + greatest(rate, 0.0))",
    "rate_dst_ratio": "srate / (drate + 1e-6)",
    "rate_per_byte": "rate / (tot_size + 1e-6)",
    "bytes_per_duration": "tot_size / (flow_duration + 1e-6)",
    "rate_iat_consistency": "rate * iat",
    "size_range": "max - min",
    "size_cv": "std / (avg + 1e-6)",
    "min_max_ratio": "min / (max + 1e-6)",
    "header_to_size": "header_length / (tot_size + 1e-6)",
    "avg_pkt_size": "tot_sum / (number + 1e-6)",
    "size_per_count": "tot_size / (number + 1e-6)",
    "l7_proto_count": "http + https + dns + telnet + smtp + ssh + irc",
    "transport_count": "tcp + udp + icmp + arp",
    "tcp_no_l7": "tcp * CASE WHEN http + https + dns + telnet + smtp + ssh + irc < 1e-6"
                 " THEN 1.0 ELSE 0.0 END",
    "udp_no_l7": "udp * CASE WHEN http + https + dns + telnet + smtp + ssh + irc < 1e-6"
                 " THEN 1.0 ELSE 0.0 END",
    "variance_to_avg": "variance / (avg + 1e-6)",
    "radius_to_magnitude": "radius / (magnitue + 1e-6)",
    "duration_ratio": "flow_duration / (duration + 1e-6)",
    "log_iat": "ln(1 + greatest(iat, 0.0))",
}


def engineered_cte() -> str:
    def fin(expr):
        return (f"CASE WHEN isfinite(CAST({expr} AS DOUBLE)) THEN CAST({expr} AS DOUBLE)"
                f" ELSE 0.0 END")
    return ("\nengineered AS (\n  SELECT source, chunk_id, window_id, "
            + ", ".join(f"{fin(c)} AS {c}" for c in RAW) + ",\n    "
            + ",\n    ".join(f"{fin(ENGINEERED_SQL[c])} AS {c}" for c in ENG)
            + "\n  FROM (SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in sorted(UNSTABLE_RAW))
            + ") FROM windows) rw\n)")


def engineered_sql() -> str:
    return (with_ctes(PACKETS_CTE, PACKET_FEATURES_CTE, FLOW_CTE, WINDOWS_CTE, engineered_cte())
            + "\nSELECT source, chunk_id, window_id, "
            + ", ".join(_r(c, UNSTABLE_ENG) for c in RAW + ENG)
            + " FROM engineered")


# ------------------------------------------------------------------ labels
from netlens.schema import SCHEMES  # noqa: E402

_SCHEME_COLS = ["category", "binary", "category_merged", "flood_merged",
                "proto_flood_merged", "final_merged", "deploy_merged"]

LEV_CTE = """
lev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         'cap' || CAST(user_id % 4 AS VARCHAR) AS source,
         ([""" + _list(CLASSES_ALPHA) + """])[user_id % 34 + 1] AS label
  FROM events
)"""

TAXONOMY_CTE = ("\ntax(label, " + ", ".join(f'"{c}"' for c in _SCHEME_COLS) + ") AS (VALUES "
                + ", ".join("(" + ", ".join(f"'{v}'" for v in
                                            [lab] + [SCHEMES[s][lab] for s in _SCHEME_COLS]) + ")"
                            for lab in CLASSES_ALPHA) + ")")


def H(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 15) AS BIGINT)"


def U(key: str, seed: int = 42) -> str:
    return f"({H(key, seed)} / 1152921504606846976.0)"


FIX_THRESHOLD, FIX_CAP, FIX_TEST_TOTAL = 320, 200, 2000

PLAN_CTE = f"""
counts AS (SELECT label, count(*) AS n FROM lev GROUP BY label),
plan AS (
  SELECT c.label, n AS total,
         CAST(CASE WHEN n > {FIX_THRESHOLD} THEN {FIX_CAP} ELSE n END AS BIGINT) AS target,
         n > {FIX_THRESHOLD} AS downsampled, t.category,
         least(1.0, CASE WHEN n > {FIX_THRESHOLD} THEN {FIX_CAP} ELSE n END / n) AS keep_p
  FROM counts c JOIN tax t USING (label)
),
samp AS (
  SELECT lev.* FROM lev JOIN plan USING (label) WHERE {U('event_id')} < keep_p
)"""

ORACLE_LABELS = {
    "p13_label_schemes": with_ctes(LEV_CTE, TAXONOMY_CTE)
    + "\nSELECT event_id, label, " + ", ".join(f'"{c}"' for c in _SCHEME_COLS)
    + " FROM lev JOIN tax USING (label)",
    "j15_unknown_labels": with_ctes(LEV_CTE, TAXONOMY_CTE)
    + "\nSELECT DISTINCT label FROM (SELECT CASE WHEN user_id % 11 = 0 THEN label || '-typo' ELSE label END AS label"
    + " FROM lev) WHERE label NOT IN (SELECT label FROM tax)",
    "a01_class_counts": with_ctes(LEV_CTE) + "\nSELECT label, count(*) AS n FROM lev GROUP BY label",
    "a02_class_plan": with_ctes(LEV_CTE, TAXONOMY_CTE, PLAN_CTE) + "\nSELECT * FROM plan",
    "sa01_hash_sample": with_ctes(LEV_CTE, TAXONOMY_CTE, PLAN_CTE)
    + "\nSELECT event_id, label, source FROM samp",
    "sa02_sample_n": with_ctes(LEV_CTE)
    + f"\nSELECT event_id, label FROM lev ORDER BY {H('event_id')}, event_id LIMIT 500",
    "sa03_sample_frac": with_ctes(LEV_CTE) + f"""
SELECT event_id, label FROM (
  SELECT event_id, label,
         row_number() OVER (PARTITION BY label ORDER BY {H('event_id')}, event_id) AS rn,
         CAST(round(count(*) OVER (PARTITION BY label) * 0.25) AS BIGINT) AS quota
  FROM lev) WHERE rn <= quota""",
    "w09_class_quota": with_ctes(LEV_CTE) + f"""
SELECT event_id, label FROM (
  SELECT event_id, label,
         row_number() OVER (PARTITION BY label ORDER BY {H('event_id')}, event_id) AS rn
  FROM lev) WHERE rn <= 100""",
    "w10_stratified_split": with_ctes(LEV_CTE) + f"""
SELECT event_id, label,
       row_number() OVER (PARTITION BY label ORDER BY {H('event_id')}, event_id)
         <= CAST(round(count(*) OVER (PARTITION BY label) * 0.8) AS BIGINT) AS is_train
FROM lev""",
    "sa06_onsite_split": with_ctes(LEV_CTE) + f"""
SELECT event_id, source,
       row_number() OVER (PARTITION BY source ORDER BY {H('event_id')}, event_id)
         <= CAST(round(count(*) OVER (PARTITION BY source) * 0.8) AS BIGINT) AS is_train
FROM lev WHERE label = 'BenignTraffic'""",
    "j04_exclude_seen": with_ctes(LEV_CTE, TAXONOMY_CTE, PLAN_CTE) + """
SELECT event_id, label FROM lev
WHERE NOT EXISTS (SELECT 1 FROM samp s WHERE s.ts IS NOT DISTINCT FROM lev.ts
  AND s.user_id IS NOT DISTINCT FROM lev.user_id AND s.event_type IS NOT DISTINCT FROM lev.event_type
  AND s.value IS NOT DISTINCT FROM lev.value)""",
    "sa05_realistic_sample": with_ctes(LEV_CTE, TAXONOMY_CTE, PLAN_CTE) + f""",
held AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H('event_id')}, event_id)
                <= CAST(round(count(*) OVER (PARTITION BY label) * 0.8) AS BIGINT) AS is_train
    FROM samp) WHERE NOT is_train
),
rplan AS (
  SELECT label, n, CAST(round(n / sum(n) OVER () * {FIX_TEST_TOTAL}) AS BIGINT) AS quota FROM counts
),
part_a AS (
  SELECT event_id, label FROM (
    SELECT h.event_id, h.label, r.quota,
           row_number() OVER (PARTITION BY h.label ORDER BY {H('h.event_id')}, h.event_id) AS rn
    FROM held h JOIN rplan r ON h.label = r.label AND r.n <= {FIX_THRESHOLD}) WHERE rn <= quota
),
unseen AS (
  SELECT lev.*, least(1.0, r.quota / greatest(r.n - {FIX_CAP}, 1)) AS keep_p, r.quota
  FROM lev JOIN rplan r ON lev.label = r.label AND r.n > {FIX_THRESHOLD}
  WHERE NOT EXISTS (SELECT 1 FROM samp s WHERE s.ts IS NOT DISTINCT FROM lev.ts
    AND s.user_id IS NOT DISTINCT FROM lev.user_id AND s.event_type IS NOT DISTINCT FROM lev.event_type
    AND s.value IS NOT DISTINCT FROM lev.value)
),
part_b AS (
  SELECT event_id, label FROM (
    SELECT event_id, label, quota,
           row_number() OVER (PARTITION BY label ORDER BY {H('event_id')}, event_id) AS rn
    FROM unseen WHERE {U('event_id', 43)} < keep_p) WHERE rn <= quota
)
SELECT * FROM part_a UNION ALL SELECT * FROM part_b""",
    "w11_held_out_sessions": with_ctes(LEV_CTE) + """
SELECT event_type AS cls, max(source) AS held_out, count(DISTINCT source) AS sessions
FROM lev GROUP BY event_type HAVING count(DISTINCT source) > 1""",
    "a34_sessions_per_class": with_ctes(LEV_CTE) + """
SELECT label, count(DISTINCT source) AS sessions, count(*) AS rows FROM lev GROUP BY label""",
    "u02_replicate": "SELECT doc_id, r.rep FROM labels, (SELECT unnest([1, 2, 3]) AS rep) r",
    "w08_first_per_fingerprint": """
SELECT fp, arg_min(doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS doc_id
FROM (SELECT doc_id, substr(md5(text), 1, 16) AS fp FROM documents) GROUP BY fp""",
    "j07_new_files": f"""
WITH f AS (SELECT doc_id, substr(md5(text), 1, 16) AS fp FROM documents)
SELECT doc_id, fp FROM f
WHERE fp NOT IN (SELECT fp FROM f WHERE {U('doc_id', 7)} < 0.5)""",
}

# -------------------------------------------------------------- evaluation
PRED_CTE = """
pred AS (
  SELECT *, event_type AS y_true,
         (['click', 'error', 'purchase', 'signup', 'view'])[k % 5 + 1] AS y_pred,
         (['click', 'error', 'purchase', 'signup', 'view'])[CAST(floor(k / 5) AS INTEGER) % 5 + 1]
           AS y_pred_b
  FROM lev
)"""


def _report_ctes(src: str, t: str, p: str, name: str) -> str:
    """Per-class precision/recall/f1/support over the union of labels."""
    return f"""
{name}_conf AS (SELECT {t} AS y_true, {p} AS y_pred, count(*) AS n FROM {src} GROUP BY 1, 2),
{name}_cls AS (
  SELECT coalesce(t.class, p.class) AS class, CAST(coalesce(tp, 0) AS BIGINT) AS tp,
         CAST(coalesce(support, 0) AS BIGINT) AS support,
         CAST(coalesce(predicted, 0) AS BIGINT) AS predicted
  FROM (SELECT y_true AS class, sum(n) AS support,
               sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp
        FROM {name}_conf GROUP BY y_true) t
  FULL OUTER JOIN (SELECT y_pred AS class, sum(n) AS predicted FROM {name}_conf GROUP BY y_pred) p
  ON t.class = p.class
),
{name}_pc AS (
  SELECT CAST(class AS VARCHAR) AS class,
         CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
         CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1,
         support
  FROM {name}_cls
),
{name}_acc AS (
  SELECT sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n) AS accuracy,
         sum(n) AS total FROM {name}_conf
)"""


def _scalar_sql(name: str) -> str:
    return f"""
SELECT a.accuracy,
       avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy,
       avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted,
       avg(precision) AS precision_macro, avg(recall) AS recall_macro
FROM {name}_pc, {name}_acc a GROUP BY a.accuracy"""


SPLIT_PRED_CTE = f"""
split AS (
  SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {H('event_id')}, event_id)
              <= CAST(round(count(*) OVER (PARTITION BY y_true) * 0.8) AS BIGINT) AS is_train
  FROM pred
),
hconf AS (SELECT y_true, y_pred, count(*) AS n FROM split WHERE NOT is_train GROUP BY 1, 2),
classes AS (SELECT y_true AS class FROM hconf UNION SELECT y_pred FROM hconf),
pri AS (
  SELECT c.class, coalesce(p.cnt, 0) / sum(coalesce(p.cnt, 0)) OVER () AS pi
  FROM classes c LEFT JOIN (SELECT y_true AS class, count(*) AS cnt FROM pred GROUP BY 1) p
  ON c.class = p.class
),
r AS (
  SELECT h.y_true, h.y_pred, h.n / greatest(nk.nk, 1) AS r,
         h.n / greatest(nk.nk, 1) * pri.pi AS j
  FROM hconf h JOIN (SELECT y_true, sum(n) AS nk FROM hconf GROUP BY y_true) nk USING (y_true)
  JOIN pri ON pri.class = h.y_true
),
rpc AS (
  SELECT pri.class, pri.pi, coalesce(d.r, 0.0) AS recall, coalesce(d.j, 0.0) AS jd,
         coalesce(c.jc, 0.0) AS jc
  FROM pri LEFT JOIN (SELECT y_true AS class, r, j FROM r WHERE y_true = y_pred) d
    ON pri.class = d.class
  LEFT JOIN (SELECT y_pred AS class, sum(j) AS jc FROM r GROUP BY y_pred) c ON pri.class = c.class
),
rpc2 AS (
  SELECT *, CASE WHEN jc = 0 THEN 0.0 ELSE jd / jc END AS precision FROM rpc
),
rpc3 AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rpc2
)"""

GAP_CTE = """
ho AS (
  SELECT y_true, max(source) AS held_out FROM pred GROUP BY y_true
  HAVING count(DISTINCT source) > 1
),
marked AS (
  SELECT p.*, coalesce(p.source = ho.held_out, false) AS is_held_out
  FROM pred p LEFT JOIN ho USING (y_true)
),
within AS (SELECT y_true AS class, avg(CAST(y_true = y_pred AS DOUBLE)) AS recall
           FROM marked WHERE NOT is_held_out GROUP BY 1),
cross_ AS (SELECT y_true AS class, avg(CAST(y_true = y_pred AS DOUBLE)) AS recall
           FROM marked WHERE is_held_out GROUP BY 1),
gap AS (
  SELECT w.class, w.recall AS within, c.recall AS "cross", w.recall - c.recall AS gap
  FROM within w JOIN cross_ c USING (class)
)"""

ORACLE_EVAL = {
    "a15_confusion": with_ctes(LEV_CTE, PRED_CTE)
    + "\nSELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY 1, 2",
    "a16_classification_report": with_ctes(LEV_CTE, PRED_CTE, _report_ctes("pred", "y_true", "y_pred", "m"))
    + """
SELECT * FROM m_pc
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1),
                 CAST(sum(support) AS BIGINT) FROM m_pc
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                 sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
                 CAST(sum(support) AS BIGINT) FROM m_pc
UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, CAST(total AS BIGINT) FROM m_acc""",
    "a17_scalar_metrics": with_ctes(LEV_CTE, PRED_CTE, _report_ctes("pred", "y_true", "y_pred", "m"))
    + _scalar_sql("m"),
    "a17_binary_metrics": with_ctes(_report_ctes("labels", "quality", "toxic", "m"))
    + _scalar_sql("m"),
    "a18_reweighted_metrics": with_ctes(LEV_CTE, PRED_CTE, SPLIT_PRED_CTE) + """
SELECT sum(jd) AS accuracy, avg(f1) AS f1_macro, sum(f1 * pi) AS f1_weighted,
       avg(recall) AS recall_macro, avg(precision) AS precision_macro FROM rpc3""",
    "t02_weakest_classes": with_ctes(LEV_CTE, PRED_CTE, SPLIT_PRED_CTE) + """
SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, pi FROM rpc3
ORDER BY f1, class LIMIT 8""",
    "a19_recall_by_class": with_ctes(LEV_CTE, PRED_CTE) + """
SELECT y_true AS class, avg(CAST(y_true = y_pred AS DOUBLE)) AS recall, count(*) AS support
FROM pred GROUP BY 1""",
    "j09_session_gap": with_ctes(LEV_CTE, PRED_CTE, GAP_CTE) + "\nSELECT * FROM gap",
    "a20_gap_summary": with_ctes(LEV_CTE, PRED_CTE, GAP_CTE) + """
SELECT avg(within) AS mean_within, avg("cross") AS mean_cross, avg(gap) AS mean_gap,
       count(*) FILTER (WHERE "cross" >= 0.8) AS n_cross_good,
       count(*) FILTER (WHERE "cross" < 0.5) AS n_cross_bad, count(*) AS n_classes FROM gap""",
    "j08_support_vs_f1": with_ctes(LEV_CTE, PRED_CTE, _report_ctes("pred", "y_true", "y_pred", "m"))
    + """
SELECT coalesce(c.class, m.class) AS class, c.rows, m.f1
FROM (SELECT CAST(y_true AS VARCHAR) AS class, count(*) AS rows FROM pred GROUP BY 1) c
FULL OUTER JOIN m_pc m ON c.class = m.class""",
    "j10_report_delta": with_ctes(LEV_CTE, PRED_CTE, _report_ctes("pred", "y_true", "y_pred", "a"),
                                  _report_ctes("pred", "y_true", "y_pred_b", "b")) + """
SELECT a.class, a.f1 AS f1_a, b.f1 AS f1_b, b.f1 - a.f1 AS delta, b.f1 - a.f1 < -0.02 AS regressed
FROM a_pc a JOIN b_pc b USING (class)""",
    "t07_best_config": with_ctes(LEV_CTE, PRED_CTE, _report_ctes("pred", "y_true", "y_pred", "a"),
                                 _report_ctes("pred", "y_true", "y_pred_b", "b")) + """
SELECT config, f1_macro FROM (
  SELECT 0 AS config, avg(f1) AS f1_macro FROM a_pc
  UNION ALL SELECT 1, avg(f1) FROM b_pc) ORDER BY f1_macro DESC, config LIMIT 1""",
    "a36_end_to_end_rates": with_ctes(LEV_CTE, PRED_CTE) + """
SELECT avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy,
       avg(CASE WHEN y_true = 'view' THEN CAST(y_pred = 'view' AS DOUBLE) END) AS benign_pass,
       avg(CASE WHEN y_true <> 'view' THEN CAST(y_pred <> 'view' AS DOUBLE) END) AS attack_caught,
       avg(CASE WHEN y_true <> 'view' THEN CAST(y_true = y_pred AS DOUBLE) END) AS attack_exact
FROM pred""",
    "a35_gate_rates": with_ctes(LEV_CTE, PRED_CTE) + """
SELECT source,
       avg(CASE WHEN event_type = 'view' THEN CAST(NOT (k % 3 = 0) AS DOUBLE) END) AS benign_pass,
       avg(CASE WHEN event_type <> 'view' THEN CAST(k % 3 = 0 AS DOUBLE) END) AS attack_flagged,
       count(*) AS rows
FROM pred GROUP BY source""",
}


def rounded(sql: str, cols, places: int = 9) -> str:
    """Wrap a query so the named double columns are rounded (cross-engine compare)."""
    rep = ", ".join(f'round("{c}", {places}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) q"


ROUND9 = {
    "a16_classification_report": ["precision", "recall", "f1"],
    "a17_scalar_metrics": ["accuracy", "balanced_accuracy", "f1_macro", "f1_weighted",
                           "precision_macro", "recall_macro"],
    "a17_binary_metrics": ["accuracy", "balanced_accuracy", "f1_macro", "f1_weighted",
                           "precision_macro", "recall_macro"],
    "a18_reweighted_metrics": ["accuracy", "f1_macro", "f1_weighted", "recall_macro",
                               "precision_macro"],
    "t02_weakest_classes": ["precision", "recall", "f1", "pi"],
    "t07_best_config": ["f1_macro"],
    "j09_session_gap": ["within", "cross", "gap"],
    "a20_gap_summary": ["mean_within", "mean_cross", "mean_gap"],
    "j10_report_delta": ["f1_a", "f1_b", "delta"],
}
for _n, _c in ROUND9.items():
    ORACLE_EVAL[_n] = rounded(ORACLE_EVAL[_n], _c)


# ------------------------------------------------------------------ alerts
from netlens.operators.alerts import DEFAULT_SIGNATURE, DISABLED_PREFIXES, NOISE  # noqa: E402
from netlens.sources.derived import ATTACK_URIS, SIGNATURES  # noqa: E402

JSON_CTE = """
jl AS (
  SELECT event_id AS line_no, ts, user_id, k, label AS capture,
         CASE WHEN event_id % 7 = 0 THEN 'flow' ELSE 'alert' END AS event_type,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+0000' AS timestamp,
         '10.0.0.' || CAST(user_id % 16 AS VARCHAR) AS src_ip,
         '10.0.1.' || CAST(k % 8 AS VARCHAR) AS dest_ip,
         ([""" + _list(SIGNATURES) + """])[k % 12 + 1] AS signature,
         CAST(CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 END AS BIGINT) AS severity
  FROM lev WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
),
fe AS (
  SELECT * FROM jl
  WHERE event_type = 'alert' AND coalesce(severity, 3) <= 2
    AND NOT (""" + " OR ".join(f"contains(signature, '{n}')" for n in NOISE) + """)
),
dpi_alerts AS (
  SELECT TRY_CAST(replace(substr(timestamp, 1, 19), 'T', ' ') AS TIMESTAMP) AS ts,
         'DPI: ' || coalesce(signature, '""" + DEFAULT_SIGNATURE + """')
           || CASE WHEN severity IS NOT NULL AND severity <> 0
                   THEN ' (sev ' || CAST(severity AS VARCHAR) || ')' ELSE '' END AS label,
         coalesce(src_ip, '?') || '->' || coalesce(dest_ip, '?') AS source
  FROM jl WHERE event_type = 'alert'
)"""

DETAIL_CTE = """
sc AS (
  SELECT event_id AS window_id, ts, label AS capture, k % 3 = 0 AS is_anomaly,
         ([""" + _list(CLASSES_ALPHA) + """])[(user_id + k) % 34 + 1] AS attack_type
  FROM lev
),
det AS (
  SELECT *, CAST(is_anomaly AS INTEGER) AS is_anomaly_i,
         CASE WHEN is_anomaly THEN attack_type ELSE 'BenignTraffic' END AS label
  FROM sc
),
alerts AS (
  SELECT ts, label, capture AS source FROM det WHERE label <> 'BenignTraffic'
  UNION ALL SELECT ts, label, source FROM dpi_alerts
)"""

REQ_CTE = """
req AS (
  SELECT page_id AS request_id,
         CASE WHEN page_id % 10 = 0
              THEN url || ([""" + _list(ATTACK_URIS) + """])[CAST(floor(page_id / 10) AS BIGINT) % 4 + 1]
              ELSE url END AS uri,
         html AS body, 6 AS proto,
         CASE WHEN page_id % 7 = 0 THEN 23 WHEN starts_with(url, 'https') THEN 443 ELSE 80 END AS dport
  FROM pages
),
nreq AS (
  SELECT request_id, lower(url_decode(replace(uri, '+', ' '))) AS u, lower(body) AS b, proto, dport
  FROM req
)"""

_RULE_SQL = [
    (1000001, "LOCAL SQLi UNION SELECT in URI", "regexp_matches(u, 'union.*select', 's')"),
    (1000002, "LOCAL SQLi tautology '' OR 1=1", "contains(u, 'or 1=1')"),
    (1000003, "LOCAL XSS script tag in request", "contains(u, '<script')"),
    (1000004, "LOCAL OS Command Injection in URI",
     "regexp_matches(u, '(?i)(;|\\||`|\\$\\()\\s*(cat|wget|curl|nc|sh|bash|chmod|busybox)\\b')"),
    (1000005, "LOCAL Mirai-style wget+chmod dropper", "contains(b, 'wget') AND contains(b, 'chmod')"),
    (1000006, "LOCAL Telnet to IoT device (policy)", "proto = 6 AND dport = 23"),
    (1000007, "LOCAL Telnet default-cred attempt (root)",
     "proto = 6 AND dport = 23 AND contains(substr(b, 1, 64), 'root')"),
]

_VERDICT_BODY = """
d AS (SELECT capture, count(*) AS flows, avg(CAST(is_anomaly AS DOUBLE)) AS ml_rate
      FROM det GROUP BY capture),
mltop AS (
  SELECT capture, attack_type AS top_attack_type FROM (
    SELECT capture, attack_type,
           row_number() OVER (PARTITION BY capture ORDER BY count(*) DESC, attack_type) AS rn
    FROM det WHERE is_anomaly GROUP BY capture, attack_type) WHERE rn = 1
),
sn AS (SELECT capture, signature, count(*) AS n FROM fe GROUP BY 1, 2),
dpi AS (
  SELECT capture, sum(n) AS dpi_alerts, max(CASE WHEN rt = 1 THEN signature END) AS top_sig,
         string_agg(CASE WHEN rn <= 5 THEN signature END, '|' ORDER BY signature) AS dpi_sigs
  FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY n DESC, signature) AS rt,
               row_number() OVER (PARTITION BY capture ORDER BY signature) AS rn FROM sn)
  GROUP BY capture
),
v0 AS (
  SELECT d.capture, flows, ml_rate, {ml_hit} AS ml_hit, top_attack_type,
         CAST(coalesce(dpi_alerts, 0) AS BIGINT) AS dpi_alerts,
         coalesce(dpi_alerts, 0) > 0 AS dpi_hit, coalesce(dpi_sigs, '') AS dpi_sigs, top_sig
  FROM d LEFT JOIN mltop USING (capture) LEFT JOIN dpi USING (capture)
),
v AS (
  SELECT capture, flows, ml_rate, ml_hit AS ml_detected,
         CASE WHEN ml_rate > 0 THEN top_attack_type ELSE 'BenignTraffic' END AS ml_label,
         dpi_alerts, dpi_hit AS dpi_detected, dpi_sigs, ml_hit OR dpi_hit AS detected,
         CASE WHEN dpi_hit THEN 'DPI: ' || top_sig WHEN ml_hit THEN top_attack_type
              ELSE 'BenignTraffic' END AS final_label,
         CASE WHEN ml_hit AND dpi_hit THEN 'both' WHEN ml_hit THEN 'ML' WHEN dpi_hit THEN 'DPI'
              ELSE 'none' END AS caught_by
  FROM v0
)"""


def _verdict_sql(ml_hit: str) -> str:
    return _VERDICT_BODY.replace("{ml_hit}", ml_hit)


ORACLE_ALERTS = {
    "s07_read_events": with_ctes(LEV_CTE, JSON_CTE) + """
SELECT line_no, event_type, timestamp, src_ip, dest_ip, capture, signature, severity FROM jl""",
    "p21_filter_events": with_ctes(LEV_CTE, JSON_CTE)
    + "\nSELECT line_no, capture, signature, severity FROM fe",
    "p22_events_to_alerts": with_ctes(LEV_CTE, JSON_CTE) + "\nSELECT * FROM dpi_alerts",
    "p26_drop_categories": with_ctes(LEV_CTE, JSON_CTE) + """
SELECT line_no, signature FROM jl WHERE event_type = 'alert'
  AND NOT regexp_matches(signature, '^(""" + "|".join(DISABLED_PREFIXES) + """)')""",
    "p25_uri_rules": with_ctes(REQ_CTE) + "\n" + "\nUNION ALL\n".join(
        f"SELECT request_id, {sid} AS sid, '{msg}' AS msg FROM nreq WHERE {pred}"
        for sid, msg, pred in _RULE_SQL),
    "p27_scored_detail": with_ctes(LEV_CTE, DETAIL_CTE.split("alerts AS")[0].rstrip().rstrip(","))
    + "\nSELECT window_id, is_anomaly_i, attack_type, label FROM det",
    "a21_label_histogram": with_ctes(LEV_CTE, DETAIL_CTE.split("alerts AS")[0].rstrip().rstrip(","))
    + """
SELECT capture, label, n, n / sum(n) OVER (PARTITION BY capture) AS share,
       contains(lower(label), 'flood') AS is_flood
FROM (SELECT capture, label, count(*) AS n FROM det GROUP BY 1, 2)""",
    "t05_top_labels": with_ctes(LEV_CTE, DETAIL_CTE.split("alerts AS")[0].rstrip().rstrip(","))
    + """
SELECT * FROM (
  SELECT capture, label, n,
         CAST(row_number() OVER (PARTITION BY capture ORDER BY n DESC, label) AS INTEGER) AS rank
  FROM (SELECT capture, label, count(*) AS n FROM det GROUP BY 1, 2)) WHERE rank <= 6""",
    "a22_dominant_signature": with_ctes(LEV_CTE, JSON_CTE) + """
SELECT capture, signature AS top_signature, n AS top_signature_n FROM (
  SELECT capture, signature, n,
         row_number() OVER (PARTITION BY capture ORDER BY n DESC, signature) AS rn
  FROM (SELECT capture, signature, count(*) AS n FROM fe GROUP BY 1, 2)) WHERE rn = 1""",
    "a24_verdicts": with_ctes(LEV_CTE, JSON_CTE, DETAIL_CTE, _verdict_sql("ml_rate > 0"))
    + "\nSELECT * FROM v",
    "a23_capture_detection": with_ctes(LEV_CTE, JSON_CTE, DETAIL_CTE, _verdict_sql("ml_rate >= 0.1"))
    + "\nSELECT * FROM v",
    "a25_detection_rollup": with_ctes(LEV_CTE, JSON_CTE, DETAIL_CTE, _verdict_sql("ml_rate >= 0.1"))
    + """
SELECT count(*) FILTER (WHERE capture <> 'BenignTraffic' AND detected) AS attacks_detected,
       count(*) FILTER (WHERE capture <> 'BenignTraffic') AS attacks,
       count(*) FILTER (WHERE capture IN (""" + _list(
        ["SqlInjection", "XSS", "CommandInjection", "BrowserHijacking", "Uploading_Attack",
         "Backdoor_Malware"]) + """) AND detected) AS web_detected,
       count(*) FILTER (WHERE capture IN (""" + _list(
        ["SqlInjection", "XSS", "CommandInjection", "BrowserHijacking", "Uploading_Attack",
         "Backdoor_Malware"]) + """)) AS web,
       bool_or(CASE WHEN capture = 'BenignTraffic' THEN detected END) AS benign_false_positive
FROM v""",
    "a27_alerts_per_label": with_ctes(LEV_CTE, JSON_CTE, DETAIL_CTE)
    + "\nSELECT label, count(*) AS n FROM alerts GROUP BY label",
    "a26_dashboard_kpis": with_ctes(LEV_CTE, JSON_CTE, DETAIL_CTE) + """
SELECT count(*) AS total, count(DISTINCT label) AS labels,
       count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 MINUTE)
         AS last_minute,
       max(ts) AS last_alert
FROM alerts""",
    "a28_timeline": with_ctes(LEV_CTE, JSON_CTE, DETAIL_CTE) + """,
cnt AS (
  SELECT CAST(floor(epoch_us(ts) / 10000000) AS BIGINT) AS bin, count(*) AS alerts
  FROM alerts WHERE ts IS NOT NULL GROUP BY 1
),
bins AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM cnt)
SELECT b.bin, make_timestamp(b.bin * 10000000) AS bin_start, coalesce(c.alerts, 0) AS alerts
FROM bins b LEFT JOIN cnt c USING (bin)""",
    "t04_recent": with_ctes(LEV_CTE, JSON_CTE, DETAIL_CTE) + """
SELECT ts, label, source FROM alerts ORDER BY ts DESC NULLS LAST, label, source LIMIT 100""",
    "t06_first_signatures": with_ctes(LEV_CTE, JSON_CTE) + """
SELECT capture, string_agg(signature, '|' ORDER BY signature) AS signatures FROM (
  SELECT capture, signature, row_number() OVER (PARTITION BY capture ORDER BY signature) AS r
  FROM (SELECT DISTINCT capture, signature FROM fe)) WHERE r <= 5 GROUP BY capture""",
}


# ----------------------------------------------------------------- packets
_FLOWROWS = with_ctes(PACKETS_CTE, PACKET_FEATURES_CTE, FLOW_CTE)

SPLIT_CTE = """
sides AS (
  SELECT source, chunk_id, window_id, count(*) AS n,
         count(*) FILTER (WHERE is_fwd = 0) AS n_in, count(*) FILTER (WHERE is_fwd = 1) AS n_out
  FROM flowrows GROUP BY 1, 2, 3
),
pos AS (
  SELECT f.source, f.chunk_id, f.window_id, CAST(f.frame_len AS DOUBLE) AS x, f.is_fwd,
         s.n_in, s.n_out,
         row_number() OVER (PARTITION BY f.source, f.chunk_id, f.window_id ORDER BY packet_no) AS p_all,
         row_number() OVER (PARTITION BY f.source, f.chunk_id, f.window_id, f.is_fwd
                            ORDER BY packet_no) AS p_side
  FROM flowrows f JOIN sides s USING (source, chunk_id, window_id)
),
ins AS (
  SELECT source, chunk_id, window_id, x, CASE WHEN n_in > 0 THEN p_side ELSE p_all END AS p
  FROM pos WHERE n_in = 0 OR is_fwd = 0
),
outs AS (
  SELECT source, chunk_id, window_id, x, CASE WHEN n_out > 0 THEN p_side ELSE p_all END AS p
  FROM pos WHERE n_out = 0 OR is_fwd = 1
),
mi AS (SELECT source, chunk_id, window_id, avg(x) AS m, var_pop(x) AS v, count(*) AS c
       FROM ins GROUP BY 1, 2, 3),
mo AS (SELECT source, chunk_id, window_id, avg(x) AS m, var_pop(x) AS v, count(*) AS c
       FROM outs GROUP BY 1, 2, 3),
cv AS (
  SELECT i.source, i.chunk_id, i.window_id, avg((i.x - a.m) * (o.x - b.m)) AS cov
  FROM ins i JOIN outs o USING (source, chunk_id, window_id, p)
  JOIN mi a ON a.source = i.source AND a.chunk_id = i.chunk_id AND a.window_id = i.window_id
  JOIN mo b ON b.source = i.source AND b.chunk_id = i.chunk_id AND b.window_id = i.window_id
  GROUP BY 1, 2, 3
)"""

ORACLE_PACKETS = {
    "w02_chunk_ids": with_ctes(PACKETS_CTE) + "\nSELECT source, packet_no, chunk_id FROM chunked",
    "w02_exact_chunk_ids": f"""
WITH RECURSIVE {PACKETS_CTE.strip().rstrip(",")},
running AS (
  SELECT source, packet_no,
         CAST(sum(frame_len) OVER (PARTITION BY source ORDER BY packet_no) AS BIGINT) AS run
  FROM packets
),
opens AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS run,
         CAST({FIXTURE_CHUNK_BYTES} AS BIGINT) AS need
  FROM running
  UNION ALL
  SELECT o.source, o.chunk_id + 1, r.run, r.run + {FIXTURE_CHUNK_BYTES}
  FROM opens o ASOF JOIN running r ON o.source = r.source AND o.need <= r.run
)
SELECT r.source, r.packet_no, o.chunk_id
FROM running r ASOF JOIN opens o ON r.source = o.source AND r.run >= o.run""",
    "w01_window_ids": _FLOWROWS + "\nSELECT source, packet_no, chunk_id, window_id FROM flowrows",
    "w03_flow_state": _FLOWROWS + """
SELECT source, packet_no, chunk_id, lo_ip, lo_port, hi_ip, hi_port, dur_us, iat_ns, is_fwd,
       CAST(fwd_n AS BIGINT) AS fwd_n, CAST(bwd_n AS BIGINT) AS bwd_n,
       CAST(cum_bytes AS BIGINT) AS cum_bytes,
       round(rate, 6) AS rate, round(srate, 6) AS srate, round(drate, 6) AS drate
FROM flowrows""",
    "w07_capture_iat": with_ctes(PACKETS_CTE) + """
SELECT source, packet_no,
       coalesce(ts_us - lag(ts_us) OVER (PARTITION BY source ORDER BY packet_no), 0) / 1e6
         AS capture_iat
FROM chunked""",
    "a09_flow_info": _FLOWROWS + """
SELECT source, chunk_id, lo_ip, lo_port, hi_ip, hi_port, count(*) AS packets,
       CAST(sum(frame_len) AS BIGINT) AS bytes, (max(ts_us) - min(ts_us)) / 1e6 AS duration,
       min(ts_us / 1e6) AS min_ts, max(ts_us / 1e6) AS max_ts, sum(ts_us) / 1e6 AS sum_ts,
       sum(ts_us) / count(*) / 1e6 AS mean_ts, sqrt(CAST(count(*) * sum(CAST(dur_us AS HUGEINT) * dur_us) - sum(CAST(dur_us AS HUGEINT)) * sum(dur_us) AS DOUBLE)
            / CAST(count(*) * count(*) AS DOUBLE)) / 1e6 AS std_ts,
       arg_max(gap, packet_no) / 1e6 AS idle, (max(ts_us) - min(ts_us)) / 1e6 AS active
FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY source, chunk_id, lo_ip, lo_port, hi_ip,
                                          hi_port ORDER BY packet_no) AS gap FROM flowrows)
GROUP BY 1, 2, 3, 4, 5, 6""",
    "a10_flow_directions": _FLOWROWS + """
SELECT source, chunk_id, lo_ip, lo_port, hi_ip, hi_port,
       CAST(sum(is_fwd) AS BIGINT) AS fwd_packets, CAST(sum(1 - is_fwd) AS BIGINT) AS bwd_packets,
       CAST(sum(CASE WHEN is_fwd = 1 THEN frame_len ELSE 0 END) AS BIGINT) AS fwd_bytes,
       CAST(sum(CASE WHEN is_fwd = 0 THEN frame_len ELSE 0 END) AS BIGINT) AS bwd_bytes
FROM flowrows GROUP BY 1, 2, 3, 4, 5, 6""",
    "a11_host_counts": with_ctes(PACKETS_CTE) + """
SELECT source, 'src_ip' AS key_kind, sip AS key, count(*) AS packets FROM chunked GROUP BY 1, 3
UNION ALL SELECT source, 'dst_ip', dip, count(*) FROM chunked GROUP BY 1, 3
UNION ALL SELECT source, 'dst_port', CAST(dport AS VARCHAR), count(*) FROM chunked GROUP BY 1, 3""",
    "a12_protocol_counts": with_ctes(PACKETS_CTE) + """
SELECT source, proto, 'src_ip' AS key_kind, sip AS key, count(*) AS packets FROM chunked GROUP BY 1, 2, 4
UNION ALL SELECT source, proto, 'dst_ip', dip, count(*) FROM chunked GROUP BY 1, 2, 4
UNION ALL SELECT source, proto, 'src_port', CAST(sport AS VARCHAR), count(*) FROM chunked GROUP BY 1, 2, 4
UNION ALL SELECT source, proto, 'dst_port', CAST(dport AS VARCHAR), count(*) FROM chunked GROUP BY 1, 2, 4""",
    "a13_privileged_connections": with_ctes(PACKETS_CTE) + """
SELECT source, 'src' AS side, sip AS ip, count(*) AS packets FROM chunked
WHERE dport BETWEEN 1 AND 1023 GROUP BY 1, 3
UNION ALL SELECT source, 'dst', dip, count(*) FROM chunked WHERE dport BETWEEN 1 AND 1023 GROUP BY 1, 3""",
    "p07_protocol_names": with_ctes(PACKETS_CTE) + """
SELECT CASE proto WHEN 0 THEN 'IP' WHEN 1 THEN 'ICMP' WHEN 2 THEN 'IGMP' WHEN 6 THEN 'TCP'
                  WHEN 17 THEN 'UDP' ELSE 'Unknown for now' END AS protocol, count(*) AS n
FROM packets GROUP BY 1""",
    "p03_packet_flags": with_ctes(PACKETS_CTE, PACKET_FEATURES_CTE) + """
SELECT source, """ + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}" for c in
        ["fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number",
         "ack_flag_number", "ece_flag_number", "cwr_flag_number", "urg_count",
         "http", "https", "dns", "telnet", "smtp", "ssh", "irc", "tcp", "udp", "dhcp",
         "arp", "icmp", "ipv", "llc"]) + """,
       CAST(sum(CASE WHEN (tcp = 1 OR udp = 1) AND (sport = 1883 OR dport = 1883) THEN 1 ELSE 0 END) AS BIGINT) AS mqtt,
       CAST(sum(CASE WHEN (tcp = 1 OR udp = 1) AND (sport = 5683 OR dport = 5683) THEN 1 ELSE 0 END) AS BIGINT) AS coap
FROM feat GROUP BY source""",
    "a08_size_summary": _FLOWROWS + """
SELECT source, chunk_id, window_id, CAST(sum(frame_len) AS BIGINT) AS tot_sum, min(frame_len) AS min,
       max(frame_len) AS max, sum(frame_len) / count(*) AS avg,
       sqrt((count(*) * sum(frame_len * frame_len) - sum(frame_len) * sum(frame_len))
            / (count(*) * count(*))) AS std, count(*) AS number
FROM flowrows GROUP BY 1, 2, 3""",
    "a06_window_split": with_ctes(PACKETS_CTE, PACKET_FEATURES_CTE, FLOW_CTE, SPLIT_CTE) + """
SELECT a.source, a.chunk_id, a.window_id,
       round(sqrt(a.m + b.m), 6) AS magnitue, round(sqrt(a.v + b.v), 6) AS radius,
       round(c.cov, 6) AS covariance,
       round(CASE WHEN b.v <> 0 THEN a.v / b.v ELSE 0.0 END, 6) AS variance,
       CAST(a.c * b.c AS DOUBLE) AS weight
FROM mi a JOIN mo b USING (source, chunk_id, window_id)
JOIN cv c USING (source, chunk_id, window_id)""",
    "a07_two_stream": _FLOWROWS + """,
r AS (
  SELECT source, chunk_id, window_id, is_fwd, frame_len AS x,
         row_number() OVER (PARTITION BY source, chunk_id, window_id, is_fwd ORDER BY packet_no) AS p
  FROM flowrows
),
side AS (
  SELECT source, chunk_id, window_id, CAST(sum(1 - is_fwd) AS BIGINT) AS n_in,
         CAST(sum(is_fwd) AS BIGINT) AS n_out,
         sum(CASE WHEN is_fwd = 0 THEN x END) AS si, sum(CASE WHEN is_fwd = 1 THEN x END) AS so,
         sum(CASE WHEN is_fwd = 0 THEN x * x END) AS ssi, sum(CASE WHEN is_fwd = 1 THEN x * x END) AS sso
  FROM r GROUP BY 1, 2, 3
),
pairs AS (
  SELECT i.source, i.chunk_id, i.window_id, sum(i.x) AS sxi, sum(i.x * i.x) AS sxxi,
         sum(o.x) AS sxo, sum(o.x * o.x) AS sxxo, sum(i.x * o.x) AS sxy, count(*) AS np
  FROM r i JOIN r o ON i.source = o.source AND i.chunk_id = o.chunk_id
       AND i.window_id = o.window_id AND i.p = o.p AND i.is_fwd = 0 AND o.is_fwd = 1
  GROUP BY 1, 2, 3
)
SELECT s.source, s.chunk_id, s.window_id, n_in, n_out,
       round(CASE WHEN n_in = 0 THEN NULL ELSE si / n_in END, 6) AS mean_in,
       round(CASE WHEN n_out = 0 THEN NULL ELSE so / n_out END, 6) AS mean_out,
       round(CASE WHEN (np * sxxi - sxi * sxi) * (np * sxxo - sxo * sxo) = 0 THEN NULL
                  ELSE (np * sxy - sxi * sxo) / sqrt((np * sxxi - sxi * sxi) * (np * sxxo - sxo * sxo))
             END, 6) AS pearson,
       round(CASE WHEN n_in = 0 THEN NULL ELSE (sxy - sxi * sxo / np) / n_in END, 6) AS covariance,
       round(CASE WHEN (n_out * sso - so * so) * n_in * n_in = 0 THEN NULL
                  ELSE ((n_in * ssi - si * si) * n_out * n_out)
                       / ((n_out * sso - so * so) * n_in * n_in) END, 6) AS variance_ratio,
       n_in * n_out AS weight
FROM side s LEFT JOIN pairs p USING (source, chunk_id, window_id)""",
}


# ---------------------------------------------------------- feature stats
from netlens.schema import PORT_FEATURES, snake  # noqa: E402

_ALL = RAW + ENG
_PA = [c for c in _ALL if c not in {snake(x) for x in PORT_FEATURES}]
_ENG_BASE = with_ctes(PACKETS_CTE, PACKET_FEATURES_CTE, FLOW_CTE, WINDOWS_CTE, engineered_cte())


def _corr_sql() -> str:
    keep = {c: f"(coalesce(var_samp({c}), 0) > 1e-9)" for c in _ALL}
    drop = {}
    for j, cj in enumerate(_ALL):
        terms = [f"({keep[ci]} AND coalesce(abs(corr({ci}, {cj})) > 0.995, false))"
                 for ci in _ALL[:j]]
        drop[cj] = "(" + " OR ".join(terms) + ")" if terms else "false"
    agg = ", ".join(f"{keep[c]} AS k_{c}, {drop[c]} AS d_{c}" for c in _ALL)
    return (_ENG_BASE + f",\nagg AS (SELECT {agg} FROM engineered)\n"
            + "SELECT feature, dropped FROM (SELECT unnest([" + _list(_ALL) + "]) AS feature, "
            + "unnest([" + ", ".join(f"k_{c}" for c in _ALL) + "]) AS keep, "
            + "unnest([" + ", ".join(f"d_{c}" for c in _ALL) + "]) AS dropped FROM agg) WHERE keep")


def _v1_sql() -> str:
    mean_cols = ([f"{f}_flag_number" for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")]
                 + ["http", "https", "dns", "telnet", "smtp", "ssh", "irc",
                    "tcp", "udp", "dhcp", "arp", "icmp", "ipv"])
    sums = ["ack_count", "syn_count", "fin_count", "rst_count"]
    exprs = {
        "header_length": "sum(CASE WHEN is_arp = 0 AND proto = 6 THEN 20 WHEN is_arp = 0 AND proto = 17 THEN 8 ELSE 0 END) / count(*)",
        "protocol_type": "m.protocol_type",
        "time_to_live": "sum(duration) / count(*)",
        "rate": "CASE WHEN max(ts_us) = min(ts_us) THEN NULL ELSE count(*) / ((max(ts_us) - min(ts_us)) / 1e6) END",
        "igmp": "sum(CASE WHEN is_arp = 0 AND proto = 2 THEN 1 ELSE 0 END) / count(*)",
        "llc": "sum(1 - is_arp) / count(*)",
        "tot_sum": "sum(frame_len)", "min": "min(frame_len)", "max": "max(frame_len)",
        "avg": "sum(frame_len) / count(*)",
        "std": "CASE WHEN count(*) < 2 THEN NULL ELSE sqrt((count(*) * sum(frame_len * frame_len) - sum(frame_len) * sum(frame_len)) / (count(*) * (count(*) - 1))) END",
        "tot_size": "sum(frame_len) / count(*)",
        "iat": "round(avg(capture_iat), 6)",
        "number": "count(*)",
        "variance": "CASE WHEN count(*) < 2 THEN NULL ELSE (count(*) * sum(frame_len * frame_len) - sum(frame_len) * sum(frame_len)) / (count(*) * (count(*) - 1)) END",
    }
    exprs.update({c: f"sum({c}) / count(*)" for c in mean_cols})
    exprs.update({c: f"sum({c})" for c in sums})
    return (with_ctes(PACKETS_CTE, PACKET_FEATURES_CTE) + """,
v1rows AS (
  SELECT *,
    (row_number() OVER (PARTITION BY source, chunk_id ORDER BY packet_no) - 1) // 10 AS window_id,
    coalesce(ts_us - lag(ts_us) OVER (PARTITION BY source ORDER BY packet_no), 0) / 1e6 AS capture_iat
  FROM feat
),
v1mode AS (
  SELECT source, chunk_id, window_id, protocol_type FROM (
    SELECT source, chunk_id, window_id, protocol_type,
           row_number() OVER (PARTITION BY source, chunk_id, window_id
                              ORDER BY count(*) DESC, protocol_type) AS rn
    FROM v1rows GROUP BY source, chunk_id, window_id, protocol_type) WHERE rn = 1
)
SELECT r.source, r.chunk_id, r.window_id, """
            + ", ".join(f"CAST({exprs[c]} AS DOUBLE) AS {c}" for c in V1)
            + """
FROM v1rows r JOIN v1mode m USING (source, chunk_id, window_id)
GROUP BY r.source, r.chunk_id, r.window_id, m.protocol_type""")


def _slog(c: str) -> str:
    return f"(sign({c}) * ln(1 + abs({c})))"


ORACLE_STATS = {
    "p11_port_agnostic": _ENG_BASE + "\nSELECT source, chunk_id, window_id, "
    + ", ".join(_r(c, UNSTABLE_ENG) for c in _PA) + " FROM engineered",
    "a29_near_constant": _ENG_BASE + ",\nagg AS (SELECT "
    + ", ".join(f"coalesce(var_samp({c}), 0) > 1e-9 AS k_{c}" for c in _ALL)
    + " FROM engineered)\nSELECT unnest([" + _list(_ALL) + "]) AS feature, unnest(["
    + ", ".join(f"k_{c}" for c in _ALL) + "]) AS keep FROM agg",
    "a30_correlated": _corr_sql(),
    "a31_scale_stats": _ENG_BASE + ",\nagg AS (SELECT "
    + ", ".join(f"avg({_slog(c)}) AS m_{c}, stddev_pop({_slog(c)}) AS s_{c}" for c in _ALL)
    + " FROM engineered)\nSELECT feature, round(mean, 6) AS mean, "
    + "round(CASE WHEN std < 1e-12 THEN 1.0 ELSE std END, 6) AS std FROM (SELECT unnest(["
    + _list(_ALL) + "]) AS feature, unnest([" + ", ".join(f"m_{c}" for c in _ALL)
    + "]) AS mean, unnest([" + ", ".join(f"s_{c}" for c in _ALL) + "]) AS std FROM agg)",
    "a33_class_weights": with_ctes(LEV_CTE) + """
SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 9) AS weight
FROM (SELECT label, count(*) AS n_c FROM lev GROUP BY label)""",
    "a37_deauth_label": """
SELECT 'cap' || CAST(user_id % 4 AS VARCHAR) AS file, count(*) AS frames,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS deauth,
       CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= 500 THEN 'attack'
            ELSE 'benign' END AS label
FROM events GROUP BY 1""",
    "a14_window_v1": _v1_sql(),
}


# ------------------------------------------------------------ more coverage
def _filename_sql() -> str:
    norm = {c: c.lower().replace("-", "").replace("_", "") for c in CLASSES_ALPHA}
    cands = "cand(cls, cn, len) AS (VALUES " + ", ".join(
        f"('{c}', '{n}', {len(n)})" for c, n in norm.items()) + ")"
    order_pos = "(VALUES " + ", ".join(
        f"('{c}', {i})" for i, c in enumerate(__import__('netlens.schema', fromlist=['x'])
                                              .CLASS_TO_CATEGORY)) + ") AS o(cls, pos)"
    return with_ctes(LEV_CTE, "\n" + cands) + f""",
names AS (
  SELECT event_id, label,
         'caps/' || CASE event_id % 4 WHEN 0 THEN lower(label) WHEN 1 THEN upper(label)
                                      WHEN 2 THEN replace(label, '-', '_') ELSE label END
           || CASE WHEN event_id % 4 = 3 THEN '-' ELSE '' END
           || CAST(user_id % 13 AS VARCHAR)
           || CASE WHEN event_id % 5 = 0 THEN '.cap' ELSE '.pcap' END AS file
  FROM lev
),
n AS (
  SELECT event_id, file,
         regexp_replace(regexp_replace(replace(replace(lower(regexp_extract(file, '([^/\\\\]*)$', 1)),
                        '.pcap', ''), '.cap', ''), '[-_]', '', 'g'), '[0-9]+$', '') AS nm
  FROM names
),
hits AS (
  SELECT n.event_id, c.cls, c.len, o.pos,
         (n.nm = c.cn) AS exact
  FROM n JOIN cand c ON n.nm <> '' AND (contains(n.nm, c.cn) OR contains(c.cn, n.nm))
  JOIN {order_pos} USING (cls)
),
best AS (
  SELECT event_id, arg_min(cls, (CASE WHEN exact THEN 0 ELSE 1 END, -len, pos)) AS derived
  FROM hits GROUP BY event_id
)
SELECT n.event_id, n.file,
       CASE WHEN n.nm = '' THEN NULL WHEN contains(n.nm, 'benign') THEN 'BenignTraffic'
            ELSE b.derived END AS derived
FROM n LEFT JOIN best b USING (event_id)"""


ORACLE_MORE = {
    "p02_frame_decode": with_ctes(PACKETS_CTE) + """
SELECT source, packet_no, 1 AS keep, is_arp, proto, ttl,
       CASE WHEN is_arp = 1 THEN 'arp:02:00:00:00:00:01' ELSE sip END AS sip,
       CASE WHEN is_arp = 1 THEN 0 ELSE sport END AS sport,
       CASE WHEN is_arp = 1 THEN 'arp:02:00:00:00:00:02' ELSE dip END AS dip,
       CASE WHEN is_arp = 1 THEN 0 ELSE dport END AS dport,
       tcp_flags, frame_len
FROM packets""",
    "p20_label_from_filename": _filename_sql(),
    "j01_taxonomy_join": with_ctes(LEV_CTE, TAXONOMY_CTE) + """
SELECT category, "binary", count(*) AS n FROM lev JOIN tax USING (label) GROUP BY 1, 2""",
    "p12_signed_log": _ENG_BASE + "\nSELECT source, chunk_id, window_id, " + ", ".join(
        f"round({_slog(c)}, 6) AS {c}" for c in
        ["rate", "iat", "header_length", "size_cv", "rate_iat_consistency"]) + " FROM engineered",
    "t01_rank_models": with_ctes(LEV_CTE, PRED_CTE, _report_ctes("pred", "y_true", "y_pred", "a"),
                                 _report_ctes("pred", "y_true", "y_pred_b", "b")) + """
SELECT model, round(f1_macro, 9) AS f1_macro,
       CAST(row_number() OVER (ORDER BY f1_macro DESC, model) AS INTEGER) AS rank FROM (
  SELECT 'k_mod_5' AS model, avg(f1) AS f1_macro FROM a_pc
  UNION ALL SELECT 'k_div_5', avg(f1) FROM b_pc)""",
}

ORACLE_MORE["sa01_sample_table"] = with_ctes(LEV_CTE, TAXONOMY_CTE, PLAN_CTE) + """
SELECT event_id, label AS label_34, category AS label_8, "binary" AS label_binary,
       CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
       CASE WHEN k % 7 = 0 THEN NULL
            ELSE CAST(CAST(value / (k % 7) AS FLOAT) AS DOUBLE) END AS ratio
FROM samp JOIN tax USING (label)"""

ORACLE_MORE["st06_timeline_by_label"] = with_ctes(LEV_CTE, JSON_CTE, DETAIL_CTE) + """
SELECT time_bucket(INTERVAL '10 seconds', ts) AS bin_start, label, count(*) AS alerts
FROM alerts WHERE ts IS NOT NULL GROUP BY 1, 2"""

ORACLE_MORE["p08_max_packets"] = with_ctes(PACKETS_CTE) + """,
firstn AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY packet_no) AS record_no FROM chunked)
  WHERE record_no <= 1500
)
SELECT source, chunk_id, CAST(count(*) AS BIGINT) AS packets,
       CAST(ceil(count(*) / 10) AS BIGINT) AS windows, CAST(sum(frame_len) AS BIGINT) AS bytes
FROM firstn GROUP BY source, chunk_id"""


def _c(n: int) -> str:
    """Average search path over n points, as the isolation forest defines it."""
    import math
    return repr(0.0 if n <= 1 else 1.0 if n == 2 else
                2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n)


ORACLE_MORE["m06_fixed_gate"] = f"""
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, embedding[3]::DOUBLE AS e2 FROM embeddings),
p AS (SELECT vec_id,
             CASE WHEN e0 < 0.0 THEN 1 + {_c(100)} WHEN e1 < 0.05 THEN 2 + {_c(1)} ELSE 2 + {_c(30)} END AS p0,
             CASE WHEN e2 < -0.02 THEN 1 + {_c(2)} ELSE 1 + {_c(60)} END AS p1 FROM e),
s AS (SELECT vec_id, power(2.0, -((p0 + p1) / 2) / {_c(256)}) AS score FROM p)
SELECT vec_id, round(score, 9) AS anomaly_score, score > 0.55 AS is_anomaly FROM s"""
ORACLE_MORE["m02_label_index"] = with_ctes(LEV_CTE) + """
SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS index FROM (SELECT DISTINCT label FROM lev)"""
ORACLE_MORE["m10_session_supports"] = with_ctes(LEV_CTE) + """
SELECT label, count(*) - CAST(round(count(*) * 0.8) AS BIGINT) AS within_rows,
       count(*) FILTER (WHERE sessions > 1 AND source = last) AS held_out_rows
FROM lev JOIN (SELECT label, max(source) AS last, count(DISTINCT source) AS sessions FROM lev GROUP BY label) USING (label)
GROUP BY label"""
ORACLE_MORE["m13_augmented_counts"] = with_ctes(LEV_CTE) + """
SELECT label, CAST(round(count(*) FILTER (WHERE source <> 'cap0') * 0.8) AS BIGINT)
              + 3 * least(50, count(*) FILTER (WHERE source = 'cap0')) AS n
FROM lev GROUP BY label"""
ORACLE_MORE["a32_exact_quantiles"] = f"""
WITH s AS ({ORACLE_MORE["m06_fixed_gate"]}),
q AS (SELECT unnest([0.0, 0.05, 0.5, 0.9, 0.95, 0.999, 1.0])::DOUBLE AS q, unnest(range(1, 8)) AS i),
a AS (SELECT quantile_cont(anomaly_score, [0.0, 0.05, 0.5, 0.9, 0.95, 0.999, 1.0]) AS x FROM s),
b AS (SELECT quantile_cont(value::DOUBLE, [0.0, 0.05, 0.5, 0.9, 0.95, 0.999, 1.0]) AS x FROM events)
SELECT q, round(a.x[i], 9) AS score, round(b.x[i], 9) AS value FROM q, a, b"""
#: addresses written out: 10.0.0.0 is 167772160, 10.0.1.0 is 167772416
_ADDRESS_CTE = """
addressed AS (SELECT *, list_reduce(list_prepend(0::BIGINT, string_split(sip, '.')::BIGINT[]), lambda a, x: a * 256 + x) AS s,
                     list_reduce(list_prepend(0::BIGINT, string_split(dip, '.')::BIGINT[]), lambda a, x: a * 256 + x) AS d
              FROM packets)"""
ORACLE_MORE["p25_network_rules"] = with_ctes(PACKETS_CTE, _ADDRESS_CTE, """
homed AS (SELECT *, CASE WHEN s BETWEEN 167772160 AND 167772415 AND d BETWEEN 167772160 AND 167772415 THEN 'internal'
                         WHEN s BETWEEN 167772160 AND 167772415 THEN 'outbound'
                         WHEN d BETWEEN 167772160 AND 167772415 THEN 'inbound' ELSE 'external' END AS direction FROM addressed)""") + """
SELECT source, packet_no, 1 AS sid, direction FROM homed WHERE direction = 'inbound' AND proto = 6
UNION ALL SELECT source, packet_no, 2, direction FROM homed WHERE direction = 'outbound' AND d BETWEEN 167772420 AND 167772423
UNION ALL SELECT source, packet_no, 3, direction FROM homed WHERE d = 167772163
UNION ALL SELECT source, packet_no, 4, direction FROM homed WHERE direction = 'outbound' AND proto = 6 AND dport = 23
UNION ALL SELECT source, packet_no, 5, direction FROM homed WHERE direction = 'internal'"""
ORACLE_MORE["p25_longest_network"] = with_ctes(PACKETS_CTE, _ADDRESS_CTE) + """
SELECT source, packet_no, dip, CASE WHEN d = 167772163 THEN 'camera' WHEN d BETWEEN 167772420 AND 167772423 THEN 'web'
                                    WHEN d BETWEEN 167772160 AND 167772415 THEN 'home' WHEN d BETWEEN 167772416 AND 167772671 THEN 'servers'
                                    WHEN d BETWEEN 167772160 AND 184549375 THEN 'site' ELSE 'all' END AS network
FROM addressed"""
