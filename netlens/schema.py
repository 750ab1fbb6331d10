"""Fixed names, label taxonomy and constants.

Everything in the FIXED VALUES blocks must equal the published feature
schema and label taxonomy for results to line up; it is stated plainly, in
its natural order, and not derived.
"""
from __future__ import annotations

import re

# --------------------------------------------------------------------------
# FIXED VALUES: the 46 window features, public names, in published order.
# --------------------------------------------------------------------------
RAW_FEATURES = [
    "flow_duration", "Header_Length", "Protocol Type", "Duration", "Rate",
    "Srate", "Drate", "fin_flag_number", "syn_flag_number", "rst_flag_number",
    "psh_flag_number", "ack_flag_number", "ece_flag_number", "cwr_flag_number",
    "ack_count", "syn_count", "fin_count", "urg_count", "rst_count", "HTTP",
    "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP", "ARP",
    "ICMP", "IPv", "LLC", "Tot sum", "Min", "Max", "AVG", "Std", "Tot size",
    "IAT", "Number", "Magnitue", "Radius", "Covariance", "Variance", "Weight",
]

# FIXED VALUES: the 27 engineered features, in published order.
ENGINEERED_FEATURES = [
    "flag_number_sum", "flag_count_sum", "syn_ack_ratio", "rst_ratio",
    "fin_ratio", "urg_ratio", "syn_no_ack", "rst_fin_combo",
    "log_rate", "rate_dst_ratio", "rate_per_byte", "bytes_per_duration",
    "rate_iat_consistency",
    "size_range", "size_cv", "min_max_ratio", "header_to_size",
    "avg_pkt_size", "size_per_count",
    "l7_proto_count", "transport_count", "tcp_no_l7", "udp_no_l7",
    "variance_to_avg", "radius_to_magnitude", "duration_ratio", "log_iat",
]

# FIXED VALUES: the older 39-column window dialect, public names, in order.
V1_FEATURES = [
    "Header_Length", "Protocol Type", "Time_To_Live", "Rate",
    "fin_flag_number", "syn_flag_number", "rst_flag_number",
    "psh_flag_number", "ack_flag_number", "ece_flag_number", "cwr_flag_number",
    "ack_count", "syn_count", "fin_count", "rst_count",
    "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP",
    "DHCP", "ARP", "ICMP", "IGMP", "IPv", "LLC",
    "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number",
    "Variance",
]

# FIXED VALUES: application-port flags that tie a model to port numbers.
PORT_FEATURES = ["HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "DHCP",
                 "l7_proto_count", "tcp_no_l7", "udp_no_l7"]

EPS = 1e-6                       # FIXED VALUE: denominator guard
WINDOW_PACKETS = 10              # FIXED VALUE: packets per window row
CHUNK_BYTES = 10 * 1024 * 1024   # FIXED VALUE: capture chunk size
IAT_SCALE = 1e9                  # FIXED VALUE: seconds -> nanoseconds
DOWNSAMPLE_THRESHOLD = 1_000_000  # FIXED VALUE: classes above this are capped
PER_CLASS_CAP = 100_000          # FIXED VALUE: cap for those classes
RANDOM_SEED = 42                 # FIXED VALUE
NEAR_CONST_THRESH = 1e-9         # FIXED VALUE: var_samp floor
CORR_THRESH = 0.995              # FIXED VALUE: |pearson| ceiling
BENIGN_LABEL = "BenignTraffic"


def snake(name: str) -> str:
    """Public feature name -> internal column name (``Tot size`` -> ``tot_size``)."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


RAW = [snake(c) for c in RAW_FEATURES]
ENG = list(ENGINEERED_FEATURES)
V1 = [snake(c) for c in V1_FEATURES]
PUBLIC_NAME = {snake(c): c for c in RAW_FEATURES + V1_FEATURES}

# --------------------------------------------------------------------------
# FIXED VALUES: 34 classes -> 8 categories, in published order.
# --------------------------------------------------------------------------
CLASS_TO_CATEGORY = {
    "DDoS-RSTFINFlood": "DDoS", "DDoS-PSHACK_Flood": "DDoS",
    "DDoS-SYN_Flood": "DDoS", "DDoS-UDP_Flood": "DDoS",
    "DDoS-TCP_Flood": "DDoS", "DDoS-ICMP_Flood": "DDoS",
    "DDoS-SynonymousIP_Flood": "DDoS", "DDoS-ACK_Fragmentation": "DDoS",
    "DDoS-UDP_Fragmentation": "DDoS", "DDoS-ICMP_Fragmentation": "DDoS",
    "DDoS-SlowLoris": "DDoS", "DDoS-HTTP_Flood": "DDoS",
    "DoS-UDP_Flood": "DoS", "DoS-TCP_Flood": "DoS",
    "DoS-SYN_Flood": "DoS", "DoS-HTTP_Flood": "DoS",
    "Mirai-greeth_flood": "Mirai", "Mirai-greip_flood": "Mirai",
    "Mirai-udpplain": "Mirai",
    "Recon-PingSweep": "Recon", "Recon-OSScan": "Recon",
    "Recon-PortScan": "Recon", "Recon-HostDiscovery": "Recon",
    "VulnerabilityScan": "Recon",
    "MITM-ArpSpoofing": "Spoofing", "DNS_Spoofing": "Spoofing",
    "BrowserHijacking": "Web", "Backdoor_Malware": "Web", "XSS": "Web",
    "Uploading_Attack": "Web", "SqlInjection": "Web", "CommandInjection": "Web",
    "DictionaryBruteForce": "BruteForce",
    "BenignTraffic": "Benign",
}

CATEGORIES = ["Benign", "DDoS", "DoS", "Mirai", "Recon", "Spoofing", "Web",
              "BruteForce"]

# FIXED VALUES: protocol-wise flood merge (DoS-X + DDoS-X -> X_Flood).
PROTO_FLOOD_MERGE = {
    "DoS-UDP_Flood": "UDP_Flood", "DDoS-UDP_Flood": "UDP_Flood",
    "DoS-SYN_Flood": "SYN_Flood", "DDoS-SYN_Flood": "SYN_Flood",
    "DoS-TCP_Flood": "TCP_Flood", "DDoS-TCP_Flood": "TCP_Flood",
    "DoS-HTTP_Flood": "HTTP_Flood", "DDoS-HTTP_Flood": "HTTP_Flood",
    "DDoS-SynonymousIP_Flood": "SYN_Flood",
}

# FIXED VALUES: reconnaissance scan merge.
RECON_SCAN_MERGE = {
    "Recon-PingSweep": "Recon-Scanning",
    "Recon-PortScan": "Recon-Scanning",
    "Recon-OSScan": "Recon-Scanning",
}

# FIXED VALUES: fragmentation merge.
FRAG_MERGE = {
    "DDoS-ACK_Fragmentation": "DDoS-Fragmentation",
    "DDoS-UDP_Fragmentation": "DDoS-Fragmentation",
    "DDoS-ICMP_Fragmentation": "DDoS-Fragmentation",
}

# FIXED VALUES: web-attack classes used by the detection roll-up.
WEB_CLASSES = ["SqlInjection", "XSS", "CommandInjection", "BrowserHijacking",
               "Uploading_Attack", "Backdoor_Malware"]

CLASSES_ALPHA = sorted(CLASS_TO_CATEGORY)   # alphabetical class index order


def merge_schemes() -> dict[str, dict[str, str]]:
    """Every label scheme as a plain dict label -> target label.

    The schemes are compositions of the fixed maps above: category, binary,
    category with DoS+DDoS as Flood, label with DoS+DDoS as Flood,
    protocol-wise flood merge, + recon-scan merge, + fragmentation merge.
    """
    out: dict[str, dict[str, str]] = {k: {} for k in
                                      ("category", "binary", "category_merged",
                                       "flood_merged", "proto_flood_merged",
                                       "final_merged", "deploy_merged")}
    for lab, cat in CLASS_TO_CATEGORY.items():
        flood = cat in ("DDoS", "DoS")
        proto = PROTO_FLOOD_MERGE.get(lab, lab)
        final = RECON_SCAN_MERGE.get(lab, proto)
        out["category"][lab] = cat
        out["binary"][lab] = "Benign" if lab == BENIGN_LABEL else "Attack"
        out["category_merged"][lab] = "Flood" if flood else cat
        out["flood_merged"][lab] = "Flood" if flood else lab
        out["proto_flood_merged"][lab] = proto
        out["final_merged"][lab] = final
        out["deploy_merged"][lab] = FRAG_MERGE.get(final, final)
    return out


SCHEMES = merge_schemes()
