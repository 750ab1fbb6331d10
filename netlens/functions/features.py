"""Engineered features, cleaning and feature selection.

All 27 engineered columns are one ``select`` of Column expressions: Catalyst
keeps them in one whole-stage-codegen span and eliminates the shared
sub-expressions (flag sums, layer-7 count).  Division by ``x + EPS`` keeps
the reference's semantics; a non-finite result becomes 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.columns import finite_or_zero, log1p_pos, nonfinite_to_null, safe_div
from netlens.schema import ENG, EPS, PORT_FEATURES, RAW, snake


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def engineered_columns() -> dict[str, Column]:
    """name -> Column for the 27 engineered features over the 46 raw ones."""
    e = F.lit(EPS)
    fns = (_c("fin_flag_number") + _c("syn_flag_number") + _c("rst_flag_number")
           + _c("psh_flag_number") + _c("ack_flag_number") + _c("ece_flag_number")
           + _c("cwr_flag_number"))
    fcs = (_c("ack_count") + _c("syn_count") + _c("fin_count") + _c("urg_count")
           + _c("rst_count"))
    l7 = (_c("http") + _c("https") + _c("dns") + _c("telnet") + _c("smtp")
          + _c("ssh") + _c("irc"))
    no_l7 = (l7 < e).cast("double")
    return {
        "flag_number_sum": fns,
        "flag_count_sum": fcs,
        "syn_ack_ratio": safe_div(_c("syn_count"), _c("ack_count") + e),
        "rst_ratio": safe_div(_c("rst_count"), fcs + e),
        "fin_ratio": safe_div(_c("fin_count"), fcs + e),
        "urg_ratio": safe_div(_c("urg_count"), fcs + e),
        "syn_no_ack": _c("syn_flag_number") * (F.lit(1.0) - _c("ack_flag_number")),
        "rst_fin_combo": _c("rst_flag_number") * _c("fin_flag_number"),
        "log_rate": log1p_pos("rate"),
        "rate_dst_ratio": safe_div(_c("srate"), _c("drate") + e),
        "rate_per_byte": safe_div(_c("rate"), _c("tot_size") + e),
        "bytes_per_duration": safe_div(_c("tot_size"), _c("flow_duration") + e),
        "rate_iat_consistency": _c("rate") * _c("iat"),
        "size_range": _c("max") - _c("min"),
        "size_cv": safe_div(_c("std"), _c("avg") + e),
        "min_max_ratio": safe_div(_c("min"), _c("max") + e),
        "header_to_size": safe_div(_c("header_length"), _c("tot_size") + e),
        "avg_pkt_size": safe_div(_c("tot_sum"), _c("number") + e),
        "size_per_count": safe_div(_c("tot_size"), _c("number") + e),
        "l7_proto_count": l7,
        "transport_count": _c("tcp") + _c("udp") + _c("icmp") + _c("arp"),
        "tcp_no_l7": _c("tcp") * no_l7,
        "udp_no_l7": _c("udp") * no_l7,
        "variance_to_avg": safe_div(_c("variance"), _c("avg") + e),
        "radius_to_magnitude": safe_div(_c("radius"), _c("magnitue") + e),
        "duration_ratio": safe_div(_c("flow_duration"), _c("duration") + e),
        "log_iat": log1p_pos("iat"),
    }


def engineer(df: DataFrame, keep: list[str] | None = None, as_float: bool = False) -> DataFrame:
    """Add the 27 engineered features (P9) and clean them (P10).

    ``keep`` columns (ids, labels) are carried through; the result holds the
    46 raw + 27 engineered columns, cleaned, as double (or float32 when
    ``as_float``, matching the reference's storage type).
    """
    keep = [c for c in (keep or []) if c in df.columns]
    eng = engineered_columns()
    t = "float" if as_float else "double"
    # two projections: the raw values first, the cleaning second, so the
    # optimizer never copies a ratio expression into each of its uses
    raw = df.select(*[F.col(c) for c in keep], *[F.col(c) for c in RAW],
                    *[eng[c].alias(c) for c in ENG])
    return raw.select(*[F.col(c) for c in keep],
                      *[finite_or_zero(c).cast(t).alias(c) for c in RAW + ENG])


def clean(df: DataFrame, cols: list[str], to: str = "zero") -> DataFrame:
    """Non-finite -> 0 (``to="zero"``) or -> NULL (``to="null"``) (P10)."""
    fn = finite_or_zero if to == "zero" else nonfinite_to_null
    return df.withColumns({c: fn(c) for c in cols})


def feature_list(which: str = "all") -> list[str]:
    """73 = raw + engineered; ``port_agnostic`` = 73 minus the 11 port features."""
    full = RAW + ENG
    if which == "all":
        return full
    if which == "raw":
        return list(RAW)
    if which == "port_agnostic":
        drop = {snake(c) for c in PORT_FEATURES}
        return [c for c in full if c not in drop]
    raise ValueError(which)


def select_features(df: DataFrame, which: str | list[str] = "all",
                    keep: list[str] | None = None) -> DataFrame:
    """Project ids + a feature list (P11); drops label/source/fp style columns."""
    feats = feature_list(which) if isinstance(which, str) else list(which)
    return df.select(*[c for c in (keep or []) if c in df.columns], *feats)


def signed_log_all(df: DataFrame, cols: list[str]) -> DataFrame:
    """sign(x)*log1p(|x|) on every feature (P12, gate input)."""
    from netlens.functions.columns import signed_log
    return df.withColumns({c: signed_log(c) for c in cols})
