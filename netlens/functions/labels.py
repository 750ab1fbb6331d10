"""Label taxonomy and label derivation.

Label schemes are literal ``map`` lookups (one codegen'd expression, no
join); the join form against the 34-row taxonomy table is there too, with a
broadcast whose size is fixed by the taxonomy.
"""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.schema import BENIGN_LABEL, CLASS_TO_CATEGORY, SCHEMES


def _map_lit(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def label_scheme(label, scheme: str, on_unknown: str = "error") -> Column:
    """Map a 34-class label through ``scheme``.

    Schemes: category, binary, category_merged, flood_merged,
    proto_flood_merged, final_merged, deploy_merged.  An unknown label raises
    (``on_unknown="error"``, like the reference) or maps to NULL (``"null"``)
    or to itself (``"self"``).
    """
    lab = F.col(label) if isinstance(label, str) else label
    if scheme == "binary":
        out = F.when(lab == BENIGN_LABEL, "Benign").when(lab.isNotNull(), "Attack")
        known = F.element_at(_map_lit(CLASS_TO_CATEGORY), lab).isNotNull()
        out = F.when(known, out)
    else:
        out = F.element_at(_map_lit(SCHEMES[scheme]), lab)
    if on_unknown == "error":
        return F.when(out.isNull() & lab.isNotNull(),
                      F.raise_error(F.concat(F.lit("unmapped label: "), lab))).otherwise(out)
    if on_unknown == "self":
        return F.coalesce(out, lab)
    return out


def with_label_columns(df: DataFrame, label: str = "label",
                       schemes=("category", "binary")) -> DataFrame:
    """Add ``label_<scheme>`` columns (sampler output adds category + binary)."""
    return df.withColumns({f"label_{s}": label_scheme(label, s) for s in schemes})


def taxonomy(spark: SparkSession) -> DataFrame:
    """The 34-row taxonomy table: label + every scheme column."""
    rows = [(lab, *[SCHEMES[s][lab] for s in SCHEME_NAMES]) for lab in CLASS_TO_CATEGORY]
    return spark.createDataFrame(rows, ["label", *SCHEME_NAMES])


SCHEME_NAMES = ["category", "binary", "category_merged", "flood_merged",
                "proto_flood_merged", "final_merged", "deploy_merged"]


def join_taxonomy(df: DataFrame, label: str = "label") -> DataFrame:
    """Dimension lookup (J1): inner join with the broadcast 34-row taxonomy."""
    tax = taxonomy(df.sparkSession).withColumnRenamed("label", label)
    return df.join(F.broadcast(tax), label, "inner")


def unknown_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels with no taxonomy entry (J15 / U3); empty when all map."""
    tax = taxonomy(df.sparkSession).select(F.col("label").alias(label))
    return df.select(label).distinct().join(F.broadcast(tax), label, "left_anti")


def assert_known(df: DataFrame, label: str = "label") -> None:
    bad = [r[0] for r in unknown_labels(df, label).limit(20).collect()]
    if bad:
        raise ValueError(f"Unmapped labels found: {bad}")


def _norm_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[-_]", "")


def label_from_filename(path) -> Column:
    """Capture file name -> class label (P20).

    Base name, lower case, ``.pcap``/``.cap`` removed, ``-``/``_`` removed,
    trailing digits stripped.  ``benign`` anywhere wins; then an exact match
    with a normalised class name; then the longest class name that contains
    the name or is contained in it.  A name of only digits gives NULL (the
    reference would match the longest class on an empty string).

    The name is normalised once (the only element of an array) and searched in
    a literal table of (normalised class name, class), longest name first.
    """
    p = F.col(path) if isinstance(path, str) else path
    n = F.lower(F.regexp_extract(p, r"([^/\\]*)$", 1))
    n = F.replace(F.replace(n, F.lit(".pcap"), F.lit("")), F.lit(".cap"), F.lit(""))
    n = F.regexp_replace(_norm_name(n), "[0-9]+$", "")
    classes = F.array(*[F.struct(_norm_name(F.lit(c)).alias("name"), F.lit(c).alias("label"))
                        for c in sorted(CLASS_TO_CATEGORY, key=lambda c: -len(c.replace("-", "").replace("_", "")))])

    def match(name: Column) -> Column:
        exact = F.filter(classes, lambda c: c["name"] == name)
        part = F.filter(classes, lambda c: name.contains(c["name"]) | c["name"].contains(name))
        return (F.when(name == "", F.lit(None).cast("string"))
                 .when(name.contains("benign"), F.lit(BENIGN_LABEL))
                 .otherwise(F.coalesce(F.get(exact, F.lit(0))["label"], F.get(part, F.lit(0))["label"])))

    return F.get(F.transform(F.array(n), match), F.lit(0))
