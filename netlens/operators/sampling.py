"""Class plans, hash samples, quotas and splits (A1, A2, SA1-SA6, W8-W11,
J2-J7, T8, U1-U4).

Randomness is a hash contract, not a generator: a row's draw is the first
60 bits of ``md5("<key>|<seed>")``.  It does not depend on file order or
partitioning and any engine reproduces it.

Quotas ("the n rows with the smallest draw per class") use an exact,
skew-proof selection instead of a per-class sort: a histogram of the top 16
bits of the draw per class finds, for every class, the one bucket where the
quota boundary falls; only the keys of that bucket are ranked, and the rows
are filtered where they lie.  A class with a third of all rows is never sorted
in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions.labels import label_scheme
from netlens.operators.joins import BROADCAST_MAX_BYTES, is_small, join_small
from netlens.session import cut_lineage
from netlens.schema import DOWNSAMPLE_THRESHOLD, PER_CLASS_CAP, RANDOM_SEED

HASH_BITS = 60
BUCKET_SHIFT = HASH_BITS - 16


def hash_draw(key, seed: int = RANDOM_SEED) -> Column:
    """60-bit integer draw of ``md5(key|seed)`` (first 15 hex digits)."""
    k = F.col(key) if isinstance(key, str) else key
    s = F.concat(k.cast("string"), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def hash_unit(key, seed: int = RANDOM_SEED) -> Column:
    """Uniform draw in [0, 1)."""
    return hash_draw(key, seed) / F.lit(float(1 << HASH_BITS))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class (A1); partial counts per partition merged by the shuffle."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_plan(counts: DataFrame, label: str = "label", threshold: int = DOWNSAMPLE_THRESHOLD,
               cap: int = PER_CLASS_CAP, with_category: bool = True) -> DataFrame:
    """Per-class plan (A2): total, target (cap only above the threshold),
    category, downsampled flag and keep probability min(1, target/total)."""
    down = F.col("n") > threshold
    out = counts.select(
        F.col(label), F.col("n").alias("total"),
        F.when(down, F.lit(cap)).otherwise(F.col("n")).cast("long").alias("target"),
        down.alias("downsampled"))
    if with_category:
        out = out.withColumn("category", label_scheme(label, "category"))
    return out.withColumn("keep_p", F.least(F.lit(1.0), F.col("target") / F.col("total")))


def sample_by_plan(df: DataFrame, plan: DataFrame, key: str, label: str = "label",
                   seed: int = RANDOM_SEED) -> DataFrame:
    """Bernoulli sample with the class's keep probability (SA1, J2).

    The plan holds one row per class; the equi-join is planned by AQE
    (broadcast when the measured plan is small, shuffle otherwise).
    """
    p = plan.select(label, "keep_p")
    return (join_small(df, p, label)
              .filter(hash_unit(key, seed) < F.col("keep_p"))
              .drop("keep_p"))


def rank_below(df: DataFrame, by: list[str], quota: DataFrame | int, key: str,
               seed: int = RANDOM_SEED, flag: str | None = None) -> DataFrame:
    """Rows whose rank by (draw, key) inside their ``by`` group is <= quota.

    ``quota`` is an int for every group or a DataFrame (by..., quota).
    With ``flag`` every row is returned and ``flag`` tells whether it made
    the quota (used by splits).  ``key`` is unique inside a group; null is a
    group like any other, and a null key a key (the first one).

    Exact and skew-proof without moving the table: a histogram of the draw's
    top bits gives each group the bucket in which its quota ends; the rows of
    that bucket (keys only) are ranked, which gives the (draw, key) of the
    group's last row; one filter against that group-sized table does the rest.
    """
    # one struct holds the group's columns: as a join key it matches null with null
    d = df.withColumn("_grp", F.struct(*by) if by else F.struct(F.lit(0).alias("_")))
    keyed = d.select("_grp", F.col(key).alias("_k"), _draw_or_first(key, seed).alias("_h")).withColumn(
        "_b", F.shiftrightunsigned(F.col("_h"), BUCKET_SHIFT))
    hist = keyed.groupBy("_grp", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy("_grp").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_upto", F.sum("_cnt").over(w))
    if isinstance(quota, int):
        hist = hist.withColumn("_quota", F.lit(quota).cast("long"))
    else:
        group = F.struct(*by) if by else F.struct(F.lit(0).alias("_"))
        q = quota.select(group.alias("_grp"), F.col("quota").cast("long").alias("_quota"))
        hist = hist.join(q, "_grp", "left").fillna(0, ["_quota"])
    # one row per group: the bucket that holds the quota's last row, if any
    ends = (F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_cnt") < F.col("_quota"))
    groups = cut_lineage(hist.groupBy("_grp").agg(
        F.max("_upto").alias("_rows"), F.first("_quota").alias("_quota"),
        F.max(F.when(ends, F.col("_b"))).alias("_end"),
        F.max(F.when(ends, F.col("_quota") - F.col("_upto") + F.col("_cnt"))).alias("_need")))
    if not by:                                        # one group: its limits are literals
        return _rank_below_all(df, keyed, groups.first(), key, seed, flag)
    # both joins are against rows of this table (one a group, with a draw and a key more)
    few = is_small(groups, max_bytes=BROADCAST_MAX_BYTES // 2)
    inside = join_small(keyed, groups.filter(F.col("_quota") < F.col("_rows")), "_grp",
                        measured=few).filter(F.col("_b") == F.col("_end"))
    rank = F.row_number().over(Window.partitionBy("_grp", "_b").orderBy("_h", "_k"))
    last = (inside.withColumn("_r", rank).filter(F.col("_r") == F.col("_need"))
                  .select("_grp", F.struct("_h", "_k").alias("_last")))
    # written once: callers use the result more than once (both sides of a split)
    limits = cut_lineage(groups.join(last, "_grp", "left").select(
        "_grp", "_last", (F.col("_quota") >= F.col("_rows")).alias("_all")))
    made = F.col("_all") | F.coalesce(_place(key, seed) <= F.col("_last"), F.lit(False))
    out = join_small(d, limits, "_grp", measured=few)
    out = out.filter(made) if flag is None else out.withColumn(flag, made)
    return out.drop("_last", "_all", "_grp")


def _draw_or_first(key: str, seed: int) -> Column:
    """The draw of the key; a null key comes before all others."""
    return F.coalesce(hash_draw(key, seed), F.lit(0).cast("long"))


def _place(key: str, seed: int) -> Column:
    return F.struct(_draw_or_first(key, seed).alias("_h"), F.col(key).alias("_k"))


def _rank_below_all(df: DataFrame, keyed: DataFrame, group, key: str, seed: int, flag: str | None) -> DataFrame:
    """:func:`rank_below` without groups; ``group`` is the row of the only one."""
    if group is None or group["_quota"] >= group["_rows"]:
        made = F.lit(True)
    elif group["_end"] is None:
        made = F.lit(False)
    else:
        last = (keyed.filter(F.col("_b") == group["_end"]).orderBy("_h", "_k").limit(group["_need"])
                     .agg(F.max(F.struct("_h", "_k")).alias("last")).first()["last"])
        h, none = _draw_or_first(key, seed), F.col(key).isNull()
        upto = none if last["_k"] is None else none | (F.col(key) <= F.lit(last["_k"]))
        made = (h < last["_h"]) | ((h == last["_h"]) & upto)
    return df.filter(made) if flag is None else df.withColumn(flag, made)


def sample_n(df: DataFrame, n: int, key: str, seed: int = RANDOM_SEED,
             by: list[str] | None = None) -> DataFrame:
    """Without-replacement sample of ``n`` rows (per ``by`` group) (SA2, W9)."""
    return rank_below(df, list(by or []), n, key, seed)


def sample_frac(df: DataFrame, frac: float, key: str, by: list[str],
                seed: int = RANDOM_SEED) -> DataFrame:
    """Same fraction of every group: round(frac * group count) rows (SA3)."""
    q = df.groupBy(*by).agg(F.round(F.count(F.lit(1)) * F.lit(frac)).cast("long").alias("quota"))
    return rank_below(df, by, q, key, seed)


def stratified_split(df: DataFrame, label: str, train_frac: float, key: str,
                     seed: int = RANDOM_SEED, by: list[str] | None = None,
                     col: str = "is_train") -> DataFrame:
    """Split every stratum: round(train_frac * count) rows go to train (W10, SA6)."""
    groups = [label] + list(by or [])
    q = df.groupBy(*groups).agg(
        F.round(F.count(F.lit(1)) * F.lit(train_frac)).cast("long").alias("quota"))
    return rank_below(df, groups, q, key, seed, flag=col)


def exclude_seen(df: DataFrame, seen: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``df`` whose value tuple never occurs in ``seen`` (J4), null equal to null.

    The join keys are two 64-bit hashes of the tuple, the second of which also covers
    which values are null; the values themselves are only compared where both hashes
    meet.  Repeats in ``seen`` do no harm, so it is not made distinct first.
    """
    def keys(frame: DataFrame, cast: bool) -> list[Column]:
        # values are hashed as the type they have in df; what does not fit it equals nothing there
        v = [F.col(c).try_cast(df.schema[c].dataType) if cast else F.col(c) for c in cols]
        return [F.xxhash64(*v), F.xxhash64(F.lit(1), *[x.isNull() for x in v], *v)]

    h, s = keys(df, False), keys(seen, True)
    right = seen.select(s[0].alias("_s_1"), s[1].alias("_s_2"), *[F.col(c).alias(f"_v_{c}") for c in cols])
    # a count of differing values: no join key, as each of the comparisons would be
    differ = sum((F.when(F.col(c).eqNullSafe(F.col(f"_v_{c}")), 0).otherwise(1) for c in cols), F.lit(0))
    left = df.withColumns({"_h_1": h[0], "_h_2": h[1]})
    return left.join(right, (F.col("_h_1") == F.col("_s_1")) & (F.col("_h_2") == F.col("_s_2")) & (differ == 0),
                     "left_anti").drop("_h_1", "_h_2")


def first_per_fingerprint(files: DataFrame, fp: str = "fp", order: str = "path") -> DataFrame:
    """First file per fingerprint in sorted order wins.

    ``min_by`` per fingerprint: one aggregation, partial per partition.
    """
    return (files.groupBy(fp)
                 .agg(F.min_by(F.struct(*[c for c in files.columns]), F.col(order)).alias("_r"))
                 .select("_r.*"))


def new_files(files: DataFrame, manifest: DataFrame, fp: str = "fp") -> DataFrame:
    """Files whose fingerprint is not yet in the manifest."""
    return files.join(manifest.select(fp).distinct(), fp, "left_anti")


def replicate(df: DataFrame, times: int, col: str = "rep") -> DataFrame:
    """Each row ``times`` times (U2), via explode of a literal sequence."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(1), F.lit(times))))


def held_out_sessions(df: DataFrame, label: str = "label", source: str = "source",
                      pick: str = "last") -> DataFrame:
    """One held-out session per class that has more than one.

    ``pick`` = last or first by name.
    """
    agg = F.max(source) if pick == "last" else F.min(source)
    return (df.groupBy(label).agg(agg.alias("held_out"),
                                  F.count_distinct(source).alias("sessions"))
              .filter(F.col("sessions") > 1)
              .select(label, "held_out", "sessions"))


def mark_held_out(df: DataFrame, label: str = "label", source: str = "source",
                  pick: str = "last", col: str = "is_held_out") -> DataFrame:
    """Held-out-session mask (J13): join the per-class pick back on label."""
    h = held_out_sessions(df, label, source, pick).select(label, "held_out")
    return (join_small(df, h, label, "left")
              .withColumn(col, F.coalesce(F.col(source) == F.col("held_out"), F.lit(False)))
              .drop("held_out"))


def sessions_per_class(df: DataFrame, label: str = "label", source: str = "source") -> DataFrame:
    """Sessions and rows per class."""
    return df.groupBy(label).agg(F.count_distinct(source).alias("sessions"),
                                 F.count(F.lit(1)).alias("rows"))


def realistic_sample(full: DataFrame, sample: DataFrame, held: DataFrame, counts: DataFrame,
                     key: str, feature_cols: list[str], label: str = "label",
                     test_total: int = 2_000_000, threshold: int = DOWNSAMPLE_THRESHOLD,
                     cap: int = PER_CLASS_CAP, seed: int = RANDOM_SEED) -> DataFrame:
    """Test set with the full data's class proportions (SA5).

    target_c = round(count_c / total * test_total).  Classes at or below the
    threshold take min(target, available) rows of the held-out split ``held``;
    capped classes take rows of ``full`` never seen by ``sample`` (J4, on
    the feature values), Bernoulli with p = min(1, target/max(1, count-cap))
    (SA1), then at most ``target`` of them by draw (W9).  Union (U1).
    """
    # the class table has one row per class, so its grand total is a small window
    plan = cut_lineage(counts.withColumn("_all", F.sum("n").over(Window.partitionBy()))
                       .select(label, "n", F.round(F.col("n") / F.col("_all") * test_total)
                               .cast("long").alias("quota")))
    few = is_small(plan)
    small = plan.filter(F.col("n") <= threshold)
    capped = plan.filter(F.col("n") > threshold).withColumn(
        "keep_p", F.least(F.lit(1.0), F.col("quota") / F.greatest(F.col("n") - cap, F.lit(1))))
    part_a = rank_below(join_small(held, small.select(label), label, "left_semi", measured=few), [label],
                        small.select(label, "quota"), key, seed)
    # the draw does not depend on what was seen, so it comes first and the anti join
    # meets drawn rows only (J5): about test_total of them, written once
    drawn = (join_small(full, capped.select(label, "keep_p"), label, measured=few)
             .filter(hash_unit(key, seed + 1) < F.col("keep_p")).select(*full.columns))
    unseen = cut_lineage(exclude_seen(drawn, sample, feature_cols))
    part_b = rank_below(unseen, [label], capped.select(label, "quota"), key, seed)
    return part_a.unionByName(part_b.select(*part_a.columns))


def shuffle_rows(df: DataFrame, key: str, seed: int = RANDOM_SEED) -> DataFrame:
    """Seeded shuffle before a write (T8): a global sort on the hash draw
    (range-partitioned, so no single task sorts everything)."""
    return df.orderBy(hash_draw(key, seed), F.col(key))


def sample_table(df: DataFrame, key: str, features: list[str], label: str = "label",
                 threshold: int = DOWNSAMPLE_THRESHOLD, cap: int = PER_CLASS_CAP,
                 seed: int = RANDOM_SEED, shuffle: bool = False) -> DataFrame:
    """The sampled training table (3.2 lifecycle): class plan (A1, A2) ->
    Bernoulli sample (SA1) -> non-finite to NULL -> ``label_34``,
    ``label_8``, ``label_binary`` (P28, P13, P14) -> float32 features ->
    optional seeded order (T8)."""
    from netlens.functions.columns import nonfinite_to_null
    plan = class_plan(class_counts(df, label), label, threshold, cap)
    s = sample_by_plan(df, plan, key, label, seed)
    out = s.select(F.col(key), F.col(label).alias("label_34"),
                   label_scheme(label, "category").alias("label_8"),
                   label_scheme(label, "binary").alias("label_binary"),
                   *[nonfinite_to_null(c).cast("float").alias(c) for c in features])
    return shuffle_rows(out, key, seed) if shuffle else out
