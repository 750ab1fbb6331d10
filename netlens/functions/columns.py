"""Small Column helpers shared by every operator (all JVM-side, codegen'd)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_zero(c) -> Column:
    """NaN, +-Inf and NULL -> 0.0 (the reference imputes every non-finite with 0).

    ``abs(x) < inf`` is false for NaN (the largest double in Spark's order)
    and for +-Inf, and NULL for NULL: two references to ``x`` keep the
    expression small when ``x`` is itself a large expression.
    """
    c = col(c).cast("double")
    return F.coalesce(F.when(F.abs(c) < F.lit(float("inf")), c), F.lit(0.0))


def nonfinite_to_null(c) -> Column:
    """NaN and +-Inf -> NULL (the sampler stores missing, not 0)."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)
                  .cast("double")).otherwise(c)


def safe_div(a, b) -> Column:
    """a / b with the reference's Inf/NaN -> 0 rule; never raises under ANSI."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")),
                      F.lit(0.0))


def signed_log(c) -> Column:
    """sign(x) * log1p(|x|)."""
    c = col(c).cast("double")
    return F.signum(c) * F.log1p(F.abs(c))


def log1p_pos(c) -> Column:
    """log1p(max(x, 0)), NaN-safe (greatest(NaN, 0) is NaN in Spark)."""
    c = finite_or_zero(c)
    return F.log1p(F.greatest(c, F.lit(0.0)))


def flag(cond: Column) -> Column:
    return cond.cast("int")


def round_doubles(df, places: int = 6):
    """Round every double column (used to compare across engines)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (NTZ) timestamp.

    Plain timestamp arithmetic, so the result does not depend on the
    session time zone (a cast to TIMESTAMP would apply it).
    """
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), col(ts).cast("timestamp_ntz"))


def from_epoch_micros(us) -> Column:
    """Inverse of :func:`epoch_micros`, as a TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", col(us), F.expr(EPOCH_NTZ))
