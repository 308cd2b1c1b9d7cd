"""Differences between two copies of a dataset.

Each copy is first reduced to one row per key (a map-side combined aggregate, so a key that is
repeated a billion times crosses the network once per task), its columns are normalised, and the
copies meet in one null-safe full outer join on the key.  The key travels as a struct: structs
compare NULL fields as equal, and aggregate and join then share one partitioning, so each copy is
shuffled once.  The result holds an array of (field, left value, right value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exact_type(left: DataFrame, right: DataFrame, name: str) -> T.DecimalType | None:
    """The decimal in which both copies' numbers are exact, where a double is not wide enough."""
    kinds = [d.schema[name].dataType for d in (left, right)]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not all(isinstance(k, (*whole, T.DecimalType)) for k in kinds) or not any(isinstance(k, (T.LongType, T.DecimalType)) for k in kinds):
        return None
    scale = max((k.scale for k in kinds if isinstance(k, T.DecimalType)), default=0)
    digits = max(k.precision - k.scale if isinstance(k, T.DecimalType) else 19 for k in kinds)
    return T.DecimalType(digits + scale, scale) if digits + scale <= 38 else None


def _normalized(df: DataFrame, name: str, exact: T.DecimalType | None) -> Column:
    """NaN is no value; numbers are compared as doubles, long and decimal ones exactly if both copies hold such."""
    kind = df.schema[name].dataType
    if exact is not None:
        return F.col(f"`{name}`").cast(exact)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, T.NumericType):
        return F.col(f"`{name}`").cast("double")
    return F.col(f"`{name}`").cast("string")


def _one_row_per_key(df: DataFrame, key: Sequence[str], fields: Sequence[str], side: str, exact: dict) -> DataFrame:
    row = F.struct(*[_normalized(df, f, exact[f]).alias(f) for f in fields])
    k = F.struct(*[F.col(f"`{c}`").alias(c) for c in key])
    return (
        df.select(k.alias("k"), row.alias("r"))
        .groupBy("k")
        .agg(F.min("r").alias(f"{side}_row"), F.max("r").alias("top"), F.count("*").alias(f"{side}_count"))
        .withColumn(f"{side}_conflicting", ~F.col(f"{side}_row").eqNullSafe(F.col("top")))
        .drop("top")
    )


def diff_copies(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], *, tolerance: float = 0.01) -> DataFrame:
    """Keys of ``left`` and ``right`` that are absent from one copy or differ in a field.

    Columns: the key, ``presence`` ('both', 'left_only', 'right_only'), ``differences`` (array of
    field, left_value, right_value as text), ``left_count``/``right_count`` (rows behind the key)
    and ``conflicting`` (a copy holds different rows under the key; its smallest row, NULL first,
    is the one compared).

    Defined edge cases: key parts compare exactly and NULL equals NULL; a repeated row counts
    once; NULL and NaN both mean no value; numbers differ when more than ``tolerance`` apart, or
    when just one is present; other columns are ignored; equal keys without a difference give no
    row, so two empty or equal tables give an empty result.
    """
    exact = {f: _exact_type(left, right, f) for f in fields}
    lhs, rhs = _one_row_per_key(left, key, fields, "left", exact), _one_row_per_key(right, key, fields, "right", exact)
    both = lhs.join(rhs, "k", "full_outer")
    in_left, in_right = F.col("left_count").isNotNull(), F.col("right_count").isNotNull()
    marks = []
    for f in fields:
        a, b = F.col(f"left_row.`{f}`"), F.col(f"right_row.`{f}`")
        kinds = [d.schema[r].dataType[f].dataType for d, r in ((lhs, "left_row"), (rhs, "right_row"))]
        if all(isinstance(k, (T.DoubleType, T.DecimalType)) for k in kinds):
            # equal infinities have no difference to subtract
            apart = F.when(a == b, F.lit(False)).otherwise(F.abs(a - b) > tolerance)
        else:
            apart = a.cast("string") != b.cast("string")
        differs = F.when(a.isNull() & b.isNull(), F.lit(False)).when(a.isNull() | b.isNull(), F.lit(True)).otherwise(apart)
        marks.append(F.when(in_left & in_right & differs, F.struct(F.lit(f).alias("field"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))))
    out = both.withColumn("differences", F.array_compact(F.array(*marks)))
    out = out.withColumn("presence", F.when(~in_left, "right_only").when(~in_right, "left_only").otherwise("both"))
    out = out.where((F.col("presence") != "both") | (F.size("differences") > 0))
    return out.select(
        *[F.col(f"k.`{c}`").alias(c) for c in key], "presence", "differences", F.coalesce("left_count", F.lit(0)).alias("left_count"), F.coalesce("right_count", F.lit(0)).alias("right_count"),
        (F.coalesce("left_conflicting", F.lit(False)) | F.coalesce("right_conflicting", F.lit(False))).alias("conflicting"),
    )
