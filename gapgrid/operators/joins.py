"""Union with type widening and small join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgrid.functions.ordering import union_all

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def supertype(types: list[T.DataType]) -> T.DataType:
    """Common type of one column: equal types stay, whole numbers give bigint, numbers double, the rest string."""
    kinds = {t.simpleString(): t for t in types if not isinstance(t, T.NullType)}
    if not kinds:
        return T.StringType()
    if len(kinds) == 1:
        return next(iter(kinds.values()))
    if all(isinstance(t, WHOLE) for t in kinds.values()):
        return T.LongType()
    if all(isinstance(t, WHOLE + REAL) for t in kinds.values()):
        return T.DoubleType()
    return T.StringType()


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Union by name: missing columns are null, differing types widen.

    The widened type is fixed before the union; otherwise ANSI mode types number-and-text as a number and
    fails on the first text.
    """
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema.fields:
            seen.setdefault(f.name, []).append(f.dataType)
    wide = {name: supertype(ts) for name, ts in seen.items()}
    cast = [df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in wide.items()])
            for df in frames]
    return union_all(cast)
