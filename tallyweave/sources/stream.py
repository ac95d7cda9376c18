"""The stream: a DataFrame with an integer key, a double value and the order of arrival."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hashed


@dataclass(frozen=True)
class Stream:
    """Columns ``seq`` (BIGINT), ``key`` (BIGINT), ``value`` (DOUBLE) and grouping columns ``by``.

    A DataFrame has no order, so whatever depends on arrival reads ``seq``. Null keys and null values
    are dropped by the sketches that read them, as SQL aggregates do.
    """

    df: DataFrame
    by: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, df: DataFrame, key: str | Column, value: str | Column | None = None, seq: str | Column | None = None, by: Sequence[str] = ()) -> Stream:
        column = lambda c, kind: (F.col(c) if isinstance(c, str) else c).cast(kind) if c is not None else F.lit(None).cast(kind)
        return cls(df.select(column(seq, "long").alias("seq"), column(key, "long").alias("key"), column(value, "double").alias("value"), *by), tuple(by))

    @classmethod
    def hashed(cls, df: DataFrame, key: str, value: str | Column | None = None, seq: str | Column | None = None, by: Sequence[str] = (), seed: int = 0) -> Stream:
        """Keys of any type that ``hashed`` takes (texts, bytes, floats, integers), as their 64-bit hashes."""
        return cls.of(hashed(df, key, seed, "_key"), "_key", value, seq, by)

    def keys(self) -> DataFrame:
        return self.df.where(F.col("key").isNotNull()).select("seq", "key", *self.by)

    def values(self) -> DataFrame:
        return self.df.where(F.col("value").isNotNull()).select("seq", "value", *self.by)


def grouped(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
