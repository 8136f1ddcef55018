"""Rows with any further columns: an operator reads the columns it names and hands the rest through.

Columns are picked by position of their exact name, so further columns may be called anything, also
like the operator's own columns, like each other, or with dots and capitals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain, [f"c{df.columns.index(n)}" for n in names]


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast to the given types."""
    plain, found = _plain(df, list(types))
    return plain.select(*[F.col(c).cast(t).alias(n) for c, (n, t) in zip(found, types.items())])


def with_row(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast, beside ``row``: a struct of all columns as they came."""
    plain, found = _plain(df, list(types))
    return plain.select(
        F.struct("*").alias("row"), *[F.col(c).cast(t).alias(n) for c, (n, t) in zip(found, types.items())]
    )


def rows_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The original columns of a frame that ``with_row`` made."""
    return df.select(*[F.col(f"row.c{i}") for i in range(len(columns))]).toDF(*columns)


def lower_ascii(column) -> F.Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, UPPER, LOWER)
