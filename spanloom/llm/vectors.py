"""Vector columns: which take part, and copies of a vector as one class."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbers(rows: DataFrame, column: str = "embedding"):
    """The column as an array of floats, or of doubles where its elements are not single-precision already."""
    single = rows.schema[column].dataType.simpleString() in ("array<float>", "void")
    return F.col(column).cast("array<float>" if single else "array<double>").alias(column)


def raw_type(rows: DataFrame, column: str = "embedding") -> str:
    """The numpy type of the column's components."""
    return "<f8" if rows.schema[column].dataType.simpleString() == "array<double>" else "<f4"


def usable(column: str = "embedding"):
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def usable_rows(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and embedding of the rows that take part; others, and rows without an id, are left out."""
    own = rows.select(F.col(id_column).cast("long").alias(id_column), numbers(rows, column))
    return own.where(F.col(id_column).isNotNull() & usable(column))


def content(column: str = "embedding"):
    """128 bits of a vector's content."""
    return F.struct(F.xxhash64(column), F.xxhash64(F.lit(1), column))


def matrix(column, width: int) -> np.ndarray:
    """Doubles, one row for each vector; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def width_of(rows: DataFrame, column: str = "embedding") -> int:
    """The length of the longest vector."""
    return rows.agg(F.max(F.size(column))).first()[0] or 1
