"""Row-level projections: null fill, label encoding, vector cleaning."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> Column:
    """Column by its literal name; dots are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A lambda body is evaluated per element, and whatever it captures with it;
    binding keeps a costly expression out of that loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def typed_fill(df: DataFrame, name: str) -> Column:
    """Numeric nulls (and NaN) become 0, booleans 0 or 1; anything else becomes text, null ''."""
    column = quoted(name)
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(column.isNull() | F.isnan(column), F.lit(0).cast(kind)).otherwise(column)
    if isinstance(kind, T.NumericType):
        return F.coalesce(column, F.lit(0).cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column.cast("int"), F.lit(0))
    return F.coalesce(column.cast("string"), F.lit(""))


def finite(column: Column) -> Column:
    """NaN, both infinities and null become 0."""
    value = column.cast("double")
    bad = value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def finite_vector(column: Column) -> Column:
    """`finite` on every entry of a vector; dense result."""
    return array_to_vector(F.transform(vector_to_array(column), finite))


def is_anomaly(column: Column, normal: str) -> Column:
    """1 unless the label equals ``normal``; a null label counts as anomaly."""
    return (~column.cast("string").eqNullSafe(F.lit(normal))).cast("byte")


def as_list(df: DataFrame, name: str) -> Column:
    """A bare string becomes a one-element array; arrays pass through."""
    column = quoted(name)
    return column if isinstance(df.schema[name].dataType, T.ArrayType) else F.array(column)


def nonzeros(df: DataFrame, features: str = "features", key: str = "row_id", keep_empty: bool = False) -> DataFrame:
    """Long form ``(key, feature_id, value)`` of a vector column, zeros left out.

    With ``keep_empty`` a row of zeros stays as one line without a feature.
    """
    vector = F.unwrap_udt(F.col(features))
    entries = F.when(
        vector["type"] == 0, F.arrays_zip(vector["indices"].alias("i"), vector["values"].alias("x"))
    ).otherwise(
        F.transform(vector["values"], lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    )
    kept = F.filter(entries, lambda e: e["x"] != 0)
    lines = F.explode_outer(kept) if keep_empty else F.explode(kept)
    return df.select(key, lines.alias("e")).select(key, F.col("e.i").alias("feature_id"), F.col("e.x").alias("value"))
