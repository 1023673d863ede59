"""Make rows serialisable as strict JSON: no NaN or infinities, timestamps as ISO text, nesting kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    MapType,
    StructType,
    TimestampNTZType,
    TimestampType,
)


def safe_value(value: Column, kind: DataType) -> Column:
    """The JSON-safe form of a column of type ``kind``, built as one nested expression."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        exact = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.when(exact.endswith(".000000"), whole).otherwise(exact)
    if isinstance(kind, DateType):
        return value.cast("string")
    if isinstance(kind, StructType):
        fields = [safe_value(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: safe_value(item, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, item: safe_value(item, kind.valueType))
    return value


def json_safe(df: DataFrame) -> DataFrame:
    return df.select(*[safe_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def json_text(df: DataFrame, name: str = "json", pretty: bool = False) -> DataFrame:
    """One JSON document per row; nulls are written out."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return json_safe(df).select(F.to_json(F.struct("*"), options).alias(name))
