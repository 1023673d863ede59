"""Nested values as rows, whatever their shape: JSON or structs become VARIANT and are taken apart level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.plans.staging import stage

# Deeper values fail instead of going round for ever on a generated text.
MOST_LEVELS = 64


def value_rows(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """One row per leaf of ``value`` (a JSON text, or a struct, array or map): keys, path, kind, text and number.

    A path reads like ``a.b[0].c``. ``kind`` is the type of the leaf; empty objects and lists are leaves too. Strings
    are in ``text``, numbers in ``number``, booleans in ``text`` as true or false; both are null for a JSON null. A text
    that is no JSON, or null, gives no row. Each level is one pass over the nested values of the level above.
    """
    kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
    parsed = F.try_parse_json(value) if kind == "string" else F.to_variant_object(value)
    level = df.select(*keys, F.lit("").alias("path"), parsed.alias("v")).filter("v is not null")
    leaves = []
    for _ in range(MOST_LEVELS):
        level = stage(level.withColumn("kind", F.schema_of_variant("v")), "levels")
        nested = F.col("kind").rlike(r"^(OBJECT|ARRAY)<.+>$") & ~F.col("kind").isin("OBJECT<>", "ARRAY<>", "ARRAY<VOID>")
        # A list of nulls has a type without content, but holds leaves.
        held = nested | (F.col("kind") == "ARRAY<VOID>") & F.try_variant_get("v", "$[0]", "variant").isNotNull()
        leaves.append(level.filter(~F.coalesce(held, F.lit(False))))
        inner = level.filter(held)
        if inner.isEmpty():
            break
        opened = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value")))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
            F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("key")))
        level = opened.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("v"))
    else:
        raise ValueError(f"values of more than {MOST_LEVELS} levels")
    found = reduce(lambda a, b: a.unionByName(b), leaves)
    is_number = F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    plain = ~F.col("kind").rlike("^(OBJECT|ARRAY)<")
    return found.select(
        *keys, "path", "kind",
        F.when(plain & ~is_number, F.try_variant_get("v", "$", "string")).alias("text"),
        F.when(is_number, F.try_variant_get("v", "$", "double")).alias("number"),
    )
