"""Joining row-level data back to per-key facts when one key may own a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.plans.staging import stage

# A key is hot when it owns more than 1/HOT_FRACTION of all rows, so at most HOT_FRACTION keys can be hot.
HOT_FRACTION = 1_000


def join_key_facts(
    rows: DataFrame, facts: DataFrame, key: str, rows_per_key: str, hot_fraction: int = HOT_FRACTION
) -> DataFrame:
    """Left-join ``facts`` (one row per key, with its row count) to ``rows``, spreading hot keys over salts.

    A hot key gets salts in proportion to its share, so that each holds about 1/``hot_fraction`` of the rows.

    The hot-key list is broadcast: by the pigeonhole principle it cannot exceed ``hot_fraction`` keys,
    whatever the data size. Only those keys are replicated on the fact side; all others keep salt 0. The facts
    are staged because the total, the hot list and the join all read them.
    """
    facts = stage(facts, "facts")
    total = facts.select(F.sum(rows_per_key)).scalar()
    salts = F.ceil(F.col(rows_per_key) * F.lit(hot_fraction) / F.greatest(F.lit(total), F.lit(1))).cast("int")
    hot = facts.filter(F.col(rows_per_key) * F.lit(hot_fraction) > total).select(
        F.col(key).alias("_hot_key"), salts.alias("_salts")
    )
    others = [c for c in rows.columns if c != key]
    salted_rows = (
        rows.join(F.broadcast(hot), rows[key] == F.col("_hot_key"), "left")
        .withColumn(
            "_salt",
            F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*others), F.col("_salts"))).otherwise(F.lit(0)).cast("int"),
        )
        .drop("_hot_key", "_salts")
    )
    last_salt = F.when(F.col(rows_per_key) * F.lit(hot_fraction) > total, salts - 1).otherwise(F.lit(0))
    salted_facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), last_salt))).drop(rows_per_key)
    return salted_rows.join(salted_facts, [key, "_salt"], "left").drop("_salt")
