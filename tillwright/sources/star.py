"""Star schema built from clean transactions: two dimensions, two facts, bulk write and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.functions.scalar import money
from tillwright.operators.kpi import period_metrics
from tillwright.plans.first_value import first_values


def customers_dim(tx: DataFrame) -> DataFrame:
    """Known customers with their first purchase time and the country of their earliest line that names one."""
    since = tx.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.min("invoice_ts").alias("first_purchase_date"))
    countries = first_values(tx, "customer_id", "country", "invoice_ts", ["invoice", "stock_code"])
    return since.join(countries, "customer_id", "left")


def products_dim(tx: DataFrame) -> DataFrame:
    """One row per stock code with the description of its earliest line ('' where that line has none)."""
    filled = tx.withColumn("description", F.coalesce("description", F.lit("")))
    return first_values(filled, "stock_code", "description", "invoice_ts", ["invoice"])


def transactions_fact(tx: DataFrame) -> DataFrame:
    """The twelve fact columns, renamed, with missing text and quantities filled."""
    return tx.select(
        F.col("invoice").cast("string").alias("invoice"),
        F.col("stock_code").cast("string").alias("stock_code"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("quantity", F.lit(0)).cast("bigint").alias("quantity"),
        F.col("invoice_ts").alias("invoice_date"),
        "price",
        F.col("customer_id").try_cast("bigint").alias("customer_id"),
        F.coalesce("country", F.lit("Unspecified")).alias("country"),
        "is_cancelled",
        "is_return",
        "is_zero_price",
        "revenue",
    )


def daily_fact(tx: DataFrame) -> DataFrame:
    """Daily measures for the warehouse; units count sale lines only (returns are left out)."""
    return period_metrics(tx, "day", units="sold").withColumnRenamed("date", "metric_date")


def star_tables(tx: DataFrame) -> dict[str, DataFrame]:
    return {
        "customers": customers_dim(tx),
        "products": products_dim(tx),
        "transactions": transactions_fact(tx),
        "daily_metrics": daily_fact(tx),
    }


def write_star(
    tables: dict[str, DataFrame],
    path: str | None = None,
    jdbc_url: str | None = None,
    jdbc_properties: dict[str, str] | None = None,
    mode: str = "overwrite",
    jdbc_partitions: int = 16,
    jdbc_batch_rows: int = 10_000,
) -> None:
    """Bulk-load the tables, to parquet folders below ``path`` or to a database by JDBC.

    Connection options come only from the caller. JDBC writers are limited to ``jdbc_partitions``
    parallel connections so that a large cluster cannot overrun the database.
    """
    if (path is None) == (jdbc_url is None):
        raise ValueError("Give exactly one of path and jdbc_url")
    for name, table in tables.items():
        if path is not None:
            table.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
            continue
        (
            table.repartition(jdbc_partitions)
            .write.mode(mode)
            .option("batchsize", jdbc_batch_rows)
            .jdbc(jdbc_url, name, properties=jdbc_properties or {})
        )


def reconcile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, and the revenue carried by the transaction fact (null for the others)."""

    def audit(name: str, table: DataFrame) -> DataFrame:
        revenue = money(F.sum("revenue")) if name == "transactions" else F.lit(None).cast("double")
        return table.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), revenue.alias("revenue")
        )

    return reduce(DataFrame.unionByName, [audit(name, table) for name, table in tables.items()])
