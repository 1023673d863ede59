"""Transactions derived from order/line-item tables, with the irregularities real invoices have.

Cancelled invoices, returns, zero prices, accounting adjustments, missing customers and descriptions,
and repeated rows are introduced by fixed rules on the keys, so that every cleaning rule has work to do.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Lines that one task sorts, joins and compares whole to find copies, at some 500 bytes of memory each.
LINES_PER_TASK = 250_000


@cache
def _schema(path: str, session: str) -> StructType:
    """Footer schema of a table, read once per session instead of once per query."""
    return SparkSession.active().read.parquet(path).schema


@cache
def _splits(path: str, session: str) -> int:
    """Splits of a table's scan, planned once per session instead of once per query."""
    return SparkSession.active().read.schema(_schema(path, session)).parquet(path).rdd.getNumPartitions()


@cache
def _rows(path: str, session: str) -> int:
    """Rows of a table by its footers, counted once per session."""
    return SparkSession.active().read.schema(_schema(path, session)).parquet(path).count()


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(path, spark.sparkContext.applicationId)).parquet(path)


def _spread(scan: DataFrame, splits: int, *keys: str) -> DataFrame:
    """Deal out a scan that has fewer splits than there are cores, as spark.sql.files.minPartitionNum would if it
    could split a row group. Tables stored in more splits than cores are never moved, whatever their size."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if splits < cores else scan


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The lines with their irregularities.

    Lines meet their orders by invoice, after every other join: where the tables are too large to broadcast, the result
    is then partitioned by a column of its own, and what groups by whole lines or by invoices shuffles nothing again.
    An order has a row for either form of its invoice number; customers and countries are joined to orders, which are few.
    Partitions are merged by their compressed bytes, which say little of the memory that sorting and comparing lines takes,
    so from ``LINES_PER_TASK`` lines per core on their number follows that of the lines, up to the session's shuffle
    partitions: beyond 200 a shuffle sorts its rows, and tasks that scan whole files spill them.
    """
    def table(name: str) -> DataFrame:
        return _table(spark, folder, name)

    c = F.col
    source = f"{folder}/lineitem.parquet", spark.sparkContext.applicationId
    splits, tasks = _splits(*source), min(int(spark.conf.get("spark.sql.shuffle.partitions")), _rows(*source) // LINES_PER_TASK)
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
    cancelled = (c("l_returnflag") == "R") & (c("l_linenumber") % 4 == 0)
    returned = (c("l_returnflag") == "A") & (c("l_linenumber") == 7)
    quantity = F.when(cancelled | returned, -c("l_quantity")).otherwise(c("l_quantity"))
    price = c("l_extendedprice").cast("decimal(12,2)")
    lines = (
        _spread(table("lineitem").select(*columns), splits, "l_orderkey", "l_partkey")
        .join(table("part").select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey"))
        .select(
            F.concat(F.when(cancelled, "C").otherwise(""), c("l_orderkey").cast("string")).alias("invoice"),
            "l_partkey", "p_name",
            quantity.cast("bigint").alias("quantity"),
            F.when(c("l_partkey") % 53 == 0, F.lit(0).cast("decimal(12,2)")).otherwise(price).alias("price"),
        )
    )
    hour = (c("o_orderkey") % 12 + 8).cast("int")
    orders = (
        table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(table("customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
        .join(table("nation").select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"))
        .select(
            (c("o_orderdate") + F.make_dt_interval(hours=hour)).alias("invoice_ts"),
            F.when(c("o_custkey") % 7 != 0, c("o_custkey")).alias("customer_id"),
            c("n_name").alias("country"), "o_orderkey",
            F.explode(F.array(F.lit(""), F.lit("C"))).alias("_prefix"),
        )
        .withColumn("_invoice", F.concat("_prefix", c("o_orderkey").cast("string")))
    )
    if tasks > spark.sparkContext.defaultParallelism:
        lines, orders = lines.repartition(tasks, "invoice"), orders.repartition(tasks, "_invoice")
    copies = F.when(c("o_orderkey") % 50 == 0, 2).otherwise(1)
    return lines.join(orders, c("invoice") == c("_invoice")).select(
        "invoice",
        c("l_partkey").cast("string").alias("stock_code"),
        F.when(c("l_partkey") % 97 == 0, None)
        .when(c("l_partkey") % 89 == 0, " Adjust bad debt ")
        .otherwise(c("p_name"))
        .alias("description"),
        "quantity", "invoice_ts", "price", "customer_id", "country",
        F.explode(F.sequence(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")
