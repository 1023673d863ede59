"""Transaction sources and sinks: typed reads, validation, union of parts, clean-set writes, load audit, manifest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillwright.functions.scalar import money, month_of
from tillwright.operators.cleaning import (
    DATE_FORMATS, PRICE, QUANTITY, add_revenue, bad_debt, cancelled, coerce_types, flag_bad_debt, flag_cancelled, flag_return,
    flag_zero_price, line_revenue,
)
from tillwright.plans.staging import hadoop_path

# Header of the exchanged files and the column each maps to.
FILE_COLUMNS = {
    "Invoice": "invoice",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_ts",
    "Price": "price",
    "Customer ID": "customer_id",
    "Country": "country",
}
TRANSACTION_COLUMNS = list(FILE_COLUMNS.values())
# Column of a scan with the text of a line that does not fit.
BROKEN = "_broken"
# Names that may be in no line of a JSON path: these values may be null everywhere, and writers leave nulls out.
OPTIONAL_KEYS = {"description", "customer_id"}
# Lines of a JSON path whose keys are looked at before all are.
KEY_LINES = 1_000
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def check_format(path: str) -> str:
    """Format for a path by its suffix; a suffix outside FORMATS raises ValueError."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = name[name.rfind("."):] if "." in name else ""
    if suffix not in FORMATS:
        raise ValueError(f"Unsupported file type {suffix or name!r}; allowed: {', '.join(sorted(FORMATS))}")
    return FORMATS[suffix]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path (local, object store, HDFS)."""
    target, files = hadoop_path(spark, path)
    return files.exists(target)


def require_columns(df: DataFrame, required: Sequence[str] = tuple(TRANSACTION_COLUMNS)) -> DataFrame:
    """Return ``df`` unchanged, or raise ValueError naming the missing columns in sorted order. Runs no job."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Input lacks the columns {missing}")
    return df


@dataclass(frozen=True)
class Intake:
    """What a read found: ``rows`` that fit, typed, and ``quarantined`` lines that don't: (path, line, fields), where
    ``fields`` is how many values could be read from the line. Together they are all lines of the files."""

    rows: DataFrame
    quarantined: DataFrame


def read_transactions(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
    quantity_type: str = QUANTITY,
    price_type: str = PRICE,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Read transactions from CSV, JSON or parquet into typed snake_case columns.

    Text formats are read as strings (no inference pass over the data) and coerced to the given types, dates by the
    given formats; unparseable values become null and can be counted by ``unparseable_values``. Several paths are
    matched by column name, each CSV path by its own header; files of one path must agree in their header, else the
    read fails. JSON lines may use the exchanged names or ours. ``columns`` limits the result to a subset.
    ``multi_line`` is needed only for quoted line breaks in CSV and makes files unsplittable, so it is off by default.

    A line that does not fit (a CSV line with more or fewer fields than the header, a JSON line that is no object
    or has none of the names) fails the job that meets it, with the line in the message; ``read_with_quarantine`` sets such lines aside instead.
    """
    found = _named_paths(spark, path, fmt, multi_line)
    told = F.concat(F.lit("A line does not fit its file: "), F.col(BROKEN))
    checked = found.withColumn("_fits", F.when(F.col(BROKEN).isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True))
    return coerce_types(checked.filter("_fits").select(*(columns or TRANSACTION_COLUMNS)), quantity_type, price_type, date_formats)


def read_with_quarantine(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
    quantity_type: str = QUANTITY,
    price_type: str = PRICE,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> Intake:
    """``read_transactions``, with lines that don't fit set aside instead of failing the job."""
    found = _named_paths(spark, path, fmt, multi_line)
    rows = found.filter(F.col(BROKEN).isNull()).select(*(columns or TRANSACTION_COLUMNS))
    given = F.size(F.filter(F.array(*[F.col(c).cast("string") for c in TRANSACTION_COLUMNS]), lambda x: x.isNotNull()))
    lines = found.filter(F.col(BROKEN).isNotNull()).select("path", F.col(BROKEN).alias("line"), given.alias("fields"))
    return Intake(coerce_types(rows, quantity_type, price_type, date_formats), lines)


def intake_report(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """Per file: path, rows (that fit) and quarantined (that don't), from one scan."""
    broken = F.col(BROKEN).isNotNull()
    return _named_paths(spark, path, fmt, multi_line).groupBy("path").agg(
        F.count_if(~broken).alias("rows"), F.count_if(broken).alias("quarantined"))


def _named_paths(spark: SparkSession, path: str | Sequence[str], fmt: str | None, multi_line: bool) -> DataFrame:
    """All paths as they are: our column names, the file, and the text of lines that don't fit."""
    paths = [path] if isinstance(path, str) else list(path)
    named = [_named(spark, p, fmt or check_format(p), multi_line) for p in paths]
    return reduce(lambda a, b: a.unionByName(b), named)


def _named(spark: SparkSession, path: str, fmt: str, multi_line: bool) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"No such input: {path}")
    if fmt == "json":
        return _named_json(spark, path)
    if fmt == "csv":
        header = spark.read.csv(path, header=True, inferSchema=False, escape='"').columns
        # With the schema given, Spark compares it with the header of every file instead of reading by position.
        names = StructType([StructField(name, StringType()) for name in [*header, BROKEN]])
        # Fields are counted only where all of a line is parsed, whichever columns are asked for.
        raw = spark.read.schema(names).option("columnPruning", "false").csv(
            path, header=True, enforceSchema=False, multiLine=multi_line, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
        # Spark refuses scans that need the broken lines and no value, such as a count; so a value always goes with them.
        raw = raw.withColumn(BROKEN, F.when(F.length(F.coalesce(F.col(f"`{header[0]}`"), F.lit(""))) >= 0, F.col(BROKEN)))
    else:
        raw = spark.read.parquet(path).withColumn(BROKEN, F.lit(None).cast("string"))
    raw = raw.withColumn("path", F.col("_metadata.file_path"))
    named = require_columns(raw.withColumnsRenamed({k: v for k, v in FILE_COLUMNS.items() if k in raw.columns}))
    return named.select(*TRANSACTION_COLUMNS, "path", BROKEN)


def _named_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON objects by either naming. A name must occur in at least one line, but for OPTIONAL_KEYS."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("path"))
    parsed = lines.withColumn("_object", F.from_json("value", "map<string,string>"))
    _require_keys(parsed)
    columns = [F.coalesce(F.col("_object")[theirs], F.col("_object")[ours]).alias(ours) for theirs, ours in FILE_COLUMNS.items()]
    names = F.array(*[F.lit(name) for pair in FILE_COLUMNS.items() for name in pair])
    fits = F.coalesce(F.arrays_overlap(F.map_keys("_object"), names), F.lit(False))
    return parsed.select(*columns, "path", F.when(~fits, F.col("value")).alias(BROKEN))


def _require_keys(objects: DataFrame) -> None:
    """``require_columns`` on the keys of JSON objects: of some lines first, of all only if a name is not among them."""
    keys = F.array_distinct(F.flatten(F.collect_set(F.map_keys("_object")))).alias("keys")

    def missing(part: DataFrame) -> list[str]:
        found = set(part.filter("_object is not null").agg(keys).first()["keys"])
        return sorted(ours for theirs, ours in FILE_COLUMNS.items() if ours not in OPTIONAL_KEYS and not found & {theirs, ours})

    if objects.isEmpty():
        return
    if missing(objects.limit(KEY_LINES)) and (absent := missing(objects)):
        raise ValueError(f"Input lacks the columns {absent}")


def unparseable_values(text: DataFrame, typed: DataFrame) -> DataFrame:
    """(column, values): how many non-blank texts of each parsed column have no typed value.

    Both sides are counted on their own, so that neither order nor keys are needed.
    """
    parsed = [c for c in ("quantity", "price", "invoice_ts", "customer_id") if c in text.columns]
    given = text.agg(*[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in parsed])
    read = typed.agg(*[F.count(c).alias(c) for c in parsed])
    sides = given.withColumn("_sign", F.lit(1)).unionByName(read.withColumn("_sign", F.lit(-1)))
    return (
        sides.unpivot(["_sign"], parsed, "column", "n").groupBy("column")
        .agg(F.sum(F.col("n") * F.col("_sign")).alias("values"))
    )


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack parts of one dataset by column name, adding the part label as ``source``; absent columns become null."""
    labelled = [df.withColumn("source", F.lit(label)) for label, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a cleaned set. Parquet is partitioned by month, so date-bounded reads prune whole folders.

    Rows are rebalanced by month first: months come out in few files of even size, and a month holding a large
    part of all rows is split over as many tasks as its measured size asks for.
    """
    if fmt == "csv":
        write_table(df, path, "csv", mode)
        return
    dated = df.withColumn("month", month_of(F.col("invoice_ts")))
    dated.hint("rebalance", F.col("month")).write.mode(mode).partitionBy("month").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a derived table such as customer scores, as parquet or CSV with a header."""
    df.write.mode(mode).format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def load_audit(raw: DataFrame) -> DataFrame:
    """One row: rows read, rows left after exact de-duplication, rows kept by cleaning, and their revenue.

    ``raw`` is typed but uncleaned. Grouping by the full row gives all four figures from one shuffle, and a
    heavily repeated row collapses to a counter before it is shuffled.
    """
    kept = ~cancelled(F.col("invoice")) & ~bad_debt(F.col("description"))
    copies = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("raw_rows"),
        F.count(F.lit(1)).alias("deduped_rows"),
        F.count_if(kept).alias("output_rows"),
        money(F.sum(F.when(kept, line_revenue(raw)))).alias("total_revenue"),
    )


def load_clean(raw: DataFrame, path: str) -> DataFrame:
    """Clean typed lines, write them like ``write_clean`` and return the row of ``load_audit``, from the same pass.

    The figures are observed in the tasks that write, whose results count once each however often tasks are repeated;
    rows that cleaning drops travel that far for it.
    """
    typed = coerce_types(raw)
    marked = typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("_copies"))
    for rule in (flag_cancelled, flag_return, flag_zero_price, flag_bad_debt, add_revenue):
        marked = rule(marked)
    marked = marked.withColumns({"_kept": ~F.col("is_cancelled") & ~F.col("is_bad_debt"), "month": month_of(F.col("invoice_ts"))})
    seen = Observation()
    observed = marked.hint("rebalance", F.col("month")).observe(
        seen,
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("raw_rows"), F.count(F.lit(1)).alias("deduped_rows"),
        F.count_if("_kept").alias("output_rows"), money(F.sum(F.when(F.col("_kept"), F.col("revenue")))).alias("total_revenue"),
    )
    observed.filter("_kept").drop("_kept", "_copies").write.mode("overwrite").partitionBy("month").parquet(path)
    figures = seen.get
    kind = "raw_rows bigint, deduped_rows bigint, output_rows bigint, total_revenue double"
    return raw.sparkSession.createDataFrame([tuple(figures[n] for n in ("raw_rows", "deduped_rows", "output_rows", "total_revenue"))], kind)


def manifest_upsert(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """Merge dataset metadata: one row per dataset id, entries of ``new`` win, newest first.

    Ids must be 32 hexadecimal digits in either case; other rows are dropped. The winner is kept by an
    aggregate rather than a window, so a dataset with a very long history is combined before the shuffle.
    """
    fields = [c for c in manifest.columns if c != "dataset_id"]
    both = manifest.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # All fields break ties, so that equal times have one winner.
    winner = F.max_by(F.struct(*fields), F.struct("_new", "created_at", *[c for c in fields if c != "created_at"])).alias("_winner")
    return (
        both.filter(F.col("dataset_id").rlike("^[0-9a-fA-F]{32}$"))
        .groupBy("dataset_id")
        .agg(winner)
        .select("dataset_id", "_winner.*")
        .orderBy(F.desc("created_at"), "dataset_id")
    )
