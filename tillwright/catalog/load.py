"""Source, sink, audit and cleaning queries."""

import pyarrow as pa
from pyspark.sql import functions as F

from tillwright.catalog.base import clean, on_clean, on_raw, raw, register, stored
from tillwright.functions.json_safe import json_safe
from tillwright.operators import cleaning
from tillwright.operators.sampling import stratified_day_sample
from tillwright.plans.staging import shared_path, stage
from tillwright.sources import star
from tillwright.sources.transactions import (
    FILE_COLUMNS,
    TRANSACTION_COLUMNS,
    check_format,
    intake_report,
    load_audit,
    load_clean,
    manifest_upsert,
    read_transactions,
    read_with_quarantine,
    require_columns,
    union_sources,
    unparseable_values,
    write_clean,
)

LINE = "invoice:s stock_code:s description:s quantity:n invoice_ts:t price:m customer_id:n country:s"
FLAGS = "is_cancelled:b is_return:b is_zero_price:b is_bad_debt:b revenue:m"


def _exported(spark, folder):
    """Raw lines written as CSV with the exchanged header, as an upload would arrive."""
    path = shared_path(spark, "upload") + ".csv"
    names = {ours: theirs for theirs, ours in FILE_COLUMNS.items()}
    exported = raw(spark, folder).withColumn("invoice_ts", F.date_format("invoice_ts", "yyyy-MM-dd HH:mm:ss"))
    exported.withColumnsRenamed(names).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False,
                                                 ignoreTrailingWhiteSpace=False)
    return path


register(
    "read_transactions", LINE, lambda spark, folder: read_transactions(spark, _exported(spark, folder)),
    "SELECT * FROM raw", views="raw",
)
register(
    "read_transactions_subset", "invoice:s quantity:n price:m",
    lambda spark, folder: read_transactions(spark, _exported(spark, folder), columns=["invoice", "quantity", "price"]),
    "SELECT invoice, quantity, price FROM raw", views="raw",
)


def _mixed_files(spark, folder):
    """Raw lines, prices with three decimals, as two CSV files whose columns stand in different order and a JSON file."""
    path = shared_path(spark, "mixed")
    names = {ours: theirs for theirs, ours in FILE_COLUMNS.items()}
    lines = raw(spark, folder).withColumn("price", F.col("price") + F.lit("0.001").cast("decimal(4,3)"))
    dated = lines.withColumn("invoice_ts", F.date_format("invoice_ts", "M/d/yyyy H:mm:ss"))
    third = F.pmod(F.xxhash64("invoice"), F.lit(3))
    for at, suffix in enumerate(("csv", "csv", "json")):
        part = dated.filter(third == at).withColumnsRenamed(names)
        columns = part.columns[::-1] if at else part.columns
        writer = part.select(*columns).write
        if suffix == "csv":
            writer.csv(f"{path}-{at}.csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        else:
            writer.json(f"{path}-{at}.json")
    return [f"{path}-0.csv", f"{path}-1.csv", f"{path}-2.json"]


register(
    "read_transactions_mixed", LINE, lambda spark, folder: read_transactions(spark, _mixed_files(spark, folder)),
    "SELECT * REPLACE (price + 0.001 AS price) FROM raw", views="raw",
)


def _damaged_files(spark, folder):
    """Raw lines in a CSV file, a CSV file with our own column names and a JSON file of either naming, by the last digit
    of the invoice. A line with quantity 13 has a field too many (CSV) or breaks off (JSON), one with quantity 17 has a
    field too few (CSV) or is no object (JSON)."""
    path = shared_path(spark, "damaged")
    lines = raw(spark, folder).withColumn("invoice_ts", F.date_format("invoice_ts", "yyyy-MM-dd HH:mm:ss"))
    digit = F.right("invoice", F.lit(1)).cast("int") % 3
    quoted = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TRANSACTION_COLUMNS])
    csv = F.concat(
        F.array_join(F.when(F.col("quantity") == 17, F.slice(quoted, 1, 7)).otherwise(quoted), ","),
        F.when(F.col("quantity") == 13, ",more").otherwise(""),
    )
    names = {ours: theirs for theirs, ours in FILE_COLUMNS.items()}
    renamed = F.to_json(F.struct(*[F.col(c).alias(names[c]) for c in TRANSACTION_COLUMNS]))
    own = F.to_json(F.struct(*TRANSACTION_COLUMNS))
    json = F.when(F.col("stock_code").endswith("1"), own).otherwise(renamed)
    json = F.when(F.col("quantity") == 13, F.substring(json, 1, 40)).when(F.col("quantity") == 17, F.lit("[1, 2]")).otherwise(json)

    def with_header(header):
        def write(batches):
            yield pa.RecordBatch.from_pydict({"value": [header]})
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
        return write

    for at, header in enumerate((list(FILE_COLUMNS), TRANSACTION_COLUMNS)):
        # As many files as tasks, whatever the size: each begins with the header.
        part = lines.filter(digit == at).select(csv.alias("value"))
        part.mapInArrow(with_header(",".join(header)), "value string").write.text(f"{path}-{at}.csv")
    lines.filter(digit == 2).select(json.alias("value")).write.text(f"{path}-2.json")
    return [f"{path}-0.csv", f"{path}-1.csv", f"{path}-2.json"]


register(
    "read_with_quarantine", LINE, lambda spark, folder: read_with_quarantine(spark, _damaged_files(spark, folder)).rows,
    "SELECT * FROM raw WHERE quantity NOT IN (13, 17)", views="raw",
)


def _part(path):
    return F.regexp_extract(path, r"-(\d)\.(?:csv|json)/", 1).cast("int").alias("part")


def _quarantine_counts(spark, folder):
    """Per part: rows that fit and lines that don't, counted by the two sides of the read and by the report."""
    paths = _damaged_files(spark, folder)
    found = read_with_quarantine(spark, paths)
    lines = found.quarantined.groupBy(_part(F.col("path"))).agg(
        F.count_if(F.col("line").endswith(",more")).alias("too_many"), F.count(F.lit(1)).alias("set_aside"))
    report = intake_report(spark, paths).groupBy(_part(F.col("path"))).agg(
        F.sum("rows").alias("rows"), F.sum("quarantined").alias("quarantined"))
    return report.join(lines, "part", "left").na.fill(0).crossJoin(found.rows.agg(F.count(F.lit(1)).alias("all_rows")))


register(
    "quarantine_counts", "part:n rows:n quarantined:n set_aside:n too_many:n all_rows:n", _quarantine_counts,
    """SELECT cast(right(invoice, 1) AS INT) % 3 AS part, count(*) FILTER (WHERE quantity NOT IN (13, 17)) AS rows,
 count(*) FILTER (WHERE quantity IN (13, 17)) AS quarantined, count(*) FILTER (WHERE quantity IN (13, 17)) AS set_aside,
 count(*) FILTER (WHERE quantity = 13 AND cast(right(invoice, 1) AS INT) % 3 < 2) AS too_many,
 (SELECT count(*) FROM raw WHERE quantity NOT IN (13, 17)) AS all_rows FROM raw GROUP BY 1""",
    views="raw",
)


def _refused(call) -> bool:
    try:
        call()
    except (ValueError, FileNotFoundError):
        return True
    return False


def _input_checks(spark, folder):
    """Which inputs are refused: a foreign suffix, a missing path, lines without a required column."""
    lines = raw(spark, folder)
    return lines.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(_refused(lambda: check_format("lines.xlsx"))).alias("foreign_suffix"),
        F.lit(_refused(lambda: read_transactions(spark, shared_path(spark, "absent") + ".csv"))).alias("missing_path"),
        F.lit(_refused(lambda: require_columns(lines.drop("price", "country")))).alias("missing_columns"),
        F.lit(_refused(lambda: require_columns(lines))).alias("complete_lines"),
    )


register(
    "input_checks", "rows:n foreign_suffix:b missing_path:b missing_columns:b complete_lines:b", _input_checks,
    "SELECT count(*) AS rows, true AS foreign_suffix, true AS missing_path, true AS missing_columns, false AS complete_lines FROM raw",
    views="raw",
)


def _parts(spark, folder):
    lines = raw(spark, folder)
    early = lines.filter(F.col("invoice_ts") < F.lit("1998-01-01").cast("timestamp_ntz"))
    late = lines.filter(F.col("invoice_ts") >= F.lit("1998-01-01").cast("timestamp_ntz")).drop("description")
    return union_sources({"first": early, "second": late})


register(
    "union_sources", LINE + " source:s", _parts,
    """SELECT *, 'first' AS source FROM raw WHERE invoice_ts < TIMESTAMP '1998-01-01'
UNION ALL SELECT * REPLACE (NULL AS description), 'second' AS source FROM raw WHERE invoice_ts >= TIMESTAMP '1998-01-01'""",
    views="raw",
)


def _written(spark, folder):
    path = shared_path(spark, "clean")
    write_clean(clean(spark, folder), path)
    return spark.read.parquet(path)


register(
    "write_clean", f"{LINE} {FLAGS} month:s", _written,
    "SELECT *, strftime(invoice_ts, '%Y-%m') AS month FROM clean",
)
register(
    "load_audit", "raw_rows:n deduped_rows:n output_rows:n total_revenue:m", on_raw(load_audit),
    """SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS deduped_rows,
 count(*) AS output_rows, sum(revenue) AS total_revenue FROM clean""",
)


def _loaded(spark, folder):
    """The audit of a load, and what the load wrote."""
    path = shared_path(spark, "loaded")
    audit = load_clean(raw(spark, folder), path)
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written_rows"), F.count_if(F.col("is_cancelled") | F.col("is_bad_debt")).alias("dropped_kinds"))
    return audit.crossJoin(written)  # one row each


register(
    "load_clean", "raw_rows:n deduped_rows:n output_rows:n total_revenue:m written_rows:n dropped_kinds:n", _loaded,
    """SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS deduped_rows,
 count(*) AS output_rows, sum(revenue) AS total_revenue, count(*) AS written_rows, 0 AS dropped_kinds FROM clean""",
)


def _manifest(spark, folder):
    per_month = (
        clean(spark, folder)
        .groupBy(F.date_format("invoice_ts", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("revenue").cast("double").alias("revenue"), F.max("invoice_ts").alias("last"))
    )

    def entries(months, rows, source):
        return months.select(
            F.md5("month").alias("dataset_id"), F.concat("month", F.lit(".csv")).alias("filename"),
            rows.alias("input_rows"), F.col("rows").alias("output_rows"), F.col("revenue").alias("total_revenue"),
            F.col("last").alias("created_at"), F.lit(source).alias("source"),
        )

    known = entries(per_month, F.col("rows") + 1, "existing")
    arriving = entries(per_month.filter(F.col("month") >= "1998-01"), F.col("rows"), "upload")
    broken = arriving.withColumn("dataset_id", F.lit("not-an-id"))
    return manifest_upsert(known, arriving.union(broken))


register(
    "manifest_upsert",
    "dataset_id:s filename:s input_rows:n output_rows:n total_revenue:m created_at:t source:s",
    _manifest,
    """SELECT md5(month) AS dataset_id, month || '.csv' AS filename,
 CASE WHEN month >= '1998-01' THEN n ELSE n + 1 END AS input_rows, n AS output_rows, revenue AS total_revenue,
 last AS created_at, CASE WHEN month >= '1998-01' THEN 'upload' ELSE 'existing' END AS source
FROM (SELECT strftime(invoice_ts, '%Y-%m') AS month, count(*) AS n, sum(revenue) AS revenue, max(invoice_ts) AS last
 FROM clean GROUP BY 1)""",
)

register(
    "customers_dim", "customer_id:n first_purchase_date:t country:s", on_clean(star.customers_dim),
    """SELECT customer_id, min(invoice_ts) AS first_purchase_date,
 first(country ORDER BY invoice_ts, invoice, stock_code) FILTER (WHERE country IS NOT NULL) AS country
FROM clean WHERE customer_id IS NOT NULL GROUP BY 1""",
)
register(
    "products_dim", "stock_code:s description:s", on_clean(star.products_dim),
    """SELECT stock_code, coalesce(description, '') AS description FROM (SELECT stock_code, description,
 row_number() OVER (PARTITION BY stock_code ORDER BY invoice_ts, invoice, coalesce(description, '')) AS rn
 FROM clean WHERE stock_code IS NOT NULL) WHERE rn = 1""",
)
FACT_SQL = """SELECT invoice, stock_code, coalesce(description, '') AS description, coalesce(quantity, 0) AS quantity,
 invoice_ts AS invoice_date, price, customer_id, coalesce(country, 'Unspecified') AS country, is_cancelled, is_return,
 is_zero_price, revenue FROM clean"""
register(
    "transactions_fact",
    "invoice:s stock_code:s description:s quantity:n invoice_date:t price:m customer_id:n country:s "
    "is_cancelled:b is_return:b is_zero_price:b revenue:m",
    on_clean(star.transactions_fact), FACT_SQL,
)
DAILY_FACT_SQL = """SELECT cast(invoice_ts AS DATE) AS metric_date, sum(revenue) AS revenue, count(DISTINCT invoice) AS orders,
 count(DISTINCT customer_id) AS customers, sum(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS units_sold,
 cast(sum(revenue) AS DOUBLE) / count(DISTINCT invoice) AS aov FROM clean GROUP BY 1"""
register(
    "daily_fact", "metric_date:d revenue:m orders:n customers:n units_sold:n aov:f", on_clean(star.daily_fact),
    DAILY_FACT_SQL,
)


def _star_written(spark, folder):
    path = shared_path(spark, "star")
    tables = star.star_tables(stored(spark, folder))
    star.write_star(tables, path=path)
    return star.reconcile({name: spark.read.parquet(f"{path}/{name}") for name in tables})


RECONCILE_SQL = """SELECT 'customers' AS table_name, count(DISTINCT customer_id) AS row_count, NULL AS revenue FROM clean
UNION ALL SELECT 'products', count(DISTINCT stock_code), NULL FROM clean
UNION ALL SELECT 'transactions', count(*), cast(sum(revenue) AS DOUBLE) FROM clean
UNION ALL SELECT 'daily_metrics', count(DISTINCT cast(invoice_ts AS DATE)), NULL FROM clean"""
register("write_star", "table_name:s row_count:n revenue:m", _star_written, RECONCILE_SQL)
register(
    "reconcile", "table_name:s row_count:n revenue:m",
    lambda spark, folder: star.reconcile(star.star_tables(stored(spark, folder))), RECONCILE_SQL,
)


def _json_rows(spark, folder):
    lines = clean(spark, folder)
    infinite = F.when(F.col("is_return"), F.lit("-Infinity").cast("double"))
    undefined = F.when(F.col("is_zero_price"), F.lit("NaN").cast("double"))
    nested = lines.select(
        "invoice", "stock_code", "invoice_ts",
        F.struct(
            F.col("price").cast("double").alias("price"),
            F.coalesce(infinite, undefined, F.col("quantity").cast("double")).alias("level"),
        ).alias("measures"),
        F.array(F.coalesce(undefined, F.lit(1.0))).alias("weights"),
    )
    safe = json_safe(nested)
    return safe.select(
        "invoice", "stock_code", "invoice_ts", F.col("measures.price").alias("price"),
        F.col("measures.level").alias("level"), F.get("weights", F.lit(0)).alias("weight"),
    )


register(
    "json_safe", "invoice:s stock_code:s invoice_ts:s price:m level:m weight:m", _json_rows,
    """SELECT invoice, stock_code, strftime(invoice_ts, '%Y-%m-%dT%H:%M:%S') AS invoice_ts, cast(price AS DOUBLE) AS price,
 CASE WHEN NOT is_return AND NOT is_zero_price THEN quantity END AS level,
 CASE WHEN NOT is_zero_price THEN 1.0 END AS weight FROM clean""",
)


def _sample_report(spark, folder, target=5_000):
    lines = stored(spark, folder)
    day = F.to_date("invoice_ts").alias("date")
    per_day = stratified_day_sample(lines, target, seed=42, distinct=True).groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("rows"), F.min("n").alias("fewest"))


register(
    "stratified_day_sample", "days:n rows:n fewest:n", _sample_report,
    """SELECT count(*) AS days, least(5000, sum(n)) AS rows, min(least(n, greatest(1, 5000 // (SELECT count(*) FROM per_day)))) AS fewest
FROM per_day""",
    helpers="per_day AS (SELECT cast(invoice_ts AS DATE) AS date, count(*) AS n FROM clean GROUP BY 1)",
)


def _sample_days(spark, folder, target=5_000):
    """Per day: lines in all, and whether its sampled lines are lines of the source, each once, and reach the quota."""
    lines = stored(spark, folder)
    sample = stage(stratified_day_sample(lines, target, seed=42, distinct=True), "sample")
    day = F.to_date("invoice_ts").alias("date")
    whole = lines.groupBy(day).agg(F.count(F.lit(1)).alias("lines"))
    quota = max(1, target // whole.count())
    drawn = sample.groupBy(day).agg(F.count(F.lit(1)).alias("drawn"))
    # Both sides have the same columns; lines of the clean set are distinct, so equal lines meet once.
    met = lines.intersect(sample).groupBy(day).agg(F.count(F.lit(1)).alias("met"))
    return whole.join(drawn, "date", "left").join(met, "date", "left").select(
        "date", "lines", (F.col("met") == F.col("drawn")).alias("from_source"),
        (F.col("drawn") >= F.least(F.col("lines"), F.lit(quota))).alias("quota_met"))


register(
    "stratified_day_sample_days", "date:d lines:n from_source:b quota_met:b", _sample_days,
    "SELECT date, n AS lines, true AS from_source, true AS quota_met FROM per_day",
    helpers="per_day AS (SELECT cast(invoice_ts AS DATE) AS date, count(*) AS n FROM clean GROUP BY 1)",
)


# --- cleaning steps -------------------------------------------------------------------------------------------------

def _text(spark, folder):
    """Raw lines as text, with some values damaged, to be parsed again."""
    lines = raw(spark, folder)
    quantity = F.when(F.col("quantity") == 13, F.lit("n/a")).otherwise(F.col("quantity").cast("string"))
    price = F.when(F.col("quantity") == 17, F.lit("")).otherwise(F.col("price").cast("string"))
    moment = F.date_format("invoice_ts", "yyyy-MM-dd HH:mm:ss")
    return lines.select(
        "invoice", quantity.alias("quantity"), price.alias("price"),
        F.when(F.col("quantity") == 19, F.lit("someday")).otherwise(moment).alias("invoice_ts"),
        F.col("customer_id").cast("decimal(12,1)").cast("string").alias("customer_id"),
    )


register(
    "coerce_types", "invoice:s quantity:n price:m invoice_ts:t customer_id:n",
    lambda spark, folder: cleaning.coerce_types(_text(spark, folder)),
    """SELECT invoice, CASE WHEN quantity <> 13 THEN quantity END AS quantity, CASE WHEN quantity <> 17 THEN price END AS price,
 CASE WHEN quantity <> 19 THEN invoice_ts END AS invoice_ts, customer_id FROM raw""",
    views="raw",
)
register(
    "unparseable_values", "field:s n:n",
    lambda spark, folder: unparseable_values(_text(spark, folder), cleaning.coerce_types(_text(spark, folder)))
    .withColumnsRenamed({"column": "field", "values": "n"}),
    """SELECT unnest(['quantity', 'price', 'invoice_ts', 'customer_id']) AS field,
 unnest([count(*) FILTER (WHERE quantity = 13), 0, count(*) FILTER (WHERE quantity = 19), 0]) AS n FROM raw""",
    views="raw",
)
register(
    "drop_exact_duplicates", LINE, on_raw(cleaning.drop_exact_duplicates), "SELECT DISTINCT * FROM raw", views="raw"
)
for _name, _operator, _flag, _sql in (
    ("flag_cancelled", cleaning.flag_cancelled, "is_cancelled", "coalesce(starts_with(invoice, 'C'), false)"),
    ("flag_return", cleaning.flag_return, "is_return", "quantity < 0 AND NOT starts_with(invoice, 'C')"),
    ("flag_zero_price", cleaning.flag_zero_price, "is_zero_price", "price = 0"),
    ("flag_bad_debt", cleaning.flag_bad_debt, "is_bad_debt", "lower(trim(coalesce(description, ''))) = 'adjust bad debt'"),
):
    register(
        _name, f"{LINE} {_flag}:b", on_raw(_operator), f"SELECT *, {_sql} AS {_flag} FROM raw", views="raw"
    )
register(
    "drop_cancelled_and_bad_debt", LINE, on_raw(cleaning.drop_cancelled_and_bad_debt),
    """SELECT * FROM raw WHERE NOT starts_with(invoice, 'C')
 AND lower(trim(coalesce(description, ''))) <> 'adjust bad debt'""",
    views="raw",
)
register(
    "add_revenue", f"{LINE} revenue:m", on_raw(cleaning.add_revenue),
    "SELECT *, quantity * price AS revenue FROM raw", views="raw",
)
register("clean_transactions", f"{LINE} {FLAGS}", on_raw(cleaning.clean_transactions), "SELECT * FROM clean")
register(
    "cleaning_report", "metric:s value:f", on_raw(cleaning.cleaning_report),
    """SELECT unnest(['raw_rows', 'raw_duplicate_rows', 'raw_cancelled_rows', 'raw_bad_debt_rows']) AS metric,
 unnest([cast(count(*) AS DOUBLE), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)),
  count(*) FILTER (WHERE starts_with(invoice, 'C')),
  count(*) FILTER (WHERE lower(trim(description)) = 'adjust bad debt')]) AS value FROM raw
UNION ALL
SELECT unnest(['clean_rows', 'returns_retained', 'zero_price_retained', 'bad_debt_remaining', 'missing_customers',
  'missing_descriptions', 'positive_revenue_rows', 'negative_revenue_rows', 'zero_revenue_rows', 'total_revenue']),
 unnest([cast(count(*) AS DOUBLE), count(*) FILTER (WHERE is_return), count(*) FILTER (WHERE is_zero_price), 0,
  count(*) FILTER (WHERE customer_id IS NULL), count(*) FILTER (WHERE description IS NULL),
  count(*) FILTER (WHERE revenue > 0), count(*) FILTER (WHERE revenue < 0), count(*) FILTER (WHERE revenue = 0),
  cast(sum(revenue) AS DOUBLE)]) FROM clean""",
)
