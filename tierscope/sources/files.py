"""File sources and sinks: raw CSV snapshots, processed Parquet, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope.config import NA_STRINGS, RAW_COLUMNS


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize_missing(df: DataFrame, na_strings: list[str] = NA_STRINGS) -> DataFrame:
    """Turn the missing-value spellings into real nulls in every string column."""
    def clean(c):
        # More than ten literals: planned as one static hash-set lookup (InSet).
        return F.when(c.isin(*na_strings), F.lit(None).cast("string")).otherwise(c)
    return df.select(*[
        clean(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def read_listings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a raw listings CSV (plain or gzip) by header, every column as text.

    An explicit schema would map fields by position, so the file is read
    all-string and columns are later selected by name.  (``ingest_file``,
    ``ingest_seq``) is the order of the rows: files by name, whatever order
    the scan packs them in, and rows as they stand in the file (a multi-line
    or gzip file is one task, which numbers its rows in order).  The rows are
    then dealt out by that key, as one file would else stay one task.
    """
    df = (spark.read.option("header", True).option("multiLine", True)
          .option("escape", '"').csv(path))
    df = df.select("*", F.col("_metadata.file_path").alias("ingest_file"), F.monotonically_increasing_id().alias("ingest_seq"))
    return normalize_missing(df.repartition("ingest_file", "ingest_seq"))


def require_columns(df: DataFrame, required: list[str] = RAW_COLUMNS) -> None:
    """Raise, naming every missing column, before any job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"listings lack the columns {', '.join(missing)}")


def write_snapshot(df: DataFrame, out: str, snapshot_date: str | None = None) -> None:
    """Write processed rows as Parquet partitioned by snapshot date.

    Dynamic partition overwrite replaces only the snapshots being written.
    """
    if snapshot_date is not None and "snapshot_date" not in df.columns:
        df = df.withColumn("snapshot_date", F.lit(snapshot_date))
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("snapshot_date").parquet(out))


def read_snapshot(spark: SparkSession, path: str, snapshot_date: str | None = None,
                  schema: T.StructType | None = None) -> DataFrame:
    """Read processed Parquet; a date filter prunes to one partition folder.

    A known schema (including the ``snapshot_date`` partition column) skips
    schema inference.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if snapshot_date is not None:
        df = df.filter(F.col("snapshot_date") == snapshot_date)
    return df


def write_json_report(df: DataFrame, path: str) -> None:
    """A small report (metrics, importances) as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json_report(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a report back; a missing path yields an empty frame, not an error."""
    from pyspark.errors import AnalysisException

    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema if schema is not None else T.StructType([]))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def tf_columns(df: DataFrame) -> list[str]:
    """Text columns whose every value is 't' or 'f' (a missing value disqualifies).

    One aggregation pass over all candidate columns.
    """
    cols = _string_columns(df)
    if not cols:
        return []
    row = df.agg(*[
        F.bool_and(F.coalesce(F.col(c).isin("t", "f"), F.lit(False))).alias(c) for c in cols
    ]).first()
    return [c for c in cols if row[c]]


def coerce_tf_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast all-'t'/'f' text columns to boolean (``col == 't'``)."""
    cols = set(tf_columns(df) if columns is None else columns)
    return df.select(*[(F.col(c) == "t").alias(c) if c in cols else F.col(c) for c in df.columns])


REQUEST_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("property_type", "room_type", "neighbourhood_cleansed", "amenities")]
    + [T.StructField(c, T.DoubleType()) for c in
       ("accommodates", "bedrooms", "beds", "bathrooms", "latitude", "longitude",
        "host_is_superhost", "host_response_rate", "host_acceptance_rate",
        "host_listings_count", "host_identity_verified", "instant_bookable",
        "review_scores_rating", "number_of_reviews", "reviews_per_month",
        "availability_365", "minimum_nights")]
    + [T.StructField("request_id", T.StringType())]
)


def read_scoring_requests(spark: SparkSession, path: str) -> DataFrame:
    """Listings to score, one JSON object per line, with a fixed schema."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)
