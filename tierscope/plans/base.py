"""Shared plan prefixes: raw listings -> cleaned -> features -> market view.

``features`` is the full lazy plan from the raw tables.  ``prepared`` is
what the dashboard queries read: the same table written once per process
as Parquet (partitioned by snapshot date) under the shared checkpoint
folder, so every panel starts from a pruned columnar scan instead of
re-running the cleaning and feature jobs, and lineage is cut.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from tierscope.config import CONFIG, Config
from tierscope.operators import research as R
from tierscope.operators.clean import clean_listings, observed_retention
from tierscope.operators.features import engineer_features
from tierscope.plans.market import market_view
from tierscope.session import checkpoint_dir, small_methods, small_scans
from tierscope.sources.files import normalize_missing, read_json_report, read_snapshot, write_json_report, write_snapshot
from tierscope.sources.tables import listings_raw

_PREPARED: dict[tuple, tuple] = {}


def landed_raw(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    """The raw snapshot landed once as Parquet, dealt out by (id, ingest_seq), unique per row.

    Downstream jobs then scan plain string columns: pushed-down filters
    evaluate on stored values in parallel scan tasks, instead of
    re-deriving the raw strings inside one task per input file.
    """
    return _materialized(spark, "raw", sf_dir, cfg,
                         lambda: listings_raw(spark, sf_dir).repartition("id", "ingest_seq"))


def loaded_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings as stored (the research reader applies its own NA rule)."""
    return landed_raw(spark, sf_dir)


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings with the missing-value spellings turned into nulls."""
    return normalize_missing(landed_raw(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    return clean_listings(loaded(spark, sf_dir), cfg)


def landed_cleaned(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    """The cleaned table written once: the feature job reads it to fit its vocabulary and again to apply it."""
    counts = (Observation("cleaning_in"), Observation("cleaning_out"))
    written = (spark.sparkContext.applicationId, "cleaned", sf_dir, cfg) in _PREPARED
    # A session of its own counts: one that has observed can't ship MLlib models that hold their training summary.
    out = _materialized(spark, "cleaned", sf_dir, cfg, lambda: clean_listings(loaded(spark.newSession(), sf_dir), cfg, counts))
    if not written:
        write_json_report(observed_retention(spark, counts), _path(spark, "retention", sf_dir, cfg))
    return out


def retention_report(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    """Rows in, rows out and percent kept, as the cleaning job counted them while it wrote."""
    landed_cleaned(spark, sf_dir, cfg)
    return read_json_report(spark, _path(spark, "retention", sf_dir, cfg), "rows_in long, rows_out long, pct_kept double")


def features(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    return engineer_features(landed_cleaned(spark, sf_dir, cfg), cfg)


def prepare(spark: SparkSession, sf_dir: str, out: str, cfg: Config = CONFIG) -> None:
    """The prepare job: clean + features, written as one snapshot partition."""
    write_snapshot(features(spark, sf_dir, cfg), out, cfg.snapshot_date)


def _path(spark: SparkSession, name: str, sf_dir: str, cfg: Config) -> str:
    tag = hashlib.sha1(repr((sf_dir, cfg)).encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark).rstrip('/')}/tierscope_{name}/{tag}"


def _materialized(spark: SparkSession, name: str, sf_dir: str, cfg: Config, build) -> DataFrame:
    """Write ``build()`` once per process under the checkpoint folder and read it back."""
    key = (spark.sparkContext.applicationId, name, sf_dir, cfg)
    if key not in _PREPARED:
        path = _path(spark, name, sf_dir, cfg)
        with small_methods(spark):
            df = build()
            with small_methods(df.sparkSession), small_scans(df.sparkSession):   # a build may read in a session of its own
                write_snapshot(df, path, cfg.snapshot_date)
        # The writer knows the schema: reads skip footer-based schema inference.
        schema = T.StructType(df.schema.fields + [T.StructField("snapshot_date", T.StringType())])
        _PREPARED[key] = (path, schema)
    path, schema = _PREPARED[key]
    return read_snapshot(spark, path, cfg.snapshot_date, schema).drop("snapshot_date")


def prepared(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    """Feature table read back from its written snapshot (prepared once per process)."""
    return _materialized(spark, "features", sf_dir, cfg, lambda: features(spark, sf_dir, cfg))


def research_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.research_priced(loaded_raw(spark, sf_dir))


def research_filtered(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    return R.research_filtered(loaded_raw(spark, sf_dir), cfg)


def research_features(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    return R.research_features(loaded_raw(spark, sf_dir), cfg)


def research_prepared(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    return _materialized(spark, "research", sf_dir, cfg,
                         lambda: research_features(spark, sf_dir, cfg))


def market(spark: SparkSession, sf_dir: str, cfg: Config = CONFIG) -> DataFrame:
    """Prepared feature table under the dashboard's default filters."""
    return market_view(prepared(spark, sf_dir, cfg))
