"""tierscope — Spark-native listing price-tier analytics.

Raw listing snapshots are cleaned, deduplicated and turned into model
features with DataFrame column expressions; market questions are answered
with grouped aggregates; a three-class price-tier model is trained,
compared, evaluated and batch-scored with Spark MLlib.
"""

__version__ = "0.1.0"
