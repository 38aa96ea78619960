"""Batch scoring applied to a stream of listing requests.

Scoring is stateless (feature expressions + a fitted ``PipelineModel``),
so the same plan runs on a streaming DataFrame: JSON-lines files landing
in a folder are scored micro-batch by micro-batch into a Parquet sink.
The caller names the checkpoint folder of the stream; started again with the
same folder, a query goes on with the files that it has not scored yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tierscope.config import CONFIG, Config
from tierscope.plans.model import FittedModel, prepare_requests, score_batch
from tierscope.sources.files import REQUEST_SCHEMA


def request_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
                 .json(folder))


def scored_stream(requests: DataFrame, model: FittedModel, cfg: Config = CONFIG,
                  property_levels: list[str] | None = None) -> DataFrame:
    return score_batch(model, prepare_requests(requests, model, cfg, property_levels), cfg)


def start_scoring(spark: SparkSession, model: FittedModel, source: str, sink: str, checkpoint: str,
                  property_levels: list[str] | None = None, trigger_once: bool = False) -> StreamingQuery:
    """Score files landing in ``source`` into ``sink``.

    ``checkpoint`` lies on shared storage and belongs to this pair of folders:
    the sink skips batch numbers it already holds, so a new checkpoint with an
    old sink would lose rows.
    """
    stream = scored_stream(request_stream(spark, source), model, property_levels=property_levels)
    writer = (stream.writeStream.format("parquet").outputMode("append")
                    .option("checkpointLocation", checkpoint)
                    .option("path", sink))
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="10 seconds")
    return writer.start()
