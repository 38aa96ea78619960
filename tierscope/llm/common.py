"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.session import checkpoint_dir


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written as compressed Parquet in the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tierscope_llm/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, schema: str, rows: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Per Arrow batch: columns as Python lists in, columns of ``schema`` out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 23, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of ``rows`` rows and ``most`` bytes of ``column`` (a longer value is a part of its own)."""
    offsets = offsets_of(batch.column(column))
    start = 0
    while start < len(batch):
        end = min(start + rows, max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + most, "right")) - 1))
        yield batch.slice(start, end - start)
        start = end


def offsets_of(a: pa.Array) -> np.ndarray:
    """Where the values of a string or binary array start, and the last ends."""
    return np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)


def append_columns(df: DataFrame, schema: str, inputs: list[str], task: Callable[[], Callable[..., dict[str, list]]]) -> DataFrame:
    """``df`` with further columns, per Arrow batch.

    ``task`` is called once in each task and gives the function that computes
    the columns from the lists of the input columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    more = to_arrow_schema(_parse_datatype_string(schema))
    whole = StructType(df.schema.fields + _parse_datatype_string(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = task()
        for batch in batches:
            out = rows(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            arrays = [pa.array(out[f.name], f.type) for f in more]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema([*batch.schema, *more]))

    return df.mapInArrow(run, whole)


SALTS = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id that each node of ``edges`` (a, b) reaches.

    Rounds of minimum labels over the edges and a pointer jump; the rows of a
    node are salted in both joins, so a hub is not one task.  Each round is
    checkpointed, tables of few rows in few files.
    """
    def salted(df: DataFrame) -> DataFrame:
        return df.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))

    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = checkpoint(both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")))
    files = 1 + both.count() // 100_000
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")).coalesce(files))
    while True:
        near = (both.join(salted(labels).withColumnRenamed("node", "a"), ["a", "salt"])
                .groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("parent"))
        step = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        jump = salted(labels.select(F.col("node").alias("parent"), F.col("component").alias("up")))
        new = checkpoint(step.join(jump, ["parent", "salt"]).select(
            "node", "old", F.least("parent", "up").alias("component")).coalesce(files))
        if not new.filter("component <> old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
