"""Fitted models and scores that outlive a process, in the shared folder.

An entry is found by a fingerprint of the rows it was made from, of the
settings and of this library's code.  It is written to a folder of its own and listed last, so one that
was cut off is never read, and two writers do not meet; a reader takes the
first that is listed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path
from typing import TypeVar

import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tierscope
from tierscope import __version__
from tierscope.session import checkpoint_dir

T = TypeVar("T")


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, the same for every process; else this session's own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return f"{(named or checkpoint_dir(spark)).rstrip('/')}/tierscope_kept"


@cache
def _code() -> str:
    """Of the modules that fit and read; the optional operators have no part in it."""
    digest = hashlib.sha256(__version__.encode())
    here = Path(tierscope.__file__).parent
    for f in sorted(here.rglob("*.py")):
        if f.relative_to(here).parts[0] in ("config.py", "functions", "operators", "plans"):
            digest.update(f.read_bytes())
    return digest.hexdigest()


def fingerprint(rows: DataFrame, *settings) -> str:
    """Of the rows, in any order, their columns and the settings."""
    # Two sums of a 64-bit hash, so that repeated rows count; maps and vectors have no hash and no place here.
    h = F.xxhash64(*sorted(rows.columns))
    found = rows.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(20,0)"))).first()
    parts = [*map(str, found), repr(sorted(rows.dtypes)), *map(repr, settings), pyspark.__version__, _code()]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def kept(spark: SparkSession, root: str, name: str, key: str, make: Callable[[str], object], read: Callable[[str], T]) -> T:
    """``read`` of the entry's folder; where there is none, ``make`` writes it first."""
    listing = f"{root}/{name}/{key}/entries"
    try:
        found = spark.read.schema("folder string").json(listing).orderBy("folder").first()
    except AnalysisException:   # no such path yet
        found = None
    if found is None:
        folder = f"{root}/{name}/{key}/{uuid.uuid4().hex}"
        make(folder)
        spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("append").json(listing)
        return read(folder)
    return read(found["folder"])


def kept_table(spark: SparkSession, root: str, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    return kept(spark, root, name, key, lambda folder: make().write.parquet(folder), spark.read.parquet)
