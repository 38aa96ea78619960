"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed 1- to 3-grams of the lower-cased letters (other
characters are one space), weighted by log term frequency and inverse
document frequency, scaled to unit length.  Document frequencies come from
every learning document; the classifier is fitted on about
``SAMPLE_PER_LANGUAGE`` learning documents of each language (by hash of
doc_id): shards of the sample run follow-the-regularised-leader with
elastic-net penalties, and their weights are averaged.  A temperature,
fitted on learning documents kept out of that, calibrates the scores.

The same documents give each language a cut, under which a text may be of a
language that was not learned: half-way from even odds to the ``LOW`` quantile
of the scores of texts that were rightly recognised.  Where fewer than
``LEAST`` were, and at least everywhere, it is ``MARGIN`` of the way from even
odds to 1.  A single language has nothing to be told from and keeps all texts.

Defined results: text that is null or has no letter is ``und`` with score 0,
as is every text if nothing can be learned; ties go to the language first in
the alphabet; rows without doc_id are not learned from; repeated rows get
equal predictions; an empty table gives an empty result; ``predict`` passes
all columns on.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import append_columns

BITS = 15
SAMPLE_PER_LANGUAGE = 1500
CALIBRATION_PER_LANGUAGE = 500
SHARDS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.01   # learning rate, its offset, penalties
UNKNOWN = "und"
LOW, LEAST, MARGIN = 0.01, 100, 0.15

_LETTER = np.zeros(1 << 16, bool)
for _cp in range(1 << 16):
    _LETTER[_cp] = chr(_cp).isalpha()


def counts(text: str) -> np.ndarray | None:
    """Occurrences in each hash bucket; None if the text has no letter."""
    units = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")
    letter = _LETTER[units]
    if not letter.any() and not any(c.isalpha() for c in text):
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]                                  # one space for each run of others
    c = np.where(letter, units, np.uint16(32))[keep].astype(np.uint32)
    total = np.zeros(1 << BITS, np.int64)
    g = np.zeros(len(c), np.uint32)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        g = (g[:len(c) - n + 1] * np.uint32(0x01000193)) ^ c[n - 1:]
        h = (g ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        total += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def features(total: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length TF-IDF weights."""
    at = np.flatnonzero(total)
    x = np.log1p(total[at]) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1.0)


def document_frequency(docs: DataFrame) -> DataFrame:
    """(bucket, df) and bucket -1 with the number of documents, over all rows of ``text``."""
    def run(batches):
        import pyarrow as pa

        df = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total = counts(text.as_py())
                if total is not None:
                    df[:-1] += total > 0
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == 1 << BITS, -1, at)), pa.array(df[at])], ["bucket", "df"])

    parts = docs.select("text").filter("text is not null").mapInArrow(run, "bucket long, df long")
    return parts.groupBy("bucket").agg(F.sum("df").alias("df"))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (bucket or bias, class) of multinomial logistic regression by FTRL-proximal."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) > L1, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    cuts: tuple[float, ...] = ()


def _logits(text: str | None, model: Model) -> np.ndarray | None:
    total = counts(text or "")
    if total is None or not model.languages:
        return None
    at, x = features(total, model.idf)
    return x @ model.weights[at] + model.weights[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest (convex in its inverse).

    As in Platt's scaling one label in N + 2 counts as wrong, or else labels
    that are all met would call for certainty.
    """
    wrong = np.full(logits.shape, 1 / (len(y) + 2) / max(1, logits.shape[1] - 1))
    wrong[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)

    def loss(log_t):
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s).sum(axis=1, keepdims=True)) * wrong - s * wrong).sum(axis=1).mean()

    low, high = -4.0, 4.0
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _cuts(logits: np.ndarray, y: np.ndarray, temperature: float, classes: int) -> tuple[float, ...]:
    """The least score of each language."""
    even = 1 / classes
    least = even + MARGIN * (1 - even)
    p = np.exp((logits - logits.max(axis=1, keepdims=True)) / temperature)
    score, found = p.max(axis=1) / p.sum(axis=1), logits.argmax(axis=1)
    right = [score[(found == k) & (y == k)] for k in range(classes)]
    return tuple(max(least, (even + float(np.quantile(x, LOW))) / 2) if len(x) >= LEAST else least for x in right)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _sample(learn: DataFrame, sizes: dict[str, int], folds: tuple[int, ...], per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language: as many rows as languages are broadcast."""
    spark = learn.sparkSession
    share = {lang: per_language / n for lang, n in sizes.items()}
    rates = spark.createDataFrame([(k, float(v)) for k, v in share.items()], "lang string, share double")
    rows = learn.filter(fold(F.col("doc_id")).isin(*folds)).join(F.broadcast(rates), "lang")
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))


def train(docs: DataFrame) -> Broadcast:
    """The model, learned from documents with a language outside the held-out fold."""
    spark = docs.sparkSession
    learn = docs.select("doc_id", "text", "lang").filter("doc_id is not null and lang is not null and text is not null").filter(
        fold(F.col("doc_id")) != 2)
    # Rows as many as languages.
    sizes = {(r["lang"], r["f"] == 3): r["count"] for r in learn.groupBy("lang", fold(F.col("doc_id")).alias("f")).count()
             .groupBy("lang", F.when(F.col("f") == 3, 3).otherwise(0).alias("f")).agg(F.sum("count").alias("count")).collect()}
    languages = sorted({lang for lang, _ in sizes})
    number = {lang: i for i, lang in enumerate(languages)}
    df = document_frequency(learn).toPandas()
    found = dict(zip(df["bucket"], df["df"], strict=True))
    idf = np.zeros(1 << BITS)
    for bucket, n in found.items():
        if bucket >= 0:
            idf[bucket] = np.log((1 + found[-1]) / (1 + n)) + 1
    if not languages:
        return spark.sparkContext.broadcast(Model([], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0))
    shared = spark.sparkContext.broadcast(idf)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "text"])
        rows = []
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            total = counts(text)
            if total is not None:
                rows.append((*features(total, shared.value), number[lang]))
        w = ftrl(rows, len(languages))
        at, c = np.nonzero(w)
        return pd.DataFrame({"bucket": at, "class": c, "w": w[at, c]})

    order = F.xxhash64(F.lit("order"), "doc_id")
    sample = (_sample(learn, {k: n for (k, cal), n in sizes.items() if not cal}, (0, 1), SAMPLE_PER_LANGUAGE)
              .select("text", "lang", order.alias("order"), F.pmod(order, F.lit(SHARDS)).alias("shard")))
    fitted = sample.groupBy("shard").applyInPandas(fit, "bucket long, class long, w double")
    averaged = fitted.groupBy("bucket", "class").agg(F.array_sort(F.collect_list("w")).alias("w")).toPandas()
    weights = np.zeros(((1 << BITS) + 1, len(languages)))
    weights[averaged["bucket"], averaged["class"]] = [sum(w) / SHARDS for w in averaged["w"]]
    raw = Model(languages, idf, weights, 1.0)
    held = _sample(learn, {k: n for (k, cal), n in sizes.items() if cal}, (3,), CALIBRATION_PER_LANGUAGE)
    shared_raw = spark.sparkContext.broadcast(raw)

    def rows(texts):
        out = [_logits(t, shared_raw.value) for t in texts]
        return {"logits": [None if x is None else x.tolist() for x in out]}

    calibration = [r for r in append_columns(held.select("text", "lang"), "logits array<double>", ["text"], lambda: rows)
                   .drop("text").collect() if r["logits"] is not None]
    logits = np.array([r["logits"] for r in calibration]).reshape(-1, len(languages))
    y = np.array([number[r["lang"]] for r in calibration], int)
    if calibration:
        raw = raw._replace(temperature=_temperature(logits, y))
    raw = raw._replace(cuts=_cuts(logits, y, raw.temperature, len(languages)))
    return spark.sparkContext.broadcast(raw)


def predict(docs: DataFrame, model: Broadcast) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone."""
    def rows(texts):
        langs, scores, m = [], [], model.value
        for t in texts:
            logits = _logits(t, m)
            if logits is None:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = np.exp((logits - logits.max()) / m.temperature)
            langs.append(m.languages[int(p.argmax())])
            scores.append(float(p.max() / p.sum()))
        return {"lang_pred": langs, "score": scores}

    return append_columns(docs, "lang_pred string, score double", ["text"], lambda: rows)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), train(docs)).drop("text")
