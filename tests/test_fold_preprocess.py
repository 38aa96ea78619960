"""Statistics of all folds from one count, and rare levels in one pass."""

from pyspark.sql import functions as F

from tierscope.config import TIER_ORDER
from tierscope.operators.features import collapse_rare
from tierscope.plans import model as M


def _rows(spark):
    rows = [(i, i % 5, float(i * i % 37) if i % 7 else None, 0.1 if i % 3 else None, None if i % 11 == 0 else "ab"[i % 2], i % 4)
            for i in range(203)]
    rows.append((900, 2, 1e6, 0.1, "c", 1))
    return spark.createDataFrame(rows, "id int, fold int, x double, flat double, level string, n int")


def test_folds_together_are_folds_alone(spark):
    df, numeric = _rows(spark), ["x", "flat", "n"]
    together = M.fit_fold_preprocess(df, numeric, ["level"], 5)
    for k, prep in enumerate(together):
        alone = M.fit_preprocess(df.where(F.col("fold") != k), numeric, ["level"])
        for got, want in zip(M.numeric_statistics(prep, numeric), M.numeric_statistics(alone, numeric), strict=True):
            assert all(abs(got[c] - want[c]) <= 1e-12 * max(abs(want[c]), 1) for c in numeric)
        assert prep.getStatement().split(" AS STRING), ")[1] == alone.getStatement().split(" AS STRING), ")[1]


def test_a_column_without_values_outside_a_fold(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (0, 3.0, "b"), (1, None, None), (1, None, None)], "fold int, x double, level string")
    for k, prep in enumerate(M.fit_fold_preprocess(df, ["x"], ["level"], 2)):
        alone = M.fit_preprocess(df.where(F.col("fold") != k), ["x"], ["level"])
        assert prep.getStatement() == alone.getStatement()



def test_rare_levels_in_one_pass(spark, tmp_dir):
    rows = [(i, level) for i, level in enumerate(["a"] * 30 + ["b"] * 3 + [None] * 4 + ["c"] * 10)]
    spark.createDataFrame(rows, "id int, level string").write.parquet(f"{tmp_dir}/rows")
    df = spark.read.parquet(f"{tmp_dir}/rows")
    few, many = collapse_rare(df, "level", 10), collapse_rare(df, "level", 10, most=1)
    want = sorted((i, level if level in (None, "a", "c") else "Other") for i, level in rows)
    assert sorted(map(tuple, few.collect())) == want == sorted(map(tuple, many.collect()))
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_a_prepared_table_is_written_by_small_methods(spark, tmp_dir, monkeypatch):
    from tierscope.plans import base
    from tierscope.session import METHOD_LIMIT

    name, limit = METHOD_LIMIT
    before, seen = spark.conf.get(name, None), []
    write = base.write_snapshot
    monkeypatch.setattr(base, "write_snapshot", lambda df, *rest: (seen.append(df.sparkSession.conf.get(name)), write(df, *rest)))
    out = base._materialized(spark, "small_methods", tmp_dir, base.CONFIG, lambda: spark.newSession().range(3).toDF("id"))
    assert seen == [limit] and spark.conf.get(name, None) == before and out.count() == 3


def test_a_prepared_table_is_made_by_small_scans(spark, tmp_dir, monkeypatch):
    from tierscope.plans import base
    from tierscope.session import SCAN_SIZE

    name, size = SCAN_SIZE
    before, seen = spark.conf.get(name, None), []
    write = base.write_snapshot
    monkeypatch.setattr(base, "write_snapshot", lambda df, *rest: (seen.append(df.sparkSession.conf.get(name)), write(df, *rest)))
    out = base._materialized(spark, "small_scans", tmp_dir, base.CONFIG, lambda: spark.newSession().range(3).toDF("id"))
    assert seen == [size] and spark.conf.get(name, None) == before and out.count() == 3


def test_vectors_of_a_fit_are_spread(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], float(i % 17), ["Budget", "Premium"][i % 17 > 8]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, level string, x double, price_category string").coalesce(1)
    assert M.spread(df, 600).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "VECTORS", 100)
    parts = M.spread(df, 600).rdd.glom().map(len).collect()
    assert len(parts) == 6 and sum(parts) == 600 and max(parts) <= 200
    seen, spread = [], M.spread
    monkeypatch.setattr(M, "spread", lambda rows, n: (out := spread(rows, n), seen.append(out.rdd.getNumPartitions()))[0])
    fitted = M.fit_candidate(M.candidates()["logistic_regression"], df, ["x"], ["level"])
    assert seen == [6] and fitted.pipeline.transform(df).where("prediction <> label_idx").count() < 30


def test_evaluation_holds_only_what_it_reads(spark, monkeypatch):
    rows = [(i, "wide " * 50, TIER_ORDER[i % 3], TIER_ORDER[i // 2 % 3], 0.2, 0.3, 0.5) for i in range(30)]
    frame = spark.createDataFrame(rows, ["id", "wide", "label", "prediction", *[f"score_{c}" for c in TIER_ORDER]])
    held, cache = [], type(frame).cache
    monkeypatch.setattr(M, "scored_frame", lambda model, test: frame)
    monkeypatch.setattr(type(frame), "cache", lambda self: held.append(self.columns) or cache(self))
    assert M.evaluate(None, None)["n"] == 30
    assert held == [["label", "prediction", *[f"score_{c}" for c in TIER_ORDER]]]
