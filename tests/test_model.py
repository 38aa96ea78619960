"""Model behaviour, persistence, batch + streaming scoring (reference test strategy §5)."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tierscope.plans import base
from tierscope.plans import model as M


def _train(spark):
    split, numeric, categorical = M.training_frame(base.features(spark, SF_SMALL))
    split = split.checkpoint()
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    return train, test, numeric, categorical


def test_empty_feature_dropped(spark):
    _, _, numeric, _ = _train(spark)
    assert "instant_bookable" not in numeric and "accommodates" in numeric


def test_selection_beats_baseline(spark):
    rows, fitted, best, _ = M.train_and_select(
        base.features(spark, SF_SMALL), names=("baseline_majority", "logistic_regression"), folds=2)
    assert best == "logistic_regression"
    by = {r["model"]: r for r in rows}
    assert by["logistic_regression"]["f1_macro"] > by["baseline_majority"]["f1_macro"]
    assert by["baseline_majority"]["roc_auc_ovr_macro"] == 0.5
    assert all(r["cv_folds"] == 2 for r in rows)


def test_unknown_candidate_raises(spark):
    import pytest
    with pytest.raises(ValueError, match="no candidate is called"):
        M.train_and_select(base.features(spark, SF_SMALL), names=("nope",), folds=2)


def test_scoring_probabilities_and_round_trip(spark, tmp_dir):
    train, test, numeric, categorical = _train(spark)
    model = M.fit_candidate(M.candidates()["logistic_regression"], train, numeric,
                            categorical)
    scored = M.score_batch(model, test).collect()
    for r in scored:
        assert abs(sum(r.probabilities.values()) - 1.0) < 1e-6
        assert abs(r.confidence - r.probabilities[r.tier]) < 1e-12
        assert r.band
    M.save_model(spark, model, tmp_dir + "/model")
    back = M.load_model(spark, tmp_dir + "/model")
    again = {r.id: r.tier for r in M.score_batch(back, test).collect()}
    assert again == {r.id: r.tier for r in scored}


def test_request_scoring_with_missing_optional_inputs(spark, tmp_dir):
    train, _, numeric, categorical = _train(spark)
    model = M.fit_candidate(M.candidates()["logistic_regression"], train, numeric,
                            categorical)
    req_dir = tmp_dir + "/requests"
    os.makedirs(req_dir)
    with open(req_dir + "/a.json", "w") as fh:
        fh.write(json.dumps({"request_id": "r1", "latitude": -33.89, "longitude": 151.27,
                             "neighbourhood_cleansed": "GERMANY", "room_type": "Entire home/apt",
                             "accommodates": 4, "amenities": '["Pool", "Wifi"]'}) + "\n")
        fh.write(json.dumps({"request_id": "r2", "latitude": -33.80, "longitude": 151.10,
                             "neighbourhood_cleansed": "Somewhere new"}) + "\n")
    from tierscope.sources.files import read_scoring_requests
    reqs = read_scoring_requests(spark, req_dir)
    out = M.score_batch(model, M.prepare_requests(reqs, model)).collect()
    assert {r.request_id for r in out} == {"r1", "r2"}
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-6 for r in out)

    from tierscope.streaming.scoring import start_scoring
    sink = tmp_dir + "/scored"
    q = start_scoring(spark, model, req_dir, sink, tmp_dir + "/stream", trigger_once=True)
    q.awaitTermination(120)
    assert {r.request_id for r in spark.read.parquet(sink).collect()} == {"r1", "r2"}


def test_a_restarted_stream_loses_nothing(spark, tmp_dir):
    """Two runs over one sink and checkpoint, one new file each."""
    from tierscope.streaming.scoring import start_scoring
    train, _, numeric, categorical = _train(spark)
    model = M.fit_candidate(M.candidates()["baseline_majority"], train, numeric, categorical)
    os.makedirs(tmp_dir + "/in")
    for run in ("a", "b", "c"):
        with open(f"{tmp_dir}/in/{run}.json", "w") as fh:
            fh.write(json.dumps({"request_id": run, "latitude": -33.8, "longitude": 151.1, "neighbourhood_cleansed": "x"}) + "\n")
        q = start_scoring(spark, model, tmp_dir + "/in", tmp_dir + "/out", tmp_dir + "/state", trigger_once=True)
        q.awaitTermination(120)
    assert sorted(r.request_id for r in spark.read.parquet(tmp_dir + "/out").collect()) == ["a", "b", "c"]


def test_every_candidate_is_saved_and_loaded(spark, tmp_dir):
    from dataclasses import replace

    from tierscope.config import CONFIG, Config
    cfg = Config(model=replace(CONFIG.model, forest_trees=3, forest_depth=4, boosting_rounds=2, boosting_depth=3))
    train, test, numeric, categorical = _train(spark)
    stages = M.feature_stages(train, numeric, categorical)
    for name, cand in M.candidates(cfg).items():
        model = M.fit_candidate(cand, train, numeric, categorical, cfg, stages)
        M.save_model(spark, model, f"{tmp_dir}/{name}", cfg)
        back = M.load_model(spark, f"{tmp_dir}/{name}")
        assert {(r.id, r.tier) for r in M.score_batch(back, test).collect()} == {(r.id, r.tier) for r in M.score_batch(model, test).collect()}


def test_location_required(spark):
    import pytest
    train, _, numeric, categorical = _train(spark)
    model = M.FittedModel("x", None, numeric=numeric, categorical=categorical)
    with pytest.raises(ValueError, match="latitude"):
        M.prepare_requests(spark.createDataFrame([("a",)], "neighbourhood_cleansed string"), model)


def test_end_to_end_jobs(spark, tmp_dir):
    from tierscope import jobs
    out = tmp_dir + "/run"
    res = jobs.run_all(spark, SF_SMALL, out, names=("baseline_majority", "logistic_regression"), folds=2)
    assert res["best_model"] == "logistic_regression"
    metrics = spark.read.json(out + "/reports/metrics")
    assert metrics.count() == 2 and metrics.where("selected").count() == 1
    row = metrics.where("selected").first()
    assert len(row.cv_scores) == 2 and len(row.per_class) == 3 and sum(c.n for c in row.confusion) == row.n
    assert json.loads(row.metadata)["snapshot_date"]
    imp = spark.read.json(out + "/reports/feature_importance")
    assert imp.count() > 0 and "importance" in imp.columns
    feats = spark.read.parquet(out + "/listings_features").limit(5).drop("snapshot_date")
    scored = jobs.score_job(spark, feats, out).collect()
    assert len(scored) == 5 and all(abs(sum(r.probabilities.values()) - 1) < 1e-6 for r in scored)


def test_forest_mtry_grid_on_exact_folds(spark):
    train, _, numeric, categorical = _train(spark)
    scores, best = M.tune_forest(train, numeric, categorical, mtry=(2, 4), trees=5)
    assert [m for m, _ in scores] == [2, 4]
    assert all(0.0 <= a <= 1.0 for _, a in scores)
    assert best.stages[-1].getNumTrees == 5
