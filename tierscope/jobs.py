"""End-to-end batch jobs: prepare -> train -> report -> score.

Plain functions over a SparkSession (the reference's command line is a
single-machine front end and is not rebuilt).  Every output lands under
``out`` (shared storage on a cluster); each job reads what the previous
one wrote, so a failed job restarts from the last written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.config import CONFIG, Config
from tierscope.plans import base
from tierscope.plans import model as M
from tierscope.plans.evaluation import model_report
from tierscope.sources.files import read_snapshot, write_json_report, write_snapshot


def prepare_job(spark: SparkSession, raw: DataFrame, out: str, cfg: Config = CONFIG) -> str:
    """Clean + features for one snapshot, written partitioned by snapshot date."""
    from tierscope.operators.clean import clean_listings
    from tierscope.operators.features import engineer_features
    path = f"{out}/listings_features"
    write_snapshot(engineer_features(clean_listings(raw, cfg), cfg), path, cfg.snapshot_date)
    return path


def train_job(spark: SparkSession, features_path: str, out: str, cfg: Config = CONFIG,
              names=None, folds: int | None = None) -> dict:
    """Cross-validate candidates, select, refit, test; save the winner and the metrics report."""
    feats = read_snapshot(spark, features_path, cfg.snapshot_date).drop("snapshot_date")
    rows, fitted, best, (train, test, _, _) = M.train_and_select(feats, cfg, names=names, folds=folds, keep=f"{out}/kept")
    M.save_model(spark, fitted[best], f"{out}/model", cfg, metrics=rows)
    # One row a candidate: fold scores, test figures, per-class table, confusion matrix and where they come from.
    stamp = M.artifact_metadata(spark, fitted[best], cfg).first()["metadata"]
    parts = []
    for r in rows:
        cv = spark.createDataFrame([(r["model"], r["cv_mean"], r["cv_std"], r["cv_scores"], r["roc_auc_ovr_macro"], r["selected"], stamp)],
                                   "model string, cv_mean double, cv_std double, cv_scores array<double>, roc_auc_ovr_macro double, "
                                   "selected boolean, metadata string")
        parts.append(cv.crossJoin(F.broadcast(model_report(M.scored_frame(fitted[r["model"]], test)))))   # one row each
    metrics = reduce(DataFrame.unionByName, parts)
    write_json_report(metrics, f"{out}/reports/metrics")
    return {"best_model": best, "metrics": rows}


def report_job(spark: SparkSession, features_path: str, out: str, cfg: Config = CONFIG,
               repeats: int = 5) -> DataFrame:
    """Permutation importance of the saved model on the same held-out split."""
    from tierscope.plans.importance import permutation_importance
    feats = read_snapshot(spark, features_path, cfg.snapshot_date).drop("snapshot_date")
    split, _, _ = M.training_frame(feats, cfg)
    test = split.where(F.col("split") == "test")
    imp = permutation_importance(M.load_model(spark, f"{out}/model"), test, repeats=repeats)
    write_json_report(imp, f"{out}/reports/feature_importance")
    return spark.read.json(f"{out}/reports/feature_importance")


def score_job(spark: SparkSession, requests: DataFrame, out: str, cfg: Config = CONFIG) -> DataFrame:
    """Batch scoring (J17) of raw-ish or engineered listings with the saved model."""
    model = M.load_model(spark, f"{out}/model")
    return M.score_batch(model, M.prepare_requests(requests, model, cfg), cfg)


def run_all(spark: SparkSession, sf_dir: str, out: str, cfg: Config = CONFIG, names=None,
            folds: int | None = None) -> dict:
    path = prepare_job(spark, base.loaded(spark, sf_dir), out, cfg)
    result = train_job(spark, path, out, cfg, names=names, folds=folds)
    report_job(spark, path, out, cfg)
    return result
