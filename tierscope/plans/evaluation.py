"""Model evaluation as DataFrame jobs: confusion matrix, F1 family, kappa,
exact one-vs-rest AUC, ROC points and error analysis.

Input: a frame with ``label`` and ``prediction`` (tier strings) and, for
AUC, one score column per class (``score_<class>``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.operators.prefix import sums_before
from tierscope.config import TIER_ORDER


def _classes_frame(df: DataFrame, classes) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)], "idx int, cls string")


def confusion_matrix(pred: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """Dense (label, prediction, n) including zero cells."""
    counts = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    grid = (_classes_frame(pred, classes).select(F.col("cls").alias("label"))
            .select("label", F.explode(F.array(*[F.lit(c) for c in classes])).alias("prediction")))
    return (grid.join(counts, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n")))


def normalized_confusion(pred: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """Confusion counts divided by the row (actual class) total."""
    cm = confusion_matrix(pred, classes)
    return cm.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def per_class_metrics(pred: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """J20/J21 per class: tp, fp, fn, tn, support, precision, recall (sensitivity),
    specificity, f1; zero where undefined."""
    cm = confusion_matrix(pred, classes)
    n_total = pred.select(F.count(F.lit(1))).scalar()
    per = cm.groupBy("label").agg(
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    col_tot = cm.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    m = per.join(col_tot, "label").select(
        F.col("label").alias("class"), "tp", "support",
        (F.col("predicted") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"))
    m = m.withColumn("tn", n_total - F.col("tp") - F.col("fp") - F.col("fn"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return m.select(
        "class", "tp", "fp", "fn", "tn", "support",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def summary_metrics(pred: DataFrame, classes=TIER_ORDER, drop_undefined_f1: bool = False) -> DataFrame:
    """J20 + J21: accuracy, macro precision/recall/F1, Cohen's kappa, n.

    ``drop_undefined_f1`` follows the research notebooks (M14): classes whose
    F1 is undefined (no true, no predicted rows) leave the macro mean instead
    of counting as 0.
    """
    pc = per_class_metrics(pred, classes)
    defined = (2 * F.col("tp") + F.col("fp") + F.col("fn")) > 0
    f1 = F.when(defined, F.col("f1")) if drop_undefined_f1 else F.col("f1")
    agg = pc.agg(F.sum("tp").alias("_tp"), F.sum("support").alias("n"),
                 F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
                 F.avg(f1).alias("f1_macro"),
                 F.sum(F.col("support") * (F.col("tp") + F.col("fp"))).alias("_pe_num"))
    po = F.col("_tp") / F.col("n")
    pe = F.col("_pe_num") / (F.col("n") * F.col("n"))
    return agg.select(po.alias("accuracy"), "precision_macro", "recall_macro", "f1_macro",
                      F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(0.0)).alias("kappa"), "n")


def model_comparison(pred: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """One row for each ``model``: n, accuracy, chance, sensitivity, specificity, precision and F1 of each class
    (0 where undefined), their mean F1 and kappa."""
    cells = pred.groupBy("model", "label", "prediction").agg(F.count(F.lit(1)).alias("c"))

    def n(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("c"))), F.lit(0))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    total, label, said = F.sum("c"), F.col("label"), F.col("prediction")
    per = []
    for t in classes:
        tp, real, claimed = n((label == t) & (said == t)), n(label == t), n(said == t)
        per += [ratio(tp, real).alias(f"sensitivity_{t}"), ratio(total - real - claimed + tp, total - real).alias(f"specificity_{t}"),
                ratio(tp, claimed).alias(f"precision_{t}"), ratio(2 * tp, real + claimed).alias(f"f1_{t}")]
    chance = sum((n(label == t) * n(said == t) for t in classes[1:]), n(label == classes[0]) * n(said == classes[0])) / (total * total)
    out = cells.groupBy("model").agg(total.alias("n"), (n(label == said) / total).alias("accuracy"), chance.alias("chance"), *per)
    mean = sum((F.col(f"f1_{t}") for t in classes[1:]), F.col(f"f1_{classes[0]}")) / len(classes)
    return out.withColumn("f1_macro", mean).withColumn("kappa", (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance")))


def _score_long(pred: DataFrame, classes) -> DataFrame:
    """(class, score, pos, neg) collapsed to distinct scores per class."""
    long = pred.select("label", *[F.col(f"score_{c}").alias(c) for c in classes]) \
               .unpivot("label", list(classes), "class", "score")
    return long.groupBy("class", "score").agg(
        F.count_if(F.col("label") == F.col("class")).alias("pos"),
        F.count_if(F.col("label") != F.col("class")).alias("neg"))


def _cumulative(vc: DataFrame) -> DataFrame:
    """Running sums of pos/neg over scores *below* each distinct score, per class."""
    return sums_before(vc, ["class"], "score", {"pos_below": "pos", "neg_below": "neg"})


def auc_ovr(pred: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """Exact one-vs-rest ROC AUC per class (ties count one half) + macro mean row."""
    cum = _cumulative(_score_long(pred, classes))
    per = cum.groupBy("class").agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    per = per.select("class", F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                     F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))
    # Macro mean in fixed class order (a sum of k values, then / k).
    wide = per.groupBy().pivot("class", list(classes)).agg(F.first("auc"))
    total = F.lit(0.0)
    for c in classes:
        total = total + F.col(f"`{c}`")
    macro = wide.select(F.lit("macro").alias("class"), (total / len(classes)).alias("auc"))
    return per.unionByName(macro)


def roc_points(pred: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """(class, threshold, fpr, tpr) for every distinct score, thresholds '>= score'."""
    cum = _cumulative(_score_long(pred, classes))
    tot = cum.groupBy("class").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return cum.join(F.broadcast(tot), "class").select(
        "class", F.col("score").alias("threshold"),
        ((F.col("_n") - F.col("neg_below")) / F.col("_n")).alias("fpr"),
        ((F.col("_p") - F.col("pos_below")) / F.col("_p")).alias("tpr"))


def model_report(pred: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """One row: the summary, the per-class table and the confusion matrix as nested columns."""
    per = per_class_metrics(pred, classes)
    cells = confusion_matrix(pred, classes)
    return summary_metrics(pred, classes).select(
        "*",
        per.select(F.array_sort(F.collect_list(F.struct("class", "precision", "recall", "f1", "support")))).scalar().alias("per_class"),
        cells.select(F.array_sort(F.collect_list(F.struct("label", "prediction", "n")))).scalar().alias("confusion"))


def cv_summary(fold_metrics: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Per model: folds, mean and population std of a per-fold metric."""
    return fold_metrics.groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def misclassification_patterns(pred: DataFrame) -> DataFrame:
    """(actual, predicted) error counts and share of all errors, descending."""
    errs = pred.where(F.col("label") != F.col("prediction"))
    total = errs.select(F.count(F.lit(1))).scalar()
    return (errs.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
                .withColumn("share_of_errors", F.col("n") / total)
                .orderBy(F.desc("n"), "label", "prediction"))


def correct_vs_incorrect_means(pred: DataFrame, features: list[str]) -> DataFrame:
    """Mean of each feature for correctly vs incorrectly classified rows."""
    return (pred.withColumn("correct", F.col("label") == F.col("prediction"))
                .groupBy("correct").agg(*[F.avg(c).alias(f"mean_{c}") for c in features]))


def accuracy_by_class(pred: DataFrame) -> DataFrame:
    """Share correct within each actual class."""
    return pred.groupBy("label").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def tier_distance_errors(pred: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """Rows by |actual tier - predicted tier| (0 exact, 1 adjacent, 2 two-tier)."""
    order = F.array(*[F.lit(c) for c in classes])
    dist = F.abs(F.array_position(order, F.col("label")) - F.array_position(order, F.col("prediction")))
    counts = pred.groupBy(dist.cast("int").alias("tier_distance")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def pseudo_predictions(features: DataFrame) -> DataFrame:
    """A deterministic stand-in classifier (room type -> tier, capacity scores)
    so the evaluation jobs can be checked against SQL before any model exists."""
    acc = F.col("accommodates").cast("double")
    bed = F.coalesce(F.col("bedrooms"), F.lit(0.0))
    pred = (F.when(F.col("room_type") == "Entire home/apt", "Premium")
              .when(F.col("room_type") == "Hotel room", "Mid-Market").otherwise("Budget"))
    return features.select(
        "id", F.col("price_category").alias("label"), pred.alias("prediction"),
        (-acc).alias("score_Budget"), (-F.abs(acc - 4.0)).alias("score_Mid-Market"),
        (acc + bed).alias("score_Premium"), "accommodates", "bedrooms", "review_scores_rating",
        "distance_from_cbd_km", "amenities_count")
