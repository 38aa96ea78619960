"""Price-tier models on Spark MLlib: preprocessing, candidates, selection, scoring.

Preprocessing is fitted on the training split only and expressed as
standard pipeline stages, so the fitted ``PipelineModel`` persists and
serves as one object:

* numeric: median imputation (exact medians) and population-std scaling,
  emitted as one fitted ``SQLTransformer`` (``Imputer`` takes an element
  rather than the midpoint, ``StandardScaler`` uses sample std);
* categorical: mode imputation (ties -> smallest) in the same statement,
  then ``StringIndexer(handleInvalid="keep")`` + ``OneHotEncoder(dropLast=True)``
  so an unseen level becomes an all-zero vector;
* ``VectorAssembler`` into ``features``; label index is alphabetical.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.config import CONFIG, TIER_ORDER, Config
from tierscope.functions.buckets import tier_band
from tierscope.functions.hashing import HASH_BITS, stable_hash
from tierscope.plans import trees as T
from tierscope.plans.kernel_map import KernelMap


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v)) + "D"


def fit_preprocess(train: DataFrame, numeric: list[str], categorical: list[str]) -> SQLTransformer:
    """Fitted statistics: exact medians, means, population stds and modes.

    Medians of all numeric inputs come from one bucketed exact-quantile job
    over the unpivoted columns (no single buffer holding every distinct
    value of a continuous column); modes are one aggregation.
    """
    from tierscope.config import CONTINUOUS_FEATURES
    from tierscope.operators.quantiles import exact_quantiles
    row = {}
    continuous = [c for c in numeric if c in CONTINUOUS_FEATURES]
    bounded = [c for c in numeric if c not in CONTINUOUS_FEATURES]
    if continuous:
        long = train.select(*[F.col(c).cast("double").alias(c) for c in continuous]).unpivot(
            [], continuous, "_col", "_val")
        for r in exact_quantiles(long, ["_col"], "_val", {"_m": 0.5}).collect():
            row[f"med_{r['_col']}"] = r["_m"]
    simple = [F.median(F.col(c).cast("double")).alias(f"med_{c}") for c in bounded] + \
        [F.mode(F.col(c), True).alias(f"mode_{c}") for c in categorical]
    if simple:
        row.update(train.agg(*simple).first().asDict())
    for c in numeric:
        row.setdefault(f"med_{c}", None)
    # Scaling statistics are taken after imputation, as the fitted pipeline sees them.
    imputed = [F.coalesce(F.col(c).cast("double"), F.lit(row[f"med_{c}"])).alias(c) for c in numeric]
    stats = train.select(*imputed).agg(
        *[F.avg(c).alias(f"mu_{c}") for c in numeric],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in numeric]).first() if numeric else None
    return _preprocess(row | (stats.asDict() if stats else {}), numeric, categorical)


def _preprocess(row: dict, numeric: list[str], categorical: list[str]) -> SQLTransformer:
    """The statement of fitted statistics: med_, mu_ and sd_ of numeric inputs, mode_ of the others."""
    parts = []
    for c in numeric:
        mu, sd = row[f"mu_{c}"], row[f"sd_{c}"]
        scale = sd if sd and sd > 0 else 1.0
        parts.append(f"(coalesce(CAST({_q(c)} AS DOUBLE), {_lit(row[f'med_{c}'])}) - {_lit(mu)}) "
                     f"/ {_lit(scale)} AS {_q('num__' + c)}")
    for c in categorical:
        parts.append(f"coalesce(CAST({_q(c)} AS STRING), {_lit(row[f'mode_{c}'])}) AS {_q('cat__' + c)}")
    return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")


def fit_fold_preprocess(train: DataFrame, numeric: list[str], categorical: list[str], folds: int) -> list[SQLTransformer]:
    """``fit_preprocess`` of the rows outside each fold, for all folds together.

    Every distinct value is counted once, with its rows outside each fold; the
    counts in order say where each fold's median lies.  Means and deviations
    follow from the sums of the other folds, the median standing in for nulls.
    """
    from tierscope.operators.prefix import sums_before
    from tierscope.session import checkpoint_dir

    def counted(columns, kind):
        long = train.select("fold", *[F.col(c).cast(kind).alias(c) for c in columns]).unpivot(["fold"], columns, "_col", "_val")
        outside = [F.count_if(F.col("fold") != k).alias(f"_g{k}") for k in range(folds)]
        return long.where(F.col("_val").isNotNull()).groupBy("_col", "_val").agg(*outside)

    checkpoint_dir(train.sparkSession)
    rows = [{f"{s}_{c}": None for s in ("med", "mu", "sd") for c in numeric} | {f"mode_{c}": None for c in categorical} for _ in range(folds)]
    if categorical:
        most = [F.min_by("_val", F.when(F.col(f"_g{k}") > 0, F.struct(-F.col(f"_g{k}"), "_val"))).alias(f"m{k}") for k in range(folds)]
        for r in counted(categorical, "string").groupBy("_col").agg(*most).collect():
            for k in range(folds):
                rows[k][f"mode_{r['_col']}"] = r[f"m{k}"]
    if numeric:
        values = counted(numeric, "double").checkpoint()
        totals = values.groupBy("_col").agg(*[F.sum(f"_g{k}").alias(f"_n{k}") for k in range(folds)])   # a row a column
        placed = sums_before(values, ["_col"], "_val", {f"_b{k}": f"_g{k}" for k in range(folds)}).join(F.broadcast(totals), "_col")

        def at(k, rank):
            return F.max(F.when((F.col(f"_b{k}") <= rank) & (rank < F.col(f"_b{k}") + F.col(f"_g{k}")), F.col("_val")))

        ends = [x for k in range(folds) for x in (at(k, F.expr(f"(_n{k} - 1) div 2")).alias(f"lo{k}"), at(k, F.expr(f"_n{k} div 2")).alias(f"hi{k}"))]
        for r in placed.groupBy("_col").agg(*ends).collect():
            for k in range(folds):
                lo, hi = r[f"lo{k}"], r[f"hi{k}"]
                rows[k][f"med_{r['_col']}"] = lo if lo is None or lo == hi else lo + (hi - lo) * 0.5
        x = {c: F.col(c).cast("double") for c in numeric}
        moments = [f(x[c]).alias(f"{n}_{c}") for c in numeric for n, f in (("n", F.count), ("avg", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))]
        found = train.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *moments).collect()   # a row a fold
        for k in range(folds):
            for c in numeric:
                rows[k][f"mu_{c}"], rows[k][f"sd_{c}"] = _pooled([r for r in found if r["fold"] is not None and r["fold"] != k], c, rows[k][f"med_{c}"])
    return [_preprocess(row, numeric, categorical) for row in rows]


def _pooled(parts: list, c: str, med: float | None) -> tuple[float | None, float | None]:
    """Mean and population deviation of a column over parts, nulls at the median."""
    if med is None:
        return None, None
    groups = [(r[f"n_{c}"], r[f"avg_{c}"], r[f"var_{c}"], r[f"min_{c}"], r[f"max_{c}"]) for r in parts if r[f"n_{c}"]]
    missing = sum(r["rows"] - r[f"n_{c}"] for r in parts)
    groups += [(missing, med, 0.0, med, med)] if missing else []
    if min(g[3] for g in groups) == max(g[4] for g in groups):   # a sum's rounding is no deviation
        return groups[0][3], 0.0
    n = sum(g[0] for g in groups)
    mu = sum(g[0] * g[1] for g in groups) / n
    return mu, (sum(g[0] * (g[2] + (g[1] - mu) ** 2) for g in groups) / n) ** 0.5


def numeric_statistics(prep: SQLTransformer, numeric: list[str]) -> tuple[dict, dict, dict]:
    """Median, mean and deviation of each input, read from the fitted statement."""
    import re
    med, mean, std = {}, {}, {}
    for c in numeric:
        m = re.search(r"\(coalesce\(CAST\(" + re.escape(_q(c)) + r" AS DOUBLE\), (\S+)\) - (\S+)\) / (\S+) AS", prep.getStatement())
        med[c], mean[c], std[c] = (None if x == "NULL" else float(x.rstrip("D")) for x in m.groups())
    return med, mean, std


def feature_stages(train: DataFrame, numeric: list[str], categorical: list[str], prep: SQLTransformer | None = None) -> list:
    """``prep``: statistics fitted on ``train`` already."""
    prep = prep or fit_preprocess(train, numeric, categorical)
    # One multi-column indexer: every vocabulary is fitted in a single pass.
    idx = [StringIndexer(inputCols=[f"cat__{c}" for c in categorical],
                         outputCols=[f"idx__{c}" for c in categorical], handleInvalid="keep")] \
        if categorical else []
    ohe = OneHotEncoder(inputCols=[f"idx__{c}" for c in categorical],
                        outputCols=[f"ohe__{c}" for c in categorical], dropLast=True, handleInvalid="error")
    asm = VectorAssembler(inputCols=[f"num__{c}" for c in numeric] + [f"ohe__{c}" for c in categorical],
                          outputCol="features")
    label = StringIndexer(inputCol="price_category", outputCol="label_idx", stringOrderType="alphabetAsc")
    return [prep, *idx, ohe, asm, label]


# --------------------------------------------------------------------------- candidates
def class_weights(train: DataFrame, label: str = "price_category") -> Column:
    """Balanced weights n / (k * n_c) as a literal map lookup (k classes, tiny)."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for cl, cnt in counts.items() for x in (F.lit(cl), F.lit(n / (k * cnt)))])
    return m[F.col(label)]


@dataclass
class Candidate:
    name: str
    estimator: object | None   # None -> a baseline (majority, or class-proportional random)
    ovr_margin: bool = False   # OneVsRest raw margins -> probabilities
    weighted: bool = False
    random_baseline: bool = False
    penalised: bool = False    # the penalty is one over the rows of the fit
    curved: bool = False       # on a random feature map of the RBF kernel
    ensemble: bool = False     # trees that are trained piece by piece (``plans.trees``)


def candidates(cfg: Config = CONFIG) -> dict:
    m, seed = cfg.model, cfg.model.random_state
    lr = LogisticRegression(featuresCol="features", labelCol="label_idx", family="multinomial",
                            elasticNetParam=0.0, standardization=False, maxIter=m.logistic_iterations, tol=1e-6)
    rf = RandomForestClassifier(featuresCol="features", labelCol="label_idx", numTrees=m.forest_trees,
                                minInstancesPerNode=2, maxDepth=m.forest_depth, weightCol="weight", seed=seed,
                                featureSubsetStrategy="sqrt")
    boosting = T.Boosting(rounds=m.boosting_rounds, depth=m.boosting_depth, seed=seed)
    nb = NaiveBayes(featuresCol="features", labelCol="label_idx", modelType="gaussian")
    svm = OneVsRest(classifier=LinearSVC(maxIter=100, regParam=0.01), featuresCol="features",
                    labelCol="label_idx", parallelism=3)
    return {
        "baseline_majority": Candidate("baseline_majority", None),
        "baseline_random": Candidate("baseline_random", None, random_baseline=True),
        "logistic_regression": Candidate("logistic_regression", lr, penalised=True),
        "random_forest": Candidate("random_forest", rf, weighted=True, ensemble=True),
        "gradient_boosting": Candidate("gradient_boosting", boosting, ensemble=True),
        "naive_bayes": Candidate("naive_bayes", nb),
        "linear_svm": Candidate("linear_svm", svm, ovr_margin=True),
        "rbf_svm": Candidate("rbf_svm", svm, ovr_margin=True, curved=True),
    }


@dataclass
class FittedModel:
    name: str
    pipeline: PipelineModel
    majority: str | None = None
    class_shares: list[float] | None = None   # class-proportional random baseline (tier order)
    seed: int = CONFIG.model.random_state
    ovr_margin: bool = False
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    trees: T.Trees | None = None
    margins: bool = False                    # the trees' sums are margins of a softmax, not probabilities
    importances: list[float] | None = None   # of the trees' inputs
    head: object | None = None               # a model of mapped rows (``kernel``), after the pipeline
    kernel: KernelMap | None = None


def fit_candidate(cand: Candidate, train: DataFrame, numeric: list[str], categorical: list[str],
                  cfg: Config = CONFIG, stages: list | None = None, classes=TIER_ORDER, folder: str | None = None,
                  key: str = "id") -> FittedModel:
    """``stages``: preprocessing fitted on ``train`` already, to share among candidates.

    ``folder``: where an ensemble keeps its pieces; a fit of the same rows that was cut off goes on there.
    """
    stages = feature_stages(train, numeric, categorical) if stages is None else stages
    if cand.estimator is None:
        counts = {r[0]: r[1] for r in train.groupBy("price_category").count().collect()}   # <= k rows
        model = Pipeline(stages=stages).fit(train)
        if cand.random_baseline:
            total = sum(counts.values())
            shares = [counts.get(c, 0) / total for c in classes]
            return FittedModel(cand.name, model, class_shares=shares, seed=cfg.model.random_state,
                               numeric=numeric, categorical=categorical)
        majority = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        return FittedModel(cand.name, model, majority=majority, numeric=numeric, categorical=categorical)
    data = train.withColumn("weight", class_weights(train)) if cand.weighted else train
    if cand.ensemble:
        return _fit_ensemble(cand, data, numeric, categorical, stages, classes, folder or scratch(train.sparkSession, "trees"), key)
    if cand.curved:
        return _fit_curved(cand, data, numeric, categorical, stages)
    n = train.count()
    estimator = cand.estimator.copy({cand.estimator.regParam: 1.0 / max(n, 1)}) if cand.penalised else cand.estimator
    pipeline = Pipeline(stages=stages).fit(data)
    head = estimator.fit(spread(pipeline.transform(data).select("features", "label_idx"), n))
    model = PipelineModel([*pipeline.stages, head])
    return FittedModel(cand.name, model, ovr_margin=cand.ovr_margin, numeric=numeric, categorical=categorical)


VECTORS = 250_000   # of a task of a fit, about


def spread(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (n of them) in enough partitions that a task of each pass of a fit holds about ``VECTORS``; few rows stay where they lie.

    Files are packed by their compressed size, which says little of the
    vectors that a fit holds.
    """
    parts = -(-n // VECTORS)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def scratch(spark, name: str) -> str:
    """A new folder's path beside the session's checkpoints."""
    import uuid

    from tierscope.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/tierscope_{name}/{uuid.uuid4().hex}"


def _fit_curved(cand: Candidate, data: DataFrame, numeric, categorical, stages: list) -> FittedModel:
    pipeline = Pipeline(stages=stages).fit(data)
    rows = pipeline.transform(data).select("features", "label_idx")
    kernel = KernelMap(len(rows.select(vector_to_array("features")).first()[0]))
    # Mapped once: every pass of the fits reads finished vectors.
    path = scratch(data.sparkSession, "vectors")
    kernel.mapped(rows).write.parquet(path)
    head = cand.estimator.fit(data.sparkSession.read.parquet(path))
    return FittedModel(cand.name, pipeline, ovr_margin=True, numeric=numeric, categorical=categorical, head=head, kernel=kernel)


def _fit_ensemble(cand: Candidate, data: DataFrame, numeric, categorical, stages: list, classes, folder: str, key: str) -> FittedModel:
    pipeline = Pipeline(stages=stages).fit(data)
    # Every pass of the fit reads assembled vectors.
    path = scratch(data.sparkSession, "vectors")
    pipeline.transform(data).select(F.col(key).alias("key"), "features", "label_idx", *["weight"] * cand.weighted).write.parquet(path)
    vectors = data.sparkSession.read.parquet(path)
    out = FittedModel(cand.name, pipeline, numeric=numeric, categorical=categorical)
    if isinstance(cand.estimator, T.Boosting):
        out.trees, out.margins = T.fit_boosting(vectors, cand.estimator, folder, len(classes)), True
    else:
        parts = T.fit_forest(vectors, cand.estimator, folder, T.part_size(cand.estimator.getMaxDepth()))
        out.trees, out.importances = T.forest_trees(data.sparkSession, parts), T.forest_importances(data.sparkSession, parts).tolist()
    return out


def predict(model: FittedModel, df: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """Adds ``prediction`` (tier), ``probability`` array (tier order) and ``score_<tier>``.

    The label index is alphabetical, which equals tier order.  One-vs-rest
    margins become probabilities as sigmoid(2 * margin) normalised over
    classes; ties in argmax go to the first class.
    """
    out = model.pipeline.transform(df)
    if model.head is not None:
        out = model.head.transform(model.kernel.mapped(out))
    k = len(classes)
    if model.class_shares is not None:
        # Probabilities are the class shares; the predicted class is drawn by a
        # seeded hash of the id (uniform in [0, 1), reproducible under any
        # partitioning) against the cumulative shares.
        probs = F.array(*[F.lit(float(p)) for p in model.class_shares])
        u = stable_hash("id", model.seed) / F.lit(float(1 << HASH_BITS))
        cum, draw = 0.0, None
        for c, p in zip(classes, model.class_shares):
            cum += p
            draw = F.when(u < cum, F.lit(c)) if draw is None else draw.when(u < cum, F.lit(c))
        draw = draw.otherwise(F.lit(classes[-1]))
        out = out.withColumn("_p", probs)
        cols = [c for c in df.columns]
        return out.select(*cols, draw.alias("prediction"), F.col("_p").alias("probability"),
                          *[F.col("_p")[i].alias(f"score_{classes[i]}") for i in range(k)])
    if model.majority is not None:
        probs = F.array(*[F.lit(1.0 if c == model.majority else 0.0) for c in classes])
    elif model.trees is not None:
        out = out.withColumn("_m", T.summed(model.trees, df.sparkSession)(vector_to_array(F.col("features"))))
        probs = F.array(*T.softmax([F.col("_m")[i] for i in range(k)])) if model.margins else F.col("_m")
    elif model.ovr_margin:
        raw = vector_to_array(F.col("rawPrediction"))
        sig = F.transform(raw, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
        probs = F.transform(sig, lambda p: p / F.aggregate(sig, F.lit(0.0), lambda a, b: a + b))
    else:
        probs = vector_to_array(F.col("probability"))
    out = out.withColumn("_p", probs)
    best = F.array_position(F.col("_p"), F.array_max(F.col("_p")))
    tiers = F.array(*[F.lit(c) for c in classes])
    out = out.withColumn("prediction_tier", F.element_at(tiers, best.cast("int")))
    cols = [c for c in df.columns]
    return out.select(*cols, F.col("prediction_tier").alias("prediction"), F.col("_p").alias("probability"),
                      *[F.col("_p")[i].alias(f"score_{classes[i]}") for i in range(k)])


def scored_frame(model: FittedModel, df: DataFrame, classes=TIER_ORDER) -> DataFrame:
    """Evaluation input: label, prediction and per-class scores."""
    return predict(model, df, classes).withColumnRenamed("price_category", "label")


def score_batch(model: FittedModel, df: DataFrame, cfg: Config = CONFIG, classes=TIER_ORDER) -> DataFrame:
    """Tier, band, probabilities map and confidence for a DataFrame of any size."""
    t = cfg.target
    p = predict(model, df, classes)
    probs = F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.col("probability"))
    return p.select(*[c for c in df.columns if c in ("id", "request_id")],
                    F.col("prediction").alias("tier"),
                    tier_band(F.col("prediction"), t.budget_max, t.mid_market_max).alias("band"),
                    probs.alias("probabilities"),
                    F.array_max("probability").alias("confidence"))


# --------------------------------------------------------------------------- training jobs
def training_frame(features: DataFrame, cfg: Config = CONFIG):
    """Usable feature lists (F13) and the split-annotated frame (J1 + J4)."""
    from tierscope.operators.features import model_inputs, usable_features
    from tierscope.operators.split import stratified_split
    numeric, categorical = model_inputs(cfg)
    numeric, categorical, _ = usable_features(features, numeric, categorical)
    split = stratified_split(features, test_size=cfg.model.test_size, seed=cfg.model.random_state,
                             folds=cfg.model.cv_folds)
    return split, numeric, categorical


def written_split(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, read back from one table partitioned by split and fold.

    Every pass of the fits then reads the columns it needs and only its folds.
    """
    import uuid

    from tierscope.session import checkpoint_dir
    spark = split.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tierscope_split/{uuid.uuid4().hex}"
    split.write.partitionBy("split", "fold").parquet(path)
    back = spark.read.schema(split.schema).parquet(path)
    return back.where(F.col("split") == "train"), back.where(F.col("split") == "test")


def evaluate(model: FittedModel, test: DataFrame) -> dict:
    """J20 + J22 on a split: accuracy, macro P/R/F1, kappa, macro AUC, n (one small row each)."""
    from tierscope.plans.evaluation import auc_ovr, summary_metrics
    scored = scored_frame(model, test).select("label", "prediction", *[f"score_{c}" for c in TIER_ORDER]).cache()
    m = summary_metrics(scored).first().asDict()
    m["roc_auc_ovr_macro"] = auc_ovr(scored).where(F.col("class") == "macro").first()["auc"]
    scored.unpersist()
    return m


def fold_stages(train: DataFrame, numeric, categorical, folds: int) -> list[list]:
    """Preprocessing fitted on the training rows outside each fold, to share among candidates."""
    preps = fit_fold_preprocess(train, numeric, categorical, folds)
    return [feature_stages(train.where(F.col("fold") != k), numeric, categorical, prep) for k, prep in enumerate(preps)]


def cross_validate(cand: Candidate, train: DataFrame, numeric, categorical, folds: int, cfg: Config = CONFIG,
                   parallelism: int | None = None, stages: list[list] | None = None) -> list[float]:
    """Macro F1 per fold; preprocessing is refitted inside every fold.

    Folds are independent, so their jobs are submitted concurrently (as
    MLlib's ``CrossValidator(parallelism=...)`` does); results keep fold order.
    """
    from concurrent.futures import ThreadPoolExecutor

    stages = stages or fold_stages(train, numeric, categorical, folds)

    def one(k: int) -> float:
        fit_part = train.where(F.col("fold") != k)
        val_part = train.where(F.col("fold") == k)
        return macro_f1(scored_frame(fit_candidate(cand, fit_part, numeric, categorical, cfg, stages[k]), val_part))
    with ThreadPoolExecutor(max_workers=parallelism or folds) as pool:
        return list(pool.map(one, range(folds)))


def macro_f1(scored: DataFrame, classes=TIER_ORDER) -> float:
    """Macro F1 from the k x k confusion counts (one job; at most k^2 rows reach the driver)."""
    cells = {(r[0], r[1]): r[2] for r in scored.groupBy("label", "prediction").count().collect()}
    f1s = []
    for c in classes:
        tp = cells.get((c, c), 0)
        fp = sum(v for (a, p), v in cells.items() if p == c and a != c)
        fn = sum(v for (a, p), v in cells.items() if a == c and p != c)
        f1s.append(2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0)
    return sum(f1s) / len(f1s)


def train_and_select(features: DataFrame, cfg: Config = CONFIG, names=None, folds: int | None = None, keep: str | None = None):
    """Cross-validate each candidate on the training split, refit, test once;
    the winner is the best CV macro F1 excluding the baselines.

    ``keep``: a folder for fold scores, fitted models and the pieces of
    ensembles; a run of the same rows and settings goes on from what is there.
    """
    import statistics

    from tierscope.plans.kept import fingerprint, kept, kept_table
    split, numeric, categorical = training_frame(features, cfg)
    train, test = written_split(split)
    spark, reg = features.sparkSession, candidates(cfg)
    names = list(names or cfg.model.candidates)
    folds = folds or cfg.model.cv_folds
    keep = keep or scratch(spark, "kept")
    key = fingerprint(train.unionByName(test), cfg, folds)
    shared = None
    whole = feature_stages(train, numeric, categorical)
    rows, fitted = [], {}
    for name in names:
        if name not in reg:
            raise ValueError(f"no candidate is called {name!r}; there are {', '.join(reg)}")

        def scores(name=name):
            nonlocal shared
            shared = shared or fold_stages(train, numeric, categorical, folds)
            found = cross_validate(reg[name], train, numeric, categorical, folds, cfg, stages=shared)
            return spark.createDataFrame(list(enumerate(found)), "fold int, f1_macro double")

        def fit(folder, name=name):
            pieces = f"{keep}/pieces-{name}/{key}"
            save_model(spark, fit_candidate(reg[name], train, numeric, categorical, cfg, whole, folder=pieces), folder, cfg)

        cv = [r["f1_macro"] for r in kept_table(spark, keep, f"cv-{name}", key, scores).orderBy("fold").collect()]
        model = kept(spark, keep, f"model-{name}", key, fit, lambda folder: load_model(spark, folder))
        fitted[name] = model
        t = evaluate(model, test)
        rows.append({"model": name, "cv_mean": statistics.fmean(cv), "cv_std": statistics.pstdev(cv),
                     "cv_folds": len(cv), "cv_scores": [float(x) for x in cv], **{k: float(v) for k, v in t.items()}})
    contenders = [r for r in rows if not r["model"].startswith("baseline_")]
    best = max(contenders, key=lambda r: r["cv_mean"])["model"] if contenders else names[0]
    best_test = max(rows, key=lambda r: r["accuracy"])["model"]   # J16: research rule
    for r in rows:
        r["selected"] = r["model"] == best
        r["best_test_accuracy"] = r["model"] == best_test
    return rows, fitted, best, (train, test, numeric, categorical)


def input_importances(model: FittedModel) -> list[tuple[str, float]]:
    """Tree importances mapped back through the assembler to input columns."""
    if model.importances is None:
        return []
    imp = model.importances
    out, pos = {}, 0
    for c in model.numeric:
        out[c] = out.get(c, 0.0) + float(imp[pos])
        pos += 1
    vocab = category_labels(model)
    for c in model.categorical:
        width = len(vocab.get(c, []))   # dropLast removes the unseen slot: one column per known level
        out[c] = out.get(c, 0.0) + float(sum(imp[pos:pos + width]))
        pos += width
    return sorted(out.items(), key=lambda kv: -kv[1])


def category_labels(model: FittedModel) -> dict[str, list[str]]:
    """Fitted vocabulary per categorical input, from the multi-column indexer."""
    from pyspark.ml.feature import StringIndexerModel
    for st in model.pipeline.stages:
        if isinstance(st, StringIndexerModel) and st.isSet("outputCols"):
            outs = st.getOutputCols()
            return {o[len("idx__"):]: list(lab) for o, lab in zip(outs, st.labelsArray)}
    return {}


# --------------------------------------------------------------------------- linear discriminant
def lda_statistics(train: DataFrame, columns: list[str], label: str = "price_category") -> tuple[DataFrame, DataFrame]:
    """(label, n, class means) and (a, b, value), the pooled within-class covariance.

    Two distributed passes: one grouped aggregate, one sum of centred
    products.  Rows with a missing input are left out.
    """
    data = train.select(label, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    means = data.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
    # One row a class.
    centred = data.join(F.broadcast(means.select(label, *[F.col(c).alias(f"_m_{c}") for c in columns])), label)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    df = F.greatest(F.count(F.lit(1)) - F.count_distinct(label), F.lit(1))
    row = centred.agg(*[(F.sum((F.col(a) - F.col(f"_m_{a}")) * (F.col(b) - F.col(f"_m_{b}"))) / df).alias(f"{i}")
                        for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("value")) for i, (a, b) in enumerate(pairs)])
    return means, row.select(F.explode(cells).alias("c")).select("c.*")


def fit_lda(train: DataFrame, columns: list[str], label: str = "price_category", classes=TIER_ORDER):
    """Weights and offset of each class's linear score; the p x p solve happens on the driver."""
    import numpy as np
    means, cov = lda_statistics(train, columns, label)
    mrows = {r[label]: r for r in means.collect()}
    at = {c: i for i, c in enumerate(columns)}
    m = np.zeros((len(columns), len(columns)))
    for r in cov.collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["value"]
    inv, n = np.linalg.pinv(m), sum(r["n"] for r in mrows.values())
    coefs = {}
    for cl in classes:
        if cl in mrows:
            mu = np.array([mrows[cl][c] for c in columns])
            w = inv @ mu
            coefs[cl] = (w.tolist(), -0.5 * float(mu @ w) + float(np.log(mrows[cl]["n"] / n)))
    return coefs


def lda_predict(coefs: dict, df: DataFrame, columns: list[str], medians: dict | None = None,
                classes=TIER_ORDER) -> DataFrame:
    """Linear discriminant scores -> softmax probabilities, argmax tier."""
    def val(c):
        x = F.col(c).cast("double")
        return F.coalesce(x, F.lit(medians[c])) if medians else x
    scores = []
    for cl in classes:
        w, b = coefs[cl]
        s = F.lit(b)
        for c, wi in zip(columns, w):
            s = s + F.lit(wi) * val(c)
        scores.append(s)
    arr = F.array(*scores)
    mx = F.array_max(arr)
    ex = F.transform(arr, lambda s: F.exp(s - mx))
    probs = F.transform(ex, lambda e: e / F.aggregate(ex, F.lit(0.0), lambda a, b2: a + b2))
    tiers = F.array(*[F.lit(c) for c in classes])
    out = df.withColumn("_p", probs)
    return out.select(*df.columns,
                      F.element_at(tiers, F.array_position(F.col("_p"), F.array_max(F.col("_p"))).cast("int"))
                      .alias("prediction"),
                      *[F.col("_p")[i].alias(f"score_{classes[i]}") for i in range(len(classes))])


# --------------------------------------------------------------------------- persistence
def artifact_metadata(spark, model: FittedModel, cfg: Config = CONFIG, metrics: list[dict] | None = None) -> DataFrame:
    """One-row metadata frame: model, snapshot, timestamp, versions, metrics (JSON)."""
    import datetime
    import json
    import platform

    import pyspark

    from tierscope import __version__
    meta = {
        "best_model": model.name, "majority": model.majority, "ovr_margin": model.ovr_margin,
        "class_shares": model.class_shares, "seed": model.seed,
        "trees": model.trees is not None, "margins": model.margins, "importances": model.importances,
        "kernel": model.kernel.described() if model.kernel else None,
        "numeric_features": model.numeric, "categorical_features": model.categorical,
        "snapshot_date": cfg.snapshot_date,
        "trained_at": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"),
        "versions": {"tierscope": __version__, "python": platform.python_version(),
                     "pyspark": pyspark.__version__},
        "metrics": metrics or [],
    }
    return spark.createDataFrame([(json.dumps(meta),)], "metadata string")


def save_model(spark, model: FittedModel, path: str, cfg: Config = CONFIG, metrics=None) -> None:
    """Fitted pipeline via MLlib persistence + metadata as a JSON-lines file."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    if model.trees is not None:
        T.save_trees(spark, model.trees, f"{path}/trees")
    if model.head is not None:
        model.head.write().overwrite().save(f"{path}/head")
    artifact_metadata(spark, model, cfg, metrics).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark, path: str) -> FittedModel:
    import json
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
    return FittedModel(meta["best_model"], PipelineModel.load(f"{path}/pipeline"), majority=meta["majority"],
                       class_shares=meta["class_shares"], seed=meta["seed"], ovr_margin=meta["ovr_margin"], numeric=meta["numeric_features"],
                       categorical=meta["categorical_features"], trees=T.load_trees(spark, f"{path}/trees") if meta["trees"] else None,
                       margins=meta["margins"], importances=meta["importances"],
                       head=OneVsRestModel.load(f"{path}/head") if meta["kernel"] else None,
                       kernel=KernelMap(**meta["kernel"]) if meta["kernel"] else None)


def stored_property_levels(model: FittedModel) -> list[str]:
    """The training vocabulary for property types, as kept by the fitted indexer (M7)."""
    return [x for x in category_labels(model).get("property_type", []) if x != "Other"]


# What a request must say, and what stands in for the rest, before features are derived.
_REQUIRED = ("latitude", "longitude", "neighbourhood_cleansed")


def _with_defaults(df: DataFrame, schema: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Every column of ``schema`` (name -> type, value if absent or null), beside the other columns."""
    def column(name):
        kind, value = schema[name]
        given = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return given if value is None else F.coalesce(given, F.lit(value).cast(kind))

    return df.withColumns({name: column(name) for name in schema})


_RAW_INPUTS = {"amenities": ("string", "[]"), "property_type": ("string", None), "accommodates": ("double", None),
               "host_listings_count": ("double", None)}


def prepare_requests(requests: DataFrame, model: FittedModel, cfg: Config = CONFIG,
                     property_levels: list[str] | None = None) -> DataFrame:
    """J17 input handling: rows that have no features yet get them, then every input of the model exists.

    Features need a place; the tier that the label stage expects is a stand-in.
    """
    from tierscope.operators.features import engineer_features
    df = requests
    if "distance_from_cbd_km" not in df.columns:
        absent = [c for c in _REQUIRED if c not in df.columns]
        if absent:
            raise ValueError(f"requests lack {', '.join(absent)}: no place, no location features")
        levels = stored_property_levels(model) if property_levels is None else property_levels
        df = engineer_features(_with_defaults(df, _RAW_INPUTS), cfg, property_levels=levels)
    return _with_defaults(df, {c: ("double", None) for c in model.numeric} | {c: ("string", None) for c in model.categorical}
                          | {"price_category": ("string", TIER_ORDER[0])})


def tune_forest(train: DataFrame, numeric: list[str], categorical: list[str], mtry=(4, 6, 9),
                trees: int = 500, depth: int = CONFIG.model.forest_depth, seed: int = CONFIG.model.random_state, folds: int = CONFIG.model.cv_folds):
    """J9 (research variant): random forest tuned over features-per-split (mtry) by
    cross-validated accuracy, on the exact stratified folds (``foldCol``).

    Returns ([(mtry, mean accuracy)], best fitted PipelineModel).  The fitted
    preprocessing statistics come from the whole training split.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    rf = RandomForestClassifier(featuresCol="features", labelCol="label_idx", numTrees=trees,
                                minInstancesPerNode=2, maxDepth=depth, seed=seed)
    pipe = Pipeline(stages=[*feature_stages(train, numeric, categorical), rf])
    grid = ParamGridBuilder().addGrid(rf.featureSubsetStrategy, [str(m) for m in mtry]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, foldCol="fold", numFolds=folds, seed=seed,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label_idx",
                                                                    metricName="accuracy"),
                        parallelism=len(mtry))
    fitted = cv.fit(train.withColumn("fold", F.col("fold").cast("int")))
    return [(m, float(a)) for m, a in zip(mtry, fitted.avgMetrics)], fitted.bestModel
