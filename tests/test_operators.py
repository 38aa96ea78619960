"""Operators and pipeline invariants, plus exact distributed ranks vs brute force."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tierscope.config import TIER_ORDER
from tierscope.functions.hashing import stable_hash
from tierscope.operators.features import collapse_to_levels, fit_top_levels
from tierscope.operators.split import class_ranks, stratified_split
from tierscope.plans import base
from tierscope.plans import market as mk
from tierscope.plans.evaluation import auc_ovr
from tierscope.sources.files import read_listings_csv, require_columns


def test_top_levels_vocabulary(spark):
    df = spark.createDataFrame([(x,) for x in "aaaaabbbcd"], "v string")
    levels = fit_top_levels(df, "v", 2)
    assert levels == ["a", "b"]
    got = {r[0] for r in df.select(collapse_to_levels(F.col("v"), levels)).collect()}
    assert got == {"a", "b", "Other"}


def test_required_columns_contract(spark):
    with pytest.raises(ValueError, match="bathrooms_text"):
        require_columns(spark.createDataFrame([(1,)], "id long"))


def test_clean_invariants(spark):
    df = base.cleaned(spark, SF_SMALL)
    rows = df.collect()
    ids = [r.id for r in rows]
    assert len(ids) == len(set(ids)) > 0
    assert all(10 <= r.price_numeric <= 5000 for r in rows)
    assert {r.price_category for r in rows} <= set(TIER_ORDER)


def test_keep_first_after_price_filter_brute_force(spark):
    """Kept row per id = first copy (ingest order) among copies that pass the price filter."""
    from tierscope.operators.clean import typed_listings
    typed = typed_listings(base.loaded(spark, SF_SMALL)).select("id", "ingest_seq", "price_numeric").collect()
    expected = {}
    for r in sorted(typed, key=lambda r: (r.id, r.ingest_seq)):
        if r.price_numeric is not None and 10 <= r.price_numeric <= 5000 and r.id not in expected:
            expected[r.id] = r.price_numeric
    got = {r.id: r.price_numeric for r in base.cleaned(spark, SF_SMALL).select("id", "price_numeric").collect()}
    assert got == expected


def test_feature_invariants(spark):
    f = base.features(spark, SF_SMALL)
    agg = f.agg(F.min("distance_from_cbd_km"), F.max("distance_from_cbd_km"), F.min("amenities_count"),
                *[F.max(c) for c in ["has_pool", "has_washer", "has_gym"]]).first()
    assert 0 <= agg[0] <= agg[1] <= 120
    assert agg[2] >= 0
    assert all(v in (0, 1) for v in agg[3:])
    assert "amenities" not in f.columns


def test_csv_round_trip(spark, tmp_dir):
    raw = base.loaded(spark, SF_SMALL).drop("ingest_seq")
    raw.coalesce(1).write.option("header", True).option("escape", '"').csv(tmp_dir + "/raw")
    back = read_listings_csv(spark, tmp_dir + "/raw")
    from tierscope.operators.clean import clean_listings
    assert clean_listings(back).count() == base.cleaned(spark, SF_SMALL).count()


def test_class_ranks_equal_global_row_number(spark):
    df = spark.range(0, 3000).withColumn("label", (F.col("id") % 3).cast("string"))
    ranked = class_ranks(df, "label", bits=4).select("id", "_rank")
    w = Window.partitionBy("label").orderBy(stable_hash("id", 42), "id")
    brute = df.select("id", F.row_number().over(w).alias("_rank"))
    assert ranked.exceptAll(brute).count() == 0 and brute.exceptAll(ranked).count() == 0


def test_stratified_split_counts(spark):
    df = spark.range(0, 1001).withColumn("price_category", F.when(F.col("id") % 10 < 5, "Budget")
                                         .when(F.col("id") % 10 < 8, "Mid-Market").otherwise("Premium"))
    s = stratified_split(df, test_size=0.2, folds=5)
    n_test = s.where(F.col("split") == "test").count()
    assert n_test == 201   # ceil(0.2 * 1001)
    per = {r[0]: r[1] for r in s.where(F.col("split") == "test").groupBy("price_category").count().collect()}
    assert per == {"Budget": 100, "Mid-Market": 60, "Premium": 41} or sum(per.values()) == 201
    folds = s.where(F.col("split") == "train").groupBy("fold").count().collect()
    sizes = sorted(r[1] for r in folds)
    assert sizes[-1] - sizes[0] <= 3 and sum(sizes) == 800


def test_auc_matches_pairwise_brute_force(spark):
    import itertools
    rows = [(i, ["Budget", "Mid-Market", "Premium"][i % 3], float(i % 7), float((i * 3) % 5), float(i % 4))
            for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, `score_Budget` double, "
                               "`score_Mid-Market` double, `score_Premium` double")
    got = {r["class"]: r["auc"] for r in auc_ovr(df).collect()}
    for k, cls in enumerate(["Budget", "Mid-Market", "Premium"]):
        pos = [r[2 + k] for r in rows if r[1] == cls]
        neg = [r[2 + k] for r in rows if r[1] != cls]
        u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
        assert abs(got[cls] - u / (len(pos) * len(neg))) < 1e-12


def test_farther_share_matches_brute_force(spark):
    f = base.features(spark, SF_SMALL)
    got = {r.id: r.farther_share for r in mk.farther_from_cbd_share(f).collect()}
    d = {r.id: r.distance_from_cbd_km for r in f.select("id", "distance_from_cbd_km").collect()}
    vals = list(d.values())
    for i, x in list(d.items())[:200]:
        assert got[i] == sum(v is not None and x is not None and v > x for v in vals) / len(vals)


def _type7(values, q):
    import math
    xs = sorted(values)
    pos = (len(xs) - 1) * q
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi or xs[lo] == xs[hi]:
        return xs[lo]
    return xs[lo] + (xs[hi] - xs[lo]) * (pos - lo)


def test_exact_quantiles_match_brute_force(spark):
    from tierscope.operators.quantiles import exact_quantiles
    # one hot group (a third of the rows), a null key, ties, a constant group
    rows = [("hot", float(i % 97) / 7.0) for i in range(900)] + \
           [(None, float(i % 5)) for i in range(300)] + \
           [("flat", 3.0)] * 50 + [("b", float(i)) for i in range(1750)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"q01": 0.01, "q25": 0.25, "med": 0.5, "q99": 0.99}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    ref = sorted([(k, *[_type7(vs, q) for q in qs.values()]) for k, vs in groups.items()], key=str)
    for bits in (2, 16):
        got = sorted(map(tuple, exact_quantiles(df, ["k"], "v", qs, bits=bits).collect()), key=str)
        assert got == ref


def test_macro_f1_undefined_class_rule(spark):
    from tierscope.plans.evaluation import summary_metrics
    rows = [("Budget", "Budget"), ("Budget", "Mid-Market"), ("Mid-Market", "Mid-Market")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    zero = summary_metrics(df).first().f1_macro          # Premium counts as 0
    dropped = summary_metrics(df, drop_undefined_f1=True).first().f1_macro
    assert abs(zero - (2 / 3 + 2 / 3 + 0) / 3) < 1e-12
    assert abs(dropped - (2 / 3 + 2 / 3) / 2) < 1e-12


def test_csv_export(spark, tmp_dir):
    from tierscope.sources.files import write_csv
    df = base.cleaned(spark, SF_SMALL).select("id", "price_numeric", "price_category")
    write_csv(df, tmp_dir + "/out")
    back = spark.read.option("header", True).csv(tmp_dir + "/out")
    assert back.count() == df.count() and back.columns == df.columns


def test_missing_report_reads_as_empty(spark, tmp_dir):
    from tierscope.sources.files import read_json_report
    df = read_json_report(spark, tmp_dir + "/does-not-exist", "feature string, importance double")
    assert df.count() == 0 and df.columns == ["feature", "importance"]


def _csv(path, rows):
    from tierscope.config import RAW_COLUMNS
    with open(path, "w") as f:
        f.write(",".join(RAW_COLUMNS) + "\n")
        for r in rows:
            f.write(",".join(str(r.get(c, "")) for c in RAW_COLUMNS) + "\n")


def test_keep_first_follows_the_order_of_files(spark, tmp_dir):
    """The second file is larger, so that a scan reads it first."""
    import os

    from tierscope.operators.clean import clean_listings
    from tierscope.sources.files import read_listings_csv
    os.makedirs(f"{tmp_dir}/in")
    _csv(f"{tmp_dir}/in/part-0.csv", [{"id": 1, "price": "$100.00"}, {"id": 2, "price": ""}])
    _csv(f"{tmp_dir}/in/part-1.csv", [{"id": i, "price": "$300.00"} for i in [1, 2, 1] + list(range(3, 3000))])
    got = {r.id: r.price_numeric for r in clean_listings(read_listings_csv(spark, f"{tmp_dir}/in")).where("id < 4").collect()}
    assert got == {1: 100.0, 2: 300.0, 3: 300.0}


def test_rows_without_an_order_are_refused(spark):
    import pytest

    from tierscope.config import RAW_COLUMNS
    from tierscope.operators.clean import clean_listings
    with pytest.raises(ValueError, match="ingest_seq"):
        clean_listings(spark.createDataFrame([tuple("" for _ in RAW_COLUMNS)], RAW_COLUMNS))


def test_running_sums_of_crowded_values(spark):
    """Nine in ten values within 1e-6 of zero: no partition gets much more than its share, and sums stay exact."""
    import random

    from tierscope.operators.prefix import sums_before
    rng = random.Random(1)
    values = sorted({rng.random() * (1e-6 if i % 10 else 1.0) for i in range(20000)})
    df = spark.createDataFrame([(v, i % 7 + 1) for i, v in enumerate(values)], "v double, n long").repartition(8)
    out = sums_before(df, [], "v", {"below": "n"})
    run, want = 0, {}
    for i, v in enumerate(values):
        want[v] = run
        run += i % 7 + 1
    assert {r.v: r.below for r in out.collect()} == want
    ranged = df.repartitionByRange(8, "v").rdd.glom().map(len).collect()
    assert max(ranged) < 3 * len(values) / 8


def test_panels_with_null_keys_and_empty_views(spark):
    from tierscope.plans import market as mk
    rows = [(i, None if i % 3 == 0 else "a", None if i % 5 == 0 else "r", 100.0 + i, "Budget", [1.0, 2.0, 3.0, None][i % 4], 10) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, neighbourhood_cleansed string, room_type string, price_numeric double, price_category string, "
                                     "distance_from_cbd_km double, availability_365 long")
    assert {r.neighbourhood_cleansed for r in mk.neighbourhood_tier_mix(df).collect()} == {None, "a"}
    assert mk.comps_standing(df).count() == 20
    far = {r.id: r.farther_share for r in mk.farther_from_cbd_share(df).collect()}
    assert (far[0], far[2], far[3]) == (0.5, 0.0, 0.0) and len(far) == 20
    assert sum(r.n for r in mk.comps_histogram(df).collect()) == 20
    empty = df.limit(0)
    assert [r.n for r in mk.tier_counts(empty).collect()] == [0, 0, 0]
    assert mk.neighbourhood_tier_mix(empty).count() == 0 and mk.farther_from_cbd_share(empty).count() == 0
