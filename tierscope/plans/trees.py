"""Ensembles of MLlib trees that are trained piece by piece and scored together.

``fit_forest`` trains a forest as sub-forests with seeds of their own, one at
a time; votes and importances add up, so the driver never holds more than one
part while it trains.  ``fit_boosting`` is multiclass boosting: each round
fits one regression tree a class to the Newton step of the softmax loss, on a
share of the rows and of the columns.  Columns are binned once and rows lie in
cached blocks; for each level, tasks sum gradient and curvature by node and
bin, and only these sums, which no number of rows makes larger, reach the
driver.  Every few rounds margins and trees are written, and a run that was
cut off goes on from there.

Both end as ``Trees``, flat arrays that a task evaluates for a whole batch.
"""

from __future__ import annotations

import copy
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.plans.kept import kept
from tierscope.session import checkpoint_dir


@dataclass
class Trees:
    """Nodes of all trees: ``feature`` (-1 at a leaf), ``threshold`` (at most: left), children, and a leaf's value a class."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each row of ``x``, the leaf values of all trees added up."""
        out, every = np.zeros((len(x), self.value.shape[1])), np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            at = every[self.feature[node] >= 0]
            while len(at):
                n = node[at]
                node[at] = np.where(x[at, self.feature[n]] <= self.threshold[n], self.left[n], self.right[n])
                at = at[self.feature[node[at]] >= 0]
            out += self.value[node]
        return out


def joined(parts: list[Trees]) -> Trees:
    start = np.cumsum([0] + [len(p.feature) for p in parts])

    def put(name, moved=False):
        return np.concatenate([getattr(p, name) + (s if moved else 0) for p, s in zip(parts, start, strict=False)])

    return Trees(put("roots", True), put("feature"), put("threshold"), put("left", True), put("right", True), put("value"))


def read_trees(spark: SparkSession, path: str, value: Callable[[np.ndarray], np.ndarray]) -> Trees:
    """The trees of a model saved by MLlib; ``value`` of the statistics (leaves x parts) of its leaves."""
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select("treeID", "nodeData.*")
    else:
        saved = saved.withColumn("treeID", F.lit(0))
    f = saved.select("treeID", "id", "impurityStats", "leftChild", "rightChild", "split").toPandas().sort_values(["treeID", "id"])
    # The nodes of a tree are numbered from zero without gaps.
    first = f.groupby("treeID")["id"].transform("size").groupby(f["treeID"]).first().cumsum().shift(fill_value=0)
    base = f["treeID"].map(first).to_numpy()
    split = f["split"].tolist()
    feature = np.array([s["featureIndex"] for s in split])
    limits = np.zeros(len(f))
    left, right = f["leftChild"].to_numpy() + base, f["rightChild"].to_numpy() + base
    for i in np.flatnonzero(feature >= 0).tolist():
        kinds, values = split[i]["numCategories"], list(split[i]["leftCategoriesOrThreshold"])
        if kinds == -1:
            limits[i] = values[0]
        elif kinds == 2:   # a one-hot column is 0 or 1
            limits[i] = 0.5
            if values == [1.0]:
                left[i], right[i] = right[i], left[i]
        else:
            raise ValueError(f"a split on {kinds} categories")
    return Trees(first.to_numpy(np.int64), feature, limits, left, right, value(np.array(f["impurityStats"].tolist(), float)))


_NODES = "node long, feature long, threshold double, left long, right long, value array<double>, root boolean"


def save_trees(spark: SparkSession, trees: Trees, path: str) -> None:
    n = len(trees.feature)
    root = np.zeros(n, bool)
    root[trees.roots] = True
    whole = [pa.array(a.astype(np.int64)) for a in (np.arange(n), trees.feature, trees.left, trees.right)]
    value = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees.value.shape[1]), pa.array(trees.value.ravel()))
    table = pa.table([whole[0], whole[1], pa.array(trees.threshold), whole[2], whole[3], value, pa.array(root)],
                     ["node", "feature", "threshold", "left", "right", "value", "root"])
    spark.createDataFrame(table, _NODES).write.parquet(path)


def load_trees(spark: SparkSession, path: str) -> Trees:
    f = spark.read.schema(_NODES).parquet(path).toPandas().sort_values("node")
    return Trees(np.flatnonzero(f["root"]), *[f[c].to_numpy() for c in ("feature", "threshold", "left", "right")], np.array(f["value"].tolist()))


def summed(trees: Trees, spark: SparkSession) -> Callable[[Column], Column]:
    """The trees as a column function of an array of doubles; broadcast, as MLlib does with its own trees."""
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(shared.value.sums(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

    return run


# ----------------------------------------------------------------------------- forests
def shares(stats: np.ndarray) -> np.ndarray:
    """A leaf's vote: its classes' shares of the rows (weights) in it."""
    return stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)


def part_size(depth: int) -> int:
    """Trees of a part: about a million nodes, those deeper than sixteen levels taken for no larger."""
    return max(1, (1 << 20) >> min(depth, 16))


def fit_forest(vectors: DataFrame, forest: RandomForestClassifier, folder: str, part: int) -> list[str]:
    """Folders of the sub-forests of at most ``part`` trees that make up ``forest``; those already there are not trained again."""
    spark, trees, seed = vectors.sparkSession, forest.getNumTrees(), forest.getSeed()
    out = []
    for i, start in enumerate(range(0, trees, part)):
        size = min(part, trees - start)

        def make(path, i=i, size=size):
            model = forest.copy({forest.numTrees: size, forest.seed: seed + i}).fit(vectors)
            model.write().save(path)
            row = (size, model.featureImportances.toArray().tolist())
            spark.createDataFrame([row], "trees int, importances array<double>").write.json(f"{path}/importances")

        out.append(kept(spark, folder, "part", f"{i}-{size}-{seed}", make, lambda path: path))
    return out


def forest_trees(spark: SparkSession, parts: list[str]) -> Trees:
    trees = joined([read_trees(spark, p, shares) for p in parts])
    trees.value /= len(trees.roots)
    return trees


def forest_importances(spark: SparkSession, parts: list[str]) -> np.ndarray:
    """Importances of the whole forest: the parts', by their trees, adding up to one."""
    rows = [spark.read.schema("trees int, importances array<double>").json(f"{p}/importances").first() for p in parts]
    total = sum(r["trees"] * np.array(r["importances"]) for r in rows)
    return total / max(total.sum(), 1e-300)


# ----------------------------------------------------------------------------- boosting
@dataclass(frozen=True)
class Boosting:
    rounds: int
    step: float = 0.06
    depth: int = 7
    rows: float = 0.9        # share of the rows of a round
    columns: float = 0.8     # share of the columns of a tree
    penalty: float = 1.0     # added to a leaf's curvature
    least: float = 1.0       # curvature of a leaf
    seed: int = 42
    every: int = 50          # rounds between checkpoints


def softmax(margins: list[Column]) -> list[Column]:
    top = F.greatest(*margins)
    e = [F.exp(m - top) for m in margins]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


BINS = 32              # of a column with more values than that
TOGETHER = 1 << 17     # rows that make one block: fewer are not dealt out
BLOCK = 1 << 19        # rows of a block, about, where one for each core would be larger


@dataclass
class Columns:
    """How columns are laid out in blocks and sums: ``plain`` ones by bins, ``hot`` ones (0 or 1) by their ones."""

    limits: list[np.ndarray]
    plain: np.ndarray
    hot: np.ndarray


def binned_columns(rows: DataFrame, width: int) -> Columns:
    """Limits between the bins of each column of ``x``: between all values if they are few, else quantiles of all rows."""
    def distinct(batches):
        found = [np.zeros(0)] * width
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            found = [f if len(f) > BINS else np.union1d(f, c) for f, c in zip(found, x.T, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([f[:BINS + 1].tolist() for f in found], pa.list_(pa.float64()))], ["c", "found"])

    values = [np.zeros(0)] * width
    for c, f in rows.select("x").mapInArrow(distinct, "c int, found array<double>").collect():
        values[c] = np.union1d(values[c], f)[:BINS + 1]
    limits = [(v[1:] + v[:-1]) / 2 for v in values]
    if many := [c for c, v in enumerate(values) if len(v) > BINS]:
        shares = [i / BINS for i in range(1, BINS)]
        for c, q in zip(many, rows.agg(*[F.percentile_approx(F.col("x")[c], shares) for c in many]).first(), strict=True):
            limits[c] = np.unique(q)
    hot = np.array([v.tolist() == [0.0, 1.0] for v in values], bool)
    return Columns(limits, np.flatnonzero(~hot), np.flatnonzero(hot))


@dataclass
class Block:
    """Rows of a partition."""

    keys: pa.ChunkedArray
    draws: np.ndarray      # hash of the key
    label: np.ndarray
    bins: np.ndarray       # plain columns x rows
    row: np.ndarray        # row and hot column of each one, by column
    hot: np.ndarray
    margins: np.ndarray    # rows x classes

    def newton(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the softmax loss, classes x rows."""
        e = np.exp(self.margins - self.margins.max(axis=1, keepdims=True))
        p = (e / e.sum(axis=1, keepdims=True)).T
        return (self.label == np.arange(len(p))[:, None]) - p, np.maximum(2 * p * (1 - p), 1e-16)

    def drawn(self, b: Boosting, r: int) -> np.ndarray:
        """Whether each row has part in round ``r``: by its key, wherever it lies."""
        z = self.draws + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        return (z ^ (z >> np.uint64(31))) >> np.uint64(44) < int(b.rows * (1 << 20))

    def down(self, tree: Growing, place: np.ndarray, level: int) -> np.ndarray:
        """The nodes of rows after the splits of a level; ``place`` is -1 for rows that have no part."""
        split = tree.levels[level]
        if not split:
            return place
        n, column, at = len(tree.feature), np.array(tree.feature), np.array(tree.at)
        moving = np.zeros(n + 1, bool)
        moving[split] = True
        rows = np.flatnonzero(moving[place])
        node = place[rows]
        right = np.zeros(len(rows), bool)
        index = np.searchsorted(tree.columns.plain, column)
        by_bin = np.append(tree.columns.plain, -1)[index] == column
        chosen = by_bin[node]
        take = slice(None) if chosen.all() else np.flatnonzero(chosen)
        right[take] = self.bins[index[node[take]], rows[take]] > at[node[take]]
        rest, mark = np.flatnonzero(~chosen), np.zeros(len(place), bool)
        for m in (m for m in split if not by_bin[m]):
            mine = rest[node[rest] == m]
            ones = self.row[slice(*np.searchsorted(self.hot, np.searchsorted(tree.columns.hot, column[m]) + np.arange(2)))]
            mark[ones] = True
            right[mine] = mark[rows[mine]]
            mark[ones] = False
        out = place.copy()
        out[rows] = np.where(right, np.array(tree.right)[node], np.array(tree.left)[node])
        return out

    def sums(self, tree: Growing, place: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """Gradient and curvature (last axis) of the nodes that ``tree`` asks for, by bin of the drawn columns, by ones, and in all."""
        wanted, plain, hot = tree.wanted, tree.plain, tree.columns.hot
        slot = np.full(len(tree.feature) + 1, -1)
        slot[wanted] = np.arange(len(wanted))
        slot = slot[place]
        rows = np.flatnonzero(slot >= 0)
        base, weights = slot[rows] * BINS, (gradient[rows], curve[rows])
        out = np.zeros((2, len(wanted), len(plain) * BINS + len(hot) + 1))
        size = len(wanted) * BINS
        for i, j in enumerate(plain.tolist()):
            index = base + self.bins[j][rows]
            for part, w in zip(out, weights, strict=True):
                part[:, i * BINS:(i + 1) * BINS] = np.bincount(index, w, size).reshape(-1, BINS)
        if len(self.row):
            at = slot[self.row]
            one = np.flatnonzero(at >= 0)
            index, row = at[one] * len(hot) + self.hot[one], self.row[one]
            for part, w in zip(out, (gradient, curve), strict=True):
                part[:, len(plain) * BINS:-1] = np.bincount(index, w[row], len(wanted) * len(hot)).reshape(len(wanted), -1)
        for part, w in zip(out, weights, strict=True):
            part[:, -1] = np.bincount(slot[rows], w, len(wanted))
        return np.moveaxis(out, 0, 2)

    def moved(self, trees: list[Growing]) -> Block:
        """The block with the trees' steps added to its margins."""
        margins = self.margins.copy()
        for k, tree in enumerate(trees):
            place = np.zeros(len(margins), np.int64)
            for level in range(len(tree.levels)):
                place = self.down(tree, place, level)
            margins[:, k] += np.array(tree.value)[place]
        return replace(self, margins=margins)


@dataclass
class Growing:
    """A tree that is grown level by level: least squares of the Newton step, from sums of gradient and curvature.

    Sums are asked for one child of a split, that with less curvature; the other's are what is left of the parent's.
    """

    columns: Columns
    drawn: np.ndarray      # columns of this tree
    b: Boosting

    def __post_init__(self):
        self.feature, self.at, self.left, self.right, self.value = [-1], [0], [-1], [-1], [0.0]
        self.wanted, self.levels, self.known, self.pairs = [0], [], {}, []
        self.plain = np.flatnonzero(np.isin(self.columns.plain, self.drawn))
        self.hot = np.isin(self.columns.hot, self.drawn)

    def split(self, sums: np.ndarray) -> None:
        """Takes the sums of the wanted nodes, and splits all nodes of this level that gain by it."""
        b, width = self.b, len(self.plain) * BINS
        known = dict(zip(self.wanted, sums, strict=True))
        for child, other, parent in self.pairs:
            known[other] = self.known[parent] - known[child]
        nodes = sorted(known)
        self.levels.append([])
        self.wanted, self.pairs, self.known = [], [], known
        every = np.stack([known[n] for n in nodes])
        total = every[:, -1]
        for n, (g, h) in zip(nodes, total, strict=True):
            self.value[n] = b.step * g / (h + b.penalty)
        below = every[:, :width].reshape(len(nodes), -1, BINS, 2).cumsum(axis=2).reshape(len(nodes), width, 2)
        below = np.concatenate([below, total[:, None] - every[:, width:-1]], axis=1)
        above = total[:, None] - below

        def worth(s):
            return s[..., 0] ** 2 / (np.maximum(s[..., 1], 0) + b.penalty)

        gain = worth(below) + worth(above) - worth(total)[:, None]
        gain[np.minimum(below[..., 1], above[..., 1]) < b.least] = -np.inf
        gain[:, width:][:, ~self.hot] = -np.inf
        best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(nodes), int)
        for i, n in enumerate(nodes):
            if not gain.shape[1] or not gain[i, best[i]] > 1e-9:
                continue
            s = int(best[i])
            by_bin = s < width
            self.feature[n] = int(self.columns.plain[self.plain[s // BINS]] if by_bin else self.columns.hot[s - width])
            self.at[n] = s % BINS if by_bin else 0
            self.left[n], self.right[n] = len(self.feature), len(self.feature) + 1
            for part in (below[i, s], above[i, s]):
                for values, v in ((self.feature, -1), (self.at, 0), (self.left, -1), (self.right, -1), (self.value, b.step * part[0] / (part[1] + b.penalty))):
                    values.append(v)
            self.levels[-1].append(n)
            if len(self.levels) < b.depth:
                pair = (self.left[n], self.right[n])
                child, other = pair if below[i, s, 1] <= above[i, s, 1] else pair[::-1]
                self.wanted.append(child)
                self.pairs.append((child, other, n))
        if not self.pairs:
            self.known = {}

    def slim(self) -> Growing:
        """What tasks need of it."""
        out = copy.copy(self)
        out.known = {}
        return out


def planted(columns: Columns, b: Boosting, r: int, k: int) -> Growing:
    """The tree of class ``k`` in round ``r`` before its first split, with the columns drawn for it."""
    width = len(columns.limits)
    rng = np.random.default_rng([b.seed, r, k])
    return Growing(columns, np.sort(rng.choice(width, max(1, round(b.columns * width)), replace=False)), b)


def _grown(data, b: Boosting, r: int, k: int, classes: int, tree: Growing) -> Trees:
    """The tree of class ``k`` in round ``r`` as arrays: limits instead of bins, and leaves with a value for each class."""
    feature = np.array(tree.feature)
    limit = np.array([tree.columns.limits[c][at] if c >= 0 else 0.0 for c, at in zip(tree.feature, tree.at, strict=True)])
    value = np.zeros((len(feature), classes))
    value[feature < 0, k] = np.array(tree.value)[feature < 0]
    return Trees(np.zeros(1, np.int64), feature, limit, np.array(tree.left), np.array(tree.right), value)


def _blocks(rows: DataFrame, columns: Columns, classes: int, parts: int, trees: Trees | None) -> RDD:
    """(block, trees of the last rounds) of each of ``parts`` partitions; margins start at what ``trees`` say."""
    width = len(columns.limits)

    def pack(batches):
        keys, draws, label, bins, row, hot, margins, n = [], [], [], [], [], [], [], 0
        for batch in batches:
            key, draw, x, idx = batch.columns
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            keys.append(key)
            draws.append(draw.to_numpy(zero_copy_only=False).view(np.uint64))
            label.append(idx.to_numpy(zero_copy_only=False).astype(np.int8))
            bins.append(np.array([np.searchsorted(columns.limits[c], x[:, c]) for c in columns.plain], np.uint8).reshape(-1, len(x)))
            at, one = np.nonzero(x[:, columns.hot])
            row.append(at + n)
            hot.append(one)
            margins.append(trees.sums(x) if trees else np.zeros((len(x), classes)))
            n += len(x)
        if n:
            row, hot = np.concatenate(row).astype(np.int32), np.concatenate(hot).astype(np.int32)
            order = np.argsort(hot, kind="stable")
            block = Block(pa.chunked_array(keys), np.concatenate(draws), np.concatenate(label), np.concatenate(bins, axis=1), row[order], hot[order], np.concatenate(margins))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])

    dealt = rows.coalesce(1) if parts == 1 else rows.repartition(parts)
    return dealt.mapInArrow(pack, "block binary").rdd.map(lambda r: (pickle.loads(r[0]), []))


def _margins(state: RDD, spark: SparkSession, kind: str, classes: int) -> DataFrame:
    """(key, m0, m1, ...) of all rows."""
    names = [f"m{c}" for c in range(classes)]

    def unpack(batches):
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                keys, margins = pickle.loads(packed)
                yield from pa.table([keys, *[pa.array(m) for m in margins.T]], ["key", *names]).to_batches(1 << 16)

    packed = spark.createDataFrame(state.map(lambda s: (pickle.dumps((s[0].keys, s[0].margins), 5),)), "rows binary", verifySchema=False)
    return packed.mapInArrow(unpack, f"key {kind}, " + ", ".join(f"{m} double" for m in names))


def _round_of_block(block: Block, columns: Columns, b: Boosting, r: int) -> list[Growing]:
    """The trees of round ``r`` where one block holds all rows."""
    part, (gradient, curve) = block.drawn(b, r), block.newton()
    out = []
    for k in range(len(gradient)):
        tree, place = planted(columns, b, r, k), np.where(part, 0, -1)
        while tree.wanted:
            tree.split(block.sums(tree, place, gradient[k], curve[k]))
            place = block.down(tree, place, len(tree.levels) - 1)
        out.append(tree.slim())
    return out


def _rounds_of_one(state: RDD, columns: Columns, b: Boosting, rounds: range) -> tuple[RDD, list[list[Growing]]]:
    """Rounds of a table of one block: no sums go between tasks, so a task grows them one after the other."""
    def grow(s):
        block, done = s[0], []
        for r in rounds:
            done.append(_round_of_block(block, columns, b, r))
            block = block.moved(done[-1])
        return block, done

    state = state.map(grow).persist(StorageLevel.MEMORY_AND_DISK)
    return state, state.map(lambda s: s[1]).first()


def _round_of_many(state: RDD, columns: Columns, b: Boosting, r: int, classes: int) -> list[Growing]:
    """The trees of round ``r``: for each level, tasks sum their blocks for the trees of all classes, and the sums are added."""
    trees = [planted(columns, b, r, k) for k in range(classes)]
    while any(t.wanted for t in trees):
        asked = [t.slim() for t in trees]

        def partial(s, asked=asked):
            block = s[0]
            part, (gradient, curve) = block.drawn(b, r), block.newton()
            out = []
            for k, tree in enumerate(asked):
                place = np.where(part, 0, -1)
                for level in range(len(tree.levels) if tree.wanted else 0):
                    place = block.down(tree, place, level)
                out.append(block.sums(tree, place, gradient[k], curve[k]) if tree.wanted else None)
            return out

        for tree, sums in zip(trees, state.map(partial).treeReduce(_added, 2 if state.getNumPartitions() > 16 else 1), strict=True):
            if tree.wanted:
                tree.split(sums)
    return [t.slim() for t in trees]


def _added(a: list, b: list) -> list:
    return [x if x is None else x + y for x, y in zip(a, b, strict=True)]


def load_boosting(spark: SparkSession, folder: str) -> tuple[int, Trees | None, str | None]:
    """Rounds done, their trees and the folder of the last checkpoint."""
    try:
        done = spark.read.schema("round int, folder string").json(f"{folder}/done").orderBy("round", "folder").collect()
    except AnalysisException:   # nothing yet
        return 0, None, None
    # Checkpoints hold the trees since the one before: one for each number of rounds.
    steps = {}
    for row in done:
        steps.setdefault(row["round"], row["folder"])
    return max(steps), joined([load_trees(spark, f"{at}/trees") for at in steps.values()]), steps[max(steps)]


def fit_boosting(vectors: DataFrame, b: Boosting, folder: str, classes: int) -> Trees:
    """``vectors``: key (unique), features, label_idx.  Margins start at zero; ``folder`` may hold rounds of a run that was cut off.

    Columns are binned once.  Blocks of binned rows and their margins stay
    cached; a run that goes on takes its margins from the trees it has.
    """
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    done, trees, _ = load_boosting(spark, folder)
    done, trees = (done, trees) if done <= b.rounds else (0, None)
    kind = vectors.schema["key"].dataType.simpleString()
    rows = vectors.select("key", F.xxhash64("key", F.lit(b.seed)).alias("draw"), vector_to_array("features").alias("x"), "label_idx")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    columns = binned_columns(rows, width)
    parts = 1 if n <= TOGETHER else max(spark.sparkContext.defaultParallelism, -(-n // BLOCK))
    state = _blocks(rows, columns, classes, parts, trees).persist(StorageLevel.MEMORY_AND_DISK)
    while done < b.rounds:
        rounds = range(done, min(b.rounds, (done // b.every + 1) * b.every))
        before, grown = state, []
        if parts == 1:
            state, grown = _rounds_of_one(state, columns, b, rounds)
            before.unpersist()
        else:
            for r in rounds:
                grown.append(_round_of_many(state, columns, b, r, classes))
                before, state = state, state.map(lambda s, trees=grown[-1]: (s[0].moved(trees), [])).persist(StorageLevel.MEMORY_AND_DISK)
                if r == rounds[-1]:   # the lineage ends here
                    state.checkpoint()
                state.count()
                before.unpersist()
        fresh = joined([_grown(state, b, r, k, classes, tree) for r, step in zip(rounds, grown, strict=True) for k, tree in enumerate(step)])
        trees, done = joined([trees, fresh]) if trees else fresh, rounds[-1] + 1
        # Written, and listed last.
        at = f"{folder}/rounds-{done}-{uuid.uuid4().hex}"
        _margins(state, spark, kind, classes).write.parquet(f"{at}/margins")
        save_trees(spark, fresh, f"{at}/trees")
        spark.createDataFrame([(done, at)], "round int, folder string").coalesce(1).write.mode("append").json(f"{folder}/done")
    state.unpersist()
    return trees
