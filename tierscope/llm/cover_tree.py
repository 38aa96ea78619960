"""Exact embedding near-duplicates by dual traversal of cover trees.

Only rows of one label (and dimension) meet.  Equal vectors are one class
with a count.  A label's classes are dealt to the cells of up to ``PIVOTS``
pivots, the top level of its tree; a class goes to the units of those pairs
of cells whose other cell it can reach: its distance to that pivot is at most
the cell's covering radius plus the link distance.  Large cells are cut by
hash, so a unit's size is bounded.  A unit grows a cover tree of each side,
whose levels halve the covering radius, and walks both at once: node pairs
further apart than their radii and the link distance are dropped, and what
is left is compared in double precision.  A unit gives, for each class, the
vectors it links to and the smallest id it reaches: no pairs leave it.

Random vectors in many dimensions have no cells to prune; they cost all pairs
of a label, in blocks, which is the price of exactness.

Defined results: rows without vec_id, label or a valid vector (no components,
a null or non-finite one, all zero) link with nothing; a row without vec_id
has no component and is kept; repeated rows are linked vectors, and share a
component; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import checkpoint, connected_components
from tierscope.operators.skew import join_on_hot_keys

COSINE = 0.98
CELL = 4096          # classes a cell should hold
PIVOTS = 1024        # of a label, at most
SAMPLE = 8           # sampled classes a pivot is chosen from
SALTED = 20_000      # classes a task deals to cells
LEAF = 48
_SLACK = 1e-9


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k rows of x, each the one farthest from those before it."""
    chosen, near = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < k and near.max() > 1e-6:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1]:chosen[-1] + 1])[:, 0])
    return x[chosen]


class Node:
    """A center, its covering radius, and children of half that radius or, in a leaf, members."""

    __slots__ = ("center", "radius", "children", "members")

    def __init__(self, x: np.ndarray, members: np.ndarray, center: int):
        self.center, self.members, self.children = center, members, []
        d = _distances(x[members], x[center:center + 1])[:, 0]
        self.radius = float(d.max())
        if len(members) <= LEAF or self.radius < 1e-7:
            return
        half = self.radius / 2
        # Where balls of half the radius hold hardly more than their center, no level groups anything.
        probe = members[:: max(1, len(members) // 32)]
        if (_distances(x[probe], x[members]) <= half).sum() < 2 * len(probe):
            return
        left = members
        while len(left):
            near = _distances(x[left], x[left[:1]])[:, 0] <= half
            self.children.append(Node(x, left[near], int(left[0])))
            left = left[~near]


def _pairs(x: np.ndarray, y: np.ndarray, a: Node, b: Node, cosine: float, same: bool):
    """Blocks (rows of x, rows of y, links) of all close pairs, each pair in one block."""
    reach = math.sqrt(2.0 - 2.0 * cosine) + _SLACK
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if float(_distances(x[a.center:a.center + 1], y[b.center:b.center + 1])[0, 0]) > a.radius + b.radius + reach:
            continue
        if a.children and (a.radius >= b.radius or not b.children):
            if same and a is b:
                stack += [(p, q) for i, p in enumerate(a.children) for q in a.children[i:]]
            else:
                stack += [(p, b) for p in a.children]
        elif b.children:
            stack += [(a, q) for q in b.children]
        else:
            for i in range(0, len(a.members), 512):
                rows = a.members[i:i + 512]
                yield rows, b.members, x[rows] @ y[b.members].T >= cosine, same and a is b


def unit_links(x: np.ndarray, n: np.ndarray, ids: np.ndarray, home: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Of each class: vectors linked in other classes, and the smallest id reached, within this unit.

    ``home`` tells the sides; with one side all pairs count, with two only those across.
    """
    sides = [np.flatnonzero(home == h) for h in np.unique(home)]
    same = len(sides) == 1
    links, parent = np.zeros(len(x), np.int64), np.arange(len(x))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    trees = [Node(x, s, int(s[0])) for s in sides]
    for rows, cols, close, itself in _pairs(x, x, trees[0], trees[-1], cosine, same):
        close = close & (rows[:, None] < cols[None, :]) if itself else close
        links[rows] += close @ n[cols]
        links[cols] += n[rows] @ close
        for i in np.flatnonzero(close.any(axis=1)):
            joined = {root(rows[i]), *(root(j) for j in cols[close[i]])}
            first = min(joined, key=lambda r: ids[r])
            for r in joined:
                parent[r] = first
    return links, np.array([ids[root(i)] for i in range(len(x))], dtype=ids.dtype)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, class) with null class where nothing can link, and the classes (class, grp, vec, id, n)."""
    number = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & number
             & F.exists("embedding", lambda x: x != 0))
    grp = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    key = F.concat_ws(":", grp, F.hex(F.xxhash64(F.lit(1), "embedding")), F.hex(F.xxhash64(F.lit(2), "embedding")))
    rows = vectors.select("vec_id", "embedding", F.when(valid, grp).alias("grp"), F.when(valid, key).alias("class"))
    made = rows.filter("class is not null").groupBy("class").agg(
        F.first("grp").alias("grp"), F.first("embedding").alias("vec"), F.min("vec_id").alias("id"), F.count("*").alias("n"))
    return rows.select("vec_id", "class"), checkpoint(made)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)")))


def unit_rows(made: DataFrame, cosine: float, cell: int) -> DataFrame:
    """(grp, i, a, j, b, home, id, n, vec): every class in the units where it may meet others."""
    reach = math.sqrt(2.0 - 2.0 * cosine) + _SLACK
    sizes = made.groupBy("grp").agg(F.count("*").alias("rows"), F.min("id").alias("first")).withColumns({
        "salts": F.expr(f"cast(ceil(rows / {SALTED}) as bigint)"), "size": F.col("rows"),
        "pivots": F.expr(f"least({PIVOTS}, cast(ceil(rows / {cell}) as int))")})
    rows = join_on_hot_keys(made, checkpoint(sizes), "grp", "rows").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    chance = F.col("pivots") * SAMPLE * (1 << 20) / F.col("size")
    sample = rows.filter((F.col("id") == F.col("first")) | (F.pmod(F.xxhash64(F.lit("pivot"), "id"), F.lit(1 << 20)) < chance))

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        p = _farthest_first(_unit(f["vec"]), int(f["pivots"].iloc[0]))
        return pd.DataFrame({"grp": f["grp"].iloc[:1], "salts": f["salts"].iloc[:1], "centers": [p.ravel()]})

    centers = checkpoint(sample.select("grp", "salts", "pivots", "id", "vec").groupBy("grp").applyInPandas(
        choose, "grp string, salts long, centers array<double>"))

    def assign(f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame({"cell": [], "away": [], **{k: f[k] for k in ("grp", "salt", "id", "n", "vec")}})
        x = _unit(f["vec"])
        d = _distances(x, np.asarray(c["centers"].iloc[0]).reshape(-1, x.shape[1]))
        return f[["grp", "salt", "id", "n", "vec"]].assign(cell=d.argmin(axis=1), away=d.min(axis=1))

    by = ["grp", "salt"]
    dealt = checkpoint(rows.select("grp", "salt", "id", "n", "vec").groupBy(*by).cogroup(_salted(centers).groupBy(*by)).applyInPandas(
        assign, "grp string, salt long, id long, n long, vec array<float>, cell int, away double"))
    radii = dealt.groupBy("grp", "cell").agg(F.max("away").alias("radius"), F.expr(f"cast(ceil(count(*) / {2 * cell}) as int)").alias("parts"))
    # At most PIVOTS cells a label.
    reachable = _salted(centers.join(radii.groupBy("grp").agg(F.collect_list(F.struct("cell", "radius", "parts")).alias("cells")), "grp"))

    def spread(f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        columns = ["grp", "i", "a", "j", "b", "home", "id", "n", "vec"]
        if not len(f):
            return pd.DataFrame({k: [] for k in columns})
        x, out = _unit(f["vec"]), []
        centers, cells = np.asarray(c["centers"].iloc[0]).reshape(-1, x.shape[1]), c["cells"].iloc[0]
        parts = {int(r["cell"]): int(r["parts"]) for r in cells}
        own, ids = f["cell"].to_numpy(), f["id"].to_numpy()
        part = (ids % 1000003 * 7919 % 1000003) % np.array([parts[int(k)] for k in own])
        d = _distances(x, centers)
        for r in cells:
            j = int(r["cell"])
            near = np.flatnonzero((d[:, j] <= r["radius"] + reach) | (own == j))
            for b in range(parts[j]):
                g = f.iloc[near]
                mine, other = list(zip(own[near].tolist(), part[near].tolist(), strict=True)), (j, b)
                low = [min(m, other) for m in mine]
                high = [max(m, other) for m in mine]
                out.append(pd.DataFrame({
                    "grp": g["grp"], "i": [k for k, _ in low], "a": [p for _, p in low], "j": [k for k, _ in high], "b": [p for _, p in high],
                    "home": [int(m == h) for m, h in zip(mine, low, strict=True)], "id": g["id"], "n": g["n"], "vec": g["vec"]}))
        return pd.concat(out, ignore_index=True)[columns]

    return dealt.groupBy(*by).cogroup(reachable.groupBy(*by)).applyInPandas(
        spread, "grp string, i int, a int, j int, b int, home int, id long, n long, vec array<float>")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows, made = classes(vectors)

    def link(f: pd.DataFrame) -> pd.DataFrame:
        first = f.iloc[0]
        lone = (first["i"], first["a"]) != (first["j"], first["b"]) and f["home"].nunique() == 1
        if lone or len(f) < 2:
            return pd.DataFrame({"id": [], "links": [], "reached": []})
        f = f.sort_values("id")
        links, reached = unit_links(_unit(f["vec"]), f["n"].to_numpy(), f["id"].to_numpy(), f["home"].to_numpy(), cosine)
        return pd.DataFrame({"id": f["id"], "links": links, "reached": reached})[links > 0]

    found = checkpoint(unit_rows(made, cosine, cell).groupBy("grp", "i", "a", "j", "b").applyInPandas(link, "id long, links long, reached long"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("reached").alias("b")))
    per_class = (made.select("class", "id", "n")
                 .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
                 .join(component.withColumnRenamed("node", "id"), "id", "left")
                 .select("class", F.col("n").alias("rows"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                         F.coalesce("component", "id").alias("component_id")))
    linked = join_on_hot_keys(rows.filter("class is not null"), per_class, "class", "rows").drop("class")
    alone = rows.filter("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
