"""Merkle manifest of a dataset: a persistent tree with a version for every tampered leaf.

A document's leaf is the digest of its fields.  The leaves of a language form
a binary tree over ascending document ids, and the subroots of the languages
form one more; its root stands for the whole dataset.

Trees are kept in aligned blocks of ``2 ** bits`` nodes.  A block is built in
one task, and its root is a leaf of the blocks above, round by round, so no
task holds more than one block, however large a language is.  On the way down
every block hands its nodes the siblings above them.  A tampered leaf makes a
version of its block that shares all nodes with the original but the copied
ancestors of the leaf (``Tree.version``); the version goes on through the
siblings of the upper blocks up to its own root.

Defined results: a null field is ``-``; null language is a language of its own,
before all others; null ids come first in theirs, and rows of one id are
ordered by leaf; repeated rows are leaves of their own; a row without id is not
tampered; one leaf alone is its subroot, and one subroot the root; a table
without rows gives none; other columns do not matter.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscope.llm.common import checkpoint

BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------ one block
class Tree:
    """The nodes of a block by level, leaves first.

    ``whole``: the block has neighbours, so that it is raised to full height
    whatever its number of leaves.
    """

    def __init__(self, leaves: list[str], whole: bool, bits: int = BITS):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 or whole and len(self.levels) <= bits:
            low = self.levels[-1]
            self.levels.append([digest(*low[i:i + 2]) for i in range(0, len(low), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> list[str]:
        """The sibling at each level, with its side (``<`` left, ``>`` right); empty where there is none."""
        out = []
        for level in self.levels[:-1]:
            if i % 2:
                out.append("<" + level[i - 1])
            else:
                out.append(">" + level[i + 1] if i + 1 < len(level) else "")
            i //= 2
        return out

    def version(self, i: int, leaf: str) -> Version:
        return Version(self, i, leaf)


class Version:
    """A tree with another leaf: the ancestors of the leaf are copied, all other nodes are those of the base."""

    def __init__(self, base: Tree, i: int, leaf: str):
        self.base, self.copied = base, {(0, i): leaf}
        for k in range(1, len(base.levels)):
            i //= 2
            below = range(2 * i, min(2 * i + 2, len(base.levels[k - 1])))
            self.copied[k, i] = digest(*[self.node(k - 1, j) for j in below])

    def node(self, level: int, i: int) -> str:
        return self.copied.get((level, i)) or self.base.levels[level][i]

    @property
    def root(self) -> str:
        return self.node(len(self.base.levels) - 1, 0)


def fold(node: str, path: list[str]) -> str:
    """The root that a node and the siblings above it lead to."""
    for s in path:
        node = digest(s[1:], node) if s[:1] == "<" else digest(node, s[1:])
    return node


# ------------------------------------------------------------------ leaves
def leaf(fields: dict[str, Column]) -> Column:
    def part(c):
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[part(fields[c]) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the language; null sorts first), h (the leaf) and changed (the tampered leaf, null for others)."""
    fields = {c: F.col(c) for c in FIELDS}
    # One more than the largest long is still a number.
    more = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
                       leaf(fields).alias("h"), F.when(tampered, leaf(more)).alias("changed"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, the place in their tree by ``order``, and n, the tree's rows.

    Rows are dealt out by ranges, equal ones over several, and numbered inside
    each; a range adds the rows of the tree in the ranges before it.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = checkpoint(spread.repartitionByRange("tree", *order, "tie").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
                           F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "tie"))
    return (ranged.withColumn("pos", inside).join(counts, ["tree", "part"])
            .withColumn("pos", F.col("pos") - 1 + F.col("before")).drop("part", "tie", "before"))


# ------------------------------------------------------------------ rounds of blocks
def blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", bits))


def _tree(f: pd.DataFrame, bits: int) -> tuple[pd.DataFrame, Tree]:
    f = f.sort_values("pos")
    return f, Tree(f["h"].tolist(), f["n"].iat[0] > 1 << bits, bits)


def climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes (tree, pos, n, h) of each round, and at last one row a tree, with its root."""
    def top(f):
        f, tree = _tree(f, bits)
        return pd.DataFrame({"tree": f["tree"].iat[0], "pos": [f["block"].iat[0]], "n": [(f["n"].iat[0] - 1 >> bits) + 1], "h": [tree.root]})

    rounds, largest = [nodes], None
    while largest is None or largest > 1:
        up = blocks(rounds[-1].select("tree", "pos", "n", "h"), bits).groupBy("tree", "block").applyInPandas(
            top, "tree string, pos long, n long, h string")
        rounds.append(checkpoint(up))
        largest = rounds[-1].agg(F.max("n")).first()[0] or 1
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """``above`` (tree, block, path, and what else its trees share) carried down to the blocks of the lowest round."""
    shared = [c for c in above.columns if c not in ("tree", "block", "path")]
    schema = ", ".join(f"{n} {t}" for n, t in above.dtypes)

    def down(f, upper):
        f, tree = _tree(f, bits)
        rest = list(upper["path"].iat[0])
        return pd.DataFrame({"tree": f["tree"], "block": f["pos"], "path": [tree.path(i) + rest for i in range(len(f))]}
                            | {c: upper[c].iat[0] for c in shared})[upper.columns]

    for nodes in reversed(rounds[1:-1]):
        lower = blocks(nodes, bits).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
        above = checkpoint(lower.applyInPandas(down, schema))
    return above


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, lang, leaf, subroot, root, path (siblings with their side, up to the root),
    tampered, changed_leaf and folded_root, the root of the tampered version or of the original leaf."""
    rounds = climb(checkpoint(positions(leaves(docs), ["doc_id", "h"])), bits)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "h")
    top = climb(checkpoint(positions(subroots, ["of"])), bits)
    path = F.array().cast("array<string>").alias("path")
    root = descend(top, top[-1].select("tree", F.lit(0).cast("long").alias("block"), path, F.col("h").alias("root")), bits)

    def languages(f, upper):
        f, tree = _tree(f, bits)
        rest = list(upper["path"].iat[0])
        return pd.DataFrame({"tree": f["of"], "block": 0, "path": [tree.path(i) + rest for i in range(len(f))],
                             "subroot": f["h"], "root": upper["root"].iat[0]})

    above = checkpoint(blocks(top[0], bits).groupBy("tree", "block").cogroup(root.groupBy("tree", "block")).applyInPandas(
        languages, "tree string, block long, path array<string>, subroot string, root string"))
    above = descend(rounds, above, bits)

    def prove(f, upper):
        f, tree = _tree(f, bits)
        rest = list(upper["path"].iat[0])
        paths = [tree.path(i) + rest for i in range(len(f))]
        # The version of an untouched leaf is the tree itself, refolded from the leaf.
        folded = [fold(h, p) if c is None else fold(tree.version(i, c).root, rest)
                  for i, (h, c, p) in enumerate(zip(f["h"], f["changed"], paths, strict=True))]
        return pd.DataFrame({"doc_id": f["doc_id"], "lang": [t[1:] if t else None for t in f["tree"]], "leaf": f["h"],
                             "subroot": upper["subroot"].iat[0], "root": upper["root"].iat[0], "path": paths,
                             "changed_leaf": f["changed"], "folded_root": folded})

    rows = blocks(rounds[0], bits).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return rows.applyInPandas(prove, "doc_id long, lang string, leaf string, subroot string, root string, path array<string>, "
                                     "changed_leaf string, folded_root string").withColumn("tampered", F.col("changed_leaf").isNotNull())


def verify(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    siblings = F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "")
    return manifest(docs, bits).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    """The same rows for DuckDB: trees as lists, a level at a time."""
    def hashed(n_chars):
        parts = [f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(parts)})"

    def path(levels, at):   # siblings of the node at this place, one a level
        node = f"({at} >> (x.lvl - 1))"
        return f"""list_transform(list_filter({levels}, lambda x: len(x.l) > 1), lambda x:
          case when {node} % 2 = 1 then '<' || x.l[{node}] when {node} + 1 < len(x.l) then '>' || x.l[{node} + 2] else '' end)"""

    return f"""
with recursive d as (select doc_id, lang, {hashed('n_chars')} as leaf, {hashed('n_chars + 1')} as more,
  list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''),
    lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: case when e >= 0 then xor(c, e) else xor(c >> 1, 3988292384 * (c & 1)) end) as inverse from documents),
o as (select *, case when xor(inverse, 4294967295) % 7 = 0 then more else leaf end as mine,
  row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from d),
t as (select lang, 1 as lvl, list(leaf order by pos) as l from o group by lang
  union all select lang, lvl + 1, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], ''))) from t where len(l) > 1),
s as (select lang, l[1] as subroot, row_number() over (order by lang nulls first) - 1 as place from t where len(l) = 1),
u as (select 1 as lvl, list(subroot order by place) as l from s
  union all select lvl + 1, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], ''))) from u where len(l) > 1),
tl as (select lang, list({{'lvl': lvl, 'l': l}} order by lvl) as levels from t group by lang),
ul as (select list({{'lvl': lvl, 'l': l}} order by lvl) as levels, max(l[1]) filter (where len(l) = 1) as root from u),
p as (select o.doc_id, o.leaf, o.mine, s.subroot, ul.root,
  list_concat({path('tl.levels', 'o.pos')}, {path('ul.levels', 's.place')}) as path
  from o join s on o.lang is not distinct from s.lang join tl on tl.lang is not distinct from o.lang, ul),
f as (select *, list_reduce(list_prepend(mine, path), lambda h, e: sha256(case when e[1] = '<' then e[2:] || h else h || e[2:] end)) as folded_root,
  sha256(array_to_string(list_transform(path, lambda e: e[2:]), '')) as proof_sha256 from p)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from f
"""
