import numpy as np
import pytest

from tierscope.llm import cover_tree as C


def brute(rows):
    ok = [i for i, (v, e, label) in enumerate(rows) if v is not None and label is not None and e is not None and len(e)
          and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    unit = {i: u / np.abs(u).max() for i, u in unit.items()}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i].add(j)
    out = []
    for i, (v, _, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            more = links[front.pop()] - seen
            seen |= more
            front += more
        low = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((v, len(links[i]), low, v == low))
    return sorted(out, key=str)


def clustered(rng, n, dim=8):
    centers = rng.normal(size=(n // 10, dim))
    return [(c + rng.normal(size=dim) * rng.choice([0.02, 0.05, 0.1, 1.0])).astype(np.float32).tolist() for c in centers[rng.integers(len(centers), size=n)]]


@pytest.mark.parametrize("cell", [4096, 15])
def test_links_and_components(spark, cell):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 300) + rng.normal(size=(60, 8)).astype(np.float32).tolist()
    rows = [(1000 + i, v, int(rng.integers(2))) for i, v in enumerate(vectors)]
    rows += [(i, vectors[0], 1) for i in range(40)]                       # exact copies
    rows += [(2000, vectors[1], None), (2001, None, 1), (2002, [0.0] * 8, 1), (2003, [float("nan")] + [1.0] * 7, 1), (2004, [1.0, None], 1),
             (2005, [float("inf"), 1.0], 1), (2006, [], 0), (2007, [1.0], 1), (2008, [2.0], 1), (2009, [1e30] * 8, 0), (2010, [3e38] * 8, 0),
             (None, vectors[0], 1), (0, vectors[0], 1), (2011, [-0.0] * 8, 1)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, kept int")
    got = sorted((tuple(r) for r in C.near_duplicates(table, cell=cell).collect()), key=str)
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == (g[0] == g[2]) for g in got)


def test_empty(spark):
    assert C.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_unit_against_brute_force():
    rng = np.random.default_rng(4)
    x = C._unit(clustered(rng, 900, 5))
    n = rng.integers(1, 4, size=900)
    ids = np.arange(900)
    close = x @ x.T >= 0.98
    np.fill_diagonal(close, False)
    links, _ = C.unit_links(x, n, ids, np.zeros(900, int))
    assert (links == close @ n).all()
    home = (rng.random(900) < 0.5).astype(int)
    links, reached = C.unit_links(x, n, ids, home)
    across = close & (home[:, None] != home[None])
    assert (links == across @ n).all() and (reached <= ids).all()


def test_tree_nests_and_prunes():
    rng = np.random.default_rng(5)
    x = C._unit(clustered(rng, 2000, 4))
    tree = C.Node(x, np.arange(2000), 0)

    def walk(node):
        d = C._distances(x[node.members], x[node.center:node.center + 1])
        assert d.max() <= node.radius + 1e-12
        assert not node.children or sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
        for c in node.children:
            assert c.radius <= node.radius / 2 + 1e-12
            walk(c)

    walk(tree)
    blocks = sum(len(r) * len(c) for r, c, _, _ in C._pairs(x, x, tree, tree, 0.98, True))
    assert tree.children and blocks < 2000 * 2000 / 4
