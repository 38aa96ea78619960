import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from tierscope.llm import merkle
from tierscope.llm.merkle import Tree, fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    n_chars = None if n_chars is None else n_chars + more
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climbed(nodes, at):
    """Root and siblings of one node, a level at a time."""
    siblings = []
    while len(nodes) > 1:
        run = at - at % 2
        siblings += [(j < at, nodes[j]) for j in range(run, min(run + 2, len(nodes))) if j != at] or [None]
        nodes, at = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], siblings


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    for part in by_lang.values():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    roots = [climbed([leaf_of(r) for r in by_lang[k]], 0)[0] for k in langs]
    out = []
    for q, k in enumerate(langs):
        nodes = [leaf_of(r) for r in by_lang[k]]
        root, upper = climbed(roots, q)
        for at, r in enumerate(by_lang[k]):
            siblings = climbed(nodes, at)[1] + upper
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(r, 1) if tampered else nodes[at]
            for s in siblings:
                node = h(node) if s is None else h(s[1], node) if s[0] else h(node, s[1])
            out.append((r[0], nodes[at], roots[q], root, h(*[s[1] for s in siblings if s]), node, node == root))
    return sorted(out, key=str)


def documents(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"text {i} é", rng.choice(langs), rng.choice(["a", None]), rng.choice([3, None, 2 ** 63 - 1]), "x", "y") for i in range(n)]
    return rows + [(None, None, None, None, None, "x", "y"), (5, "", "", "", 0, "x", "y"), *rows[:3], *rows[:3], (9, "other", rows[9][2], "a", 1, "x", "y")]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_equals_brute_force(spark, bits):
    rows = documents(70, ["en", "en", "en", "de", None, "fr", "és"])
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA).repartition(7), bits).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_many_languages(spark):
    rows = documents(30, [f"l{i}" for i in range(40)])
    assert sorted(map(tuple, merkle.verify(spark.createDataFrame(rows, SCHEMA), 1).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(7, "one", "en", "s", 3, "", "")], [(7, "x" * 3_000_000, None, None, None, "", "")]])
def test_few_and_long(spark, rows):
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_repeated_rows_share_no_position(spark):
    rows = [(1, "same", "en", "s", 4, "", "")] * 50
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA).repartition(5), 2).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_sql_says_the_same(spark):
    rows = [r for r in documents(70, ["en", "de", None]) if r[4] != 2 ** 63 - 1]
    documents_table = spark.createDataFrame(rows, SCHEMA).toPandas()
    con = duckdb.connect()
    con.register("raw", documents_table)
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, text, lang, source, cast(n_chars as bigint) as n_chars from raw")
    assert sorted(con.execute(merkle.oracle_sql()).fetchall(), key=str) == brute(rows)


def test_a_version_copies_only_the_ancestors():
    tree = Tree([h(str(i)) for i in range(13)], True, 4)
    before = [list(level) for level in tree.levels]
    version = tree.version(12, h("other"))
    assert set(version.copied) == {(0, 12), (1, 6), (2, 3), (3, 1), (4, 0)}
    assert version.root == fold(h("other"), tree.path(12)) == Tree([*before[0][:12], h("other")], True, 4).root != tree.root
    assert tree.levels == before
    assert all(version.node(k, i) is tree.levels[k][i] for k, level in enumerate(before) for i in range(len(level)) if (k, i) not in version.copied)
