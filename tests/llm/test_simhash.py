import random
import re

import pytest
import xxhash

from tierscope.llm import simhash
from tierscope.llm.common import connected_components
from tierscope.operators.skew import join_on_hot_keys


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    left, out = set(fps), {}
    while left:
        first = min(left)
        front, seen = [first], {first}
        left.discard(first)
        while front:
            i = front.pop()
            near = {j for j in left if bin(fps[i] ^ fps[j]).count("1") <= 3}
            left -= near
            seen |= near
            front += near
        out |= {i: first for i in seen}
    return out


TEXTS = [None, "", " \n ", "One", "one", "A b", "É b c d", "a b c d e f a b c d", "x\x0by\x1cz w",
         " ".join(str(i * 7919 % 1000) for i in range(30000))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_documents(spark, docs):
    rng = random.Random(1)
    texts = list(TEXTS)
    for _ in range(40):
        w = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(w))
            w[rng.randrange(300)] = "new"
    table = docs([(i, t, None) for i, t in enumerate(texts)] + [(5, TEXTS[5], "en"), (None, "one", "en")])
    out = simhash.near_duplicates(table).collect()
    assert len(out) == len(texts) + 2
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    for r in out:
        if r.doc_id is None:
            assert r.component_id == want[3]
        else:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.near_duplicates(table.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [4096, 5])
def test_links_of_dense_groups_and_of_large_buckets(spark, bucket):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    base = rng.getrandbits(64)
    fps |= {base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 8))) for _ in range(400)}
    for f in list(fps)[:100]:
        fps.add(f ^ sum(1 << b for b in rng.sample(range(64), 3)))
    ids = {i: f for i, f in enumerate(sorted(fps))}
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in ids.items()], "fp long, id long")
    got = {r.node: r.component for r in connected_components(simhash.links(rows, bucket=bucket)).collect()}
    assert {i: got.get(i, i) for i in ids} == brute_components(ids)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 900)] + [(7, 7), (3, 900), (900, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[140] == 100 and got[899] == 3 and got[3] == 3 and 7 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(2000)] + [(i, i) for i in range(2, 4000)], "k long, v long")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("w", -rows.k)
    out = join_on_hot_keys(rows, table, "k", "n").collect()
    assert len(out) == rows.count() and all(r.w == -r.k for r in out)


def test_no_second_bucket_is_passed_on(spark):
    """All fingerprints of the bits that stay open: as many as a bucket can hold."""
    assert simhash.most_open(3) == 18 and simhash.most_open(1) == 16
    rows = spark.createDataFrame([(0, 5, fp, fp) for fp in range(1 << 8)], "part long, key long, fp long, id long")
    out = simhash._link(rows, 1, 1 << 8).collect()
    assert len(out) == (1 << 8) - 1 and all(r["a"] is not None and r["b"] == 0 for r in out)
