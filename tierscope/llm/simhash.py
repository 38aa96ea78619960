"""SimHash near-duplicates: exact linking by pigeonhole blocks, then components.

Fingerprints are equal for equal word sequences, so only distinct ones are
linked, each standing for its smallest doc_id.  The 64 bits are cut into six
blocks; two fingerprints with at most three differing bits agree in at least
three whole blocks, so each goes to one bucket for each choice of three
blocks (20 tables of 32-bit keys, so buckets stay small at any size).  Inside
a bucket every fingerprint reaches the others by breadth-first search with
verified Hamming distances, and one row per member names the smallest id it
reaches: no pairs are emitted.  A bucket of more than ``BUCKET`` members is
passed on and cut once more by the same scheme over its open bits; the bits
that are then open (18 at most for three differing bits) bound the distinct
fingerprints of a bucket, so every one is searched.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows get the same component; a row without doc_id links
nothing but takes the component of its fingerprint; an empty table gives an
empty result; other columns of the input do not matter.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import checkpoint, connected_components, map_rows
from tierscope.operators.skew import join_on_hot_keys

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BUCKET = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64 (signed, as Spark's long)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*accumulate(map((1).__add__, map(len, words)))]   # one past the space after each word
    starts = [0, *ends[:max(0, len(words) - shingle)]]
    stops = ends[min(shingle, len(words)) - 1:]
    hashes = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, map(slice, starts, map((-1).__add__, stops))),
                             repeat(SEED)), "<u8", len(starts))
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def rows(batch):
        return {"doc_id": batch["doc_id"], "fp": [fingerprint(t, shingle) for t in batch["text"]]}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", rows)


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal runs of the given bit positions."""
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _tables(bits: list[int], max_bits: int) -> list[int]:
    """Masks of all choices of half of 2 * max_bits blocks: close pairs agree under one of them."""
    return [sum(c) for c in combinations(_blocks(bits, 2 * max_bits), max_bits)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _reached(fps: np.ndarray, ids: np.ndarray, max_bits: int) -> np.ndarray:
    """For each member the smallest id it reaches by links inside the bucket."""
    root, left = np.empty_like(ids), np.argsort(ids, kind="stable")
    while len(left):
        first, front = ids[left[0]], left[:1]
        root[front], left = first, left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front[0]]) <= max_bits
            root[left[near]] = first
            front, left = np.concatenate([front[1:], left[near]]), left[~near]
    return root


def _link(rows: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """Rows (part, key, fp, id) -> links (a, b), and members of larger buckets (part, key, fp, id)."""
    def run(frames):
        held: list[pd.DataFrame] = []     # the bucket that the last batch ended in, if it is small
        passed = None                     # the large bucket that is being passed on

        def links(f: pd.DataFrame):
            starts = np.flatnonzero(np.r_[True, (f["key"].diff() != 0)[1:] | (f["part"].diff() != 0)[1:]])
            sizes = np.diff(np.r_[starts, len(f)])
            fps, ids = f["fp"].to_numpy().view(np.uint64), f["id"].to_numpy()
            for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
                if n > bucket:
                    yield f.iloc[s:s + n].assign(a=None, b=None)
                    continue
                root = _reached(fps[s:s + n], ids[s:s + n], max_bits)
                moved = root != ids[s:s + n]
                if moved.any():
                    yield pd.DataFrame({"a": ids[s:s + n][moved], "b": root[moved]}).assign(part=None, key=None, fp=None, id=None)

        for f in frames:
            last = (f["part"].iloc[-1], f["key"].iloc[-1])
            if passed is not None:
                same = ((f["part"] == passed[0]) & (f["key"] == passed[1])).to_numpy()
                if same.any():
                    yield f[same].assign(a=None, b=None)
                    f = f[~same]
                if not len(f):
                    continue
                passed = None
            f = pd.concat([*held, f], ignore_index=True) if held else f.reset_index(drop=True)
            tail = ((f["part"] == last[0]) & (f["key"] == last[1])).to_numpy()
            size = int(tail.sum())
            if size < len(f):
                yield from links(f[~tail])
            held = [f[tail]]
            if size > bucket:
                yield held[0].assign(a=None, b=None)
                held, passed = [], last
        for f in held:
            yield from links(f.reset_index(drop=True))

    out = "a long, b long, part long, key long, fp long, id long"
    cols = [c.split()[0] for c in out.split(", ")]

    def ordered(frames):
        for f in run(frames):
            yield f[cols].astype("Int64")

    return rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInPandas(ordered, out)


def _explode(rows: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(t).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for t, m in enumerate(masks)])
    return rows.select("*", F.explode(keys).alias("k")).select("k.part", "k.key", *rows.columns)


def most_open(max_bits: int) -> int:
    """Bits that a choice of blocks and one more over its open bits can leave open."""
    masks = _tables(list(range(64)), max_bits)
    return max(64 - (m | m2).bit_count() for m in masks for m2 in _tables([b for b in range(64) if not m >> b & 1], max_bits))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints (fp, id); connected as the full link graph is."""
    masks = _tables(list(range(64)), max_bits)
    first = checkpoint(_link(_explode(distinct.select("fp", "id"), masks), max_bits, bucket))
    # Large buckets: again by choices of blocks, over the bits that their first mask leaves open.
    finer = []
    for t, m in enumerate(masks):
        for m2 in _tables([b for b in range(64) if not m >> b & 1], max_bits):
            finer.append((t, _signed(m | m2)))
    by_part = F.create_map(*[x for t in range(len(masks)) for x in
                             (F.lit(t), F.array(*[F.lit(m) for p, m in finer if p == t]))])
    large = (first.filter("fp is not null").select(F.col("part").alias("p"), "fp", "id")
             .select("p", "fp", "id", F.posexplode(by_part[F.col("p").cast("int")]).alias("i", "m"))
             .select((F.col("p") * 100 + F.col("i")).alias("part"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp", "id"))
    second = _link(large, max_bits, 1 << most_open(max_bits))
    return first.filter("a is not null").select("a", "b").union(second.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable)."""
    fps = checkpoint(fingerprints(docs, shingle))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    found = connected_components(links(distinct.filter("id is not null"), max_bits))
    component = (distinct.join(found.withColumnRenamed("node", "id"), "id", "left")
                 .select("fp", "n", F.coalesce("component", "id").alias("component_id")))
    out = join_on_hot_keys(fps, component, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the rows whose group has a smaller doc_id, and one of equal rows.

    Rows without doc_id can't be named in a group; they stay.
    """
    found = near_duplicates(docs, shingle, max_bits)
    keep = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))
