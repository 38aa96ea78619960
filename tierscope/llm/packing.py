"""Best-fit decreasing packing of tokenised documents into fixed-size sequences.

Lengths are small integers, so best-fit decreasing depends only on how many
pieces have each length.  Spark counts pieces by length; the driver runs the
exact algorithm on those counts (at most ``SIZE`` numbers, whatever the
corpus), placing all equal pieces that meet equal bins at once; a segment
tree over remaining capacities finds the tightest open bin in logarithmic
time.  The resulting plan says for each length which ranks go to which bins;
Spark ranks the pieces of a length (over hashed shards, so that one frequent
length is not one task) and looks every rank up in the plan.

Defined results: null text counts as empty; an empty document is the closing
id alone; repeated rows are packed once each; ties in length are broken by
doc_id, piece and checksum; an empty table gives an empty result; other
columns of the input do not matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.llm.common import checkpoint, map_rows
from tierscope.llm.tokens import byte_level, load_byte_level

SIZE = 2048
SHARDS = 64

def tokenized_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; only documents over ``size`` ids are cut."""
    content = docs.sparkSession.sparkContext.broadcast(load_byte_level(tokenizer_path))
    end = np.zeros(1, "<u4")

    def rows(batch):
        out = defaultdict(list)
        texts = (t or "" for t in batch["text"])
        for doc_id, ids in zip(batch["doc_id"], byte_level(content.value).encode(texts), strict=True):
            ids = np.append(ids, end)
            n = len(ids)
            cuts = [0, *range(n % size or size, n, size), n]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for name, v in (("doc_id", doc_id), ("piece", piece), ("start", a), ("length", b - a),
                                ("ids_crc32", zlib.crc32(ids[a:b]))):
                    out[name].append(v)
        return out

    return map_rows(docs.select("doc_id", "text"),
                    "doc_id long, piece int, start long, length long, ids_crc32 long", rows)


class CapacityTree:
    """Segment tree over remaining capacities; a node holds the number of open bins under it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.open[i] += bins
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is ``least`` or more."""
        i = least + self.leaves
        if not self.open[i]:
            while i > 1 and (i % 2 or not self.open[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not self.open[2 * i])
        return i - self.leaves


def best_fit_decreasing(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (length, first rank, first bin, pieces per bin, offset in the bin).

    Row k covers the ranks of its length up to the next row's: rank q goes to
    bin ``first bin + (q - first rank) // per bin``.
    """
    tree, bins, n_bins, plan = CapacityTree(size), defaultdict(list), 0, []
    for length in sorted(counts, reverse=True):
        done, count = 0, counts[length]
        while done < count:
            room = tree.tightest(length)
            if room is None:
                room = size
                new = -(-(count - done) // (size // length))
                first, n, n_bins = n_bins, new, n_bins + new
            else:
                first, n = bins[room].pop()
                tree.add(room, -n)
            per_bin = min(room // length, count - done)
            filled = min(n, (count - done) // per_bin)
            plan.append((length, done, first, per_bin, size - room))
            done += filled * per_bin
            for a, k, left in ((first, filled, room - per_bin * length), (first + filled, n - filled, room)):
                if k and left:
                    bins[left].append((a, k))
                    tree.add(left, k)
    return plan


def pack(pieces: DataFrame, size: int = SIZE, shards: int = SHARDS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length and ids_crc32."""
    sc = pieces.sparkSession.sparkContext
    ranked = checkpoint(pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")))
    # At most size * shards rows, whatever the corpus.
    counts = np.zeros((size + 1, shards), np.int64)
    for r in ranked.groupBy("length", "shard").count().collect():
        counts[r["length"], r["shard"]] = r["count"]
    plan = best_fit_decreasing({n: int(c) for n, c in enumerate(counts.sum(axis=1)) if c}, size)
    plan = np.array(plan or [(0, 0, 0, 1, 0)], np.int64)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    looked_up = sc.broadcast((np.cumsum(counts, axis=1) - counts, plan[order]))

    w = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("rank", F.row_number().over(w) - 1)

    def place(frames):
        before, plan = looked_up.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for f in frames:
            length = f["length"].to_numpy()
            rank = f["rank"].to_numpy().astype(np.int64) + before[length, f["shard"].to_numpy()]
            _, first_rank, first_bin, per_bin, used = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
            q = rank - first_rank
            yield f.drop(columns=["shard", "rank"]).assign(
                sequence_id=first_bin + q // per_bin, offset=used + q % per_bin * length)

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    return pack(tokenized_pieces(docs, tokenizer_path, size), size)
