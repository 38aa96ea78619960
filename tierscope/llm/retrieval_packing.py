"""Lexical retrieval packing: sequences of documents that share rare terms.

Terms are the ids of the tokenizer, so statistics of the whole corpus (how
many documents hold a term, mean length) are a table no longer than the
vocabulary.  Documents are dealt out in ranges of their best two terms by
BM25 weight; copies and a frequent term spread over several ranges.  A task
goes through its range in blocks of bounded size: each block is a shard with
an inverted index of its own (``Shard``).  A seed document is the query; its
unused neighbours, best first, fill the seed's window.  What does not fit of
the last one is the next seed, and the window that a block leaves open goes
on in the next, so sequences have no gaps.  The last window of a task is cut
into powers of two, which need no padding.

Defined results: null text counts as empty; an empty document is the closing
id alone; whole windows of a long document are sequences of their own, and
its rest is packed; documents without a neighbour are packed in the order of
the range; repeated rows are documents of their own; an empty table gives an
empty result; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import offsets_of, slices, stored
from tierscope.llm.tokens import byte_level, load_byte_level

SIZE = 1024
K1, B = 1.2, 0.75
QUERY_TERMS = 24            # of a seed, those of most weight
BLOCK_IDS = 4_000_000       # of a shard; with at most BLOCK_DOCS documents
BLOCK_DOCS = 60_000


# ------------------------------------------------------------------ statistics of the corpus
def encoded(docs: DataFrame, tokenizer_path: str, end: int = 0) -> tuple[DataFrame, int]:
    """(doc_id, ids as binary, see ``kind``) of every document, closed by ``end``; and the vocabulary's size."""
    loaded = load_byte_level(tokenizer_path)
    content = docs.sparkSession.sparkContext.broadcast(loaded)
    size = byte_level(loaded).size
    closing, form = np.array([end], "<u4"), kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = (t or "" for t in part.column(1).to_pylist())
                ids = [np.append(x, closing).astype(form).tobytes() for x in byte_level(content.value).encode(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary"), size


def kind(vocabulary: int) -> str:
    """Form of ids between tasks: little-endian, of 16 bits if that is enough."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _ids(a: pa.Array, form: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and where each row's start (and the last ends)."""
    starts = offsets_of(a).astype(np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]] if len(a) else np.zeros(0, np.uint8)
    return data.view(form), (starts - starts[0]) // np.dtype(form).itemsize


def doc_terms(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) of every distinct term of every document, in that order."""
    small = ids.itemsize == 2 and len(starts) <= 1 << 16
    whole, bits = (np.uint32, 16) if small else (np.uint64, 32)
    key = np.repeat(np.arange(len(starts) - 1, dtype=whole) << whole(bits), np.diff(starts)) | ids
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> whole(bits)).astype(np.int64), (key & whole((1 << bits) - 1)).astype(np.int64), n


class Bm25:
    """Weights from the whole corpus: documents, their mean length, and how many hold each term."""

    def __init__(self, documents: int, mean_length: float, holders: np.ndarray):
        self.mean_length = max(mean_length, 1.0)
        self.idf = np.log1p((documents - holders + 0.5) / (holders + 0.5)).astype(np.float32)
        self.idf[holders < 2] = 0   # such a term leads to no other document

    def weights(self, term: np.ndarray, often: np.ndarray, length: np.ndarray) -> np.ndarray:
        norm = K1 * (1 - B + B * length / self.mean_length)
        return (self.idf[term] * often * (K1 + 1) / (often + norm)).astype(np.float32)


def statistics(docs: DataFrame, size: int) -> Bm25:
    """Counts are summed in every task, then by term; at most ``size`` rows reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, documents, length, form = np.zeros(size, np.int64), 0, 0, kind(size)
        for batch in batches:
            for part in slices(batch, 0):
                ids, starts = _ids(part.column(0), form)
                holders += np.bincount(doc_terms(ids, starts)[1], minlength=size)
                documents, length = documents + len(part), length + len(ids)
        term = np.flatnonzero(holders)
        # Two rows more: of all documents.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(holders[term], [documents, length]))], ["term", "n"])

    found = docs.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(found["term"], found["n"], strict=True))
    holders = np.zeros(size, np.int64)
    terms = found[found["term"] >= 0]
    holders[terms["term"]] = terms["n"]
    return Bm25(n.get(-1, 0), n.get(-2, 0) / max(n.get(-1, 0), 1), holders)


def best_terms(docs: DataFrame, model: Broadcast) -> DataFrame:
    """``docs`` with first and second, the document's two terms of most weight (null without)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, starts = _ids(part.column(1), kind(len(model.value.idf)))
                doc, term, often = doc_terms(ids, starts)
                w = model.value.weights(term, often, np.diff(starts)[doc])
                begin = np.searchsorted(doc, np.arange(len(part)))   # every document has the closing id
                out = []
                for _ in range(2):
                    top = np.maximum.reduceat(w, begin)
                    at = np.flatnonzero((w == top[doc]) & (w > 0))
                    owner, one = np.unique(doc[at], return_index=True)
                    best = np.full(len(part), -1)
                    best[owner] = term[at[one]]
                    w[at[one]] = 0
                    out.append(pa.array(best, mask=best < 0))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], ["doc_id", "ids", "first", "second"])

    return docs.mapInArrow(run, "doc_id long, ids binary, first long, second long")


# ------------------------------------------------------------------ one shard
class Shard:
    """Inverted index of a block of documents; ``best`` gives the unused neighbour of most BM25 score."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, model: Bm25):
        doc, term, often = doc_terms(ids, starts)
        weight = model.weights(term, often, np.diff(starts)[doc])
        keep = weight > 0
        doc, term, weight = doc[keep], term[keep], weight[keep]
        self.n = len(starts) - 1
        self.doc_begin, self.terms, self.weight = np.searchsorted(doc, np.arange(self.n + 1)), term, weight
        by_term = np.argsort(term, kind="stable")
        self.posted, self.posted_weight = doc[by_term], weight[by_term]
        self.term_begin = np.searchsorted(term[by_term], np.arange(len(model.idf) + 1))
        self.unused = np.ones(self.n, np.float32)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every unused document for the seed's terms of most weight."""
        a, b = self.doc_begin[seed], self.doc_begin[seed + 1]
        terms = self.terms[a:b]
        if b - a > QUERY_TERMS:
            terms = terms[np.argpartition(-self.weight[a:b], QUERY_TERMS)[:QUERY_TERMS]]
        spans = [slice(self.term_begin[t], self.term_begin[t + 1]) for t in terms]
        if not spans:
            return np.zeros(self.n)
        found = np.concatenate([self.posted[s] for s in spans])
        return np.bincount(found, np.concatenate([self.posted_weight[s] for s in spans]), self.n) * self.unused


def fill(shard: Shard, lengths: np.ndarray, room: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(document, start, length): all documents in windows of ``size``, one piece after the other.

    ``room`` is what an open window still takes; the last window may stay open.
    """
    waiting, seed_scores, rest = iter(range(shard.n)), None, None
    shard.unused[lengths == 0] = 0
    left = np.count_nonzero(lengths)
    while left or rest:
        if rest:
            doc, start = rest
            rest = None
        else:
            doc, start = -1, 0
            if seed_scores is not None:
                best = int(seed_scores.argmax())
                if seed_scores[best] > 0:
                    doc = best
            if doc < 0:   # a new seed: the next in the order of the range
                doc = next(d for d in waiting if shard.unused[d])
                seed_scores = None
            shard.unused[doc] = 0
            left -= 1
        if room == size or seed_scores is None:
            seed_scores = shard.scores(doc)
        seed_scores[doc] = 0
        n = min(room, int(lengths[doc]) - start)
        yield doc, start, n
        room -= n
        if room == 0:
            room = size
        if start + n < lengths[doc]:
            rest = doc, start + n


def powers(pieces: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start in it, length, number of the sequence): pieces (start, length) dealt to sequences whose sizes are falling powers of two."""
    total = sum(n for _, n in pieces)
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    number, room = 0, sizes[0] if sizes else 0
    for i, (start, n) in enumerate(pieces):
        while n:
            take = min(n, room)
            yield i, start, take, number
            start, n, room = start + take, n - take, room - take
            if not room and number + 1 < len(sizes):
                number += 1
                room = sizes[number]


# ------------------------------------------------------------------ packing
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Range:
    """Packs the documents of one task, block by block; ``rows`` are finished pieces."""

    def __init__(self, model: Bm25, task: int, size: int):
        self.model, self.size, self.sequence = model, size, task << 33
        self.open: list[tuple] = []        # pieces of the window not yet full: doc_id, start, doc_tokens, ids
        self.filled = 0
        self.columns = [[] for _ in range(7)]

    def _put(self, doc_id, start: int, total: int, ids: np.ndarray, offset: int) -> None:
        for c, v in zip(self.columns, (doc_id, start, len(ids), total, self.sequence, offset, ids.astype("<u4").tobytes()), strict=True):
            c.append(v)

    def rows(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in self.columns[:6]], pa.array(self.columns[6], pa.binary())], names)
        self.columns = [[] for _ in range(7)]
        return out

    def _close(self) -> None:
        offset = 0
        for doc_id, start, total, ids in self.open:
            self._put(doc_id, start, total, ids, offset)
            offset += len(ids)
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def block(self, doc_ids: list, ids: np.ndarray, starts: np.ndarray) -> None:
        whole = np.diff(starts) // self.size * self.size   # windows that a document fills alone
        for d in np.flatnonzero(whole):
            for a in range(0, int(whole[d]), self.size):
                self._put(doc_ids[d], a, int(starts[d + 1] - starts[d]), ids[starts[d] + a:starts[d] + a + self.size], 0)
                self.sequence += 1
        rest = np.diff(starts) - whole
        for d, start, n in fill(Shard(ids, starts, self.model), rest, self.size - self.filled, self.size):
            at = starts[d] + whole[d] + start
            self.open.append((doc_ids[d], int(whole[d]) + start, int(starts[d + 1] - starts[d]), ids[at:at + n].copy()))
            self.filled += n
            if self.filled == self.size:
                self._close()

    def end(self) -> None:
        pieces, last, offset = self.open, 0, 0
        for i, start, n, number in powers([(0, len(p[3])) for p in pieces]):
            if number != last:
                self.sequence, last, offset = self.sequence + 1, number, 0
            doc_id, first, total, ids = pieces[i]
            self._put(doc_id, first + start, total, ids[start:start + n], offset)
            offset += n
        self.open = []


def pack(docs: DataFrame, model: Bm25, size: int = SIZE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The pieces of encoded documents (doc_id, ids) and their places in the sequences; ``ids`` are those of the piece."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Equal documents are told apart by a number, so that a large group of copies spreads over ranges.
    keys = ["first", "second", F.xxhash64("doc_id"), "doc_id", "tie"]
    ranged = best_terms(docs, shared).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Range(shared.value, TaskContext.get().partitionId(), size)
        waiting, held, rows = [], 0, 0
        width = np.dtype(kind(len(shared.value.idf))).itemsize
        for batch in batches:
            for part in slices(batch, 1, width * block_ids, BLOCK_DOCS):
                n = int(np.ptp(offsets_of(part.column(1)))) // width
                if waiting and (held + n > block_ids or rows + len(part) > BLOCK_DOCS):
                    yield from packed(out, waiting)
                    waiting, held, rows = [], 0, 0
                waiting.append(part)
                held, rows = held + n, rows + len(part)
        if waiting:
            yield from packed(out, waiting)
        out.end()
        yield out.rows()

    def packed(out, parts):
        column = pa.concat_arrays([p.column(1) for p in parts])
        ids, starts = _ids(column, kind(len(shared.value.idf)))
        out.block([d for p in parts for d in p.column(0).to_pylist()], ids, starts)
        yield out.rows()

    return ranged.select("doc_id", "ids").mapInArrow(run, SCHEMA)


def sequences(docs: DataFrame, tokenizer_path: str, size: int = SIZE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The pieces of all documents with their ids (little-endian, 32 bits each), sequence and offset."""
    coded, vocabulary = encoded(docs, tokenizer_path)
    coded = stored(coded)
    return pack(coded, statistics(coded, vocabulary), size, block_ids)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As ``sequences``, the ids of a piece given by their CRC-32."""
    return sequences(docs, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
