import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tierscope.llm import retrieval_packing as rp

PATH = public_tokenizers.path("byte_bpe_50k.json")
T = Tokenizer.from_file(PATH)


def reference(text):
    return T.encode(text or "", add_special_tokens=False).ids + [0]


def checked(rows, pieces, size):
    """Every id of every document in one piece, every sequence gapless and full (or a power of two); the padding."""
    expected = defaultdict(list)
    for doc_id, text in rows:
        expected[doc_id].append(reference(text))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    ids = {doc_id: x for doc_id, (x, *_) in expected.items()}
    for (doc_id, total), found in by_doc.items():
        assert total == len(ids[doc_id])
        # Copies of a document may be cut at other places: each place is covered once by each.
        cover = np.zeros(total, int)
        for p in found:
            assert p.length > 0 and p.ids_crc32 == zlib.crc32(np.array(ids[doc_id][p.start:p.start + p.length], "<u4"))
            cover[p.start:p.start + p.length] += 1
        assert (cover == len(expected[doc_id])).all()
    assert {d for d, _ in by_doc} == set(expected)
    for found in by_sequence.values():
        end = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end == size or end & (end - 1) == 0 and end < size
    return by_sequence


WORDS = {k: [f"{k}{a}{b}" for a in "bcdfg" for b in "aeiou"] for k in ("kal", "mir", "top", "zun", "vex", "qua")}


def topics(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        topic = rng.choice([*WORDS])
        out.append((i, " ".join(rng.choice(WORDS[topic] if rng.random() < 0.3 else ["the", "of", "and", "in", "was", "for"]) for _ in range(rng.randint(5, 120))), topic))
    return out


ODD = [(900, None), (901, ""), (902, "x " * 5000), (903, "hello <|endoftext|> world"), (904, "a" * 30_000), *[(905, "the same row of a copy")] * 40]


@pytest.mark.parametrize("block", [500, rp.BLOCK_IDS])
def test_whole_documents_are_packed_without_padding(spark, docs, block):
    rows = [(i, t) for i, t, _ in topics(200)] + ODD + [(10 ** 6 + i, "copy of one text, many times " * 9) for i in range(60)]
    table = docs([(*r, None) for r in rows]).repartition(5)
    out = rp.sequences(table, PATH, block_ids=block)
    from pyspark.sql import functions as F
    pieces = out.withColumn("ids_crc32", F.crc32("ids")).collect()
    checked(rows, pieces, rp.SIZE)
    for p in pieces:
        assert len(p.ids) == 4 * p.length


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "one short text")], [(7, "word " * 100_000)]])
def test_few_and_long(docs, rows):
    checked(rows, rp.digests(docs([(*r, None) for r in rows]), PATH).collect(), rp.SIZE)


def test_windows_hold_documents_of_a_topic(docs):
    rows = topics(600)
    topic = {i: t for i, _, t in rows}
    pieces = rp.digests(docs([(i, t, None) for i, t, _ in rows]), PATH).collect()
    windows = checked([r[:2] for r in rows], pieces, rp.SIZE)
    pure = [max(sum(p.length for p in w if topic[p.doc_id] == t) for t in WORDS) / sum(p.length for p in w) for w in windows.values() if len(w) > 1]
    assert np.mean(pure) > 0.75   # a sixth at random


def small(texts):
    ids = [np.array(reference(t), "<u2") for t in texts]
    return np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids])), ids


def brute_bm25(ids, query, doc, model_of, terms):
    n, mean = len(ids), sum(map(len, ids)) / len(ids)
    total = 0.0
    for t in terms:
        holders = sum(t in x for x in ids)
        often = int((ids[doc] == t).sum())
        if holders >= 2 and often:
            idf = np.log(1 + (n - holders + 0.5) / (holders + 0.5))
            total += idf * often * (rp.K1 + 1) / (often + rp.K1 * (1 - rp.B + rp.B * len(ids[doc]) / mean))
    return total


def test_scores_are_bm25(spark, docs):
    texts = [t for _, t, _ in topics(40, 5)] + ["", "a", "a"]
    flat, starts, ids = small(texts)
    coded, vocabulary = rp.encoded(docs([(i, t, None) for i, t in enumerate(texts)]), PATH)
    model = rp.statistics(coded, vocabulary)
    for seed in (0, 7, 40):
        shard = rp.Shard(flat, starts, model)
        old, rp.QUERY_TERMS = rp.QUERY_TERMS, 10 ** 6
        try:
            got = shard.scores(seed)
        finally:
            rp.QUERY_TERMS = old
        assert np.allclose(got, [brute_bm25(ids, seed, d, model, set(ids[seed].tolist())) for d in range(len(ids))], rtol=1e-4, atol=1e-5)
        shard.unused[3] = 0
        assert shard.scores(seed)[3] == 0


def test_neighbours_are_taken_best_first():
    flat, starts, ids = small(["kalba kalbe " * 9, "the of and " * 9, "kalba the " * 9, "kalba kalbe " * 8, "zunda"])
    holders = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=50257)
    shard = rp.Shard(flat, starts, rp.Bm25(5, float(np.mean([len(x) for x in ids])), holders))
    order = [d for d, _, _ in rp.fill(shard, np.diff(starts), 1024, 1024)]
    assert order[:3] == [0, 3, 2] and sorted(order) == [0, 1, 2, 3, 4]


def test_powers_of_two():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 200) for _ in range(rng.randint(1, 5))]
        got = list(rp.powers([(0, n) for n in lengths]))
        sizes = defaultdict(int)
        for _, _, n, number in got:
            sizes[number] += n
        assert sum(sizes.values()) == sum(lengths) and all(n & (n - 1) == 0 for n in sizes.values()) and len(set(sizes.values())) == len(sizes)
        assert [sum(n for i, _, n, _ in got if i == k) for k in range(len(lengths))] == lengths


def test_ids_above_sixteen_bits():
    ids = np.array([70_000, 5, 70_000, 9], "<u4")
    doc, term, often = rp.doc_terms(ids, np.array([0, 3, 4]))
    assert (doc.tolist(), term.tolist(), often.tolist()) == ([0, 0, 1], [5, 70_000, 9], [1, 2, 1])
