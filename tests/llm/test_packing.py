import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tierscope.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["The cat sat.", "", " ", "a  b", "a   b \n  c  ", "\x1c!\x1cb", "  lead", "don't 's 'll we're", "　x\xa0y", "\n", "\n\n",
         "a\n\n\n b", "x   y\t", "é" * 300 + " z", "<|endoftext|> x", "1234 56,7", "a\n", "a \n", " \n a", "日本語 テキスト", " b"]


def reference(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("fast", [True, False])
def test_encoder_parity(fast):
    content, ranked = tokens.load_byte_level(PATH)
    assert ranked
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab,. \n\t'1é\xa0") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["a" * 50_000, " " * 50_000 + "x", "\n" * 20_000, "ab" * 20_000 + "<|endoftext|>", "hello <|endoftext|> world"]
    got = [x.tolist() for x in tokens.TextEncoder(content, fast).encode(texts)]
    assert got == reference(texts) and got[-1] == [31373, 220, 50256, 995]


def test_every_code_point_is_encoded_alike():
    e = tokens.TextEncoder(tokens.load_byte_level(PATH)[0])
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(start, start + 512) if not 0xD800 <= c < 0xE000) for start in range(0, 0x30000, 512)]
    assert [x.tolist() for x in e.encode(texts)] == reference(texts)


def brute_force(lengths, size):
    """Best-fit decreasing, one piece after the other."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("size", [1, 7, 16, 100])
def test_plan_is_best_fit_decreasing(size):
    rng = random.Random(size)
    for _ in range(60):
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 200))]
        counts = Counter(lengths)
        plan = packing.best_fit_decreasing(counts, size)
        used, by_length = defaultdict(int), defaultdict(list)
        for row in plan:
            by_length[row[0]].append(row)
        for n, rows in by_length.items():
            ends = [r[1] for r in rows[1:]] + [counts[n]]
            for (_, first, bin_, per, offset), end in zip(rows, ends):
                for q in range(end - first):
                    b = bin_ + q // per
                    assert used[b] == offset + q % per * n
                    used[b] += n
        assert sorted(size - u for u in used.values()) == brute_force(lengths, size)


def test_capacity_tree():
    tree = packing.CapacityTree(20)
    for c in (3, 3, 9, 20):
        tree.add(c, 1)
    assert [tree.tightest(x) for x in (0, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    tree.add(20, -1)
    assert tree.tightest(10) is None


def test_documents(spark, docs):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(100, None, None), (101, long, None), (101, long, None)] + [(200 + i, "same text", "en") for i in range(300)]
    out = packing.pack_documents(docs(rows), PATH).collect()
    ids = {i: x + [0] for (i, _, _), x in zip(rows, reference([t or "" for _, t, _ in rows]))}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in out:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert len(by_doc) == len(ids)
    n = len(ids[101])
    assert sorted(set(by_doc[101])) == [(k, max(0, n % 2048 + 2048 * (k - 1)), 2048 if k else n % 2048) for k in range(-(-n // 2048))]
    assert len(by_doc[101]) == 2 * -(-n // 2048)
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(by_bin) <= -(-total // 2048) + 1
    assert packing.pack_documents(docs(rows[:1]).limit(0), PATH).collect() == []
