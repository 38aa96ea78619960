import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tierscope.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "The cat  sat.\nOn\tthe mat ", "日本é\0\0x", "a" * 3000, "\U0001f600 né", " lead", "x" + " " * 45 + "y", "▁a"]


def test_parity_on_random_texts():
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abe,. \n  \0'1é日-=") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    e = tokens.metaspace(tokens.load(PATH))
    e.GROUP, e.WORDS = 400, 300
    assert [x.tolist() for x in e.encode(texts)] == SP.encode(texts)


def test_whole_tokenizer_agrees_with_words():
    whole = tokens.tokenizer(tokens.parse_model(open(PATH, "rb").read()))
    assert [e.ids for e in whole.encode_batch(TEXTS)] == SP.encode(TEXTS)


def varint(n):
    return bytes([n]) if n < 128 else bytes([n % 128 + 128]) + varint(n // 128)


def field(number, value):
    return varint(number * 8) + varint(value) if isinstance(value, int) else varint(number * 8 + 2) + varint(len(value)) + value


def unigram_model():
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("▁ab", -2.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("c", -5.0, 1), ("bc", -4.0, 1), ("▁a", -3.5, 1)]
    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + field(3, k)) for p, s, k in pieces)
    return out + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0))


def test_unigram_model():
    data = unigram_model()
    ours, theirs = tokens.tokenizer(tokens.parse_model(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ("abc", "ab c", "aabbcc abc", "é abc", "c"):
        assert ours.encode(text).ids == theirs.encode(text)
        assert ours.decode(ours.encode(text).ids, skip_special_tokens=False) == text


def test_other_model_types_are_refused():
    with pytest.raises(ValueError):
        tokens.parse_model(field(1, field(1, b"a")) + field(2, field(3, 4)))


def test_documents(spark, docs):
    table = docs([(i, t, None) for i, t in enumerate(TEXTS)] + [(50, None, None), (2, TEXTS[2], "x")])
    out = tokens.digests(table, PATH).collect()
    assert len(out) == len(TEXTS) + 2 and all(r.round_trip for r in out)
    for r in out:
        ids = SP.encode(TEXTS[r.doc_id] if r.doc_id < 50 else "")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4")))
    full = {r.doc_id: r for r in tokens.encode_decode(table, PATH).collect()}
    assert full[2].decoded == TEXTS[2] and full[8].decoded == " a" and full[50].ids == []
    assert tokens.digests(table.limit(0), PATH).collect() == []
