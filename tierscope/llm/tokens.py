"""Encoding of whole texts under public vocabularies, and SentencePiece models.

``TextEncoder`` encodes under a byte-level vocabulary.  For SentencePiece
models no token crosses from one word into the next, so the ids of a text are
the ids of its words joined; corpora repeat words, so a worker encodes each
word once and then looks it up (``WordEncoder``, ``metaspace``).

A SentencePiece model is read from its protobuf and rebuilt for the
tokenizers library: normaliser and metaspace marker, unigram scores or the
merges that BPE scores imply, byte fallback, and the decoder.  ``load``
verifies that the rebuilt tokenizer agrees with the sentencepiece library on
every piece of the vocabulary and on probe texts, and raises otherwise.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from tierscope.llm.common import map_rows


class _Numbered(dict):
    """Numbers words as they are first looked up; ``new`` lists those since it was last emptied."""

    def __init__(self):
        self.new = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


class WordEncoder:
    """Ids of texts from the ids of their words.

    ``words`` cuts a text; ``plain`` tells words that may be joined by
    ``separator``, a text that then gets exactly one id, which no plain word
    has: many new words are encoded as one text, and cut at that id.
    """

    WORDS, IDS = 1_000_000, 20_000_000   # remembered; beyond them the rarest words go
    GROUP = 1_000_000                    # characters encoded at a time

    def __init__(self, tokenizer, words: Callable, plain: Callable, separator: str, separator_id: int):
        self.tokenizer, self.words, self.plain = tokenizer, words, plain
        self.separator, self.separator_id = separator, separator_id
        self._forget()

    def _forget(self) -> None:
        self.number, self.used = _Numbered(), 0
        self.ids = np.empty(1 << 16, "<u4")
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)
        self.seen = np.zeros(1 << 14, np.int32)

    def _gather(self, row: np.ndarray) -> np.ndarray:
        """The ids of the words of these numbers, joined."""
        n = self.lengths[row].astype(np.int64)
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.starts[row] - ends + n, n) + np.arange(int(ends[-1]) if len(row) else 0)]

    def _trim(self) -> None:
        """Keeps the words seen most often, half of the limits at most."""
        words, often = list(self.number), 2
        seen = self.seen[:len(words)]
        while (kept := np.flatnonzero(seen >= often)).size > self.WORDS // 2 or self.lengths[kept].sum() > self.IDS // 2:
            often *= 2
        ids, n = self._gather(kept), self.lengths[kept]
        self._forget()
        self.number.update((words[i], k) for k, i in enumerate(kept.tolist()))
        self._room()
        self.lengths[:len(n)], self.starts[:len(n)] = n, np.cumsum(n) - n
        self._keep(ids)

    def _room(self) -> None:
        """Places for every numbered word."""
        while len(self.starts) < len(self.number):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4")

    def _keep(self, ids: np.ndarray) -> int:
        """Appends to the remembered ids; where they start."""
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self) -> None:
        """Encodes the words that were numbered since the last call."""
        new, self.number.new = self.number.new, []
        known = len(self.number) - len(new)
        self._room()
        joined = [i for i, w in enumerate(new) if self.plain(w)]
        chunks = [joined[i:i + 2000] for i in range(0, len(joined), 2000)]
        for chunk, ids in zip(chunks, self._encode([self.separator.join([new[i] for i in c]) for c in chunks]), strict=True):
            cuts = np.flatnonzero(ids == self.separator_id)
            starts, row = np.concatenate([[0], cuts + 1]), np.array(chunk) + known
            self.lengths[row] = np.append(cuts, len(ids)) - starts
            self.starts[row] = starts + self._keep(ids)
        alone = [i for i, w in enumerate(new) if not self.plain(w)]
        for i, ids in zip(alone, self._encode([new[i] for i in alone]), strict=True):
            self.lengths[known + i], self.starts[known + i] = len(ids), self._keep(ids)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.number) > self.WORDS or self.used > self.IDS:
            self._trim()
        find, number = self.words, self.number.__getitem__
        rows = [np.fromiter(map(number, find(t)), np.int32) for t in texts]
        self._learn()
        if rows:
            self.seen[:len(self.number)] += np.bincount(np.concatenate(rows), minlength=len(self.number)).astype(np.int32)
        for r in rows:
            yield self._gather(r)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a group of texts is encoded at a time."""
        group, chars = [], 0
        for t in texts:
            group.append(t)
            chars += len(t)
            if chars > self.GROUP:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)


_WORKER: dict[tuple, WordEncoder] = {}


def encoder(make: Callable[[str], WordEncoder], tokenizer_json: str) -> WordEncoder:
    """One encoder a worker process."""
    key = make.__name__, zlib.crc32(tokenizer_json.encode())
    if key not in _WORKER:
        _WORKER[key] = make(tokenizer_json)
    return _WORKER[key]


class TextEncoder:
    """Ids of whole texts under a byte-level vocabulary, as the tokenizers library gives them by default.

    Merges of byte pairs by rank are the same whoever does them, so texts go
    through tiktoken with the ranks of the vocabulary, several times as fast.
    The library itself encodes texts that hold one of its added tokens, and
    all texts where ``fast`` is false.
    """

    def __init__(self, tokenizer_json: str, fast: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        content = json.loads(tokenizer_json)
        self.added = [t["content"] for t in content["added_tokens"]]
        self.size, self.ranked = self.tokenizer.get_vocab_size(), None
        if fast:
            raw = {chr(c): b for b, c in enumerate(_byte_letters())}
            ranks = {bytes(raw[c] for c in piece): i for piece, i in content["model"]["vocab"].items() if piece not in self.added}
            self.ranked = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for t in texts:
            if self.ranked and not any(a in t for a in self.added):
                yield self.ranked.encode_to_numpy(t, disallowed_special=())
            else:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")


# Fixed value: the words of the byte-level pre-tokeniser.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[int]:
    """The code point that stands for each byte: itself where it can be printed, else the next from 256 on."""
    printed, more = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    return [b if b in printed else next(more) for b in range(256)]


def load_byte_level(path: str) -> tuple[str, bool]:
    """A tokenizer's JSON, and whether ranks give its ids: on every piece, pairs of pieces and the probe texts."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    parts = json.loads(content)
    before = parts["pre_tokenizer"] or {}
    if parts["model"]["type"] != "BPE" or parts["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        return content, False
    encoder = TextEncoder(content)
    raw = {chr(c): b for b, c in enumerate(_byte_letters())}
    pieces = [bytes(raw[c] for c in p).decode("utf-8", "replace") for p in parts["model"]["vocab"] if p not in encoder.added]
    texts = PROBES + ["\n".join(pieces[i:i + 500]) for i in range(0, len(pieces), 500)] + [" ".join(pieces[i:i + 500]) for i in range(0, len(pieces), 500)]
    pairs = ["\n".join(a + b for a, b in zip(pieces[i:i + 500], pieces[i + 1:i + 501], strict=False)) for i in range(0, len(pieces), 500)]
    same = all(np.array_equal(encoder.ranked.encode_to_numpy(t, disallowed_special=()), x.ids)
               for t, x in zip(texts + pairs, encoder.tokenizer.encode_batch_fast(texts + pairs, add_special_tokens=False), strict=True))
    return content, same


def byte_level(loaded: tuple[str, bool]) -> TextEncoder:
    """The encoder of what ``load_byte_level`` gives, one a worker process."""
    key = "byte level", zlib.crc32(loaded[0].encode())
    if key not in _WORKER:
        _WORKER[key] = TextEncoder(*loaded)
    return _WORKER[key]


def metaspace(tokenizer_json: str) -> WordEncoder:
    """No piece has the space marker after another character, so a text is cut before each run of markers.

    NUL is no piece but a byte, so it never merges.  The normaliser's part
    (marker, prefix) is done by ``prepared``.
    """
    from tokenizers import Tokenizer, normalizers

    t = Tokenizer.from_str(tokenizer_json)
    prefix = any(x["type"] == "Prepend" for x in json.loads(tokenizer_json)["normalizer"]["normalizers"])
    nul = t.token_to_id("<0x00>")
    t.normalizer = normalizers.Sequence([])
    find = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def words(text: str) -> list[str]:
        return find(MARK * prefix + text.replace(" ", MARK)) if text else []

    return WordEncoder(t, words, lambda w: "\0" not in w, "\0", nul)


MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    out, i = [], 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i:i + n], i + n
        out.append((key >> 3, value))
    return out


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]]     # text, score, type
    unigram: bool
    byte_fallback: bool
    unknown_id: int
    normalizer: str
    charsmap: bytes
    dummy_prefix: bool
    extra_spaces_removed: bool


def parse_model(data: bytes) -> Model:
    """The parts of a SentencePiece ``ModelProto`` that encoding needs."""
    top = _fields(data)
    pieces = []
    for number, value in top:
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
    trainer = dict(_fields(next((v for n, v in top if n == 2), b"")))
    norm = dict(_fields(next((v for n, v in top if n == 3), b"")))
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError(f"model type {kind} is neither unigram (1) nor BPE (2)")
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(pieces, kind == 1, bool(trainer.get(35, 0)), unknown, norm.get(1, b"").decode(), norm.get(2, b""),
                 bool(norm.get(3, 1)), bool(norm.get(4, 1)))


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs in the order of the joined piece's score; among equals the longer left part first."""
    known = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            found += [(-score, -i, piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: x[:2])]


def tokenizer(model: Model):
    """The model rebuilt for the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.unigram:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown_id, model.byte_fallback))
    else:
        t = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model),
                                 unk_token=model.pieces[model.unknown_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.extra_spaces_removed:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if words_apart(model):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                   *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return t


def words_apart(model: Model) -> bool:
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


PROBES = ["", " ", "  ", "a", " a", "a ", "Hello  world\n a\t b  ", "日本é\0 x ﬁ①", f"a{MARK}b", "<s> </s> <unk> <0x0A>",
          "===== ---- !!!!!!", "\U0001f600\U0001f600", "don't 12345 6.7e-8", *(" " * n + "x" + " " * n for n in range(2, 40))]


def load(path: str) -> str:
    """The rebuilt tokenizer as JSON, after the parity check with sentencepiece."""
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read()
    model = parse_model(data)
    if model.unigram or model.charsmap or model.extra_spaces_removed or not model.byte_fallback or not words_apart(model):
        raise ValueError("texts of this model can't be encoded word by word; use tokenizer(parse_model(...))")
    content = tokenizer(model).to_str()
    surfaces = [p.replace(MARK, " ") for p, _, _ in model.pieces]
    texts = PROBES + surfaces + [a + b for a, b in zip(surfaces, surfaces[1:], strict=False)]
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    ours = [x.tolist() for x in metaspace(content).encode(texts)]
    for text, a, b in zip(texts, ours, theirs.encode(texts), strict=True):
        if a != b:
            raise ValueError(f"no parity with sentencepiece for {text!r}: {a} and {b}")
    return content


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, ids (null text: none) and ``decoded``, the text that they give back.

    Defined results: empty text has no ids; repeated rows are encoded alike;
    a text that holds the marker itself decodes with a space in its place;
    an empty table gives an empty result.
    """
    content = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def rows(batch):
        words = encoder(metaspace, content.value)
        ids = [*words.encode([t or "" for t in batch["text"]])]
        decoded = [x for i in range(0, len(ids), 100)
                   for x in words.tokenizer.decode_batch([x.tolist() for x in ids[i:i + 100]], skip_special_tokens=False)]
        return {"doc_id": batch["doc_id"], "ids": ids, "decoded": decoded}

    return map_rows(docs.select("doc_id", "text"), "doc_id long, ids array<int>, decoded string", rows)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number and CRC-32 of its ids (little-endian, 32 bits) and whether they decode to the text."""
    content = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def rows(batch):
        words = encoder(metaspace, content.value)
        out = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_crc32": [], "decoded_crc32": [], "round_trip": []}
        texts = [t or "" for t in batch["text"]]
        coded = words.encode(texts)
        for i in range(0, len(texts), 100):
            ids = [*islice(coded, 100)]
            back = words.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
            out["n_tokens"] += [len(x) for x in ids]
            out["ids_crc32"] += [zlib.crc32(x) for x in ids]
            out["decoded_crc32"] += [zlib.crc32(x.encode()) for x in back]
            out["round_trip"] += [a == b.replace(MARK, " ") for a, b in zip(back, texts[i:i + 100], strict=True)]
        return out

    return map_rows(docs.select("doc_id", "text"),
                    "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean", rows)
