"""Phrase collocations by sorted count streams, read in prefix and in suffix order.

Every word of a text starts a window: itself and up to four words after it,
within its piece.  Tasks sort their windows into runs of distinct windows with
counts, words held as numbers in a dictionary of the run, and cut every run at
the same boundary windows, quantiles of a sample of the corpus (they decide
where a window is merged, not what is counted).  Runs of one range are merged.
In prefix order the windows that start with a phrase follow one another, so
sums over the merged stream count all phrases; a phrase at the rim of a range
is added up with its other parts.

Frequent phrases, far fewer than words, go on as two streams, in prefix order
and in the order of their reversed words.  One pass over the first meets every
phrase after its beginnings and before its extensions to the right, one pass
over the second after its endings and before its extensions to the left; a
range that starts amid the extensions of a phrase is told its count.  Joined
by merging, the streams hold the two parts of every cut and the largest
extension, and nothing is looked up by hash.

Defined results: null text is empty; null language is ``und``, as the language
of that name; repeated rows count each time; a language without frequent
phrases has no rows; ties are broken by count, then by the bytes of the phrase;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.llm.common import checkpoint, slices

LONGEST = 5
LEAST = 100          # occurrences of a candidate
TOP = 2000           # rows of a language
RUN = 1_000_000      # windows sorted at a time
RANGE = 1_000_000    # windows of a range, about
SLICE = 1 << 21      # bytes of text cut into words at a time (a longer text is cut by itself)
SAMPLED = 50         # windows of the sample for each range
SHARDS = 64

# What separates words, and what separates pieces.
SPACES, STOPS = "\x20\x09", ".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in SPACES]] = 1
_KIND[[ord(c) for c in STOPS]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


# ------------------------------------------------------------------ words and windows
def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, and for each its piece and its row."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    data, kind = _LOWER[raw], _KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]                     # a text's first word is not the last one's rest
    starts = np.flatnonzero(first)
    upto = np.cumsum(inside)
    place = np.append(upto[starts] - 1, upto[-1] if len(upto) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    row = np.searchsorted(offsets, starts, "right") - 1
    return words, np.cumsum(kind == 2)[starts] + row, row


def windows(code: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """The code of the word at each place and of the four after it, 0 beyond the end of its piece."""
    out = [code]
    for k in range(1, LONGEST):
        later = np.zeros_like(code)
        later[:-k] = np.where(piece[k:] == piece[:-k], code[k:], 0)
        out.append(later)
    return out


def merged(columns: list[np.ndarray], n: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` (codes up to ``size``) in order, the counts of equal ones summed."""
    bits = max(1, int(size).bit_length())
    per = 63 // bits
    keys = [reduce(lambda a, c: a << np.uint64(bits) | c.astype(np.uint64), columns[i:i + per], np.zeros(len(n), np.uint64))
            for i in range(0, len(columns), per)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(n), bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.add.reduceat(n[order], first) if len(n) else n


def ranked(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words in byte order, and each word's place among them, from 1."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order) + 1, np.int32)
    place[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(order).to_pylist(), place[coded.indices.to_numpy()]


class Run:
    """Windows gathered by a task until they are sorted; ``slices`` cuts them at the boundaries."""

    def __init__(self):
        self.words, self.pieces, self.langs, self.known, self.size, self.base = [], [], [], {}, 0, 0

    def add(self, texts: pa.Array, langs: pa.Array) -> None:
        words, piece, row = words_of(texts)
        self.words.append(words)
        self.pieces.append((piece + self.base).astype(np.int32))
        self.base += int(piece[-1] if len(piece) else 0) + 2
        self.langs.append(np.array([self.known.setdefault(x.encode(), len(self.known)) for x in langs.to_pylist()], np.int32)[row])
        self.size += len(words)

    def sorted(self) -> tuple[list[bytes], list[bytes], list[np.ndarray], np.ndarray]:
        """(languages, words, columns: language and words of the window, counts)."""
        words, code = ranked(pa.concat_arrays(self.words))
        self.words = []
        langs, place = ranked(pa.array([*self.known], pa.binary()))
        columns = [place[np.concatenate(self.langs)], *windows(code, np.concatenate(self.pieces))]
        self.langs, self.pieces = [], []
        return langs, words, *merged(columns, np.ones(len(code), np.int64), max(len(words), len(langs)))


def position(boundary: list[bytes], langs: list[bytes], words: list[bytes], columns: list[np.ndarray]) -> int:
    """Where a window (language, words) would stand among sorted windows."""
    low, high = 0, len(columns[0])
    for value, known, column in zip(boundary, [langs, *[words] * LONGEST], columns, strict=False):
        at = bisect_left(known, value)
        part = column[low:high]
        if at == len(known) or known[at] != value:
            return low + int(np.searchsorted(part, at + 1))
        low, high = low + int(np.searchsorted(part, at + 1)), low + int(np.searchsorted(part, at + 1, "right"))
    return low


def _numbers(a: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight next to each other."""
    return pa.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _numbers_back(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int32)


RUN_SCHEMA = "range int, n int, langs binary, words binary, columns array<binary>, counts binary"


def cut(run: Run, boundaries: list[list[bytes]]) -> Iterator[dict]:
    """One row of RUN_SCHEMA for each range in which the run has windows."""
    langs, words, columns, n = run.sorted()
    cuts = [0, *[position(b, langs, words, columns) for b in boundaries], len(n)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        # Counts of a run fit 32 bits, as its windows do.
        if a < b:
            lang_used, lang = np.unique(columns[0][a:b], return_inverse=True)
            used = np.unique(np.concatenate([c[a:b] for c in columns[1:]]))
            used = used[used > 0]
            place = np.zeros(len(words) + 1, np.int32)
            place[used] = np.arange(1, len(used) + 1)
            yield {"range": k, "n": b - a, "langs": b"\t".join(langs[i - 1] for i in lang_used), "words": b"\t".join(words[i - 1] for i in used),
                   "columns": [_numbers(lang + 1), *[_numbers(place[c[a:b]]) for c in columns[1:]]], "counts": _numbers(n[a:b])}


# ------------------------------------------------------------------ counting
def boundaries(docs: DataFrame, run_range: int = RANGE) -> list[list[bytes]]:
    """Windows (language, words) that cut the corpus into ranges of about ``run_range`` windows.

    They come from a sample of ``SAMPLED`` windows a range, so the driver
    holds that many rows.
    """
    total, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = -(-(total or 0) // (6 * run_range))   # five bytes and a space make a word, about
    if ranges < 2:
        return []
    wanted = SAMPLED * ranges
    share = min(1.0, 50 * wanted / n)
    # Of the sampled documents, every word alike: a long one gives more.
    each = min(1.0, 6 * wanted / (share * total))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                words, piece, row = words_of(part.column(0))
                at = np.flatnonzero(rng.random(len(words)) < each)
                langs = part.column(1).to_pylist()
                found = [b"\t".join([langs[row[i]].encode(), *[words[j].as_py() for j in range(i, min(i + LONGEST, len(words))) if piece[j] == piece[i]]])
                         for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["window"])

    found = sorted(bytes(r.window).split(b"\t") for r in docs.sample(share, 7).mapInArrow(draw, "window binary").collect())
    return [list(k) for k in sorted({tuple(found[len(found) * i // ranges]) for i in range(1, ranges)})] if found else []


def escaped(words: list[bytes]) -> bytes:
    """Words joined by tabs; characters below the tab are written so that keys are ordered as their words are."""
    return b"\t".join(re.sub(rb"[\x00-\x08]", lambda m: b"\x0b" + bytes([m[0][0] + 64]), w) for w in words)


def phrase(key):
    """The phrase of a key as text."""
    out = F.translate(key, "\t", " ")
    for c in range(9):
        out = F.replace(out, F.lit("\x0b" + chr(c + 64)), F.lit(chr(c)))
    return out


def count_phrases(docs: DataFrame, least: int = LEAST, run_range: int = RANGE, run: int = RUN) -> DataFrame:
    """(lang, key, f): the phrases of one to five words with ``least`` occurrences, and of the empty phrase, as often as there are words."""
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    limits = docs.sparkSession.sparkContext.broadcast(boundaries(docs, run_range))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            return pa.RecordBatch.from_pylist([*cut(gathered, limits.value)], pa.schema(
                [("range", pa.int32()), ("n", pa.int32()), ("langs", pa.binary()), ("words", pa.binary()), ("columns", pa.list_(pa.binary())), ("counts", pa.binary())]))

        gathered = Run()
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                gathered.add(part.column(0), part.column(1))
                if gathered.size >= run:
                    yield rows()
                    gathered = Run()
        if gathered.size:
            yield rows()

    def count(table: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(dict(zip(("lang", "key", "f"), _prefixes(table, least), strict=True)),
                                    pa.schema([("lang", pa.string()), ("key", pa.binary()), ("f", pa.int64())]))

    parts = docs.mapInArrow(runs, RUN_SCHEMA).groupBy("range").applyInArrow(count, "lang string, key binary, f long")
    whole = parts.groupBy("lang", "key").agg(F.sum("f").alias("f"))
    return whole.filter((F.col("f") >= least) | (F.octet_length("key") == 0)).withColumn("key", F.col("key").cast("string"))


def _prefixes(table: pa.Table, least: int) -> tuple[list, list, list]:
    """Counts of all phrases of a range that reach ``least`` or may go on beside it."""
    parts = table.to_pylist()
    langs, lang = ranked(pa.array([x for p in parts for x in p["langs"].split(b"\t")], pa.binary()))
    words, place = ranked(pa.array([x for p in parts for x in (p["words"].split(b"\t") if p["words"] else [])], pa.binary()))
    columns, counts, at, lang_at = [[] for _ in range(LONGEST + 1)], [], 0, 0
    for p in parts:
        n_langs, n_words = p["langs"].count(b"\t") + 1, p["words"].count(b"\t") + 1
        codes = [lang[lang_at:lang_at + n_langs], place[at:at + n_words]]
        at, lang_at = at + n_words, lang_at + n_langs
        for k, data in enumerate(p["columns"]):
            columns[k].append(np.concatenate([[0], codes[k > 0]]).astype(np.int32)[_numbers_back(data, p["n"])])
        counts.append(_numbers_back(p["counts"], p["n"]).astype(np.int64))
    columns, n = merged([np.concatenate(c) for c in columns], np.concatenate(counts), max(len(words), len(langs)))
    out, new = ([], [], []), np.zeros(len(n), bool)
    new[0] = True
    for k, column in enumerate(columns):   # the phrase of the first k words
        new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        f = np.add.reduceat(n, first)
        keep = f >= least
        keep[[0, -1]] = True
        if k == 0:
            keep[:] = True
        else:
            keep &= column[first] > 0
        for i, c in zip(first[keep].tolist(), f[keep].tolist(), strict=True):
            out[0].append(langs[columns[0][i] - 1].decode())
            out[1].append(escaped([words[x[i] - 1] for x in columns[1:k + 1]]))
            out[2].append(c)
    return out


# ------------------------------------------------------------------ frequent phrases
PASS_SCHEMA = "lang string, key string, f long, parts array<long>, more long"


def beginnings(counts: DataFrame) -> DataFrame:
    """(lang, key, f, parts, more) of each phrase: counts of its beginnings, shortest first, and the largest of its extensions."""
    # Rows stay where the range partitioner put them: the pass below goes through one partition in order.
    ranged = checkpoint(counts.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
                        .withColumn("part", F.spark_partition_id()))
    # Beginnings of a partition's first phrase that lie in the partitions before: at most four of each.
    cuts = F.transform(F.sequence(F.lit(1), F.lit(LONGEST - 1)), lambda k: F.call_function("substring_index", F.col("first.key"), F.lit("\t"), k))
    heads = (ranged.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("first"))
             .select("part", F.col("first.lang").alias("lang"), F.explode(F.array_except(F.array_distinct(cuts), F.array("first.key"))).alias("key")))
    known = {}
    for r in heads.join(counts, ["lang", "key"]).collect():
        known.setdefault(r["part"], []).append((r["lang"], r["key"], r["f"]))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, done, part = [], [], None   # phrases that the next may extend: lang, key, f, its own, parts, more

        def close():
            lang, key, f, own, parts, more = open_.pop()
            if own or more:
                done.append((lang, key, f if own else None, parts if own else None, more or None))

        def enter(lang, key, f, own):
            while open_ and not (open_[-1][0] == lang and key.startswith(open_[-1][1] + "\t")):
                close()
            if open_:
                open_[-1][5] = max(open_[-1][5], f)
            open_.append([lang, key, f, own, [x[2] for x in open_], 0])

        def rows():
            out = pd.DataFrame(done, columns=["lang", "key", "f", "parts", "more"]).astype({"f": "Int64", "more": "Int64"})
            done.clear()
            return out

        for frame in frames:
            for lang, key, f, p in zip(frame["lang"], frame["key"], frame["f"], frame["part"], strict=True):
                if p != part:
                    while open_:
                        close()
                    part = p
                    for head in sorted(known.get(p, [])):
                        enter(*head, False)
                enter(lang, key, f, True)
            yield rows()
        while open_:
            close()
        yield rows()

    parts = ranged.mapInPandas(walk, PASS_SCHEMA)
    return parts.groupBy("lang", "key").agg(F.max("f").alias("f"), F.first("parts", ignorenulls=True).alias("parts"), F.max("more").alias("more"))


def backwards(key: str):
    return F.array_join(F.reverse(F.split(key, "\t")), "\t")


def candidates(counts: DataFrame) -> DataFrame:
    """(lang, key, a, lefts, rights, longer): counts of a phrase's beginnings and endings, shortest first, and of its most frequent extension."""
    prefix = beginnings(counts).withColumnsRenamed({"parts": "lefts"})
    suffix = beginnings(counts.withColumn("key", backwards("key"))).select(
        "lang", backwards("key").alias("key"), F.col("parts").alias("rights"), F.col("more").alias("before"))
    both = prefix.filter(F.size("lefts") > 0).join(suffix.hint("merge"), ["lang", "key"])
    return both.select("lang", "key", F.col("f").alias("a"), "lefts", "rights", F.greatest("more", "before").alias("longer"))


def scored(found: DataFrame, words: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer one stands for.

    ``words``: (lang, n).  A longer phrase stands for one inside it if it has
    ``share`` percent of its occurrences; the one with a word more, on the way
    to it, has as many at least.
    """
    kept = found.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    # One row a language, whatever number of them there is; the planner decides how.
    kept = kept.join(words, "lang")
    big = "cast({} as decimal(19,0))".format

    def score(k):
        l, r = F.element_at("lefts", k), F.element_at("rights", F.size("lefts") + 1 - k)
        return F.struct(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("big_a") * F.col("big_n"),
                                        l.cast("decimal(19,0)") * r.cast("decimal(19,0)")).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    kept = kept.withColumns({"big_a": F.expr(big("a")), "big_n": F.expr(big("n"))})
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("lefts")), score))
    return kept.withColumn("cut", best).select("lang", phrase(F.col("key")).alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def first_rows(rows: DataFrame, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """With rank, from 1: the ``top`` rows of each language.  The first of every shard come first, so no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    inner = Window.partitionBy("lang", "shard").orderBy(*order)
    outer = Window.partitionBy("lang").orderBy(*order)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards)))
    few = dealt.withColumn("rank", F.row_number().over(inner)).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(outer).cast("long")).filter(F.col("rank") <= top).drop("shard")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 100, run_range: int = RANGE, run: int = RUN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score."""
    counts = checkpoint(count_phrases(docs, least, run_range, run))
    words = counts.filter("key = ''").select("lang", F.col("f").alias("n"))
    found = candidates(counts.filter("key <> ''"))
    return first_rows(scored(found, words, share), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from (select coalesce(lang, 'und') as lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
g as (select lang, m, ws[i:i + m - 1] as p, count(*) as f
  from (select lang, m, ws, unnest(range(1, len(ws) - m + 2)) as i from w, range(1, 6) t(m) where len(ws) >= m) group by 1, 2, 3),
n as (select lang, sum(f) as n from g where m = 1 group by 1),
c as (select * from g where m >= 2 and f >= {least}),
inside as (select lang, sub, max(f) as f from (select lang, f, m, unnest(flatten(list_transform(range(2, m), lambda k:
  list_transform(range(1, m - k + 2), lambda i: p[i:i + k - 1])))) as sub from c) group by 1, 2),
s as (select c.lang, c.p, c.f as a, n.n, l.f as l, r.f as r, k, (1000 * c.f::hugeint * n.n::hugeint) // (l.f::hugeint * r.f::hugeint) as score
  from c join n using (lang) join range(1, 5) t(k) on k < c.m
  join g l on l.lang = c.lang and l.p = c.p[1:k] join g r on r.lang = c.lang and r.p = c.p[k + 1:]),
b as (select * from s qualify row_number() over (partition by lang, p order by score, k) = 1),
o as (select b.lang, array_to_string(b.p, ' ') as phrase, a, l, r, n, score from b left join inside x on x.lang = b.lang and x.sub = b.p
  where x.f is null or 100 * x.f < 100 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
  cast(n as bigint) as n, cast(score as bigint) as score
from o qualify rank <= {top}
"""
