"""Quality rules: a threshold table compiled into one projection of native columns.

Everything is built-in Spark functions: per document the words are split
once, counted, hashed once each, and the hashes of 8-word windows come from
three ``zip_with`` doublings (1 -> 2 -> 4 -> 8 words), so no row is exploded
and nothing is shuffled.  Windows are compared by their 64-bit hash within
one document.

Defined results: null or empty text has zero counts and fails the base
(fewer than 20 words); repeated rows are judged alike, row by row; other
columns of the input are kept out of the result, so clashing names do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be this by or an from at have not",
    "de": "der die das und ist ein eine im den dem nicht von zu mit sich auf für in es als auch",
    "fr": "le la les de des un une que et est pour dans pas sur du en qui au il avec plus ne",
    "es": "el la los las de que y en un una por con no para se del su al lo como es",
}


@dataclass(frozen=True)
class Rule:
    """``percent`` of ``part`` in ``whole`` must stay within the bounds (integers, so exact)."""

    name: str
    part: str
    whole: str
    at_least: int | None = None
    at_most: int | None = None

    def broken(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        bad = F.lit(False)
        if self.at_least is not None:
            bad = bad | (part < whole * self.at_least)
        if self.at_most is not None:
            bad = bad | (part > whole * self.at_most)
        return bad


RULES = (
    Rule("mean word length", "word_chars", "n_words", at_least=200, at_most=1500),
    Rule("symbols a word", "n_symbols", "n_words", at_most=30),
    Rule("shouted words", "n_shouted", "n_words", at_most=30),
    Rule("stop words", "n_stop_words", "n_words", at_least=4),
    Rule("repeated lines", "n_dup_lines", "n_lines", at_most=50),
    Rule("table lines", "n_bar_lines", "n_lines", at_most=60),
)


def stop_words() -> list[str]:
    """Each word as it stands inside a sentence and at its start."""
    words = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    return words + [w[0].upper() + w[1:] for w in words]


def _measures(docs: DataFrame) -> DataFrame:
    """doc_id and all counts; staged so that each array is computed once."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.select("doc_id", "t",
                 F.array_remove(F.split("t", SPACE), "").alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    for width in (1, 2, 4):
        d = d.withColumn(f"h{2 * width}", F.when(F.size(f"h{width}") > width, F.zip_with(
            F.expr(f"slice(h{width}, 1, size(h{width}) - {width})"),
            F.expr(f"slice(h{width}, {width + 1}, size(h{width}) - {width})"),
            lambda a, b: F.xxhash64(a, b))).otherwise(F.expr("cast(array() as array<bigint>)")))
    # Start positions of windows found twice: equal neighbours in hash order.
    d = d.withColumn("runs", F.when(
        F.size("h8") > F.size(F.array_distinct("h8")),
        F.array_sort(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    d = d.withColumn("twice", F.expr("""
        zip_with(runs, slice(runs, 2, size(runs)), (a, b) -> named_struct('i', a.i, 'j', b.i, 'same', a.h <=> b.h))"""))
    d = d.withColumn("starts", F.expr("""
        sort_array(array_distinct(flatten(transform(filter(twice, x -> x.same), x -> array(x.i, x.j)))))"""))
    # A window covers 8 words or as many as lie before the next window's start.
    covered = F.expr("""
        8 + aggregate(zip_with(slice(starts, 1, size(starts) - 1), slice(starts, 2, size(starts)),
                               (a, b) -> least(8, b - a)), 0, (s, x) -> s + x)""")
    symbols = F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))
    return d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("starts") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(stop_words()))).cast("long").alias("n_stop_words"),
        F.size(F.filter("w", lambda x: x.endswith("!!"))).cast("long").alias("n_shouted"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("|"))).cast("long").alias("n_bar_lines"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts, ``base_failed``, the ``kept`` verdict and the broken rules."""
    m = _measures(docs)
    base = ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    return (m.withColumn("base_failed", base).withColumn("broken_rules", broken)
             .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
             .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     "base_failed", "kept", "n_lines", "n_stop_words", "n_shouted", "n_bar_lines",
                     F.array_join("broken_rules", ",").alias("broken_rules")))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in plain SQL: windows as rows, grouped by their words."""
    stops = ", ".join(f"'{w}'" for w in stop_words())
    checks = []
    for r in rules:
        bad = [f"100 * {r.part} < {r.at_least} * {r.whole}"] if r.at_least is not None else []
        bad += [f"100 * {r.part} > {r.at_most} * {r.whole}"] if r.at_most is not None else []
        checks.append(f"case when {' or '.join(bad)} then '{r.name}' end")
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, i, array_to_string(w[i:i + 7], ' ') as g from w, unnest(range(1, len(w) - 6)) as u(i)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
cover as (select r, count(distinct i + k) as n from twice, unnest(range(0, 8)) as u(k) group by r),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
        cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        cast(coalesce(n, 0) as bigint) as n_repeat_words, cast(len(lines) as bigint) as n_lines,
        cast(len(list_filter(w, lambda x: x in ({stops}))) as bigint) as n_stop_words,
        cast(len(list_filter(w, lambda x: ends_with(x, '!!'))) as bigint) as n_shouted,
        cast(len(list_filter(lines, lambda x: ends_with(rtrim(x), '|'))) as bigint) as n_bar_lines
      from w left join cover using (r)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
        coalesce(array_to_string(list_filter([{', '.join(checks)}], lambda x: x is not null), ','), '') as broken_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and broken_rules = '' as kept, n_lines, n_stop_words, n_shouted, n_bar_lines, broken_rules from b
"""
