"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into buckets, whose number follows the size of the texts: a bucket for each
``TEXT_BYTES`` of them, ``BUCKETS`` at least, so that it stands for much the same number of n-grams at every size; beyond 64 GB of text (``MOST_BUCKETS``) it
stands for more. Two multinomials are counted over
all texts: the raw corpus, and the trusted target among it (texts that a label calls good; without any label, texts
that pass the base rules). A text's score is the mean over its n-grams of log p_target - log p_raw, both
smoothed by ``SMOOTHING`` counts a bucket; it is kept if the score is at least ``LEAST`` and no base rule fails.

Everything is DataFrame functions. Counting explodes hashes only and aggregates before its one shuffle, of at
most a row a bucket from each task; the resulting weights (32 MB at most) become a literal of the scoring
expression, which works within each row, and no group gathers in a task.

Base counts of a text: ``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (of ``[#*$%&|<>]``);
``n_dup_lines`` (lines with a word, equal to an earlier line); ``n_repeat_words`` (words in 3-word windows found
twice or more, by 48 bits of the windows' hashes at every length of text).

Defined results: null and blank texts have no words, score 0 and fail the base rules. A target or corpus without
n-grams gives all weights 0, so that the base rules alone decide. Repeated rows stay. Extra columns pass through
``with_quality_rules`` unless they carry the name of an added column, which is then replaced.

Trusted ids are broadcast up to a counted 32 MB (two million ids); more of them are joined by a shuffle of the texts, the
only case in which texts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only, small, unused

BUCKETS, SMOOTHING, LEAST = 1 << 14, 1.0, -0.05
TEXT_BYTES, MOST_BUCKETS = 1 << 14, 1 << 22
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """The text with a blank for each white-space character; single characters keep ``replace`` and ``split`` off regular expressions."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def word_hashes(text: Column) -> Column:
    """Hash of each word; what stands between neighbouring blanks is empty and is taken out by its hash."""
    return F.array_remove(F.transform(F.split(spaced(text), " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _rest(array: Column, n: int) -> Column:
    return F.slice(array, n + 1, F.greatest(F.size(array) - n, F.lit(0)))


def _front(array: Column, n: int) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - n, F.lit(0)))


def pair_hashes(hashes: Column) -> Column:
    return F.zip_with(_front(hashes, 1), _rest(hashes, 1), lambda a, b: F.xxhash64(a, b))


def base_counts(text: Column, hashes: Column, pairs: Column) -> dict[str, Column]:
    text = without = F.coalesce(text, F.lit(""))
    for c in "#*$%&|<>":
        without = F.replace(without, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": F.length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.length(text) - F.length(without)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(hashes, pairs),
    }


def repeat_words(hashes: Column, pairs: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows are sorted by hash, so equal ones are
    neighbours, and the union of [p, p + 3) over their positions is counted. A position takes the low bits of
    the sorted numbers; texts of 2**16 words or more, which these do not hold, sort pairs of hash and position."""
    windows = F.zip_with(_front(pairs, 1), _rest(hashes, 2), lambda a, b: F.xxhash64(a, b))
    packed = F.transform(windows, lambda h, i: F.shiftleft(F.shiftright(h, 16), 16).bitwiseOR(i.cast("bigint")))

    def short(s: Column) -> Column:
        same = F.zip_with(_front(s, 1), _rest(s, 1), lambda a, b: F.shiftright(a.bitwiseXOR(b), 16) == 0)
        no = F.array(F.lit(False))
        marked = lambda e: F.zip_with(s, F.zip_with(F.concat(no, e), F.concat(e, no), lambda x, y: x | y), lambda v, m: F.when(m, v.bitwiseAND(0xFFFF).cast("int")))
        return let(same, lambda e: F.when(F.array_contains(e, True), union(F.array_compact(marked(e)))).otherwise(0))

    def long(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        return union(F.transform(F.filter(s, lambda x, i: F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False))), lambda x: x["p"]))

    def union(positions: Column) -> Column:
        gaps = lambda p: F.zip_with(_front(p, 1), _rest(p, 1), lambda a, b: F.least(b - a, F.lit(3)))
        return let(F.sort_array(positions), lambda p: F.aggregate(gaps(p), F.lit(3), lambda t, x: t + x))

    structs = F.sort_array(F.transform(windows, lambda h, i: F.struct(F.shiftright(h, 16).alias("h"), i.alias("p"))))
    n = F.size(hashes)
    no_repeat = F.size(F.array_distinct(F.transform(windows, lambda h: F.shiftright(h, 16)))) == n - 2
    return F.when((n < 4) | no_repeat, 0).when(n < 65536, let(F.sort_array(packed), short)).otherwise(let(structs, long)).cast("long")


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """A power of two that follows the texts, ``TEXT_BYTES`` of them a bucket, from ``BUCKETS`` to ``MOST_BUCKETS``."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (size // TEXT_BYTES).bit_length()))


def weights(docs: DataFrame, good: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> list[float]:
    """log p_target - log p_raw of each bucket; ``good`` has the ids of trusted texts in ``id_col``."""
    buckets = buckets or buckets_for(docs, text_col)
    rows = only(docs, id_col, text_col).toDF("id", "text")
    rows = rows.select("id", word_hashes(F.col("text")).alias("h")).withColumn("p", pair_hashes(F.col("h")))
    if good is not None and not good.isEmpty():
        marks = only(good, id_col).distinct().toDF("good_id")
        trusted = only(docs, id_col, text_col).toDF("id", "text").join(small(marks, 16), F.col("id") == F.col("good_id"), "left_semi")
        trusted = trusted.select(word_hashes(F.col("text")).alias("h")).withColumn("p", pair_hashes(F.col("h")))
    else:
        trusted = rows.where(~failed(F.size("h"), repeat_words(F.col("h"), F.col("p"))))

    def counts(part: DataFrame, name: str) -> tuple[DataFrame, int]:
        grams = part.select(F.explode(F.concat("h", "p")).alias("g")).groupBy(F.col("g").bitwiseAND(buckets - 1).cast("int").alias("b")).agg(F.count("*").alias(name))
        found = cut(grams)  # at most ``buckets`` rows
        return found, found.agg(F.sum(name)).first()[0] or 0

    (raw, n_raw), (target, n_target) = counts(rows, "raw"), counts(trusted, "target")
    if not n_raw or not n_target:
        return [0.0] * buckets
    share = lambda n, total: F.log((F.coalesce(n, F.lit(0)) + SMOOTHING) / (total + SMOOTHING * buckets))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(raw, "b", "left").join(target, "b", "left")
    every = every.select("b", F.round(share(F.col("target"), n_target) - share(F.col("raw"), n_raw), 6).alias("w"))
    return every.agg(F.sort_array(F.collect_list(F.struct("b", "w"))).alias("all")).select(F.col("all.w")).first()[0]


def _llr(weight: list[float], h: Column, pairs: Column) -> Column:
    """Mean weight of a text's words and pairs."""
    table = F.split(F.lit(",".join(map(str, weight))), ",").cast("array<double>")
    summed = lambda grams: F.aggregate(grams, F.lit(0.0), lambda t, g: t + F.get(table, g.bitwiseAND(len(weight) - 1).cast("int")))
    return F.round(F.when(F.size(h) > 0, (summed(h) + summed(pairs)) / (2 * F.size(h) - 1)).otherwise(0.0), 9)


def with_quality_rules(docs: DataFrame, weight: list[float], text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with the base counts, ``llr``, ``base_failed`` and ``kept``."""
    text = F.col(f"`{text_col}`")
    h_name, p_name = unused(docs, "word_h", "pair_h")
    hashed = docs.select("*", word_hashes(text.cast("string")).alias(h_name)).withColumn(p_name, pair_hashes(F.col(h_name)))
    h, pairs = F.col(h_name), F.col(p_name)
    counts = base_counts(text.cast("string"), h, pairs)
    clash = [c for c in docs.columns if c in ADDED]
    out = hashed.drop(*clash).select("*", *[c.alias(n) for n, c in counts.items()], _llr(weight, h, pairs).alias("llr")).drop(h_name, p_name)
    bad = failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.withColumn("base_failed", bad).withColumn("kept", ~bad & (F.col("llr") >= least))


def passing(docs: DataFrame, weight: list[float], text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``with_quality_rules`` would keep.

    The verdict is one expression that binds the hashes with ``let``: a filter over named columns is pushed below their
    projection, which repeats the hashing for each mention of them."""

    def verdict(h: Column, pairs: Column) -> Column:
        return ~failed(F.size(h), repeat_words(h, pairs)) & (_llr(weight, h, pairs) >= least)

    text = F.col(f"`{text_col}`").cast("string")
    return docs.where(let(word_hashes(text), lambda h: let(pair_hashes(h), lambda pairs: verdict(h, pairs))))
