"""Benchmark decontamination by winnowing.

Of each ``window`` words that an item and a document share, the hashes of the inner k-grams are the same in
both, so the smallest of them is too: keeping the minimum k-gram of every window of documents and items alike
loses no shared window. Kept fingerprints of documents are looked up among the items' ones, and each meeting is
extended word by word to both sides. A run of at least ``window`` words is a hit.

The benchmark's counted size decides how fingerprints are joined. Up to ``INDEX_BYTES`` of item text the items' index is broadcast, and there is one pass over
the documents without a shuffle. Beyond it, fingerprints of documents and of items are joined by a shuffle, and each pair of text
and item that meets is extended by itself; neither texts nor items ever gather in one place. Both ways give the same rows.

Defined results: null and wordless texts have no words and no hits. An item of fewer words than ``window`` is
one window itself and is fingerprinted with its own length; an item without words never occurs. Repeated item
ids count once, repeated documents keep their rows. Item ids are compared as strings in ``items``.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import wordhash
from .common import cut, only, small, unused

WINDOW, GRAM = 10, 5
INDEX_BYTES = 8 << 20


def minima(hashes: np.ndarray, texts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the k-grams that are the minimum of a window of ``length`` words of one text."""
    grams = wordhash.grams(hashes, k)
    span = length - k + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : j + n], out=least)
    whole = texts[:n] == texts[length - 1 : length - 1 + n]
    kept = np.zeros(len(grams), bool)
    for j in range(span):
        kept[j : j + n] |= whole & (grams[j : j + n] == least)
    at = np.flatnonzero(kept)
    return at, grams[at]


class Index:
    """Fingerprints of items for each window length, and the items' words."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int):
        self.words: list[list[bytes]] = []
        self.ids: list[str] = []
        self.length: list[int] = []
        entries: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        texts = pa.array([t for _, t in items], pa.string())
        for first, low, starts, ends, hashes, at in wordhash.grouped(texts, wordhash.alnum):
            raw = low.tobytes()
            for k in range(len(at) - 1):
                a, b = int(at[k]), int(at[k + 1])
                if a == b:
                    continue
                length = min(window, b - a)
                i = len(self.ids)
                self.ids.append(items[first + k][0])
                self.words.append([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
                self.length.append(length)
                pos, values = minima(hashes[a:b], np.zeros(b - a, np.int8), length, min(gram, length))
                for p, v in zip(pos.tolist(), values.tolist(), strict=True):
                    entries[length][v].append((i, p))
        self.entries = {n: dict(x) for n, x in entries.items()}
        self.gram = gram
        self.maybe = {}
        for n, x in self.entries.items():
            self.maybe[n] = np.zeros(1 << 20, bool)
            self.maybe[n][(np.array(list(x), np.uint64) & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, column: pa.Array):
        """For each text: row, words, and for texts with hits the runs (first word, end) and the items."""
        for first, low, starts, ends, hashes, at in wordhash.grouped(column, wordhash.alnum):
            counts = np.diff(at)
            texts = np.repeat(np.arange(len(counts)), counts)
            runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
            found: dict[int, set[int]] = defaultdict(set)
            raw = low.tobytes() if len(low) else b""
            for length, entries in self.entries.items():
                pos, values = minima(hashes, texts, length, min(self.gram, length))
                keep = self.maybe[length][(values & np.uint64((1 << 20) - 1)).astype(np.int64)]
                done: dict[tuple[int, int], int] = {}
                for p, v in zip(pos[keep].tolist(), values[keep].tolist(), strict=True):
                    for item, q in entries.get(v, ()):
                        k = int(texts[p])
                        if done.get((item, p - q), -1) > p:
                            continue
                        lo, hi = self._extended(raw, starts, ends, p, int(at[k]), int(at[k + 1]), self.words[item], q)
                        done[(item, p - q)] = hi
                        if hi - lo >= length:
                            runs[k].append((lo - int(at[k]), hi - int(at[k])))
                            found[k].add(item)
            for k, n in enumerate(counts.tolist()):
                yield first + k, n, runs.get(k, []), sorted({self.ids[i] for i in found.get(k, ())})

    @staticmethod
    def _extended(raw, starts, ends, p, least, most, words, q):
        lo, i = p, q
        while lo > least and i > 0 and raw[starts[lo - 1] : ends[lo - 1]] == words[i - 1]:
            lo, i = lo - 1, i - 1
        hi, i = p, q
        while hi < most and i < len(words) and raw[starts[hi] : ends[hi]] == words[i]:
            hi, i = hi + 1, i + 1
        return lo, max(lo, hi)


def covered(runs: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    items = only(benchmark, item_col, item_text).toDF("item", "text").where("text is not null and item is not null")
    return items.select(F.col("item").cast("string").alias("item"), "text").distinct()


def _fits(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) <= INDEX_BYTES


def _judge(docs: DataFrame, items: DataFrame, window: int, gram: int):
    """A function for Arrow workers: batches and the position of their text column to (batch, words, runs, items)."""
    index = Index([(r.item, r.text) for r in items.collect()], window, gram)  # at most INDEX_BYTES
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(index)))

    def judge(batches, column):
        own = pickle.loads(zlib.decompress(sent.value))
        for batch in batches:
            n = batch.num_rows
            words, runs, found = [0] * n, [()] * n, [()] * n
            for row, count, spans, ids in own.hits(batch.column(column)):
                words[row], runs[row], found[row] = count, sorted(set(spans)), ids
            yield batch, words, runs, found

    return judge


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _spans(runs) -> pa.Array:
    return pa.array([[{"first": a, "end": b} for a, b in r] for r in runs], _SPANS)


def _key(text):
    """128 bits that stand for a text in joins."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def _prints(texts: DataFrame, lengths: list[int] | None, window: int, gram: int) -> DataFrame:
    """(k, l, length, print) of the texts (k, l, text): for each of the lengths, or for a text's own window."""

    def run(batches):
        for batch in batches:
            out = [[np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64)]]
            k, l = (batch.column(c).to_numpy() for c in (0, 1))
            for first, _, _, _, hashes, at in wordhash.grouped(batch.column(2), wordhash.alnum):
                counts = np.diff(at)
                texts_of = np.repeat(np.arange(len(counts)), counts)
                for length in lengths or range(1, window + 1):
                    pos, values = minima(hashes, texts_of, length, min(gram, length))
                    row = texts_of[pos]
                    if not lengths:
                        mine = np.minimum(counts[row], window) == length
                        row, values = row[mine], values[mine]
                    out.append([k[first + row], l[first + row], np.full(len(row), length, np.int32), values.view(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["k", "l", "length", "print"])

    return texts.select("k", "l", "text").mapInArrow(run, "k long, l long, length int, print long").distinct()


def _met(docs: DataFrame, items: DataFrame, text_col: str, window: int, gram: int) -> DataFrame:
    """(k, l, runs, items) of the texts with hits, by a join of fingerprints."""
    k, l = _key(F.col("text"))
    texts = only(docs, text_col).toDF("text").where("text is not null").select(k.alias("k"), l.alias("l"), "text")
    k, l = (F.xxhash64("item", "text"), F.xxhash64(F.lit(7), "item", "text"))
    tests = items.select(k.alias("k"), l.alias("l"), "item", "text")
    own = cut(_prints(tests, None, window, gram))
    lengths = sorted(r.length for r in own.select("length").distinct().collect())  # ``window`` rows at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], "k long, l long, runs array<struct<first: long, end: long>>, items array<string>")
    met = _prints(texts, lengths, window, gram).join(own.select(F.col("k").alias("ik"), F.col("l").alias("il"), "length", "print"), ["length", "print"])
    met = cut(met.select("k", "l", "ik", "il").distinct())
    pairs = met.join(tests.select(F.col("k").alias("ik"), F.col("l").alias("il"), "item", F.col("text").alias("said")), ["ik", "il"])
    pairs = pairs.join(texts.dropDuplicates(["k", "l"]), ["k", "l"])

    def run(batches):
        for batch in batches:
            spans, rows = [], []
            for row, (item, said, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item", "said", "text")), strict=True)):
                for _, _, runs, found in Index([(item, said)], window, gram).hits(pa.array([text], pa.string())):
                    if found:
                        spans.append(sorted(set(runs)))
                        rows.append(row)
            hit = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([hit.column("k"), hit.column("l"), hit.column("item"), _spans(spans)], ["k", "l", "item", "runs"])

    found = pairs.select("k", "l", "item", "said", "text").mapInArrow(run, "k long, l long, item string, runs array<struct<first: long, end: long>>")
    return found.groupBy("k", "l").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each document: id, ``n_words``, ``n_hit``, ``runs`` (array of first word and end), ``items`` (sorted)."""
    items = _items(benchmark, item_col, item_text)
    kind = only(docs, id_col).toDF("id").schema[0]
    facts = StructType.fromDDL("n_words long, n_hit long, runs array<struct<first: long, end: long>>, items array<string>").fields

    if _fits(items):
        judge = _judge(docs, items, window, gram)

        def run(batches):
            for batch, words, runs, found in judge(batches, 1):
                columns = [pa.array(words, pa.int64()), pa.array([covered(r) for r in runs], pa.int64()), _spans(runs), pa.array([sorted(i) for i in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_hit", "runs", "items"])

        return only(docs, id_col, text_col).mapInArrow(run, StructType([kind, *facts])).withColumnRenamed("id", id_col)

    def count(batches):
        for batch in batches:
            words = np.zeros(batch.num_rows, np.int64)
            for first, _, _, _, _, at in wordhash.grouped(batch.column(1), wordhash.alnum):
                words[first : first + len(at) - 1] = np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(words)], ["id", "k", "l", "n_words"])

    def sums(batches):
        for batch in batches:
            hit = [covered([(r["first"], r["end"]) for r in rs]) for rs in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "n_hit" else pa.array(hit, pa.int64()) for c in ("id", "n_words", "n_hit", "runs", "items")], ["id", "n_words", "n_hit", "runs", "items"])

    rows = only(docs, id_col, text_col).toDF("id", "text")
    k, l = _key(F.col("text"))
    rows = rows.select("id", "text", k.alias("k"), l.alias("l")).mapInArrow(count, StructType([kind, *StructType.fromDDL("k long, l long, n_words long").fields]))
    rows = rows.join(small(cut(_met(docs, items, text_col, window, gram)), 512), ["k", "l"], "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select("id", "n_words", none("runs"), none("items")).mapInArrow(sums, StructType([kind, *facts])).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has no hit."""
    items = _items(benchmark, item_col, item_text)
    if not _fits(items):
        names = unused(docs, "text_k", "text_l")
        hit = cut(_met(docs, items, text_col, window, gram).select("k", "l")).toDF(*names)
        k, l = _key(F.col(f"`{text_col}`"))
        return docs.join(small(hit, 32), (k == F.col(names[0])) & (l == F.col(names[1])), "left_anti")
    judge = _judge(docs, items, window, gram)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch, _, runs, _ in judge(batches, at):
            yield batch.filter(pa.array([not r for r in runs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
