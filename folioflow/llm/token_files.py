"""Token-id files: whole texts to ids, ids in ascending id order to compressed segments, and back.

A dataset is a folder in which each row is a segment: ``part`` and ``seq`` (its place), ``ids`` and ``counts``
(documents in it and their tokens) and ``blocks`` (see ``token_coder``: reset and checksummed each by itself, so a reader may
start at any segment). Spark commits the files, so an executor's loss leaves no half-written part.

``ordered`` range-partitions the texts by document id before anything is computed from them, so bounds are drawn from ids alone, each text is tokenised
once, and ids are coded where they arise, by ``token_kernel``. Parts and segments are of bounded size, only their sums are added up across parts.

Of a text, each word with the blank before it is looked up among at most ``KNOWN`` words, or those of one segment, that the library has encoded, and is else given
to the library: with a byte-level tokenizer no token crosses such a border (``by_words`` says which tokenizers that holds for; the others get whole texts).
``write_texts`` has the texts of a segment cut by ``token_kernel``, so that Python sees each piece once a segment.

Defined results: a null or empty text has only the end id. Documents with equal ids are in the order of a hash of their texts, so that an id of a third of all rows
spreads over parts; equal rows are in any order, which nothing shows. Bytes that are not UTF-8 are read as U+FFFD. Null ids come first. Ids may be of any type that Spark orders. A special token's string
within a text is what the library makes of it, or ordinary text with ``special_as_text``. Extra columns are not read. A dataset
without documents is a folder without rows.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import token_kernel
from .common import only, small, texts_of
from .token_coder import BLOCK, LANES

SEGMENT = BLOCK * LANES  #: ids of a segment, or one document more
TEXTS = 2 * SEGMENT  #: bytes of texts that ``write_texts`` makes a segment of, or one document more
KNOWN, LONG = 1 << 19, 64  #: words held by a Python process (about 200 bytes each), and bytes of the longest of them
_BORDER = re.compile(r"(?= \S)")


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) in ascending order of ids, over parts of about equal numbers of documents."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = only(docs, id_col, text_col).toDF("id", "text")
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.spark_partition_id()]
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys[:2])


def by_words(model: str) -> bool:
    """Whether the tokenizer (its JSON) encodes a text as the sum of what lies between blanks that a character other than white space follows:
    its pattern joins such a blank to that character, and a run of white space gives its last blank up to it. The same holds for the borders of ``token_kernel.cut``:
    letters, marks and a lone line feed are in parts of their own."""
    j = json.loads(model)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(rf"[\s{token_kernel.MARKS}]", t["content"]) for t in j["added_tokens"])
    pre = {k: v for k, v in (j["pre_tokenizer"] or {}).items() if k != "trim_offsets"}
    return added and pre == plain and j["model"].get("type") == "BPE" and not j["model"].get("dropout") and not any(j.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))


class _Words:
    """Encodes words (UTF-8), each by itself; what the library made of a word is held as little-endian 32-bit integers."""

    def __init__(self, model, end: bytes):
        self.model, self.end = model, end
        self.known: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > KNOWN:
            self.known = known = {w: known[w] for w in words if w in known}
        new = list(dict.fromkeys(w for w in words if w not in known))
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            coded = [e.ids for e in self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            raw = np.fromiter(itertools.chain.from_iterable(coded), "<u4").tobytes()
            ends = itertools.accumulate((4 * len(ids) for ids in coded), initial=0)
            known.update((w, raw[i:j]) for w, (i, j) in zip(part, itertools.pairwise(ends), strict=True))
        out = [known[w] for w in words]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def encoded(self, texts: list[str]) -> list[bytes]:
        cut = [_BORDER.split(t) for t in texts]
        coded = iter(self.of([w.encode() for words in cut for w in words]))
        return [b"".join([*itertools.islice(coded, len(words)), self.end]) for words in cut]


def _model(tokenizer: str, special_as_text: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = special_as_text
    return model


_kept: dict[tuple, _Words] = {}  # of this Python process, for its next task


def _words(tokenizer: str, special_as_text: bool, end_id: int) -> _Words:
    """The words of the task that this process ran before, if it was for the same tokenizer (its file is unchanged)."""
    file = os.stat(tokenizer)
    key = tokenizer, file.st_mtime_ns, file.st_size, special_as_text, end_id
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Words(_model(tokenizer, special_as_text), np.array([end_id], "<u4").tobytes())
    return _kept[key]


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """(id, ids): the whole text's ids and ``end_id`` as little-endian 32-bit integers, row by row; ``tokenizer`` is a path that executors can read."""

    def run(batches):
        model, end = _model(tokenizer, special_as_text), np.array([end_id], "<u4").tobytes()
        encoded = _Words(model, end).encoded if by_words(model.to_str()) else lambda texts: [np.array(e.ids, "<u4").tobytes() + end for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                texts = [t or "" for t in texts_of(batch.column(1)[k : k + 256])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 256], pa.array(encoded(texts), pa.binary())], ["id", "ids"])

    rows = only(docs, id_col, text_col).toDF("id", "text")
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("ids", BinaryType())]))


def write(ids: DataFrame, path: str, in_order: bool = False) -> None:
    """Write (id, ids) as a dataset; ``in_order`` says that the rows come from ``ordered``."""
    kind = ids.schema["id"].dataType

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        keys, counts, held, size = [], [], [], 0

        def segment(arrow_kind):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([keys], pa.list_(arrow_kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.binary())], ["part", "seq", "ids", "counts", "raw"])

        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(raw.as_buffer())
                keys.append(key)
                counts.append(held[-1].size // 4)
                size += counts[-1]
                if size >= SEGMENT:
                    yield segment(arrow_kind)
                    keys, counts, held, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield segment(arrow_kind)

    if not in_order:
        n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ids = ids.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
    _save(ids.mapInArrow(run, _schema(kind, counts=ArrayType(LongType()), raw=BinaryType())), path)


def _schema(kind, **more) -> StructType:
    return StructType([StructField("part", IntegerType()), StructField("seq", LongType()), StructField("ids", ArrayType(kind)), *[StructField(k, t) for k, t in more.items()]])


def _save(segments: DataFrame, path: str) -> None:
    segments.select("part", "seq", "ids", "counts", token_kernel.encode(segments.sparkSession, F.col("raw")).alias("blocks")).write.parquet(path)


def write_texts(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, special_as_text: bool = False) -> None:
    """Write the whole texts' ids as a dataset: ``write`` of the ``token_ids`` of the ``ordered`` texts, with each distinct piece of a segment's texts encoded once."""
    rows, spark = ordered(docs, id_col, text_col), docs.sparkSession
    if not by_words(Path(tokenizer).read_text("utf-8")):
        return write(token_ids(rows, tokenizer, "id", "text", end_id, special_as_text), path, in_order=True)
    kind = rows.schema["id"].dataType

    def gather(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def segment():
            ids = pa.concat_arrays([b.column(0) for b in held])
            texts = [t.fill_null(b"") for t in (b.column(1) for b in held)]
            ends = np.cumsum(np.concatenate([pc.binary_length(t).to_numpy(zero_copy_only=False) for t in texts])).astype("<i4")
            joined = b"".join(x.as_buffer() for t in texts for x in t)
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([joined], pa.binary()), pa.array([ends.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "ids", "texts", "ends"])

        for batch in batches:
            sums, at = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                before = int(sums[at - 1]) if at else 0
                to = min(int(np.searchsorted(sums, before + TEXTS - size)) + 1, batch.num_rows)
                held.append(batch.slice(at, to - at))
                size += int(sums[to - 1]) - before
                at = to
                if size >= TEXTS:
                    yield segment()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield segment()

    def run(batches):
        words = _words(tokenizer, special_as_text, end_id)
        for batch in batches:
            for i in range(batch.num_rows):
                found, codes = token_kernel.pieces(batch.column("cut")[i].as_py())
                table = [words.end, *words.of(found)]
                sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
                n = sizes[codes]
                ends = np.cumsum(n)
                # each id's place in the table
                at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n)
                at += np.arange(len(at))
                raw = np.frombuffer(b"".join(table), "<u4")[at]
                counts = np.diff(ends[codes == 0], prepend=0)
                columns = [batch.column(c)[i : i + 1] for c in ("part", "seq", "ids")]
                columns += [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64())), pa.array([raw.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "ids", "counts", "raw"])

    texts = rows.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(gather, _schema(kind, texts=BinaryType(), ends=BinaryType()))
    cut = texts.select("part", "seq", "ids", token_kernel.cut(spark, F.col("texts"), F.col("ends")).alias("cut"))
    _save(cut.mapInArrow(run, _schema(kind, counts=ArrayType(LongType()), raw=BinaryType())), path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of each document of a dataset, all from the decoded blocks."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "seq", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    totals = {r.part: r.n for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each part
    before, bases = 0, {}
    for part in sorted(totals):
        bases[part] = before
        before += totals[part]
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv]) if bases else F.lit(None).cast("map<int,bigint>")
    starts = sizes.select("part", "seq", (F.coalesce(F.sum("n").over(within), F.lit(0)) + F.element_at(base, F.col("part"))).cast("long").alias("begin"))
    kind = files.schema["ids"].dataType.elementType

    def run(batches):
        for batch in batches:
            for keys, counts, begin, coded in zip(*(batch.column(n).to_pylist() for n in ("ids", "counts", "begin")), batch.column("raw"), strict=True):
                stream, ends = memoryview(coded.as_buffer()), np.cumsum(counts)
                if 4 * ends[-1] != len(stream):
                    raise ValueError("a segment's counts do not fit its blocks")
                raw = [stream[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts, strict=True)]
                columns = [pa.array(keys, batch.schema.field("ids").type.value_type), pa.array(begin + ends - np.array(counts), pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(map(bytes, raw), pa.binary())] * with_ids, ["id", "start", "n_tokens", "ids_crc32", "token_ids"][: 4 + with_ids])

    rows = files.join(small(starts, 32), ["part", "seq"]).select("ids", "counts", "begin", token_kernel.decode(spark, F.col("blocks")).alias("raw"))
    fields = [StructField("id", kind), *[StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32")]]
    return rows.mapInArrow(run, StructType(fields + [StructField("token_ids", BinaryType())] * with_ids))
