"""Conflict-constrained best-fit packing of texts into bins of a fixed number of units (words).

Texts longer than a bin are cut into full bins, alone in theirs, and a rest. The other pieces are taken longest first. Open bins
stand in the order of their residuals; a piece goes to the tightest bin that holds it and has neither its source
nor its duplicate cluster: the search starts at the smallest sufficient residual and goes on to its successors until a
compatible bin is found, else a bin is opened. Each bin carries two bitmaps, of sources and of clusters; a packing group numbers its own sources and
clusters, so no two values share a bit, and a bitmap is as wide as the group has values.

A duplicate cluster is any column: op5 gives the component of near copies that ``ngram_jaccard`` found, and the words it counted as units; without
a column, texts that differ in case or white space only are a cluster (enough after the near copies have gone, as in the pipeline). Units may
be any counted column too, such as the number of token ids of ``token_files``.

Pieces are dealt to packing groups of about ``GROUP_ROWS`` rows by a hash of id, length, source and cluster, so a source or cluster
of a third of all rows spreads over all groups, and the groups' number follows the input. Equal rows are counted before the exchange and dealt in lots of
``LOT``. Only ids and numbers are shuffled, never texts.

Defined results: null and wordless texts have no piece and no row. Equal lengths are taken in the order of ids, numbers by value and all other
kinds as strings. Repeated rows are pieces of their own and, with one cluster, never share a bin. A null source is a source of its own, a null
cluster a cluster of its row alone. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import wordhash

CAPACITY, GROUP_ROWS, LOT = 2048, 4096, 256


def pack(pieces: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece (length, source, cluster), lengths in falling order."""
    #: residuals in order, and for each the bins that have it in the order they were opened, by their source bitmap
    order: list[int] = []
    bins: dict[int, dict[int, list[int]]] = {}
    sources: list[int] = []
    clusters: list[int] = []
    left: list[int] = []
    source_bit: dict = {}
    cluster_bit: dict = {}
    out = []
    for length, source, cluster in pieces:
        s, c = 1 << source_bit.setdefault(source, len(source_bit)), 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        found = -1
        for r in range(bisect_left(order, length), len(order)):
            best = None
            for bitmap, members in bins[order[r]].items():
                if not bitmap & s:
                    b = next((b for b in members if not clusters[b] & c), None)
                    if b is not None and (best is None or b < best):
                        best = b
            if best is not None:
                found = best
                break
        if found < 0:
            found = len(left)
            left.append(capacity)
            sources.append(0)
            clusters.append(0)
        else:
            held = bins[left[found]]
            held[sources[found]].remove(found)
            if not held[sources[found]]:
                del held[sources[found]]
                if not held:
                    del bins[left[found]]
                    order.pop(bisect_left(order, left[found]))
        out.append((found, capacity - left[found]))
        left[found] -= length
        sources[found] |= s
        clusters[found] |= c
        if left[found]:
            if left[found] not in bins:
                insort(order, left[found])
                bins[left[found]] = {}
            insort(bins[left[found]].setdefault(sources[found], []), found)
    return out


def counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, n, source, cluster): words and a hash of the words, from one pass over the texts."""

    def run(batches):
        for batch in batches:
            n, digest = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for first, _, _, _, hashes, at in wordhash.grouped(batch.column(1), wordhash.spaced):
                part = slice(first, first + len(at) - 1)
                n[part] = np.diff(at)
                # order matters: each word's hash is mixed with its place in the text
                place = (np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordhash.mix(hashes + wordhash.mix(place)), dtype=np.uint64)])
                digest[part] = total[at[1:]] - total[at[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), batch.column(2), pa.array(digest.view(np.int64))], ["id", "n", "source", "cluster"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source"))
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("n", LongType()), rows.schema["source"], StructField("cluster", LongType())]))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", units: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each piece: id, ``piece``, ``first`` (unit within the text), ``n_units``, ``bin_id``, ``bin_offset``, ``bin_fill``.
    With ``units`` (and then ``cluster``) given, ``text_col`` is not read."""
    if units is None:
        if cluster is not None:
            raise ValueError("clusters are given together with units")
        rows = counted(docs, id_col, text_col, source_col)
    else:
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), units.cast("long").alias("n"), F.col(f"`{source_col}`").cast("string").alias("source"), (F.lit(None) if cluster is None else cluster).cast("long").alias("cluster"))
    rows = rows.where("n > 0").groupBy("id", "n", "source", "cluster").agg(F.count("*").alias("copies"))
    lots = F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {LOT}"))
    rows = rows.withColumn("lot", F.explode(lots)).withColumn("copies", F.least(F.lit(LOT), F.col("copies") - F.col("lot") * LOT))
    groups = max(1, -(-docs.count() // group_rows))
    key = F.pmod(F.xxhash64(F.col("id").cast("string"), "n", "source", "cluster", "lot"), F.lit(groups))
    rows = rows.withColumn("pack_group", key).select("pack_group", "id", "n", "source", "cluster", "copies")
    kind = rows.schema["id"]
    sizes = [StructField(c, LongType()) for c in ("piece", "first", "n_units", "bin_id", "bin_offset", "bin_fill")]

    def run(table: pa.Table) -> pa.Table:
        ids, columns = table.column("id"), [table.column(c).to_pylist() for c in ("n", "source", "cluster", "copies")]
        keys = ids.to_pylist()
        if not all(k is None or isinstance(k, int | float) for k in keys):
            keys = [None if k is None else str(k) for k in keys]
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, 0 if keys[i] is None else keys[i], columns[0][i], columns[2][i] is not None, columns[2][i] or 0, columns[1][i] or ""))
        whole: list[tuple[int, int, int, int, int]] = []
        rest: list[tuple[int, int, tuple]] = []
        for i in order:
            n, source, cluster, copies = (c[i] for c in columns)
            for copy in range(copies):
                for k in range(n // capacity):
                    whole.append((i, k, capacity, len(whole), 0))
                if n % capacity:
                    own = ("row", i, copy) if cluster is None else cluster
                    rest.append((i, n // capacity, (n % capacity, source, own)))
        rest.sort(key=lambda x: -x[2][0])
        placed = [(i, piece, p[0], len(whole) + b, at) for (i, piece, p), (b, at) in zip(rest, pack([p for _, _, p in rest], capacity), strict=True)]
        row, piece, n, bin_, at = (np.array(x, np.int64) for x in zip(*(whole + placed), strict=True))
        fill = np.bincount(bin_, n).astype(np.int64)[bin_]
        values = [piece, piece * capacity, n, (table.column("pack_group")[0].as_py() << 24) + bin_, at, fill]
        return pa.Table.from_arrays([ids.take(pa.array(row)), *map(pa.array, values)], ["id", *[f.name for f in sizes]])

    out = rows.groupBy("pack_group").applyInArrow(run, StructType([kind, *sizes]))
    return out.withColumnRenamed("id", id_col)
