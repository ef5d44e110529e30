"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (an offset and a step from its name).
Shards take turns, each claiming the first free slot of its order, until the table is full; so slots are even
within one turn, and adding or removing a shard moves few slots. A row's slot is the 60-bit hash of its key
modulo the table size; the table (``SIZE`` entries, a constant) is part of the plan, so placement is one
array access without a shuffle.

Defined results: a null key has the hash of the empty string. Equal keys share a shard. Shards are known by
name: their order in the list does not matter, repeated names count once; no shard at all is an error. Columns that already
have the names of the two added ones are replaced, the key included, after the key has been read; other extra columns stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

SIZE = 65_537


def lookup_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """The index (in name order) of each slot's shard."""
    names = sorted(set(shards))
    if not names or size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("at least one shard and a prime table size are needed")
    seeds = [hashlib.md5(name.encode()).digest() for name in names]
    offset = [int.from_bytes(s[:8], "big") % size for s in seeds]
    step = [int.from_bytes(s[8:], "big") % (size - 1) + 1 for s in seeds]
    table, turn, filled = np.full(size, -1, np.int32), [0] * len(names), 0
    while True:
        for i in range(len(names)):
            while table[slot := (offset[i] + turn[i] * step[i]) % size] >= 0:
                turn[i] += 1
            table[slot] = i
            turn[i] += 1
            filled += 1
            if filled == size:
                return table


def slot_of(key, size: int = SIZE):
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def sharded(df: DataFrame, key: str, shards: list[str], size: int = SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the name of the shard of each row."""
    names = sorted(set(shards))
    table = F.split(F.lit(",".join(map(str, lookup_table(names, size).tolist()))), ",").cast("array<int>")
    slot = slot_of(F.col(f"`{key}`"), size)
    own = [c for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    (at,) = unused(df, "slot_at")
    placed = df.withColumn(at, slot)
    return placed.select(*[F.col(f"`{c}`") for c in own], F.col(at).alias(slot_col), F.element_at(F.array(*map(F.lit, names)), F.element_at(table, F.col(at) + 1) + 1).alias(shard_col))


def write_sharded(df: DataFrame, path: str, key: str, shards: list[str], size: int = SIZE) -> None:
    """Parquet folders ``shard=<name>`` under ``path``."""
    sharded(df, key, shards, size).write.partitionBy("shard").parquet(path)
