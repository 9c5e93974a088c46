"""Sharding by a lookup table that shards fill in turns.

Every shard prefers the slots of a prime-sized table in its own order (an offset and a step from its name).
In each turn a shard claims its next free slot, until the table is full. So shares differ by one slot at most,
and adding or removing a shard moves little besides its own share. Placement is one hash and one lookup.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters of the registered query and of the pipeline.
SHARDS, TABLE_SIZE = 64, 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of the shard. ``size`` is a prime, at least the number of shards; names are distinct."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime and no smaller than the number of shards")
    turns = np.arange(size, dtype=np.int64)
    preference = np.empty((len(shards), size), dtype=np.int32)
    for k, name in enumerate(shards):
        digest = hashlib.sha256(name.encode()).digest()
        offset = int.from_bytes(digest[:8], "big") % size
        step = int.from_bytes(digest[8:16], "big") % (size - 1) + 1 if size > 2 else 1
        preference[k] = (offset + turns * step) % size
    owner = np.full(size, -1, dtype=np.int32)
    following = np.zeros(len(shards), dtype=np.int64)
    filled = 0
    while filled < size:
        for k in range(len(shards)):
            if filled == size:
                break
            at = following[k]
            while owner[preference[k, at]] >= 0:
                at += 1
            owner[preference[k, at]] = k
            following[k] = at + 1
            filled += 1
    return owner


def slot_of(keys: list[Column], size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, keys: list[str], shards: list[str] | None = None, size: int = TABLE_SIZE,
                  shard_col: str = "shard", slot_col: str | None = None) -> DataFrame:
    """``df`` with the index of each row's shard; nothing but the table moves.

    The table is broadcast: its bound is ``size`` rows, whatever the data. Rows with equal keys share a shard;
    null keys hash like any value; a column named like the new one is replaced. No rows give no rows.
    """
    names = shards if shards is not None else [f"shard-{k:05d}" for k in range(SHARDS)]
    owner = lookup_table(names, size)
    spark = df.sparkSession
    slots = spark.createDataFrame([(i, int(s)) for i, s in enumerate(owner)], "`__slot` int, `__shard` int")
    new = {shard_col, *([slot_col] if slot_col else [])}
    kept = [c for c in df.columns if c not in new]
    marked = df.withColumn("__slot", slot_of([F.col(f"`{c}`") for c in keys], size))
    placed = marked.join(F.broadcast(slots), "__slot")
    return placed.select(*[F.col(f"`{c}`") for c in kept],
                         *([F.col("__slot").alias(slot_col)] if slot_col else []), F.col("__shard").alias(shard_col))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", files_per_shard: int = 8) -> None:
    """One folder per shard with at most ``files_per_shard`` files; a large shard is salted over that many tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != shard_col]), F.lit(files_per_shard))
    (df.repartition(F.col(shard_col), salt).write.mode("overwrite").partitionBy(shard_col).parquet(path))
