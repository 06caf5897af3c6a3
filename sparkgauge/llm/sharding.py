"""Placement by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a table of prime size: an
offset and a step, both from a hash of its name. Shards take turns, and at each turn a
shard claims the first slot of its order that is still free, so shards get equal numbers
of slots (within one) and few keys move when a shard comes or goes. The table is a
literal of ``slots`` small integers, so its size is fixed by a parameter; a row is placed
by one hash and one array lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, SHARDS = 4099, 32


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. ``slots`` must be a prime of at least len(shards)."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no smaller than the number of shards")
    offset = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    table, turn, taken = [-1] * slots, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while table[at := (offset[i] + turn[i] * step[i]) % slots] >= 0:
                turn[i] += 1
            table[at] = i
            taken += 1
            if taken == slots:
                return table


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    """The slot of a row: the first 32 bits of the MD5 of its key, modulo the table's size."""
    text = F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).cast("int")


def shard(df: DataFrame, key_cols: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (string); these replace columns of those names.

    Rows with equal keys get one shard, so repeated rows stay together; a null in a key is
    a value of its own. A hot key cannot be split by its key alone: place by more columns
    (such as a document id) to spread it. An empty table gives an empty result.
    """
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",").cast("array<int>")
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    placed = df.withColumn("slot", slot_of([F.col(k) for k in key_cols], slots))
    return placed.withColumn("shard", F.element_at(names, F.element_at(table, F.col("slot") + 1) + 1))


def write_shards(df: DataFrame, path: str, key_cols: list[str], shards: list[str], slots: int = SLOTS) -> None:
    """Write ``df`` as Parquet with one folder for each shard, without a shuffle."""
    shard(df, key_cols, shards, slots).drop("slot").write.mode("errorifexists").partitionBy("shard").parquet(path)
